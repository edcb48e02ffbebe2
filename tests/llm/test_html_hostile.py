"""Tables with hostile spans: time and text in proportion to the page, placement as a plain grid has it."""

import random
import re
import time

import pytest

from wayfold.llm import html_text


def wall(cells, span, rows):
    return "<table><tr>" + f"<td rowspan=0 colspan={span}>a" * cells + "<tr><td>x" * rows + "</table>"


def stairs(n):
    """Spans that end one row after another, then as many rows."""
    return "<table><tr>" + "".join(f"<td rowspan={k + 2}>a" for k in range(n)) + "<tr><td>x" * n + "</table>"


def late_column(columns, rows):
    """Wide columns, then rows whose only cell stands behind all of them."""
    return "<table><tr>" + f"<td rowspan=0>{'w' * 60}" * columns + "<tr><td>x" * rows + "</table>"


@pytest.mark.parametrize("page", [wall(40, 1000, 2_000), wall(1_000, 1000, 9_000), wall(3_000, 1, 6_000), stairs(3_000), late_column(300, 2_000), late_column(900, 6_000), "<table>" + "<tr><td rowspan=65534 colspan=1000>a<td>b" * 2_500 + "</table>"])
def test_hostile_spans(page):
    began = time.perf_counter()
    out = html_text.extract(page)
    assert time.perf_counter() - began < 5 and len(out) < 40 * len(page)
    seen, shown = re.findall("[abx]|w+", out), re.findall(">([abx]|w+)", page)
    assert seen == shown


def plain_columns(rows):
    """First column of every cell, by a grid of booleans."""
    grid, found = set(), []
    for y, row in enumerate(rows):
        x = 0
        for across, down in row:
            while (y, x) in grid:
                x += 1
            found.append(x)
            grid |= {(y + j, x + i) for j in range(down) for i in range(across)}
            x += across
    return found


def test_columns_against_a_plain_grid():
    rng = random.Random(3)
    for _ in range(400):
        rows = [[(rng.choice((1, 1, 2, 4)), rng.choice((1, 1, 2, 3, 7))) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 12))]
        table = html_text.Table()
        for row in rows:
            table.new_row()
            for across, down in row:
                table.add(["x"], {"colspan": str(across), "rowspan": str(down)})
        assert [at for row in table.rows for at, _, _ in row] == plain_columns(rows), rows


def test_columns_after_the_last_spanned_one_follow_each_other():
    page = "<table><tr>" + "<td colspan=1000 rowspan=2>a" * 2 + "<td>b<tr><td>c<td>d</table>"
    assert html_text.extract(page).split() == ["a", "a", "b", "c", "d"]


def test_ordinary_tables_stay_aligned():
    page = "<table><tr><td rowspan=3>" + "w" * 70 + "<td rowspan=3>" + "v" * 70 + "<td>1<tr><td>2<tr><td>3</table>"
    assert html_text.extract(page) == "w" * 70 + "  " + "v" * 70 + "  1\n" + " " * 144 + "2\n" + " " * 144 + "3"


@pytest.mark.parametrize(("html", "text"), [("<form><input value=typed><input type=SUBMIT value='Send it'></form>", "Send it"), ("a<input type=hidden value=no>b", "ab"), ("<input type=button hidden value=no>", ""), ("<input type=submit>", "")])
def test_labels_of_buttons(html, text):
    assert html_text.extract(html) == text
