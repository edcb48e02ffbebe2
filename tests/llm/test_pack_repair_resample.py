"""Packing, conversation repair and importance resampling against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import conversations, importance, packing

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(FILE)


def ids_of(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(docs, pieces, capacity):
    """Every id lies in one piece, every sequence is gapless and padded by nothing."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    wanted = defaultdict(list)
    for doc_id, text in docs:
        wanted[doc_id].append(ids_of(text))
    assert by_doc.keys() == wanted.keys()
    for doc_id, texts in wanted.items():
        own = by_doc[doc_id]
        assert sum(p.length for p in own) == sum(map(len, texts))
        if len(texts) > 1:
            continue
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(texts[0])) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + p.length], "<u4").tobytes())
            at += p.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, FILE)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [t for c, t in got.dtypes if c != "doc_id"] == ["bigint"] * 6
    rows = docs.select("doc_id", "text").collect()
    check_pieces(rows, got.collect(), 1024)


def test_packing_edge_cases(spark):
    rng = random.Random(3)
    rows = [(1, None, "x"), (2, "", "y"), (3, "a <|endoftext|> b", "z"), (4, "word " * 9000, ""), (5, " " * 3000 + "é日本" * 500, None), (6, "same text", ""), (6, "same text", ""), (None, "no id", "")]
    rows += [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "日本"], k=rng.randrange(1, 40))), "") for k in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string").withColumn("number", F.lit(1)).withColumn("row", F.lit(2))
    for capacity in (1024, 64):
        check_pieces([r[:2] for r in rows], packing.pack(docs, FILE, capacity).collect(), capacity)
    assert packing.pack(docs.where("false"), FILE).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_closest_sum_is_the_best(seed):
    rng = random.Random(seed)
    have = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
    target = rng.randrange(1, 90)
    sums = {0}
    for length, n in have.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    best, used = packing.closest_sum(have, target)
    assert best == max(s for s in sums if s <= target)
    assert sum(k * n for k, n in used.items()) == best and all(n <= have[k] for k, n in used.items())


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_every_rest_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 1024])
    counts = {rng.randrange(1, capacity): rng.randrange(1, 10 ** rng.randrange(1, 4)) for _ in range(rng.randrange(1, 40))}
    windows, parts = defaultdict(list), defaultdict(list)
    for origin, first, last, within, length, skip, each, sequence, offset in packing.fill_windows(counts, capacity):
        for n in range(first, last + 1):
            turn = n - first + skip
            windows[sequence + turn // each].append((offset + turn % each * length, length))
            parts[origin, n].append((within, length))
    for own in windows.values():
        own.sort()
        filled = sum(n for _, n in own)
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert filled == capacity or filled & (filled - 1) == 0
    assert Counter(origin for origin, _ in parts) == Counter(counts)
    for (origin, _), own in parts.items():
        own.sort()
        assert [w for w, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) == origin


def test_plan_does_not_grow_with_the_counts():
    small = packing.fill_windows({n: 50 + n % 7 for n in range(1, 1024)}, 1024)
    large = packing.fill_windows({n: 10**9 + n % 7 for n in range(1, 1024)}, 1024)
    assert len(large) < 4 * len(small)
    assert len(packing.fill_windows({700: 10**9}, 1024)) < 100


SPACES = " \t\n\x0b\x0c\r"
VALID = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute_audit(kinds):
    """Cheapest, then least audit by trying every sequence of edits; kinds are (initial, gone, truncated)."""
    best = None
    found: list[tuple[int, str, tuple]] = []

    def search(i, made, audit, cost, roles, inserts):
        nonlocal best
        if best is not None and cost > best:
            return
        if i == len(kinds) and VALID.match(made):
            best = cost if best is None else min(best, cost)
            found.append((cost, audit, roles))
        if inserts:
            for r in "ua":
                if re.match(r"s?(ua)*u?\Z", made + r):
                    search(i, made + r, audit + "I", cost + 2, (*roles, ("I", r)), inserts - 1)
        if i < len(kinds):
            initial, gone, truncated = kinds[i]
            search(i + 1, made, audit + "D", cost + 3, roles, 2)
            if not gone:
                if re.match(r"s?(ua)*u?\Z", made + initial):
                    search(i + 1, made + initial, audit + "K", cost + truncated, (*roles, ("K", i)), 2)
                for r in "ua":
                    if re.match(r"s?(ua)*u?\Z", made + r):
                        search(i + 1, made + r, audit + "R", cost + 2 + truncated, (*roles, (r, i)), 2)

    search(0, "", "", 0, (), 2)
    return min(found, key=lambda x: x[:2])


def brute_repair(rows, every):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    out = {}
    for conv in every:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, counts = set(), [], Counter()
        for _, _, role, text in own:
            last = text.rstrip(SPACES)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1] or "?", fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit, roles = brute_audit(kinds)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[x]}:" if e == "I" else f"{own[x][2]}:{own[x][3]}" if e == "K" else f"{full[e]}:{own[x][3]}" for e, x in roles]
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_reported(report):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in report.collect()}


def test_conversation_repair_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    report, _ = conversations.repair(conversations.damage(table), table)
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert as_reported(report) == brute_repair(damaged(rows), {r[0] for r in rows})


def test_conversation_repair_edge_cases(spark):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", None), (1, 3, "user", "x"), (1, 3, "assistant", "Yes."), (1, 3, "user", "x"), (2, 0, "", "a."), (2, -(2**63), "Ünknown", "é日."), (2, 2**63 - 1, "tool", "." * 10), (3, 1, "user", "  \x0b")]
    rows += [(c, t, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Ok.", "Ok.", "cut", "", " \t", "End! "])) for c in range(10, 90) for t in range(rng.randrange(1, 7))]
    wide = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = wide.withColumn("at", F.lit(1)).withColumn("signature", F.lit("x")).withColumn("first", F.lit(0))
    rows = [r for r in rows if r[0] != 2]  # gaps of the widest turns do not fit a long
    every = {r[0] for r in rows}
    report, _ = conversations.repair(conversations.damage(table.where("conv_id is null or conv_id <> 2")), table.where("conv_id is null or conv_id <> 2"))
    assert as_reported(report) == brute_repair(damaged(rows), every)
    wide_report, _ = conversations.repair(table.where("conv_id = 2"))
    assert [r.gaps for r in wide_report.collect()] == [2**63 - 1]
    plain, repaired = conversations.repair(table)
    kept = defaultdict(list)
    for r in repaired.orderBy("conv_id", "place").collect():
        kept[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.edit in "KRI"
    for r in plain.collect():
        assert hashlib.sha256("\n".join(kept[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        assert VALID.match("".join(x[0] for x in kept[r.conv_id]))
    empty, none = conversations.repair(table.where("false"))
    assert empty.count() == none.count() == 0
    gone, _ = conversations.repair(table.where("false"), table.where("conv_id = 1"))
    assert as_reported(gone) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_solver_on_every_short_signature_and_a_long_one():
    shapes = {"s": ("s", 0, 0), "u": ("u", 0, 0), "a": ("a", 0, 0), "o": ("?", 0, 0), "U": ("u", 0, 1), "O": ("?", 0, 1), "2": ("u", 1, 0)}
    for n in range(5):
        for signature in itertools.product(shapes, repeat=n):
            cost, audit, _ = brute_audit([shapes[c] for c in signature])
            assert conversations.Solver("".join(signature)).solve() == (cost, audit), signature
    cost, audit = conversations.Solver("s" + "ua" * 50_000 + "u").solve()
    assert (cost, audit) == (2, "K" * 100_002 + "I")


def plain_resample(docs, benchmark, recipe):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, recipe.longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % recipe.buckets
    found = [(doc_id, *features(text)) for doc_id, text in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in benchmark for f in features(text)[1])
    many_s, many_t, b = sum(s.values()), sum(t.values()), recipe.buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (many_s + b) / ((s[k] + 1) * (many_t + b))))
    rows = []
    for doc_id, words, fs in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= recipe.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: recipe.percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("recipe", [importance.Recipe(), importance.Recipe(longest=3, buckets=64, seed="x", least_words=1, percent=50)])
def test_resampling_of_the_table(spark, recipe):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = importance.resample(docs, benchmark, recipe)
    names = ("doc_id", "n_features", "weight", "score", "rank")
    wanted = plain_resample(docs.select("doc_id", "text").collect(), [r.text for r in benchmark.collect()], recipe)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == wanted
    drawn = sorted(r[0] for r in wanted if r[4])
    assert drawn and sorted(r.doc_id for r in importance.drawn_documents(docs, got).collect()) == drawn


def test_resampling_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "!? \x00"), (None, "null id " * 30), (4, "Ärger ÄRGER ärger Straße " * 9), (5, "word " * 5000), (5, "word " * 5000), (6, "ten " * 19)]
    rows += [(k, f"alpha beta {k % 7} " * 10) for k in range(20, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("number", F.lit(0)).withColumn("row", F.lit(0))
    benchmark = spark.createDataFrame([(1, "alpha 3 beta"), (2, None)], "item_id long, text string")
    recipe = importance.Recipe(percent=50)
    names = ("doc_id", "n_features", "weight", "score", "rank")
    got = importance.resample(docs, benchmark, recipe)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == plain_resample(rows, ["alpha 3 beta", None], recipe)
    assert importance.resample(docs.where("false"), benchmark).count() == 0
    assert importance.resample(docs, benchmark.where("false")).count() == len(rows)
    assert importance.resample(docs.where("doc_id < 3"), benchmark).where("rank is not null").count() == 0


def test_matrix_blocks_are_bounded_and_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    recipe = importance.Recipe(longest=2, buckets=500)
    blocks = importance.count_matrix(docs, recipe, "csr-test").collect()
    assert sum(len(b.ids) for b in blocks) == docs.count()
    for b in blocks:
        assert len(b.ids) <= importance.BLOCK_ROWS and len(b.starts) == len(b.ids) + 1 and b.starts[-1] == len(b.indices) == len(b.counts)
        for k in range(len(b.ids)):
            own = b.indices[b.starts[k] : b.starts[k + 1]]
            assert own == sorted(set(own))


def test_matrix_row_groups_are_bounded(spark):
    import pyarrow.parquet as pq

    # One partition of many blocks: readers take a row group at once, so none may hold them all.
    words = " ".join(f"w{x}" for x in range(3_000))
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(words), F.lit(" v"), "id").alias("text"))
    matrix = importance.count_matrix(docs, importance.Recipe(), "csr-groups")
    cells = sum(r.n for r in matrix.select(F.size("indices").alias("n")).collect())
    groups = []
    for file in matrix.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        at = next(k for k in range(meta.num_columns) if meta.schema.column(k).path.startswith("indices"))
        groups += [meta.row_group(g).column(at).num_values for g in range(meta.num_row_groups)]
    assert sum(groups) == cells > 1 << 22 and max(groups) <= 1 << 21
