"""Repair of conversation structure, solved once for each distinct signature.

A conversation's rows in order become one character each: the role's initial
and the fault. Equal strings have equal cheapest edits, so distinct signatures
are solved by a memoised recursion, their audits join back, and a replay over
the ordered rows applies them.

Faults of a row, the first counts: blank (nothing but separators), duplicate
(role and text of an earlier row of the conversation), truncated (the last
character that is no separator is none of . ! ?). Edits: Keep costs 0, Rerole
to user or assistant 2, Delete 3 (the only one for blank and duplicate rows),
Insert of an empty user or assistant row 2; a truncated row that stays costs 1
more. Role initials must come to `(s?(ua)+)?`; of equally cheap audits the
ASCII-least is taken. Since one letter has one outcome, ties go to the least
letter at each step.

Null ids, turns, roles and texts count as one space in keys and rows; a null id
is a conversation of its own, null turns come first and are left out of gaps.
Gaps beyond a long are given as the largest one.
Rows of one turn are taken by role, then text. Rows that repeat turn, role and
text are duplicates. A conversation without rows has zeros, an empty audit and
the hash of the empty string. Other columns are not looked at. Very long texts
need no care; of a very long conversation one task holds the signature and the
audit, a character or two a row, and its texts pass it one by one, as its hash
demands. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import number_rows

#: Signature characters by fault: as they are, truncated, to be deleted; each for initials s, u, a and any other.
PLAIN, CUT, GONE, INITIALS = "suao", "SUAO", "1234", "suao"
#: Rows whose characters are put together at once, and rows between which the recursion's memo is kept.
BLOCK, STRETCH = 4096, 128
#: The separators.
SPACES = " \t\n\x0b\x0c\r"
FORBIDDEN = 1 << 60
#: States of the repaired initials so far: nothing, after s, after a whole pair, after u.
BEGIN, SYSTEM, PAIR, USER = range(4)
AFTER_WANTED = (USER, USER, USER, PAIR)
#: Inserts in one place that can be of use.
INSERTS = 2


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, stripped of ends, repeated or given to the user, by a hash of id and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("code")).where("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


class Solver:
    """Cheapest edits of signatures."""

    def __init__(self, signature: str):
        self.signature = signature
        self.choices = bytearray((len(signature) + 1) * 4 * (INSERTS + 1))
        self.memo: dict[tuple[int, int, int], int] = {}

    def options(self, i: int, state: int, inserts: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(letter, cost, next row, next state, inserts left), letters in ASCII order."""
        kind, wanted = self.signature[i : i + 1], "a" if state == USER else "u"
        if kind:
            yield "D", 3, i + 1, state, INSERTS
        if inserts:
            yield "I", 2, i, AFTER_WANTED[state], inserts - 1
        if kind and kind not in GONE:
            extra = int(kind in CUT)
            if kind.lower() == wanted:
                yield "K", extra, i + 1, AFTER_WANTED[state], INSERTS
            elif kind.lower() == "s" and state == BEGIN:
                yield "K", extra, i + 1, SYSTEM, INSERTS
            yield "R", 2 + extra, i + 1, AFTER_WANTED[state], INSERTS

    def cheapest(self, i: int, state: int, inserts: int) -> int:
        known = self.memo.get((i, state, inserts))
        if known is not None:
            return known
        best, letter = (0, "") if i == len(self.signature) and state in (BEGIN, PAIR) else (FORBIDDEN, "")
        for name, cost, *then in self.options(i, state, inserts):
            total = cost + self.cheapest(*then)
            if total < best:
                best, letter = total, name
        self.choices[(i * 4 + state) * (INSERTS + 1) + inserts] = ord(letter) if letter else 0
        self.memo[i, state, inserts] = best
        return best

    def solve(self) -> tuple[int, str]:
        """Cost and audit. Stretches are solved from the end, so neither the recursion nor the memo grows with the signature."""
        for start in range(len(self.signature) // STRETCH * STRETCH, -1, -STRETCH):
            for state in range(4):
                self.cheapest(start, state, INSERTS)
            self.memo = {k: v for k, v in self.memo.items() if k[0] == start}
        cost, audit, at = self.memo[0, BEGIN, INSERTS], [], (0, BEGIN, INSERTS)
        while letter := chr(self.choices[(at[0] * 4 + at[1]) * (INSERTS + 1) + at[2]]).strip("\0"):
            audit.append(letter)
            at = next(then for name, _, *then in self.options(*at) if name == letter)
        return cost, "".join(audit)


def illegal_pairs(signature: str) -> int:
    plain = signature.translate(str.maketrans(CUT + GONE, PLAIN + INITIALS))
    return sum(plain[i : i + 2] not in ("su", "ua", "au") for i in range(len(plain) - 1))


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, illegal, cost, audit) of distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            costs, audits = zip(*(Solver(s).solve() for s in texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([illegal_pairs(s) for s in texts], pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "illegal", "cost", "audit"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, illegal long, cost long, audit string")


def _fault(first: Column) -> Column:
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return F.when(last == "", "blank").when(F.col("at") > first, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and at, a number that rises in each conversation's order."""
    plain = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))).withColumn("row", F.monotonically_increasing_id())
    return number_rows(plain, [F.asc(c) for c in ("conv_id", "turn", "role", "text", "row")], "turns", "at").drop("row")


def reports(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of every: gaps, faults and signature of its ordered rows.

    Characters meet in blocks first, so a conversation of any length sends one
    string a block to the task that puts its signature together.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    told = rows.select("conv_id", "turn", "role", "text", "at", digest.alias("digest"))
    again = told.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    judged = told.join(again, same, "left").withColumn("fault", _fault(F.coalesce("first", "at")))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    place = F.when((F.col("role") == "") | (initial == 0), 4).otherwise(initial)
    letters = F.when(F.col("fault") == "truncated", CUT).when(F.col("fault") == "", PLAIN).otherwise(GONE)
    signs = judged.select("conv_id", "at", "fault", F.substr(letters, place, F.lit(1)).alias("sign"))
    blocks = signs.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sign"))), lambda x: x["sign"]), "").alias("signs"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    parts = (
        blocks.unionByName(rows.where("turn is not null").select("conv_id", "turn").distinct(), allowMissingColumns=True)
        .unionByName(every.select("conv_id").distinct(), allowMissingColumns=True)
        .groupBy("conv_id")
    )
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    found = parts.agg(
        F.when(F.count("turn") == 0, 0).otherwise(F.coalesce(span.try_cast("long"), F.lit((1 << 63) - 1))).cast("long").alias("gaps"),
        *(F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "signs")))), lambda x: x["signs"]), "").alias("signature"),
    )
    return found


def audited(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Reports with illegal pairs, cost and audit."""
    found = reports(rows, every)
    return found.join(solved(found), "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits (at -1) before the rows they edit, a conversation together and in order."""
    joined = rows.select("conv_id", "at", "role", "text").unionByName(audits.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "at")


class Replay:
    """Applies one audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, BEGIN

    def wanted(self) -> str:
        role = "assistant" if self.state == USER else "user"
        self.state = AFTER_WANTED[self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self.wanted(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the rows that come out up to and with this one."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[:1] == "s" else AFTER_WANTED[self.state]
            yield letter, role, text
        elif letter == "R":
            yield letter, self.wanted(), text


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations after their edits."""
    joined = _replayed(rows, audits.select("conv_id", "audit")).select("conv_id", "at", "role", "text", "audit")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, replay, place, out, like = None, None, 0, [], None

        def put(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal place
            for edit, role, text in found:
                out.append((key, place, edit, role, text))
                place += 1

        for like in batches:
            for conv, at, role, text, audit in zip(*(like.column(k).to_pylist() for k in range(5)), strict=True):
                if at < 0:
                    if replay:
                        put(replay.inserted())
                    key, replay, place = conv, Replay(audit), 0
                else:
                    put(replay.row(role, text))
            yield _batch(out, like)
            out = []
        if replay:
            put(replay.inserted())
            yield _batch(out, like)

    def _batch(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 5
        types = [like.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    return joined.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with repaired_sha256, the hash of the repaired `role:text` rows joined by newlines."""
    names = audits.columns
    joined = _replayed(rows, audits).select(*names, "at", "role", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audits.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, replay, digest, first = None, None, hashlib.sha256(), True

        def put(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in found:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        def closed() -> pa.RecordBatch:
            put(replay.inserted())
            return pa.RecordBatch.from_arrays([*header.columns, pa.array([digest.hexdigest()], pa.string())], [*names, "repaired_sha256"])

        for batch in batches:
            done = []
            at, role, text = (batch.column(k).to_pylist() for k in range(len(names), len(names) + 3))
            for k in range(batch.num_rows):
                if at[k] < 0:
                    if replay:
                        done.append(closed())
                    header = batch.slice(k, 1).select(names)
                    replay, digest, first = Replay(header.column(names.index("audit"))[0].as_py()), hashlib.sha256(), True
                else:
                    put(replay.row(role[k], text[k]))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if replay:
            yield closed()

    return joined.mapInArrow(run, f"{schema}, repaired_sha256 string")


def repair(conversations: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Report with audit and hash for each conv_id of every (default: of the table itself), and the repaired rows."""
    rows = ordered(conversations)
    audits = audited(rows, conversations if every is None else every)
    return repaired_digests(rows, audits), repaired_rows(rows, audits)
