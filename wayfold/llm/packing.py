"""Packing documents into token sequences of one length with minimum bin slack.

A document's ids and an end id are cut into whole windows, which are sequences
of their own, and a rest shorter than a window. Rests are packed by their
lengths alone: the driver holds how many there are of each length, at most one
count per length, and fills window after window. It takes the longest rest
left, and subset sums over the others' lengths, as bits of one integer, give the
multiset that comes closest to the capacity; its counts are read back from the
bits before each bundle. A filling is repeated as often as the counts permit,
so the steps do not grow with the number of documents. Where no multiset fills
a window, the gap is cut from one more rest and the remainder goes back among
the lengths; what is left in the end, less than a window, becomes sequences of
powers of two, which take no padding.

The plan says for each length which of its rests, numbered over the whole
table, go to which sequence and offset; a join by length and number applies it.

Null and empty texts are the end id alone. Rows that repeat an id are packed
each on its own. Other columns are not looked at. A very long text gives its
windows in one row. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bpe import PATTERN, byte_alphabet
from wayfold.llm.common import materialize, number_rows

CAPACITY, END = 1024, 0
PLAN = "rest_length int, first long, last long, within int, length int, skip long, each int, sequence long, offset int"


def id_encoder(spec: bytes) -> Callable[[str], list[int]]:
    """Text to ids as the tokenizers library gives them, special strings included.

    Where merges are in the order of their ids, which they are in byte-level
    files, the same ids come from the faster of the two libraries; texts that
    it refuses go to the other.
    """
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(spec.decode("utf-8"))
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    plain.no_padding()
    plain.no_truncation()
    data, back = json.loads(spec), byte_alphabet()
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    raw = {bytes(back[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    joined = [raw[b"".join(bytes(back[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))] for m in data["model"]["merges"]]
    if joined != sorted(joined) or sorted(raw.values()) != list(range(len(raw))) or max(raw[bytes([b])] for b in range(256)) > min(joined, default=256):
        return slow
    quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=raw, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return quick.encode(text, allowed_special="all") if any(s in text for s in special) else quick.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the library's own panics are no Exception
            return slow(text)

    return encode


def closest_sum(have: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to target of at most have[length] of each length, and one multiset that gives it."""
    reach, mask, bundles = 1, (1 << target + 1) - 1, []
    for length in sorted(have, reverse=True):
        left, size = min(have[length], target // length), 1
        while left:
            take = min(size, left)
            bundles.append((length, take, reach))
            reach |= reach << take * length & mask
            left, size = left - take, size * 2
        if reach >> target:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(bundles):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return best, used


def fill_windows(counts: dict[int, int], capacity: int) -> list[tuple]:
    """The plan's rows for so many rests of each length; rests are numbered by length, then within it."""
    have, runs, rows, sequence, first = {}, {}, [], 0, 0
    for length in sorted(counts):
        have[length] = counts[length]
        runs[length] = [(length, first, counts[length], 0)]
        first += counts[length]

    def place(length: int, each: int, times: int, offset: int, cut: int = 0) -> None:
        """Puts so many rests of a length, or a piece cut from each, into the next windows."""
        left, skip, whole = each * times, 0, runs[length]
        have[length] -= left
        while left:
            origin, start, n, within = whole.pop()
            take = min(n, left)
            if n > take:
                whole.append((origin, start + take, n - take, within))
            rows.append((origin, start, start + take - 1, within, cut or length, skip, each, sequence, offset))
            if cut:
                runs.setdefault(length - cut, []).append((origin, start, take, within + cut))
                have[length - cut] = have.get(length - cut, 0) + take
            left, skip = left - take, skip + take
        if not have[length]:
            del have[length]

    left = sum(length * n for length, n in have.items())
    while left >= capacity:
        longest = max(have)
        others = have | {longest: have[longest] - 1}
        total, need = closest_sum({k: n for k, n in others.items() if n}, capacity - longest)
        need[longest] = need.get(longest, 0) + 1
        gap = capacity - longest - total
        cut = max(k for k, n in have.items() if n > need.get(k, 0)) if gap else None
        times = min(have[k] // (n + (k == cut)) for k, n in (need | {cut: need.get(cut, 0)} if gap else need).items())
        offset = 0
        for length in sorted(need, reverse=True):
            place(length, need[length], times, offset)
            offset += need[length] * length
        if gap:
            place(cut, 1, times, offset, gap)
        sequence, left = sequence + times, left - times * capacity
    size, used = 1 << max(left.bit_length() - 1, 0), 0
    while left:
        longest = max(have)
        piece = min(longest, size - used)
        place(longest, 1, 1, used, piece if piece < longest else 0)
        used, left = used + piece, left - piece
        if used == size:
            sequence, used, size = sequence + 1, 0, 1 << max(left.bit_length() - 1, 0)
    return rows


def tokenized(docs: DataFrame, tokenizer_file: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Written rows: doc_id, doc_tokens, crcs of the whole windows, rest (ids as little-endian unsigned 32-bit integers), row."""
    with open(tokenizer_file, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(spec.value)
        for batch in batches:
            tokens, crcs, rests = [], [], []
            for value in batch.column(1):
                ids = encode(value.as_py() or "")
                ids.append(END)
                data = np.array(ids, "<u4").tobytes()
                whole = len(ids) // capacity * capacity
                tokens.append(len(ids))
                crcs.append([zlib.crc32(data[4 * k : 4 * (k + capacity)]) for k in range(0, whole, capacity)])
                rests.append(data[4 * whole :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], ["doc_id", "doc_tokens", "crcs", "rest"])

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, doc_tokens long, crcs array<long>, rest binary")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Sequences of one whole window have odd ids, packed ones even ids.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer_file, capacity, id_col, text_col)
    windows = rows.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    length = (F.octet_length("rest") / 4).cast("int")
    rests = rows.where(F.octet_length("rest") > 0).select("doc_id", "doc_tokens", "rest", "row", length.alias("rest_length"))
    counts = {r.rest_length: r.n for r in rests.groupBy("rest_length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(fill_windows(counts, capacity), PLAN)
    numbered = number_rows(rests, [F.asc("rest_length"), F.asc("row")], "rests", "number")
    placed = numbered.join(F.broadcast(plan), "rest_length").where("number between first and last")
    turn = F.col("number") - F.col("first") + F.col("skip")
    pieces = placed.select(
        "doc_id", (F.col("doc_tokens") - F.col("rest_length") + F.col("within")).alias("start"), F.col("length").cast("long").alias("length"),
        F.crc32(F.expr("substring(rest, 4 * within + 1, 4 * length)")).alias("ids_crc32"), "doc_tokens",
        ((F.expr("(number - first + skip) div each") + F.col("sequence")) * 2).alias("sequence_id"),
        (F.col("offset") + (turn % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
    return windows.unionByName(pieces)
