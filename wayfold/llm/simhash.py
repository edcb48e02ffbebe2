"""SimHash near-duplicates found by multi-index hashing.

Fingerprint: A-Z lower-cased, words split at space and \\x09-\\x0D, shingles of
``shingle`` words with repeats; bit i is set when it is set in over half of the
shingles' XXH64 (seed 42). Texts with fewer words hash their whole word
sequence; null, empty and blank texts have fingerprint zero and link like any
other.

Search: equal fingerprints collapse to one row first, so copies cost nothing.
Fingerprints at up to 3 differing bits differ in at most one bit of one of two
32-bit segments. Each fingerprint files both segments in the table and probes
the Hamming ball of radius one around them. Of a ball only the values with a
set bit cleared are probed: of two segments one bit apart exactly one holds the
bit, so that side reaches the other. Matches are verified on all 64 bits.

Repeated rows keep a row each. Null ids get a fingerprint and a component but
never name one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import free_prefix, materialize
from wayfold.llm.components import connected_components

#: Shingles hashed at once, which bounds memory on very long texts.
BLOCK = 1 << 16
SEGMENT_BITS = 32


def shingle_hashes(text: str | None, shingle: int = 3) -> Iterator:
    """Arrays of the XXH64 of a text's shingles in their order, repeats included."""
    import numpy as np
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(shingle, len(words))
    total = len(words) - width + 1 if words else 0
    for begin in range(0, total, BLOCK):
        part = words[begin : min(total, begin + BLOCK) + width - 1]
        rows = zip(*(part[k:] for k in range(width)), strict=False)
        yield np.array([hashed(b" ".join(row), 42) for row in rows], dtype="<u8")


def majority(hashes: Iterable) -> int:
    """Unsigned 64-bit SimHash of shingle hashes, zero for none."""
    import numpy as np

    votes, total = np.zeros(64, dtype=np.int64), 0
    for found in hashes:
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(found)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            signed = [v - (1 << 64) if v >> 63 else v for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(fp: Column, k: int) -> Column:
    """Segment k with its number above it, so that one long is the whole key."""
    value = F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return value.bitwiseOR(F.lit(k << SEGMENT_BITS))


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Verified pairs (u < v) of distinct fingerprints at up to max_bits (3 at most) differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with a ball of radius one cover up to 3 differing bits")
    fp = F.col("fp")
    table = distinct.select(fp.alias("b"), F.explode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("key"))
    balls = []
    for k in (0, 1):
        at = _segment(fp, k)
        balls += [at] + [at.bitwiseAND(F.lit(~(1 << i))) for i in range(SEGMENT_BITS)]
    probes = distinct.select(fp.alias("a"), F.explode(F.array_distinct(F.array(*balls))).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = probes.join(table, (probes["key"] == table["key"]) & (F.col("a") != F.col("b")) & near)
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, component_id) of all documents, and classes (fp, root, component_id).

    component_id is the smallest id reachable over links, itself included; null
    only where no row of the component has an id.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    labels = connected_components(links(distinct, max_bits))
    member = labels.withColumnRenamed("node", "fp").join(distinct, "fp")
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = member.select("fp", "root").join(named, "root")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    classes = materialize(classes, "classes")
    return rows.join(classes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"), classes


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, null ids last.

    Of a component's rows with that id the one of the smallest fingerprint and
    text hash stays: only rows of the same component replace each other.
    """
    _, classes = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    row = free_prefix(docs.columns) + "row"
    tagged = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows-with-number")
    found = fingerprints(tagged, row, text_col, shingle).withColumnRenamed("doc_id", row)
    known = tagged.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    order = F.struct(F.col("id").isNull(), "id", "fp", "text", row)
    first = found.join(known, row).join(classes, "fp").groupBy("root").agg(F.min(order)[row].alias(row))
    return tagged.join(first, row, "left_semi").select(*docs.columns)
