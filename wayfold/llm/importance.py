"""Resampling documents towards the word distribution of a target corpus.

Features are runs of 1 to n words, hashed to buckets. Documents become rows of
a sparse document-by-bucket count matrix, persisted as CSR blocks: ids, row
starts, bucket indices and counts of up to BLOCK_ROWS documents and about
BLOCK_CELLS cells. Column sums of the blocks give both distributions, the
floored log ratios are the gains of the buckets, and the product of matrix and
gains gives the documents' weights. Scores add seeded Gumbel noise, so the
highest scores are a sample without replacement in proportion to the weights.

Null texts and texts without words have no features and weight 0. A null id
counts as an empty one in the noise and comes last among ties. Rows that repeat
an id are scored and drawn each on its own. Other columns are not looked at.
Very long texts are one matrix row of at most as many cells as there are
buckets. An empty table gives an empty result; an empty target gives weights by
the add-one terms alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, number_rows

BLOCK_ROWS, BLOCK_CELLS, CACHE_WORDS = 4096, 1 << 16, 1 << 17
#: A row of the matrix's files is a whole block. Parquet holds 100 rows before it looks at their size, and
#: Spark reads up to 4,096 rows of a row group at once, so a row group gets a fixed number of blocks.
BLOCK_FILES = {"parquet.block.row.count.limit": "8"}
#: A-Z become a-z, other ASCII but letters and digits a space; bytes of longer characters stay.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Recipe:
    longest: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10


def words_of_bytes(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(FOLDED).split()


def count_matrix(docs: DataFrame, recipe: Recipe, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """CSR blocks, written: ids, digests (of id and text), n_words, starts, indices, counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, digests array<long>, n_words array<long>, starts array<int>, indices array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, digests, n_words, rows, cells, counts = [], [], [], [], [], []

        def block() -> pa.RecordBatch:
            key = np.repeat(np.arange(len(rows), dtype=np.int64), rows) * recipe.buckets + np.array(cells, np.int64)
            cell, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, weights=np.array(counts, np.float64), minlength=len(cell)).astype(np.int32)
            starts = np.searchsorted(cell, np.arange(len(rows) + 1, dtype=np.int64) * recipe.buckets).astype(np.int32)
            columns = [ids, digests, n_words, starts, (cell % recipe.buckets).astype(np.int32), total]
            types = [f.type.value_type for f in target]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(columns, types, strict=True)], [f.name for f in target])

        for batch in batches:
            target = pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("digests", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), *((n, pa.list_(pa.int32())) for n in ("starts", "indices", "counts"))])
            for doc_id, text, digest in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = words_of_bytes(text.as_py() or "")
                found = Counter(words)
                for n in range(2, recipe.longest + 1):
                    found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
                for feature, count in found.items():
                    bucket = known.get(feature)
                    if bucket is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        bucket = known[feature] = zlib.crc32(feature) % recipe.buckets
                    cells.append(bucket)
                    counts.append(count)
                ids.append(doc_id.as_py())
                digests.append(digest.as_py())
                n_words.append(len(words))
                rows.append(len(found))
                if len(rows) >= BLOCK_ROWS or len(cells) >= BLOCK_CELLS:
                    yield block()
                    ids, digests, n_words, rows, cells, counts = [], [], [], [], [], []
        if rows:
            yield block()

    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)))
    return materialize(rows.mapInArrow(run, schema), name, BLOCK_FILES)


def column_sums(matrix: DataFrame, buckets: int) -> list[int]:
    """Features in every bucket; a task adds up its blocks, so its part is at most as long as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2))
            total += np.bincount(at, weights=counts, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains_of(corpus: list[int], target: list[int]) -> list[int]:
    """Floored thousandths of every bucket's log ratio of target to corpus, one added to each count."""
    many, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(((t + 1.0) * (all_s + many)) / ((s + 1.0) * (all_t + many)))) for s, t in zip(corpus, target, strict=True)]


def noise(seed: str, doc_id: object) -> int:
    """Thousandths of a Gumbel variate that the seed and the id fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(matrix: DataFrame, gains: list[int], recipe: Recipe) -> DataFrame:
    """(doc_id, digest, n_words, n_features, weight, score) of every matrix row."""
    field = matrix.schema["ids"].dataType.elementType.simpleString()
    vector = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, at, counts = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                row_sum = lambda cells: np.diff(np.concatenate([[0], np.cumsum(cells)])[starts])  # noqa: B023, E731
                n, total = row_sum(counts), row_sum(counts * vector[at])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0)[k].values
                score = weight + np.array([noise(recipe.seed, x) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1)[k].values, batch.column(2)[k].values, *map(pa.array, (n, weight, score))], ["doc_id", "digest", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(run, f"doc_id {field}, digest long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Scores are whole numbers of a bounded range (gains and noise are), so the
    driver reads a histogram of at most some hundred thousand rows to find the
    lowest score that is drawn; only rows at or above it are ranked.
    """
    matrix = count_matrix(docs, recipe, "csr", id_col, text_col)
    wanted = count_matrix(target, recipe, "csr-target", target_id, target_text)
    gains = gains_of(column_sums(matrix, recipe.buckets), column_sums(wanted, recipe.buckets))
    rows = materialize(scored(matrix, gains, recipe).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= recipe.least_words
    seen = sorted(((r.score, r.n) for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted_rows = recipe.percent * sum(n for _, n in seen) // 100
    cut, above = None, 0
    for score, n in seen:
        if above >= wanted_rows:
            break
        cut, above = score, above + n
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("row")
    high = fit & (F.col("score") >= cut)
    numbered = number_rows(rows.where(high), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "drawn", "number")
    ranked = numbered.withColumn("rank", F.when(F.col("number") < wanted_rows, F.col("number") + 1)).drop("number")
    return ranked.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long"))).drop("row")


def drawn_documents(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of docs with all their columns; equal rows of one id stand or fall together."""
    own = resampled.where("rank is not null").select(F.col("doc_id").alias("__drawn_id"), F.col("digest").alias("__drawn_digest")).distinct()
    return docs.join(own, F.col(id_col).eqNullSafe(F.col("__drawn_id")) & (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("__drawn_digest")), "left_semi")
