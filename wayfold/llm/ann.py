"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: each vector is padded to CODE_BITS dimensions and rotated by one random
orthogonal matrix; the signs are packed into bits. Beside them go the norm and
the correction scalar <o, x>, the inner product of the unit vector with its own
code x.

Search: a rotated unit query is rounded to QUERY_BITS bits a component and kept
as bit planes, so that <x, q> is a weighted sum of the set bits that code and
plane share: AND and population count on packed words. <x, q> / <o, x>
estimates <o, q> without bias, with an error of about sqrt((1 - <o, x>^2) /
<o, x>^2 / (bits - 1)) and that of the rounding; EPSILON of them is the error
bound. Rows whose upper bound reaches the k-th best exact score found so far
are reranked in double precision.

Rows are dealt into groups of about ROW_GROUP and queries into groups of about
QUERY_GROUP; one job meets every group of rows with every group of queries,
each pair a key of one shuffle. A task holds one group of rows and streams the
queries past it, so memory is bounded. The shuffle holds each row once for each
group of queries and each query once for each group of rows; the work, every
query against all rows, is the stated one. The k best of each pair are merged.

Vectors that are null, zero, of another length than the most frequent one, or
with null or non-finite components take no part. Rows repeating an id count
once, with the best score; of a query id's vectors the smallest is asked; a
query never finds its own id. Ties go to the smaller id. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

CODE_BITS, QUERY_BITS = 256, 4
EPSILON = 2.5
ROW_GROUP, QUERY_GROUP = 16_384, 16_384
#: Smaller tables are dealt into more groups, so that they are more than one task.
LEAST_GROUP = 2_048
ROW_BLOCK = 8_192
SEED = 5
NEIGHBOURS = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, broken) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimensions: int) -> np.ndarray:
    """Orthonormal columns that carry a vector into the code space."""
    size = max(CODE_BITS, -(-dimensions // 64) * 64)
    drawn = np.random.Generator(np.random.Philox(key=SEED)).standard_normal((size, dimensions))
    return np.linalg.qr(drawn)[0].T.astype(np.float32)


def unit_rotated(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the rotated unit vectors."""
    top = np.abs(vectors).max(axis=1)
    norm = np.linalg.norm(vectors / top[:, None], axis=1)
    return norm * top, ((vectors / top[:, None] / norm[:, None]).astype(np.float32) @ turn)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, norm, correction, code) of every usable row of the most frequent length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimensions = length.n if length else 1
    turn = rotation(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm, turned = unit_rotated(matrix, turn)
            signs = turned > 0
            correction = np.abs(turned).sum(axis=1, dtype=np.float64) / np.sqrt(turned.shape[1])
            code = np.packbits(signs, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norm), pa.array(correction), pa.array([c.tobytes() for c in code], pa.binary())],
                ["vec_id", "embedding", "norm", "correction", "code"],
            )

    same = rows.where(F.size("embedding") == dimensions)
    return same.mapInArrow(run, "vec_id long, embedding array<double>, norm double, correction double, code binary")


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(rows * query, axis=1)[:, -1]


class Rows:
    """One block of index rows, its codes as words by place."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.ids = column("vec_id").to_numpy()
        self.matrix = column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(self.ids), -1)
        code = np.frombuffer(b"".join(column("code").to_pylist()), dtype=np.uint8).reshape(len(self.ids), -1)
        self.words = np.ascontiguousarray(code.view("<u8").T)
        self.bits = code.shape[1] * 8
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int32)
        norm, correction = column("norm").to_numpy(), column("correction").to_numpy()
        self.scale = norm / correction / np.sqrt(self.bits)
        self.error = np.sqrt(np.maximum(0.0, 1 - correction**2) / (self.bits - 1)) / correction * norm


class Query:
    """A rotated unit query in bit planes: q is about low + step * number."""

    def __init__(self, turned: np.ndarray):
        levels = (1 << QUERY_BITS) - 1
        self.low = float(turned.min())
        self.step = (float(turned.max()) - self.low) / levels or 1.0
        number = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.total = int(number.sum())
        self.planes = [np.packbits(number >> j & 1).view("<u8") for j in range(QUERY_BITS)]
        self.off = self.step / np.sqrt(12.0)

    def upper(self, rows: Rows, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with the rows, and what they are at most."""
        shared = np.zeros(len(rows.ids), dtype=np.int32)
        for j, plane in enumerate(self.planes):
            for word, mask in zip(rows.words, plane, strict=True):
                if mask:
                    shared += np.bitwise_count(word & mask).astype(np.int32) << j
        # <x, q> over signs: twice the part on set bits, less the whole.
        on_set = self.low * rows.ones + self.step * shared
        guess = (2.0 * on_set - (self.low * rows.bits + self.step * self.total)) * rows.scale
        return guess, guess + epsilon * (rows.error + self.off * np.sqrt(rows.bits) * rows.scale)


def merged(found: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores), each id once; ties to the smaller id."""
    ids, scores = np.concatenate((found[0], ids)), np.concatenate((found[1], scores))
    order = np.lexsort((ids, -scores))
    _, once = np.unique(ids[order], return_index=True)
    order = order[np.sort(once)][:k]
    return ids[order], scores[order]


def nearest(blocks: list[Rows], own: int, asked: np.ndarray, turned: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of the blocks for one query."""
    query, norm = Query(turned), float(np.linalg.norm(asked))
    found = np.zeros(0, dtype=np.int64), np.zeros(0)
    for rows in blocks:
        guess, high = query.upper(rows, epsilon)
        other = rows.ids != own
        if len(found[0]) < k:  # the best guesses give a first bar
            first = np.argpartition(-np.where(other, guess, -np.inf), min(4 * k, len(guess) - 1))[: 4 * k]
            first = first[other[first]]
            found = merged(found, rows.ids[first], exact(rows.matrix[first], asked), k)
        bar = found[1][-1] / norm if len(found[0]) == k else -np.inf
        bar -= 1e-9 * max(1.0, abs(bar)) if np.isfinite(bar) else 0.0
        near = np.nonzero((high >= bar) & other)[0]
        found = merged(found, rows.ids[near], exact(rows.matrix[near], asked), k)
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query row, by inner product.

    is_query is a condition on the column vec_id.
    """
    index = materialize(build_index(vectors, id_col, vector_col), "ann-index")
    asked = index.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = index.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"), F.max(F.size("embedding")).alias("length")).first()
    row_groups = max(-(-size.rows // ROW_GROUP), min(8, -(-size.rows // LEAST_GROUP)), 1)
    query_groups = max(-(-size.queries // QUERY_GROUP), 1)
    dimensions = size.length or 1

    groups = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    kept = ("vec_id", "embedding", "norm", "correction", "code")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("norm", "double"), ("correction", "double"), ("code", "binary"))]
    # Rows that repeat an id with other vectors are dealt apart, so that a frequent id is no single task.
    rows = index.select(deal(row_groups, "vec_id", "embedding").alias("g"), groups(query_groups).alias("c"), F.lit(0).alias("asks"), *kept)
    queries = asked.select(groups(row_groups).alias("g"), deal(query_groups, "vec_id").alias("c"), F.lit(1).alias("asks"), "vec_id", "embedding", *none)
    dealt = rows.unionByName(queries).repartition(row_groups * query_groups, "g", "c").sortWithinPartitions("g", "c", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, pair, parts, blocks = rotation(dimensions), None, [], []
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                part, (g, c, asks) = batch.slice(begin, end - begin), marks[:, begin].tolist()
                if (g, c) != pair:
                    pair, parts, blocks = (g, c), [], []
                if not asks:
                    parts.append(part)
                    continue
                if parts:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    blocks += [Rows(b) for b in table.to_batches(max_chunksize=ROW_BLOCK)]
                    parts = []
                if blocks:
                    yield answers(part, turn, blocks)

    def answers(part: pa.RecordBatch, turn: np.ndarray, blocks: list[Rows]) -> pa.RecordBatch:
        own = part.column(3).to_numpy()
        asked = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        _, turned = unit_rotated(asked, turn)
        best = [nearest(blocks, *q, k, epsilon) for q in zip(own.tolist(), asked, turned, strict=True)]
        size = [len(ids) for ids, _ in best]
        columns = np.repeat(own, size), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    out = dealt.mapInArrow(run, NEIGHBOURS)
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
