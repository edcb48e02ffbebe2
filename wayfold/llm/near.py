"""Near copies by shingle similarity: SimHash links first, MinHash bands for what they cannot reach, exact Jaccard to confirm.

Shingles: words lower-cased (A-Z) and split as in simhash, runs of SHINGLE words
without repeats; a text with fewer words is one shingle, a blank one has none.
Texts of equal shingle sets collapse to one row first. Two texts are near copies
when the Jaccard similarity of their sets is MIN_SIMILARITY or more.

Every set has the SimHash fingerprint of its text's shingles. Fingerprints at up
to 3 differing bits are linked by the operator of op1; a set is compared with one
set of its own or a linked fingerprint, the hub of those, so that a group of
copies costs a pair a text. A pair at similarity 0.8 differs in some 10 bits, which
no complete segments of 64 bits reach, so the rest is found by bands.

Candidates share one of BANDS bands of ROWS minima each: a pair at similarity
0.8 is missed with probability (1 - 0.8^5)^24 = 7e-5, and less above. Every
candidate is verified on the whole sets. Only components matter, so bands of one
component are left out, and a band's bucket is first compared with one member
alone, in HUB_ROUNDS rounds with another
member each. In buckets that still hold several components and at most FEW_SETS
texts, all pairs across components are compared, so no more than half of that a
text. Larger ones are cut into blocks of BLOCK_SETS texts, and each pair of
blocks is compared as a whole, in a task of bounded size: the numbers of common shingles are products of matrices of shared
shingles, and of what is found one link a pair of components leaves the task.
Texts are then sent once for each block of their bucket, pairs never. The products
still grow with the square of a group of texts that are alike but under the
similarity, which no exact method avoids.

Only texts that share a band or a link with another are compared, so those alone
are set apart and shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import simhash
from wayfold.llm.common import free_prefix, materialize
from wayfold.llm.components import connected_components

SHINGLE, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 24, 5, 7
HUB_ROUNDS = 3
#: Texts of a bucket whose pairs are compared one by one.
FEW_SETS = 16
#: Texts of a block, and shingles that a block holds at most unless one text has more.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
#: Shared shingles multiplied at once.
COLUMNS = 4_096
#: Shingles held at once beside all minima, which keeps them in the cache.
BLOCK = 1 << 8


def shingle_set(hashes: list):
    """Sorted distinct hashes of all arrays."""
    import numpy as np

    return np.unique(np.concatenate([*hashes, np.zeros(0, dtype="<u8")]))


def shingles(text: str | None, width: int = SHINGLE):
    """Sorted distinct XXH64 of a text's shingles."""
    return shingle_set(list(simhash.shingle_hashes(text, width)))


def similarity(a, b) -> float:
    """Jaccard similarity of two sets of shingles; two empty sets are equal."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sketch(rows: DataFrame, text_col: str, own: str) -> DataFrame:
    """rows with the columns set (a hash of the shingle set), n (its size), fp (the text's SimHash) and bands, their names after own."""
    column = rows.columns.index(text_col)
    names = [*rows.columns, f"{own}set", f"{own}n", f"{own}fp", f"{own}bands"]
    schema = rows.withColumns({**dict.fromkeys(names[-4:-1], F.lit(0).cast("long")), names[-1]: F.array().cast("array<long>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        rng = np.random.Generator(np.random.Philox(key=SEED))
        turn = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        shift = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
        for batch in batches:
            keys, sizes, prints, bands = [], [], [], []
            for value in batch.column(column):
                hashes = list(simhash.shingle_hashes(value.as_py(), SHINGLE))
                found = shingle_set(hashes)
                least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
                for begin in range(0, len(found), BLOCK):
                    least = np.minimum(least, (found[begin : begin + BLOCK, None] * turn + shift).min(axis=0))
                keys.append(signed(xxhash.xxh3_64_intdigest(found.tobytes())))
                sizes.append(len(found))
                prints.append(signed(simhash.majority(hashes)))
                bands.append([signed(xxhash.xxh64_intdigest(part.tobytes(), k)) for k, part in enumerate(least.reshape(BANDS, ROWS))])
            more = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) at MIN_SIMILARITY or more. texts: (set, text) of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(64)(shingles)
        for batch in batches:
            near = [similarity(held(a.as_py()), held(b.as_py())) >= MIN_SIMILARITY for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    left, right = (texts.select(F.col("set").alias(k), F.col("text").alias(f"{k}_text")) for k in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def common_counts(sets: list):
    """Matrix of the numbers of common shingles of every two sets."""
    import numpy as np

    found, place, times = np.unique(np.concatenate([*sets, np.zeros(0, dtype="<u8")]), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # places among the shingles that more than one set has
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = times[place] > 1
    rows, columns = owner[kept], shared[place[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)))
    for begin in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        low, high = np.searchsorted(columns, [begin, begin + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[rows[low:high], columns[low:high] - begin] = 1.0
        out += part @ part.T
    return out


def links_of(keys: list[int], roots: list[int], sets: list) -> list[tuple[int, int]]:
    """Links at MIN_SIMILARITY or more between sets of different roots, one for each two roots that they join."""
    import numpy as np

    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = common_counts(sets)
    union = size[:, None] + size[None, :] - both
    near = (both >= MIN_SIMILARITY * union - 1e-9) & (np.array(roots)[:, None] != np.array(roots)[None, :])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if similarity(sets[i], sets[j]) >= MIN_SIMILARITY:
            found.setdefault(tuple(sorted((roots[i], roots[j]))), (min(keys[i], keys[j]), max(keys[i], keys[j])))
    return list(found.values())


def across_blocks(label: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between the components that share a band. label: (band, set, n, root, k, total); texts: (set, text)."""
    count = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    placed = label.withColumn("blocks", count).withColumn("own", own)
    # Every two blocks meet: a row goes to the pair of its block with each block.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "root")
    rows = pairs.join(texts, "set").select("band", "i", "j", "set", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(4 * BLOCK_SETS)(shingles)
        pair, keys, roots, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            found = links_of(keys, roots, sets) if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for *now, key, root, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if now != pair:
                    yield done()
                    pair, keys, roots, sets = now, [], [], []
                keys.append(key)
                roots.append(root)
                sets.append(held(text))
        yield done()

    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of each set and one of its own or a linked fingerprint, at most one pair a set. sets: (set, fp)."""
    first = materialize(sets.groupBy("fp").agg(F.min("set").alias("first")), "first-of-fingerprint")
    links = materialize(simhash.links(first.select("fp")), "simhash-links")
    near = links.select(F.col("u").alias("fp"), F.col("v").alias("hub")).unionByName(links.select(F.col("v").alias("fp"), F.col("u").alias("hub")))
    near = near.unionByName(first.select("fp", F.col("fp").alias("hub")))
    hub = near.groupBy("fp").agg(F.min(F.struct(F.xxhash64("hub").alias("h"), "hub"))["hub"].alias("hub"))
    pairs = sets.join(hub, "fp").join(first.select(F.col("fp").alias("hub"), "first"), "hub").where("set != first")
    return pairs.select(F.least("set", "first").alias("u"), F.greatest("set", "first").alias("v")).distinct()


def near_sets(sets: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all sets with a near copy.

    sets: (set, n, fp, bands), one row a set; texts_of gives (set, text) of the sets in its argument's column set.
    """
    filed = sets.select("set", "n", F.explode("bands").alias("band"))
    shared = filed.groupBy("band").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low != high").select("band")
    filed = materialize(filed.join(shared, "band"), "shared-bands")
    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    like = lambda x, y: F.least(x, y) >= F.lit(MIN_SIMILARITY) * F.greatest(x, y)
    tried = materialize(simhash_pairs(sets.select("set", "fp")), "simhash-pairs")
    compared = filed.select("set").unionByName(tried.select(F.col("u").alias("set"))).unionByName(tried.select(F.col("v").alias("set")))
    texts = materialize(texts_of(compared.distinct()), "compared-texts")
    edges = materialize(verified(tried, texts), "simhash-edges")
    for k in range(HUB_ROUNDS + 1):
        roots = connected_components(edges)
        label = filed.join(roots, filed["set"] == roots["node"], "left").select("band", "set", "n", F.coalesce("root", "set").alias("root"))
        mixed = label.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
        label = materialize(label.join(mixed, "band"), "mixed-bands")
        if k == HUB_ROUNDS:
            break
        filed = label.drop("root")
        hub = label.groupBy("band").agg(F.min(F.struct(F.xxhash64("set", F.lit(k)).alias("h"), "set", "n", "root")).alias("r"))
        spokes = label.join(hub, "band").where((F.col("root") != F.col("r.root")) & like(F.col("n"), F.col("r.n")))
        spokes = materialize(spokes.select(*pair(F.col("set"), F.col("r.set"))).distinct().join(tried, ["u", "v"], "left_anti"), "hub-pairs")
        tried, edges = tried.unionByName(spokes), edges.unionByName(materialize(verified(spokes, texts), "hub-edges"))
    size = label.groupBy(F.col("band").alias("b")).agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    label = materialize(label.join(size, F.col("band") == F.col("b")).drop("b"), "bands-with-size")
    few = label.where(F.col("k") <= FEW_SETS)
    a, b = few.alias("a"), few.alias("b")
    across = (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.set") < F.col("b.set")) & like(F.col("a.n"), F.col("b.n"))
    rest = a.join(b, across).select(F.col("a.set").alias("u"), F.col("b.set").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    edges = edges.unionByName(verified(materialize(rest, "cross-pairs"), texts))
    return connected_components(edges.unionByName(materialize(across_blocks(label.where(F.col("k") > FEW_SETS), texts), "cross-edges")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near copies: the one with the smallest id.

    Null ids come last; of a component's rows with one id the one of the smallest
    set and text stays, so that only rows of the same component replace each other.
    """
    own = free_prefix(docs.columns)
    rows = materialize(sketch(docs.withColumn(f"{own}row", F.monotonically_increasing_id()), text_col, own), "sketches")
    first = materialize(rows.groupBy(F.col(f"{own}set").alias("set")).agg(F.min(f"{own}row").alias(f"{own}row")), "first-rows")
    sets = rows.join(first, f"{own}row", "left_semi").select(*(F.col(f"{own}{name}").alias(name) for name in ("set", "n", "fp", "bands")))

    def texts_of(some: DataFrame) -> DataFrame:
        return rows.join(first.join(some, "set", "left_semi"), f"{own}row", "left_semi").select(F.col(f"{own}set").alias("set"), F.col(text_col).alias("text"))

    roots = near_sets(materialize(sets, "sets"), texts_of)
    member = rows.select(F.col(id_col).alias("id"), F.col(f"{own}set").alias("set"), F.xxhash64(text_col).alias("text"), F.col(f"{own}row").alias(f"{own}row"))
    member = member.join(roots.withColumnRenamed("node", "set"), "set", "left")
    order: Column = F.struct(F.col("id").isNull(), "id", "set", "text", f"{own}row")
    kept = member.groupBy(F.coalesce("root", "set")).agg(F.min(order)[f"{own}row"].alias(f"{own}row"))
    return rows.join(kept, f"{own}row", "left_semi").select(*docs.columns)
