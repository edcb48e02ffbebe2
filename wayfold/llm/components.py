"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, so a hub never has its
neighbours gathered in one task: minima combine before the shuffle and the
joins split skewed keys. Rounds are written to the shared scratch folder, which
cuts lineage; the edge set is stable after O(log^2) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected edges of comparable ids -> (node, root), root the smallest id of each component.

    Self-loops and repeated edges are harmless, null ends are ignored, no edges give no rows.
    """
    now = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    before, seen = None, _signature(now)
    while seen[0] and seen != before:
        before = seen
        now = materialize(_small_star(_large_star(now)), "stars")
        seen = _signature(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
