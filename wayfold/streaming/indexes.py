"""Indexes that every push updates, and feeds of what it changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.operators import cells
from wayfold.sources import versions


def visits_of(points: DataFrame, keys: Sequence[str], visit_gap_s: int) -> DataFrame:
    return cells.visits(cells._tallied(cells.bucketed(points), keys), keys, visit_gap_s)


def update_index(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], visit_gap_s: int, batch: int, parts: int = 64) -> bool:
    """Merges visits of one push into the stored ones; a push that is replayed adds nothing."""
    return versions.upsert(spark, path, new, "subject_id", batch, lambda rows: cells.visits(rows, keys, visit_gap_s), parts)


def stored_visits(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return versions.read(spark, path, like.schema)


def feed(rows: DataFrame, path: str, batch: int) -> None:
    """What a push gave, in a folder of its own number: written again, it replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_feed(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def index_push(spark: SparkSession, folder: str, points: DataFrame, batch: int, settings: Settings = Settings(), levels: Sequence[int] = cells.s2.LEVELS) -> None:
    """Cell and subject indexes and the cell feeds after one push of points with time_offset.

    folder gets cells and subjects (visits), first_seen (cells whose first point
    is in this push) and changed (the new accumulators of every cell the push
    touches). Feeds come before the commit, under the push's number, so a push
    that fails anywhere and is replayed gives the same rows once.
    """
    keys, spots = list(cells.S2_KEYS), f"{folder}/cells"
    new = versions.materialize(cells.s2_visits(points, levels, settings.cell_visit_s), "push-cells")
    if batch > versions.manifest(spark, spots).batch:
        touched = new.select(*keys).distinct()
        known = stored_visits(spark, spots, new).join(touched, keys, "left_semi")
        feed(touched.join(known.select(*keys).distinct(), keys, "left_anti"), f"{folder}/first_seen", batch)
        feed(cells.of_visits(cells.visits(known.unionByName(new), keys, settings.cell_visit_s), keys), f"{folder}/changed", batch)
        update_index(spark, spots, new, keys, settings.cell_visit_s, batch)
    update_index(spark, f"{folder}/subjects", visits_of(points, ["subject_id"], 0), ["subject_id"], 0, batch)


def index_stream(points: DataFrame, folder: str, checkpoint: str, settings: Settings = Settings(), levels: Sequence[int] = cells.s2.LEVELS, also: Callable[[DataFrame, int], None] | None = None):
    """Keeps the indexes of a stream of points up to date; returns the running query."""

    def handle(batch: DataFrame, number: int) -> None:
        index_push(batch.sparkSession, folder, batch, number, settings, levels)
        if also:
            also(batch, number)

    return points.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
