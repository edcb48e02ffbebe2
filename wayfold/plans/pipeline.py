"""The ingest order end to end, and the read API over its results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.operators import admin, cells, clean, improve, offsets, quality, segments
from wayfold.scratch import materialize


class Results(NamedTuple):
    quarantined: DataFrame
    stored: DataFrame
    snaps: DataFrame
    improved: DataFrame
    moves: DataFrame
    stays: DataFrame
    s2: DataFrame
    areas: DataFrame | None
    subjects: DataFrame


def admit(points: DataFrame, received_at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, snaps, quarantined) of decoded points: validated, exact duplicates out, sanitised, stamped, images split off.

    Every row in is stored, quarantined or the duplicate of a stored one. Points
    without the columns of decoded ones count as validated.
    """
    decoded = "geometry_type" in points.columns
    valid, bad = quality.split_valid(quality.validate(points) if decoded else points.withColumn("invalid_reason", F.lit(None).cast("string")))
    stored = quality.stamp(quality.sanitize(quality.dedupe(valid)), received_at)
    return stored, snaps(stored), bad


def process(points: DataFrame, settings: Settings = Settings(), areas: DataFrame | None = None, received_at: Column | None = None) -> Results:
    """Decoded points to all analytics, in the order of ingest.

    Offsets come before cleaning; only the area indexes see grounded rows alone.
    """
    stored, _, bad = admit(points, received_at)
    stored = materialize(stored, "stored")
    images = snaps(stored)
    timed = offsets.with_time_offset(stored, width=settings.bucket_s)
    kept = clean.without_teleports(clean.stateless(timed, settings), settings)
    better = materialize(improve.improve(kept, settings), "improved")  # six readers follow
    active, idle = segments.act_split(better)
    low = better.where(clean.grounded())
    return Results(
        bad,
        stored,
        images,
        better,
        segments.plausible_moves(segments.moves(active, idle, settings), settings),
        segments.plausible_stays(segments.stays(idle, settings), settings),
        cells.s2_index(low, visit_gap_s=settings.cell_visit_s, width=settings.bucket_s),
        admin.admin_index(low, areas, settings.admin_visit_s, width=settings.bucket_s) if areas is not None else None,
        cells.subject_index(better, settings.bucket_s),
    )


def last_known(subjects: DataFrame, tracks: DataFrame, subject: str | None = None) -> DataFrame:
    """A subject's accumulator, or everyone's, beside the last point."""
    if subject is not None:
        subjects, tracks = (df.where(F.col("subject_id") == subject) for df in (subjects, tracks))
    last = tracks.groupBy("subject_id").agg(F.max_by(F.struct("event_id", "lon", "lat", "unix_s"), F.struct("unix_s", "event_id")).alias("last_track"))
    return subjects.join(last, "subject_id")


def s2_dump(found: DataFrame, subject: str, level: int, collectable: bool = False) -> DataFrame:
    """One level of a subject's cells; only coarse levels may be collected."""
    from wayfold.functions.s2 import LEVELS

    if level not in LEVELS or (collectable and level > 8):
        raise ValueError(f"level {level} is not indexed" if level not in LEVELS else "levels over 8 are streamed, not collected")
    return found.where((F.col("subject_id") == subject) & (F.col("level") == level)).orderBy("cell_key")


def areas_dump(found: DataFrame, subject: str, dataset_pattern: str) -> DataFrame:
    """A subject's areas of the last dataset that a pattern matches."""
    import re

    named = [d for d in admin.DATASETS if re.search(dataset_pattern, d, re.I)]
    if not named:
        raise ValueError("no such dataset")
    return found.where((F.col("subject_id") == subject) & (F.col("dataset") == named[-1])).orderBy("area_key")


def snaps(points: DataFrame) -> DataFrame:
    """Points with an image; none where the table has no image columns."""
    if not {"img_b64", "img_s3"} <= set(points.columns):
        return points.where("false").withColumn("snap_key", F.lit(None).cast("string"))
    return points.where(quality.is_snap(points)).withColumn("snap_key", quality.snap_key())
