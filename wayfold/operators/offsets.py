"""Seconds since the subject's previous point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.config import DAY, Settings
from wayfold.operators.ordered import with_previous

ORDER = ("unix_s", "event_id")


def clamped(seconds: Column) -> Column:
    """First row 1; over a day 1; backwards 0."""
    return F.when(seconds.isNull() | (seconds > DAY), F.lit(1)).when(seconds < 0, F.lit(0)).otherwise(seconds).cast("long")


def with_time_offset(tracks: DataFrame, order: tuple[str, ...] = ORDER, width: int = Settings.bucket_s) -> DataFrame:
    """Adds time_offset; the previous row is the subject's, of whatever device."""
    seen = with_previous(tracks, ["subject_id"], order, ["unix_s"], "__prev", width=width)
    return seen.withColumn("time_offset", clamped(F.col("unix_s") - F.col("__prev.unix_s"))).drop("__prev", "__bucket")
