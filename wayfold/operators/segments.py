"""Movement cut into moves (trips) and stays, with their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.config import ACTIVITIES, Settings
from wayfold.functions import activity as A
from wayfold.functions.geo import box_area_m2, distance_m, distance_np, distance_py, simplify
from wayfold.functions.num import truncate
from wayfold.operators.clean import with_resets
from wayfold.operators.offsets import clamped
from wayfold.operators.ordered import scan_runs, with_previous, with_running_sum

ORDER = ("unix_s", "event_id")


def act_split(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rows for moves, inactive rows for stays); unknown counts as inactive."""
    active = A.is_active(F.col("activity"))
    return tracks.where(active), tracks.where(~active)


def move_breaks(gap_s: int) -> Column:
    """Whether a move ends before this row, given the struct prev of the row before."""
    step = F.col("unix_s") - F.col("prev.unix_s")
    a, b = F.col("prev.activity"), F.col("activity")
    both = A.is_human(a) & A.is_human(b)
    started = A.is_human(a) & (b == "Automotive")
    return (step > gap_s) | (step <= -1) | (~both & ~started & (F.abs(A.delta(a, b)) > 1))


def move_segments(active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Active rows with segment, counted from 1 for each subject, and prev."""
    columns = ["unix_s", "activity", "lon", "lat", "elevation"]
    seen = with_previous(active, ["subject_id"], ORDER, columns, "prev", width=settings.bucket_s)
    starts = F.when(F.col("prev").isNull() | move_breaks(settings.move_gap_s), 1).otherwise(0)
    cut = with_running_sum(seen.withColumn("starts", starts), ["subject_id"], ORDER, F.col("starts"), "segment", width=settings.bucket_s)
    return cut.drop("__bucket")


def moves(active: DataFrame, inactive: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row a move of at least two points.

    The subject's last move is open, unless an inactive row follows it by more
    than the gap. Distances are haversine metres, rounded.
    """
    rows = move_segments(active, settings)
    inner = F.col("starts") == 0
    step = F.when(inner, clamped(F.col("unix_s") - F.col("prev.unix_s")))
    metres = F.when(inner, distance_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat")))
    climb = F.when(inner & (step > 0), F.col("elevation") - F.round("prev.elevation"))
    rows = rows.select("*", step.alias("__s"), metres.alias("__m"), climb.alias("__climb"), F.when(step > 0, metres / step).alias("__calc"))
    stats = lambda c, name: [f(c).alias(f"{name}_{s}") for s, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    point = F.struct("unix_s", "event_id", "lon", "lat")
    weight = lambda a: F.sum(F.when(F.col("activity") == a, F.col("time_offset")).otherwise(0)).alias(f"w_{a.lower()}")
    out = rows.groupBy("subject_id", "segment").agg(
        F.min_by("device_id", point).alias("device_id"),
        F.count("*").alias("raw_point_count"),
        F.min("unix_s").alias("start_s"),
        F.max("unix_s").alias("end_s"),
        *stats(F.col("accuracy"), "accuracy"),
        *stats(F.round("elevation"), "elevation"),
        *stats(F.col("speed"), "speed_reported"),
        *stats(F.col("__calc"), "speed_calculated"),
        F.sum("__m").alias("metres"),
        F.min(point).alias("first"),
        F.max(point).alias("last"),
        F.coalesce(F.sum(F.when(F.col("__climb") > 0, F.col("__climb"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(F.col("__climb") < 0, -F.col("__climb"))), F.lit(0.0)).alias("loss"),
        *(weight(a) for a in ACTIVITIES),
    )
    # Which moves are open: the subject's last one, if no inactive row closed it.
    out = finished_moves(out.withColumn("__last_active", F.max("end_s").over(Window.partitionBy("subject_id"))).where("raw_point_count >= 2"))
    if inactive is not None:
        out = out.join(inactive.groupBy("subject_id").agg(F.max("unix_s").alias("__last_idle")), "subject_id", "left")
    else:
        out = out.withColumn("__last_idle", F.lit(None).cast("long"))
    ended = F.coalesce(F.col("__last_idle") - F.col("end_s") > settings.move_gap_s, F.lit(False))
    out = out.withColumn("is_open", (F.col("end_s") == F.col("__last_active")) & ~ended)
    return out.drop("__last_active", "__last_idle")


#: Quantities of moves and stays with the places to which their statistics are given.
MOVE_QUANTITIES = {"accuracy": 0, "elevation": 0, "speed_reported": 2, "speed_calculated": 2}
STAY_QUANTITIES = {"accuracy": 0, "elevation": 0}


def given(quantities: dict[str, int]) -> dict[str, Column]:
    return {f"{q}_{s}": truncate(F.col(f"{q}_{s}"), places) for q, places in quantities.items() for s in ("mean", "median", "min", "max")}


def finished_moves(sums: DataFrame) -> DataFrame:
    """Moves from what was summed up over their points, in a batch or a stream."""
    weights = [f"w_{a.lower()}" for a in ACTIVITIES]
    out = sums.withColumns(
        {
            "activity": segment_activity(F.col("speed_reported_mean")),
            "duration_s": F.col("end_s") - F.col("start_s"),
            "distance_traversed_m": F.round("metres"),
            "distance_absolute_m": F.round(distance_m(F.col("first.lon"), F.col("first.lat"), F.col("last.lon"), F.col("last.lat"))),
            "elevation_gain_m": F.floor("gain").cast("double"),
            "elevation_loss_m": F.floor("loss").cast("double"),
        }
    )
    return out.withColumns(given(MOVE_QUANTITIES)).drop("metres", "first", "last", "gain", "loss", *weights)


def segment_activity(mean_speed: Column) -> Column:
    """A move's activity from the seconds of each: the leader, unless a close second bends it."""
    rows = F.array_sort(F.array(*(F.struct((-F.col(f"w_{a.lower()}")).alias("neg"), F.lit(k).alias("k")) for k, a in enumerate(ACTIVITIES))))
    first, second = F.get(rows, 0), F.get(rows, 1)
    close = (first["k"] > 0) & (second["k"] > 0) & (second["neg"] < 0) & (-first["neg"] < -second["neg"] * 1.61)
    human = (first["k"] <= 3) & (second["k"] <= 3) & (F.abs(first["k"] - second["k"]) < 2)
    pair = F.when(human, F.least(first["k"], second["k"])).otherwise(F.greatest(first["k"], second["k"]))
    lead = F.get(F.filter(rows, lambda r: (r["k"] > 0) & (r["neg"] < 0)), 0)["k"]
    name = lambda k: F.element_at(F.array(*map(F.lit, ACTIVITIES)), k.cast("int") + 1)
    return F.when(close, name(pair)).when(lead.isNotNull(), name(lead)).otherwise(A.from_speed_max(mean_speed, 1.0, True))


def plausible_moves(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    # In whole hundredths, to which both means are cut: ten times 0.09 is under 0.9 in doubles.
    calculated, reported = (F.round(F.col(f"speed_{kind}_mean") * 100) for kind in ("calculated", "reported"))
    keep = (F.col("distance_traversed_m") >= settings.move_min_m) & ~(calculated > 10 * reported)
    return found.where(F.coalesce(keep, F.lit(False)))


def move_paths(active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Simplified paths: Douglas-Peucker, half the tolerance under 500 m."""
    rows = move_segments(active, settings)
    paths = rows.groupBy("subject_id", "segment").agg(F.array_sort(F.collect_list(F.struct("unix_s", "event_id", "lon", "lat"))).alias("points")).where(F.size("points") >= 2)
    tolerance = settings.simplify_degrees
    shape = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))

    @F.pandas_udf(shape)
    def simple(points: pd.Series) -> pd.Series:
        out = []
        for path in points:
            lon, lat = (np.array([p[c] for p in path]) for c in ("lon", "lat"))
            length = float(distance_np(lon[:-1], lat[:-1], lon[1:], lat[1:]).sum())
            out.append([{"lon": lon[i], "lat": lat[i]} for i in simplify(lon, lat, tolerance / 2 if length < 500 else tolerance)])
        return pd.Series(out)

    return paths.select("subject_id", "segment", F.size("points").alias("raw_point_count"), simple("points").alias("path"))


class StayCounter:
    """Numbers stays: broken by time or by distance from the running centroid."""

    def __init__(self, settings: Settings):
        self.settings, self.stay, self.t = settings, 0, None
        self.x = self.y = 0.0
        self.n = 0

    def add(self, t: int, lon: float, lat: float) -> int:
        s = self.settings
        if self.n and (t - self.t < -1 or t - self.t > s.stay_gap_s or distance_py(self.x / self.n, self.y / self.n, lon, lat) > s.stay_radius_m):
            self.stay, self.x, self.y, self.n = self.stay + 1, 0.0, 0.0, 0
        if self.n < s.stay_cap:
            self.x, self.y, self.n = self.x + lon, self.y + lat, self.n + 1
        self.t = t
        return self.stay


def stay_segments(inactive: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Inactive rows with run and stay. Runs are cut at silences, where every stay ends, so they are independent."""
    runs = with_resets(inactive, F.col("unix_s") - F.col("prev.unix_s") > settings.stay_gap_s, settings)
    schema = T.StructType([*inactive.schema.fields, T.StructField("run", T.LongType()), T.StructField("stay", T.LongType())])
    finish = lambda batch, found: batch.assign(run=batch["__run"], stay=found)
    return scan_runs(runs, ORDER, ("unix_s", "lon", "lat"), lambda: StayCounter(settings), StayCounter.add, finish, schema)


def stays(inactive: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a stay of at least two points; the subject's last stay is open."""
    rows = stay_segments(inactive, settings)
    stats = lambda c: [f(c).alias(f"{c}_{s}") for s, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    out = rows.groupBy("subject_id", "run", "stay").agg(
        F.min_by("device_id", F.struct(*ORDER)).alias("device_id"),
        F.count("*").alias("raw_point_count"), F.min("unix_s").alias("start_s"), F.max("unix_s").alias("end_s"), *stats("accuracy"), *stats("elevation"),
        F.struct(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n")).alias("box"),
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
    )
    last = F.max("end_s").over(Window.partitionBy("subject_id"))
    out = out.withColumn("is_open", F.col("end_s") == last)
    return finished_stays(out.where("raw_point_count >= 2"))


def finished_stays(sums: DataFrame) -> DataFrame:
    """Stays from what was summed up over their points, in a batch or a stream."""
    area = truncate(box_area_m2(F.col("box.w"), F.col("box.s"), F.col("box.e"), F.col("box.n")))
    return sums.withColumns({"duration_s": F.col("end_s") - F.col("start_s"), "area_m2": area, **given(STAY_QUANTITIES)}).drop("box")


def plausible_stays(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return found.where(F.col("duration_s") > settings.stay_min_s)



def as_tracks(found: DataFrame) -> DataFrame:
    """Moves or stays in the columns of points, at their end (stays: at their centre), for layers that hold both."""
    place = ["lon", "lat"] if "lon" in found.columns else [F.lit(None).cast("double").alias(c) for c in ("lon", "lat")]
    activity = F.col("activity") if "activity" in found.columns else F.lit("Stationary")
    return found.select("subject_id", "device_id", F.col("end_s").alias("unix_s"), *place, F.col("accuracy_mean").alias("accuracy"), activity.alias("activity"), F.col("duration_s").alias("time_offset"))
