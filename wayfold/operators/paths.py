"""Rates of how a move's path turns and crosses itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.functions.geo import bearing_deg, distance_m
from wayfold.operators.ordered import with_previous
from wayfold.operators.segments import ORDER, move_segments

SEGMENT = ["subject_id", "segment"]


def steps(active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Steps of moves: subject_id, segment, unix_s, event_id, x1, y1, x2, y2, metres, bearing."""
    rows = move_segments(active, settings).where("starts = 0")
    a, b = ("prev.lon", "prev.lat"), ("lon", "lat")
    ends = [F.col(c) for c in (*a, *b)]
    return rows.select(*SEGMENT, *ORDER, *(c.alias(n) for c, n in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)), distance_m(*ends).alias("metres"), bearing_deg(*ends).alias("bearing"))


def turning(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(subject_id, segment, metres, turned): turns between neighbouring steps, each times the length of both."""
    seen = with_previous(found, SEGMENT, ORDER, ["metres", "bearing"], "last", width=settings.bucket_s)
    turn = F.abs(F.col("last.bearing") - F.col("bearing")) * (F.col("last.metres") + F.col("metres"))
    return seen.groupBy(*SEGMENT).agg(F.sum("metres").alias("metres"), F.coalesce(F.sum(turn), F.lit(0.0)).alias("turned"))


def cell(c: str, level: Column) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")


def spread(found: DataFrame, level: Column) -> DataFrame:
    """Steps once for each cell of a level that their boxes touch."""
    rows = found.withColumn("level", level)
    for axis in "xy":
        low, high = cell(f"{axis}_low", F.col("level")), cell(f"{axis}_high", F.col("level"))
        rows = rows.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return rows


def crossings(found: DataFrame) -> DataFrame:
    """(subject_id, segment, crossed): metres of both steps of each pair that cross properly.

    A step lives in the cells of a grid about as wide as itself, four at most,
    and asks in the cells of every coarser grid that its move has steps in. Only
    pairs that share a cell meet, and a pair counts in the first cell it shares,
    so neither a long path nor a long step is compared with everything.
    """
    boxed = found.withColumns({f"{a}_{n}": f(f"{a}1", f"{a}2") for a in "xy" for n, f in (("low", F.least), ("high", F.greatest))})
    size = F.greatest(F.col("x_high") - F.col("x_low"), F.col("y_high") - F.col("y_low"))
    own = boxed.where(size > 0).withColumn("own", F.ceil(F.log2(size)).cast("int"))
    levels = own.groupBy(*SEGMENT).agg(F.collect_set("own").alias("levels"))  # a few dozen at most
    asking = own.join(levels, SEGMENT).withColumn("ask", F.explode(F.filter("levels", lambda k: k >= F.col("own")))).drop("levels")
    names = [c for c in own.columns if c not in SEGMENT]
    a = spread(asking, F.col("ask")).select(*SEGMENT, "level", "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in names))
    b = spread(own, F.col("own")).select(*SEGMENT, "level", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in names))
    met = a.join(b, [*SEGMENT, "level", "cx", "cy"])
    later = F.struct(*(f"b_{c}" for c in ORDER)) > F.struct(*(f"a_{c}" for c in ORDER))
    first = True
    for axis in "xy":
        corner = F.greatest(cell(f"a_{axis}_low", F.col("level")), cell(f"b_{axis}_low", F.col("level")))
        first = (F.col(f"c{axis}") == corner) & first
    once = ((F.col("a_own") < F.col("level")) | later) & first

    def side(p: tuple[str, str], q: tuple[str, str], r: tuple[str, str]) -> Column:
        (px, py), (qx, qy), (rx, ry) = (tuple(map(F.col, x)) for x in (p, q, r))
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    a1, a2, b1, b2 = (("a_x1", "a_y1"), ("a_x2", "a_y2"), ("b_x1", "b_y1"), ("b_x2", "b_y2"))
    cross = (side(a1, a2, b1) * side(a1, a2, b2) < 0) & (side(b1, b2, a1) * side(b1, b2, a2) < 0)
    return met.where(once & cross).groupBy(*SEGMENT).agg(F.sum(F.col("a_metres") + F.col("b_metres")).alias("crossed"))


def path_rates(active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(subject_id, segment, bearing_delta_rate, self_crossing_rate) of every move with a length."""
    found = steps(active, settings)
    both = turning(found, settings).where("metres > 0").join(crossings(found), SEGMENT, "left")
    return both.select(*SEGMENT, (F.col("turned") / F.col("metres")).alias("bearing_delta_rate"), (F.coalesce("crossed", F.lit(0.0)) / F.col("metres")).alias("self_crossing_rate"))
