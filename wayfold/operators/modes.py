"""Activity weights over sliding windows, exponential averages and meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.config import TALLY_ORDER, Settings
from wayfold.functions.activity import code
from wayfold.functions.num import ewma_alpha
from wayfold.operators.ordered import BUCKET, lent_by_time, own_rows, with_previous, with_running_sum

ORDER = ("unix_s", "event_id")


def with_modes(tracks: DataFrame, interval_s: int, weight: str = "time_offset", width: int = Settings.bucket_s) -> DataFrame:
    """Adds am_<activity>, the weight of each activity in the last interval_s seconds.

    Windows hold one subject's time bucket, with the rows that the bucket before
    lends for its first interval.
    """
    w = Window.partitionBy("subject_id", BUCKET).orderBy("unix_s").rangeBetween(-interval_s, 0)
    name = F.when(F.col("activity") == "", F.lit("Unknown")).otherwise(F.col("activity"))
    rows = lent_by_time(tracks, interval_s, width=width)
    return own_rows(rows.select("*", *(F.sum(F.when(name == a, F.col(weight)).otherwise(0)).over(w).alias(f"am_{a.lower()}") for a in TALLY_ORDER)))


def with_sliding_sums(tracks: DataFrame, interval_s: int, width: int = Settings.bucket_s) -> DataFrame:
    """Adds sums over the last interval_s seconds: metres by reported speed, changes of speed and turns of heading.

    tracks has time_offset. Unknown speeds and headings (negative or null) count
    as none; turns are at most half a circle.
    """
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    seen = with_previous(tracks, ["subject_id"], ORDER, ["speed", "heading"], "__p", width=width).drop(BUCKET)
    turn = F.abs(known("heading") - F.when(F.col("__p.heading") >= 0, F.col("__p.heading")))
    rows = seen.withColumns({
        "__metres": F.coalesce(known("speed"), F.lit(0.0)) * F.col("time_offset"),
        "__change": F.coalesce(known("speed") - F.when(F.col("__p.speed") >= 0, F.col("__p.speed")), F.lit(0.0)),
        "__turn": F.coalesce(F.least(turn, 360 - turn), F.lit(0.0)),
    })
    w = Window.partitionBy("subject_id", BUCKET).orderBy("unix_s").rangeBetween(-interval_s, 0)
    summed = lent_by_time(rows, interval_s, width=width).select("*", *(F.sum(f"__{n}").over(w).alias(f"sum_{n}") for n in ("metres", "change", "turn")))
    return own_rows(summed).drop("__p", "__metres", "__change", "__turn")


def ranked_modes(prefix: str = "am_") -> Column:
    """Array of (weight, activity), heaviest first, ties to the smaller code."""
    rows = F.array(*(F.struct((-F.col(f"{prefix}{a.lower()}")).alias("neg"), code(F.lit(a)).alias("code"), F.lit(a).alias("activity")) for a in TALLY_ORDER))
    return F.transform(F.array_sort(rows), lambda r: F.struct((-r["neg"]).alias("weight"), r["activity"].alias("activity")))


def ewma(tracks: DataFrame, value: Column, minutes: float = 1.0, by: str = "subject_id", width: int = Settings.bucket_s) -> DataFrame:
    """(by, rate): the exponential average of value over each subject's points in time order.

    The first value sets the rate. In closed form it is a weighted sum, a row's
    weight following from its number counted from the end, so that nothing is
    gathered: numbers come from running counts over time buckets.
    """
    alpha = ewma_alpha(minutes)
    rows = with_running_sum(tracks.select(by, *ORDER, value.cast("double").alias("__x")).where("__x is not null"), [by], ORDER, F.lit(1), "__n", width=width)
    size = rows.groupBy(F.col(by).alias("__by")).agg(F.max("__n").alias("__size"))
    left = F.pow(F.lit(1.0 - alpha), F.col("__size") - F.col("__n"))
    weighed = rows.join(size, F.col(by).eqNullSafe(F.col("__by")))
    rate = F.sum(F.col("__x") * left * F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(F.lit(alpha)))
    return weighed.groupBy(by).agg(rate.alias("rate"))


def meters(tracks: DataFrame, until_s: Column, by: Sequence[str] = ("subject_id",), tick_s: int = 5, minutes: Sequence[int] = (1, 5, 15)) -> DataFrame:
    """Rows a second by key: count, mean rate since the first tick, and exponential averages of the rate at until_s.

    The clock ticks every tick_s; the first tick that has rows sets the rates,
    ticks without rows let them decay. Each average is a weighted sum over the
    ticks with rows, so that no order and no list of ticks is needed.
    """
    ticks = tracks.groupBy(*by, F.floor(F.col("unix_s") / tick_s).alias("__tick")).agg(F.count("*").alias("__n"))
    first = ticks.groupBy(*(F.col(k).alias(f"__f_{k}") for k in by)).agg(F.min("__tick").alias("__first"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__f_{k}"))
    rows = ticks.join(first, same).withColumn("__end", F.floor(until_s / tick_s)).where("__tick <= __end")

    def average(m: int) -> Column:
        alpha = ewma_alpha(m, tick_s)
        own = F.when(F.col("__tick") == F.col("__first"), F.lit(1.0)).otherwise(F.lit(alpha))
        return F.sum(F.col("__n") / tick_s * own * F.pow(F.lit(1.0 - alpha), F.col("__end") - F.col("__tick"))).alias(f"rate_{m}m")

    mean = F.sum("__n") / ((F.max("__end") - F.min("__first") + 1) * tick_s)
    return rows.groupBy(*by).agg(F.sum("__n").alias("count"), mean.alias("mean_rate"), *(average(m) for m in minutes))
