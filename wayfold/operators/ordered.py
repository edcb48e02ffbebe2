"""Previous row, running folds and sliding frames over long ordered groups.

A subject can own a third of all rows, so none of these may put a whole subject
into one task. Rows are cut into buckets; windows run inside (group, bucket) and
a few small rows per bucket carry state across: the last row, the bucket's sums,
or the rows at its edges. Carry tables join on the same keys as the windows, so
the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.config import Settings

BUCKET = "__bucket"
#: True for rows that other buckets lend; they are dropped after the windows.
LENT = "__lent"


def bucketed(df: DataFrame, time: str = "unix_s", width: int = Settings.bucket_s) -> DataFrame:
    return df if BUCKET in df.columns else df.withColumn(BUCKET, F.floor(F.col(time) / width))


def bucket_width(df: DataFrame, rows: int = 2_000_000, time: str = "unix_s", widest: int = Settings.bucket_s) -> int:
    """Seconds a bucket may take so that the busiest hour of the busiest subject, all through it, gives no more rows."""
    busiest = df.groupBy("subject_id", F.floor(F.col(time) / 3_600).alias("h")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return widest if not busiest else max(3_600, min(widest, rows // busiest * 3_600))


def _carried(df: DataFrame, by: Sequence[str], per_bucket: DataFrame, *values: str) -> DataFrame:
    keys = [*by, BUCKET]
    right = per_bucket.select(*(F.col(k).alias(f"__c_{k}") for k in keys), *values)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    return df.join(right, same, "left").drop(*(f"__c_{k}" for k in keys))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], into: str = "prev", time: str = "unix_s", width: int = Settings.bucket_s) -> DataFrame:
    """Adds a struct of the previous row's columns in (by), ordered by order; null on the first row."""
    df = bucketed(df, time, width)
    row, rank = F.struct(*columns), F.struct(*order)
    last = df.groupBy(*by, BUCKET).agg(F.max_by(row, rank).alias("__last"))
    across = Window.partitionBy(*by).orderBy(BUCKET)
    last = last.withColumn("__carry", F.lag("__last").over(across))
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)
    near = df.withColumn(into, F.lag(row).over(inside))
    return _carried(near, by, last, "__carry").withColumn(into, F.coalesce(into, "__carry")).drop("__carry")


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple[str, Column]], time: str = "unix_s", width: int = Settings.bucket_s, current: bool = True) -> DataFrame:
    """Adds sums, minima or maxima over all earlier rows of (by) and, if asked for, this one.

    folds: new column to (sum, min or max; value). A sum over nothing is 0, an
    extreme is null. A column __bucket of df is taken as the bucket: buckets must
    follow one another as rows do.
    """
    names = list(folds)
    df = bucketed(df, time, width).withColumns({f"__v_{n}": value for n, (_, value) in folds.items()})
    fold = {n: getattr(F, how) for n, (how, _) in folds.items()}
    parts = df.groupBy(*by, BUCKET).agg(*(fold[n](f"__v_{n}").alias(f"__p_{n}") for n in names))
    across = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, BUCKET, *(fold[n](f"__p_{n}").over(across).alias(f"__c_{n}") for n in names))
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    near = df.withColumns({n: fold[n](f"__v_{n}").over(inside) for n in names})
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    joined = _carried(near, by, parts, *(f"__c_{n}" for n in names))
    whole = joined.withColumns({n: both[folds[n][0]](F.col(n), F.col(f"__c_{n}")) for n in names})
    return whole.drop(*(f"__c_{n}" for n in names), *(f"__v_{n}" for n in names))


def with_running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, into: str, time: str = "unix_s", width: int = Settings.bucket_s) -> DataFrame:
    """Adds the sum of value over this and all earlier rows of (by)."""
    return with_running(df, by, order, {into: ("sum", value)}, time, width)


def lent_by_time(df: DataFrame, seconds: int, time: str = "unix_s", width: int = Settings.bucket_s) -> DataFrame:
    """Rows with bucket and __lent: each in its own bucket, and lent to later ones that look back seconds to it."""
    first, last = F.floor(F.col(time) / width), F.floor((F.col(time) + seconds) / width)
    return df.withColumn(BUCKET, F.explode(F.sequence(first, last))).withColumn(LENT, F.col(BUCKET) != first)


def lent_by_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, time: str = "unix_s", width: int = Settings.bucket_s) -> DataFrame:
    """Rows with bucket and __lent: each bucket of (by) also gets so many rows from before and after it.

    Only the rows at the edges of buckets are lent, numbered through the group;
    a bucket asks for the numbers next to its own, however many buckets they
    come from.
    """
    df = bucketed(df, time, width)
    out = df.withColumn(LENT, F.lit(False))
    for count, descending in ((before, True), (after, False)):
        if not count:
            continue
        down = lambda names: [F.col(c).desc() for c in names]
        up = lambda names: [F.col(c) for c in names]
        edge = Window.partitionBy(*by, BUCKET).orderBy(*(down if descending else up)(order))
        rows = df.withColumn("__edge", F.row_number().over(edge)).where(F.col("__edge") <= count).drop("__edge")
        # Numbered away from the rows that ask: forwards for those before, backwards for those after.
        whole = Window.partitionBy(*by).orderBy(*(up if descending else down)((BUCKET, *order)))
        rows = rows.withColumn("__place", F.row_number().over(whole))
        asks = rows.groupBy(*by, BUCKET).agg(F.min("__place").alias("__first"))
        wanted = F.when(F.col("__first") > 1, F.sequence(F.greatest(F.lit(1), F.col("__first") - count), F.col("__first") - 1))
        asks = asks.select(*(F.col(k).alias(f"__b_{k}") for k in by), F.col(BUCKET).alias("__to"), F.explode(wanted).alias("__want"))
        same = F.col("__place") == F.col("__want")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
        lent = rows.join(asks, same).withColumn(BUCKET, F.col("__to")).withColumn(LENT, F.lit(True))
        out = out.unionByName(lent.select(*out.columns))
    return out


def own_rows(df: DataFrame) -> DataFrame:
    """Without the rows that were lent."""
    return df.where(~F.col(LENT)).drop(LENT, BUCKET)


def scan_runs(runs: DataFrame, order: Sequence[str], columns: Sequence[str], fresh: Callable[[], Any], step: Callable, finish: Callable[[pd.DataFrame, list], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """A sequential scan of each (subject_id, __run), for state that windows cannot express.

    Rows are dealt by run and sorted in their partition; one Python pass then
    walks the partition, with new state at each run. Batches stay small and many
    short runs cost nothing extra. step(state, *columns) gives a row's result,
    finish(batch, results) the output rows.
    """
    keys = ["subject_id", "__run"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            found = []
            for subject, number, *values in zip(*(batch[c].tolist() for c in (*keys, *columns)), strict=True):
                if (subject, number) != last:
                    last, state = (subject, number), fresh()
                found.append(step(state, *values))
            yield finish(batch, found)[schema.names]

    return runs.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
