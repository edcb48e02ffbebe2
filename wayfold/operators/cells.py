"""Mergeable accumulators by cell, area or subject.

Rows first collapse into runs: a subject's consecutive rows in one finest cell.
Only runs, with their counts, tallies and inner gaps, are copied to the levels
and merged there. Consecutive rows of a run are consecutive in every coarser
cell too, so visits stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.config import TALLY_ORDER, Settings
from wayfold.functions import s2
from wayfold.operators.ordered import BUCKET, bucketed, with_running, with_running_sum

AM = tuple(f"am_{a.lower()}" for a in TALLY_ORDER)
SUMS = ("count", "total_offset_s", *AM)


def dominant() -> Column:
    """The activity with the largest tally; ties to the earlier, all zero to Unknown."""
    best = F.greatest(*AM)
    out = F.lit("Unknown")
    for a in reversed(TALLY_ORDER):
        out = F.when((F.col(f"am_{a.lower()}") == best) & (best > 0), F.lit(a)).otherwise(out)
    return out


def _tallied(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows as runs of one point."""
    # A stored total stands for the time of all that it was made of.
    known = ["total_time_offset"] if "total_time_offset" in tracks.columns else []
    offset = F.coalesce(*(F.col(c) for c in (*known, "time_offset")), F.lit(1)).cast("long")
    name = F.when(F.col("activity") == "", F.lit("Unknown")).otherwise(F.col("activity"))
    return tracks.select(
        *keys, BUCKET, F.col("unix_s").alias("first_s"), F.col("unix_s").alias("last_s"), F.lit(1).cast("long").alias("count"), F.lit(0).cast("long").alias("__gaps"), offset.alias("total_offset_s"),
        *(F.when(name == a, offset).otherwise(F.lit(0)).alias(c) for a, c in zip(TALLY_ORDER, AM, strict=True)),
    )


def runs(tracks: DataFrame, cell: Column, visit_gap_s: int, order: Sequence[str] = ("unix_s", "event_id"), width: int = Settings.bucket_s) -> DataFrame:
    """Runs (subject_id, cell, first_s, last_s, count, __gaps, tallies) of a subject's consecutive rows in one cell.

    A run ends at its time bucket at the latest. One shuffle by subject and bucket.
    """
    rows = bucketed(tracks.withColumn("__cell", cell), width=width)
    rows = _tallied(rows, ["subject_id", "__cell", *(c for c in order if c != "unix_s")])
    time = [F.col("first_s") if c == "unix_s" else F.col(c) for c in order]
    near = Window.partitionBy("subject_id", BUCKET).orderBy(*time)
    new = ~F.col("__cell").eqNullSafe(F.lag("__cell").over(near)) | F.lag("first_s").over(near).isNull()
    gap = F.coalesce((F.col("first_s") - F.lag("first_s").over(near) > visit_gap_s).cast("long"), F.lit(0))
    marked = rows.withColumn("__new", new.cast("int")).withColumn("__gaps", gap)
    marked = marked.withColumn("__run", F.sum("__new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("subject_id", BUCKET, "__run").agg(
        F.first("__cell").alias("__cell"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"),
        F.coalesce(F.sum(F.when(F.col("__new") == 0, F.col("__gaps"))), F.lit(0)).alias("__gaps"), *(F.sum(c).alias(c) for c in SUMS),
    ).drop("__run")


def in_buckets(parts: DataFrame, keys: Sequence[str], visit_gap_s: int) -> DataFrame:
    """Sums of keys and time buckets from runs, with the gaps inside the bucket."""
    near = Window.partitionBy(*keys, BUCKET).orderBy("first_s", "last_s").rowsBetween(Window.unboundedPreceding, -1)
    gaps = parts.withColumn("__new", (F.col("first_s") - F.max("last_s").over(near) > visit_gap_s).cast("long"))
    return gaps.groupBy(*keys, BUCKET).agg(
        (F.sum("__gaps") + F.coalesce(F.sum("__new"), F.lit(0))).alias("__gaps"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), *(F.sum(c).alias(c) for c in SUMS)
    )


def merged(parts: DataFrame, keys: Sequence[str], visit_gap_s: int) -> DataFrame:
    """Accumulators of keys from runs.

    A visit begins where a point comes more than visit_gap_s after all earlier
    ones. Visits are counted inside time buckets and then across them, so a key
    with very many runs is many tasks.
    """
    each = in_buckets(parts, keys, visit_gap_s)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    each = each.withColumn("__gaps", F.col("__gaps") + F.coalesce((F.col("first_s") - F.lag("last_s").over(across) > visit_gap_s).cast("int"), F.lit(0)))
    whole = each.groupBy(*keys).agg(
        F.sum("count").alias("count"), (F.sum("__gaps") + 1).alias("visit_count"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), *(F.sum(c).alias(c) for c in SUMS[1:])
    )
    return whole.withColumn("activity_mode", dominant())


def accumulate(tracks: DataFrame, keys: Sequence[str], visit_gap_s: int, width: int = Settings.bucket_s) -> DataFrame:
    """Count, visits, first and last time, dwell and dwell by activity for each key."""
    return merged(_tallied(bucketed(tracks, width=width), keys), keys, visit_gap_s)


def merge(stored: DataFrame, batch: DataFrame, keys: Sequence[str], visit_gap_s: int) -> DataFrame:
    """Accumulators of two disjoint pieces of time, merged; the stored one is the earlier or the later."""
    fields = ["count", "visit_count", "first_s", "last_s", "total_offset_s", *AM]
    old = stored.select(*keys, F.struct(*fields).alias("old"))
    new = batch.select(*keys, F.struct(*fields).alias("new"))
    both = old.join(new, list(keys), "full_outer")
    add = lambda c: F.coalesce(F.col(f"old.{c}"), F.lit(0)) + F.coalesce(F.col(f"new.{c}"), F.lit(0))
    apart = (F.col("new.first_s") - F.col("old.last_s") > visit_gap_s) | (F.col("old.first_s") - F.col("new.last_s") > visit_gap_s)
    joined = F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & ~apart, 1).otherwise(0)
    out = both.select(
        *keys, add("count").alias("count"), (add("visit_count") - joined).alias("visit_count"),
        F.least("old.first_s", "new.first_s").alias("first_s"), F.greatest("old.last_s", "new.last_s").alias("last_s"),
        add("total_offset_s").alias("total_offset_s"), *(add(c).alias(c) for c in AM),
    )
    return out.withColumn("activity_mode", dominant())


def visits(parts: DataFrame, keys: Sequence[str], visit_gap_s: int, width: int = Settings.bucket_s) -> DataFrame:
    """One row a visit: keys, first_s, last_s, count and tallies, from runs, points or visits.

    Rows of a key that are at most visit_gap_s apart are one visit. Visits are
    closed under this: those of any batches, overlapping ones too, unite to
    those of all their points, so they are what an index is stored as.
    """
    rows = parts.drop("__gaps", BUCKET).withColumn(BUCKET, F.floor(F.col("first_s") / width))
    order = ("first_s", "last_s", "count")
    seen = with_running(rows, keys, order, {"__seen": ("max", F.col("last_s"))}, "first_s", width, current=False)
    new = (F.col("__seen").isNull() | (F.col("first_s") - F.col("__seen") > visit_gap_s)).cast("long")
    numbered = with_running_sum(seen.withColumn("__new", new), keys, order, F.col("__new"), "__visit", "first_s", width)
    return numbered.groupBy(*keys, "__visit").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), *(F.sum(c).cast("long").alias(c) for c in SUMS)).drop("__visit")


def of_visits(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accumulators of keys from all their visits."""
    whole = stored.groupBy(*keys).agg(F.sum("count").alias("count"), F.count("*").alias("visit_count"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), *(F.sum(c).alias(c) for c in SUMS[1:]))
    return whole.withColumn("activity_mode", dominant())


S2_KEYS = ("subject_id", "level", "cell_key")


def s2_visits(tracks: DataFrame, levels: Sequence[int] = s2.LEVELS, visit_gap_s: int = Settings.cell_visit_s, width: int = Settings.bucket_s) -> DataFrame:
    """Visits of every cell of every level; rows are tallied by point, as runs hide the gaps that a later batch may fill."""
    at = F.array(*(F.struct(F.lit(k).alias("level"), s2.token(s2.parent(F.col("__leaf"), k)).alias("cell_key")) for k in levels))
    leaf = tracks.withColumn("__leaf", s2.leaf_id("lat", "lon")).where("__leaf is not null")
    points = _tallied(bucketed(leaf.withColumn("__at", F.explode(at)).select("*", "__at.*"), width=width), S2_KEYS)
    return visits(points, S2_KEYS, visit_gap_s, width)


def with_s2(tracks: DataFrame, levels: Sequence[int] = s2.LEVELS) -> DataFrame:
    """One row per level with level and cell_id; points without a place drop out."""
    leaf = tracks.withColumn("__leaf", s2.leaf_id("lat", "lon")).where("__leaf is not null")
    at = F.array(*(F.struct(F.lit(k).alias("level"), s2.parent(F.col("__leaf"), k).alias("cell_id")) for k in levels))
    return leaf.select(*tracks.columns, F.explode(at).alias("__at")).select(*tracks.columns, "__at.*")


def with_levels(found: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Runs or visits of finest cells, once a level."""
    at = F.array(*(F.struct(F.lit(k).alias("level"), s2.parent(F.col("__cell"), k).alias("cell_id")) for k in levels))
    return found.withColumn("__at", F.explode(at)).select("*", "__at.*")


def s2_index(tracks: DataFrame, levels: Sequence[int] = s2.LEVELS, visit_gap_s: int = Settings.cell_visit_s, width: int = Settings.bucket_s) -> DataFrame:
    leaf = tracks.withColumn("__leaf", s2.leaf_id("lat", "lon")).where("__leaf is not null")
    found = runs(leaf, s2.parent(F.col("__leaf"), max(levels)), visit_gap_s, width=width)
    cells = merged(with_levels(found, levels), ["subject_id", "level", "cell_id"], visit_gap_s)
    return cells.withColumn("cell_key", s2.token(F.col("cell_id"))).drop("cell_id")


#: Rows up to which a subject is one task where that spares a shuffle of what its cells hold.
WHOLE_SUBJECT = 100_000


def large_subjects(tracks: DataFrame, rows: int = WHOLE_SUBJECT) -> DataFrame:
    """Subjects of more rows: at most a row for so many of tracks."""
    return tracks.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("subject_id")


def s2_index_of_pushes(tracks: DataFrame, cell: Column, push: Column, large: DataFrame, levels: Sequence[int] = s2.LEVELS, visit_gap_s: int = Settings.cell_visit_s, width: int = Settings.bucket_s) -> DataFrame:
    """The cell index of pushes that may overlap in time, from the visits of each; cell is the finest one of a row.

    Visits of any batches unite, and a cell's are those of its parts united. So
    a push gives visits of finest cells alone, and they are copied to the levels
    behind the one shuffle that deals them by subject; nothing of a level is
    shuffled. Subjects named by large are dealt by time bucket too, where a visit
    ends at the latest, and their cells are put together across buckets.
    """
    points = tracks.withColumn("__cell", cell).withColumn("__push", push).where("__cell is not null")
    many = large.select(F.col("subject_id").alias("__large"))
    named = F.col("subject_id").eqNullSafe(F.col("__large"))
    whole = _levels_of_pushes(points.join(F.broadcast(many), named, "left_anti").withColumn(BUCKET, F.lit(0).cast("long")), ["subject_id"], levels, visit_gap_s)
    cut = _levels_of_pushes(bucketed(points.drop(BUCKET).join(F.broadcast(many), named, "left_semi"), width=width), ["subject_id", BUCKET], levels, visit_gap_s)
    keys = ["subject_id", "level", "cell_id"]
    alone = in_buckets(whole, keys, visit_gap_s).withColumn("visit_count", F.col("__gaps") + 1).withColumn("activity_mode", dominant())
    together = merged(cut, keys, visit_gap_s)
    return alone.select(*together.columns).unionByName(together).withColumn("cell_key", s2.token(F.col("cell_id"))).drop("cell_id")


def _levels_of_pushes(points: DataFrame, by: Sequence[str], levels: Sequence[int], visit_gap_s: int) -> DataFrame:
    """The visits that each push has in finest cells and one time bucket, once a level; dealt by columns that all windows behind it share."""
    own = ["subject_id", BUCKET, "__push", "__cell"]
    # Each row is copied to all levels before it is summed up: more and smaller tasks than the rows alone would need.
    tasks = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _tallied(points, ["subject_id", "__push", "__cell"]).repartition(tasks, *by)
    near = Window.partitionBy(*own).orderBy("first_s")
    new = F.coalesce((F.col("first_s") - F.lag("first_s").over(near) > visit_gap_s).cast("long"), F.lit(0))
    numbered = dealt.withColumn("__new", new).withColumn("__visit", F.sum("__new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*own, "__visit").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.lit(0).cast("long").alias("__gaps"), *(F.sum(c).cast("long").alias(c) for c in SUMS))
    return with_levels(found.drop("__push", "__visit"), levels)


def grid_key(lat: Column, lon: Column, n: int) -> Column:
    return F.concat_ws(":", F.floor(lat * n).cast("string"), F.floor(lon * n).cast("string"))


def grid_index(tracks: DataFrame, per_degree: Sequence[int] = (1, 10, 100), visit_gap_s: int = Settings.cell_visit_s, width: int = Settings.bucket_s) -> DataFrame:
    """A plain longitude-latitude grid at several resolutions, the last of which the others divide."""
    finest = per_degree[-1]
    found = runs(tracks, F.struct(F.floor(F.col("lat") * finest).alias("y"), F.floor(F.col("lon") * finest).alias("x")), visit_gap_s, width=width)
    up = lambda c, n: F.floor(F.col(f"__cell.{c}") / (finest // n)).cast("string")
    at = F.array(*(F.struct(F.lit(k).alias("level"), F.concat_ws(":", up("y", n), up("x", n)).alias("cell_key")) for k, n in enumerate(per_degree)))
    return merged(found.withColumn("__at", F.explode(at)).select("*", "__at.*"), ["subject_id", "level", "cell_key"], visit_gap_s)


def level_index(tracks: DataFrame, levels: Mapping[int, Callable[[], Column]], aggregates: Mapping[str, Column], own: Mapping[int, Mapping[str, Column]] | None = None, by: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Aggregates of your own over keys of your own, many levels in one pass: (by, level, cell_key, columns).

    levels: level to a function that gives its key; rows whose key is null are
    skipped. aggregates: what every level computes. own: what a level computes
    in place of that; its columns are null at the others.
    """
    own = own or {}
    at = F.array(*(F.struct(F.lit(k).alias("level"), key().cast("string").alias("cell_key")) for k, key in levels.items()))
    rows = tracks.select("*", F.explode(at).alias("__at")).select("*", "__at.level", "__at.cell_key").where("cell_key is not null")
    plain = [k for k in levels if k not in own]
    made = []
    if plain:
        made.append(rows.where(F.col("level").isin(plain)).groupBy(*by, "level", "cell_key").agg(*(a.alias(n) for n, a in aggregates.items())))
    for k, mine in own.items():
        made.append(rows.where(F.col("level") == k).groupBy(*by, "level", "cell_key").agg(*(a.alias(n) for n, a in mine.items())))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def subject_index(tracks: DataFrame, width: int = Settings.bucket_s) -> DataFrame:
    """One accumulator a subject, in which every forward step is a visit."""
    return accumulate(tracks, ["subject_id"], 0, width)


def tile_accumulate(tracks: DataFrame, zoom: int) -> DataFrame:
    """Points clustered by slippy-map tile: count, largest and mean values."""
    n = float(1 << zoom)
    x = F.floor((F.col("lon") + 180) / 360 * n).cast("long")
    phi = F.radians("lat")
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2 * n).cast("long")
    tiles = tracks.withColumn("tile_x", x).withColumn("tile_y", y)
    return tiles.groupBy("tile_x", "tile_y").agg(
        F.count("*").alias("point_count"), F.max("speed").alias("max_speed"), F.max("elevation").alias("max_elevation"),
        F.sum("time_offset").alias("sum_offset"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
    )
