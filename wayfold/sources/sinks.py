"""Writers of points, segments and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import versions

# Battery states of the metrics export.
BATTERY_STATES = {"unplugged": 1, "charging": 2, "full": 3}


def month(unix_s: Column) -> Column:
    """Calendar month in UTC."""
    return F.date_format(F.timestamp_seconds(unix_s), "yyyy-MM")


def store_monthly(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends points, one folder a month and bucket of subjects.

    Subjects hash to so many buckets, so folders do not grow with them; rows of
    one bucket and month go to several writers, so a subject with very many
    rows is no single task. A reader of one subject prunes to its bucket.
    """
    placed = points.withColumn("ym", month(F.col("unix_s"))).withColumn("subject_bucket", subject_bucket(F.col("subject_id"), buckets))
    day = F.floor(F.col("unix_s") / 86_400)
    placed.repartition("ym", "subject_bucket", day).sortWithinPartitions("ym", "subject_bucket", "subject_id", "unix_s").write.mode("append").partitionBy("ym", "subject_bucket").parquet(path)


def subject_bucket(subject: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int")


def stored_points(spark: SparkSession, path: str, subject: str | None = None, buckets: int = 64) -> DataFrame:
    """Points of the monthly store, all or one subject's."""
    rows = spark.read.parquet(path)
    if subject is None:
        return rows
    return rows.where((F.col("subject_bucket") == subject_bucket(F.lit(subject), buckets)) & (F.col("subject_id") == subject))


def store_pushed(points: DataFrame, all_path: str, last_path: str) -> None:
    """Appends to the whole history and replaces the last push."""
    points.write.mode("append").parquet(all_path)
    points.write.mode("overwrite").parquet(last_path)


def raw_log(messages: DataFrame, path: str) -> None:
    """Unvalidated input as it came."""
    messages.select("value").write.mode("append").text(path)


def write_json(rows: DataFrame, path: str, compress: bool = True) -> None:
    rows.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def quarantine(invalid: DataFrame, path: str) -> None:
    invalid.write.mode("append").partitionBy("invalid_reason").json(path)


def feature_json(points: DataFrame) -> Column:
    """A point as feature text; null properties are left out."""
    props = F.struct(*(c for c in points.columns if c not in ("lon", "lat", "type", "geometry_type", "has_properties")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties")))


def push_layer(points: DataFrame, path: str, source: str, layer: str, append: bool = True) -> None:
    """Feature text of a tile layer."""
    points.select(feature_json(points).alias("value")).write.mode("append" if append else "overwrite").option("compression", "gzip").text(f"{path}/{source}/{layer}")


def edge_files(spark: SparkSession, edge: str, canonical: str) -> list[str]:
    """Files of the edge layer that the canonical one does not hold yet."""
    held = set(versions.manifest(spark, canonical).note.get("edge", []))
    return sorted(f for f in spark.read.text(edge).inputFiles() if f not in held)


def layer_lines(spark: SparkSession, canonical: str, edge: str | None = None) -> DataFrame:
    """(value): the canonical layer, and with edge also what was pushed since; every line once, whenever a compaction stopped."""
    now = versions.manifest(spark, canonical)
    files = [f"{canonical}/{f}" for f in now.parts.values()] + (edge_files(spark, edge, canonical) if edge else [])
    return spark.read.schema("value string").text(files) if files else spark.createDataFrame([], "value string")


def compact_layer(spark: SparkSession, edge: str, canonical: str, files: int, rows_a_file: int = 1_000_000) -> bool:
    """Once more than so many edge files are new, their lines are added to the canonical layer in few files; returns whether they were.

    One manifest names both the new folder and the edge files it holds, so a
    run that stops before it has done nothing and one that stops after it has
    done all; the files may then be deleted at leisure. Names of deleted files
    leave the manifest with the next compaction.
    """
    new = edge_files(spark, edge, canonical)
    if len(new) <= files:
        return False
    now, lines = versions.manifest(spark, canonical), spark.read.schema("value string").text(new)
    folder, there = f"data/v={now.version + 1}", set(spark.read.text(edge).inputFiles())
    lines.coalesce(max(1, -(-lines.count() // rows_a_file))).write.mode("overwrite").option("compression", "gzip").text(f"{canonical}/{folder}")
    held = [f for f in now.note.get("edge", []) if f in there] + new
    versions.commit(spark, canonical, versions.Manifest(now.version + 1, now.batch, now.parts | {str(now.version + 1): folder}, {"edge": held}))
    return True


#: Number fields of the time-series export, where a point has them.
METRIC_FIELDS = ("lon", "lat", "accuracy", "v_accuracy", "speed", "speed_accuracy", "heading", "heading_accuracy", "elevation", "pressure", "heart_rate", "battery_level", "steps", "distance", "pace", "cadence", "acceleration", "time_offset", "accel_x", "accel_y", "accel_z", "user_accel_x", "user_accel_y", "user_accel_z", "gyro_x", "gyro_y", "gyro_z", "gyro_sum")


def metrics(points: DataFrame, measurement: str = "track") -> DataFrame:
    """Wide rows of the time-series export: tags, time and every number field that the points have."""
    status = F.lit(0)
    if "battery_status" in points.columns:
        for name, number in BATTERY_STATES.items():
            status = F.when(F.lower("battery_status") == name, F.lit(number)).otherwise(status)
    tags = [F.lit(measurement).alias("measurement"), *(c for c in ("alias", "name") if c in points.columns), "subject_id", "device_id", F.when(F.col("activity") == "", "Unknown").otherwise(F.col("activity")).alias("activity")]
    fields = [F.col(c).cast("double").alias(c) for c in METRIC_FIELDS if c in points.columns]
    return points.select(*tags, F.timestamp_seconds("unix_s").alias("time"), *fields, status.alias("battery_state"))


def put_state(rows: DataFrame, path: str, bucket: str, key: str = "key") -> None:
    """Values by key as a table, one folder a bucket of keys; a bucket is replaced as a whole."""
    kept = [c for c in rows.columns if c != key]
    rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*kept)).alias("value")).write.mode("overwrite").parquet(f"{path}/bucket={bucket}")


def get_state(spark: SparkSession, path: str, bucket: str, keys: list[str] | None = None) -> DataFrame:
    """(key, value) of a bucket: all, or those of the keys."""
    rows = spark.read.schema("key string, value string").parquet(f"{path}/bucket={bucket}")
    return rows if keys is None else rows.where(F.col("key").isin(keys))
