"""Validation, duplicate removal and clean-up of incoming points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.num import truncate


def invalid_reason(subject: str | None = None, typed: bool = False) -> Column:
    """The first rule that a decoded point breaks, null if none.

    Expects type, geometry_type, lon, lat, has_properties, name, device_id,
    time (text), unix_s and accuracy; missing properties are null. With typed
    also wrong_types, the names of properties whose JSON type is not theirs.
    """
    parsed = F.unix_timestamp(F.try_to_timestamp(F.col("time")))
    both = F.col("time").isNotNull() & F.col("unix_s").isNotNull()
    # A malformed text time beside a Unix time counts as infinitely far away.
    apart = both & (parsed.isNull() | (F.abs(F.col("unix_s") - parsed) > 1))
    wrong = lambda name: F.array_contains("wrong_types", F.lit(name)) if typed else F.lit(False)
    rules = [
        ("empty", F.col("type").isNull() | ~F.coalesce("has_properties", F.lit(False)) & F.col("geometry_type").isNull()),
        ("not a feature", F.col("type") != "Feature"),
        ("no geometry", F.col("geometry_type").isNull()),
        ("not a point", F.col("geometry_type") != "Point"),
        ("bad latitude", ~F.coalesce(F.col("lat").between(-90, 90), F.lit(False))),
        ("bad longitude", ~F.coalesce(F.col("lon").between(-180, 180), F.lit(False))),
        ("no properties", ~F.coalesce("has_properties", F.lit(False))),
        ("name not text", wrong("name")),
        ("no name", F.coalesce("name", F.lit("")) == ""),
        ("device not text", wrong("device_id")),
        ("no device", F.col("device_id").isNull()),
        ("no time", F.coalesce("unix_s", parsed).isNull()),
        ("times differ", apart | (wrong("time") & F.col("unix_s").isNotNull()) | (wrong("unix") & F.col("time").isNotNull())),
        ("accuracy not a number", wrong("accuracy")),
        ("no accuracy", F.col("accuracy").isNull()),
    ]
    if subject is not None:
        rules.append(("other subject", F.col("subject_id") != subject))
    return F.coalesce(*(F.when(broken, F.lit(reason)) for reason, broken in rules))


def validate(points: DataFrame, subject: str | None = None) -> DataFrame:
    return points.withColumn("invalid_reason", invalid_reason(subject, "wrong_types" in points.columns))


def split_valid(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of validate()."""
    return points.where("invalid_reason is null").drop("invalid_reason"), points.where("invalid_reason is not null")


def dedupe(points: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact duplicates removed, the time of receipt aside; streams use dedupe_arriving."""
    if columns:
        return points.dropDuplicates(columns)
    kinds = dict(points.dtypes)
    maps = [c for c in points.columns if kinds[c].startswith("map<")]  # maps do not compare: their sorted entries do
    keyed = points.withColumns({f"__d_{c}": F.array_sort(F.map_entries(c)) for c in maps})
    keys = [c for c in points.columns if c not in ("received_at", *maps)] + [f"__d_{c}" for c in maps]
    return keyed.dropDuplicates(keys).select(*points.columns)


def row_digest(points: DataFrame) -> Column:
    """A digest of whole rows, the time of receipt aside: equal for exact repeats alone, whatever the order of map entries."""
    kinds = dict(points.dtypes)
    names = sorted(c for c in points.columns if c != "received_at")
    return F.sha2(F.to_json(F.struct(*(F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map<") else F.col(c) for c in names))), 256)


def dedupe_stream(points: DataFrame, columns: list[str], delay: str = "1 hour") -> DataFrame:
    """First rows by some columns of a stream with a time ts; rows behind the watermark drop out."""
    return points.withWatermark("ts", delay).dropDuplicatesWithinWatermark(columns)


def dedupe_arriving(points: DataFrame, remember: str = "1 day", unless: Column | None = None) -> DataFrame:
    """A stream without exact repeats of rows that came within the last so long, in this push or an earlier one.

    The clock is the time of arrival, so points of the past are never late.
    Rows for which unless holds are kept, however often they come.
    """
    key = row_digest(points)
    if unless is not None:
        key = F.when(unless, F.uuid()).otherwise(key)
    rows = points.withColumn("__key", key).withColumn("__arrived", F.current_timestamp())
    return rows.withWatermark("__arrived", remember).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__arrived")


def sanitize(points: DataFrame) -> DataFrame:
    """Whole-number accuracy; an alias where there is none; an id of the feature's own reset; null extras dropped."""
    out = points.withColumn("accuracy", truncate(F.col("accuracy")))
    if "id" in points.columns:
        out = out.withColumn("id", F.lit(0).cast(points.schema["id"].dataType))
    if "extras" in points.columns:
        out = out.withColumn("extras", F.map_filter("extras", lambda _, v: v.isNotNull() & (v != "null")))
    if "alias" in points.columns:
        out = out.withColumn("alias", F.coalesce("alias", "subject_id"))
    return out.drop("bbox", "wrong_types")


def stamp(points: DataFrame, received_at: Column | None = None) -> DataFrame:
    return points.withColumn("received_at", received_at if received_at is not None else F.unix_timestamp())


def is_snap(points: DataFrame) -> Column:
    """Presence of an image property, even an empty one."""
    return F.col("img_b64").isNotNull() | F.col("img_s3").isNotNull()


def snap_key() -> Column:
    """Second part of a stored image's address, or subject, device and time."""
    stored = F.when(F.contains("img_s3", F.lit("/")), F.split_part("img_s3", F.lit("/"), F.lit(2))).otherwise(F.col("img_s3"))
    return F.coalesce(stored, F.format_string("%s_%s_%010d", "subject_id", "device_id", "unix_s"))


def snap_bucket() -> Column:
    return F.when(F.contains("img_s3", F.lit("/")), F.split_part("img_s3", F.lit("/"), F.lit(1))).otherwise(F.lit(""))


# How JPEG data begins.
JPEG = "FFD8FF"


def decoded_snaps(points: DataFrame, bucket: str = "") -> DataFrame:
    """Points with an image: snap_key, image (bytes, null where it is no JPEG), and the point with the stored image's address.

    The text form of the image goes, img_s3 says where the image is to be
    stored, as bucket/key.
    """
    image = F.try_to_binary("img_b64", F.lit("base64"))
    key = snap_key()
    rows = points.where(is_snap(points)).select("*", key.alias("snap_key"), F.when(F.hex(F.substring(image, 1, 3)) == JPEG, image).alias("image"))
    kept = F.coalesce("img_s3", F.concat(F.lit(f"{bucket}/" if bucket else ""), "snap_key"))
    return rows.withColumn("img_s3", kept).drop("img_b64")


def with_property(points: DataFrame, name: str, value: Column) -> DataFrame:
    """Points with an extra property set; one of that name is replaced."""
    others = F.map_filter(F.coalesce("extras", F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return points.withColumn("extras", F.map_concat(others, F.create_map(F.lit(name), value.cast("string"))))


def without_property(points: DataFrame, name: str) -> DataFrame:
    return points.withColumn("extras", F.map_filter("extras", lambda k, _: k != name))


def pretty(points: DataFrame) -> Column:
    """One line a point for logs: subject, time, place, speed, accuracy, activity."""
    stamp = F.date_format(F.timestamp_seconds("unix_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.format_string("%s %s [%.6f,%.6f] %.2fm/s +-%.0fm %s", "subject_id", stamp, "lon", "lat", F.coalesce("speed", F.lit(-1.0)), F.coalesce("accuracy", F.lit(0.0)), F.coalesce("activity", F.lit("")))
