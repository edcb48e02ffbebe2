"""Readers of point messages: newline-delimited features, arrays, collections, the older flat format."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import names, notes
from wayfold.functions.num import truncate

#: What is said about elements that are no points.
UNREADABLE, UNKNOWN_KIND, TOO_DEEP, NO_PLACE, NO_FEATURES = "not readable", "unknown type", "nested too deeply", "no place", "no features"

# Declared, so that readers never infer; unknown properties stay in extras.
PROPERTIES = {
    "name": ("Name", "string"), "device_id": ("UUID", "string"), "time": ("Time", "string"), "unix": ("UnixTime", "double"), "alias": ("Alias", "string"),
    "accuracy": ("Accuracy", "double"), "speed": ("Speed", "double"), "heading": ("Heading", "double"), "elevation": ("Elevation", "double"), "activity": ("Activity", "string"),
    "gyro_x": ("GyroscopeX", "double"), "gyro_y": ("GyroscopeY", "double"), "gyro_z": ("GyroscopeZ", "double"),
    "accel_x": ("AccelerometerX", "double"), "accel_y": ("AccelerometerY", "double"), "accel_z": ("AccelerometerZ", "double"),
    "user_accel_x": ("UserAccelerometerX", "double"), "user_accel_y": ("UserAccelerometerY", "double"), "user_accel_z": ("UserAccelerometerZ", "double"),
    "pressure": ("Pressure", "double"), "heart_rate": ("HeartRate", "double"), "battery_level": ("BatteryLevel", "double"), "battery_status": ("BatteryStatus", "string"),
    "network_info": ("NetworkInfo", "string"), "steps": ("NumberOfSteps", "double"), "version": ("Version", "string"), "img_b64": ("imgB64", "string"), "img_s3": ("imgS3", "string"),
    "distance": ("Distance", "double"), "pace": ("CurrentPace", "double"), "cadence": ("CurrentCadence", "double"), "trip_start": ("CurrentTripStart", "string"),
}
LEGACY = "uuid string, pushToken string, version string, id long, name string, lat double, long double, accuracy double, vAccuracy double, elevation double, speed double, speed_accuracy double, tilt double, heading double, heading_accuracy double, heartrate double, time string, floor int, notes string, COVerified boolean, remoteaddr string"


def read_messages(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(value): one JSON text a row. Lines by default, whole files where an array or collection spans lines; gzip is read as it is."""
    return spark.read.text(path, wholetext=whole)


#: What one parse of an object gives. Values keep their JSON types, so that a text is not taken for a number.
OBJECT = (
    "type variant, geometry struct<type variant, coordinates variant>, properties struct<" + ", ".join(f"{source} variant" for source, _ in PROPERTIES.values()) + ">, "
    "name variant, uuid variant, time variant, accuracy variant, lat variant, `long` variant, _corrupt_record string"
)


def elements_of(text: str) -> list[dict]:
    """(object, reason) of every element of a message, collections taken apart however deep they stand in one another."""
    try:
        root = json.loads(text)
    except RecursionError:
        return [{"object": text, "reason": TOO_DEEP}]
    except ValueError:
        return [{"object": None, "reason": UNREADABLE}]
    found, open_ = [], list(reversed(root)) if isinstance(root, list) else [root]
    while open_:
        now, reason = open_.pop(), None
        if isinstance(now, dict) and now.get("type") == "FeatureCollection":
            inner = now.get("features")
            if "features" in now:
                open_.extend(reversed(inner) if isinstance(inner, list) else [] if inner is None else [inner])
                continue
            reason = NO_FEATURES
        try:
            found.append({"object": json.dumps(now, ensure_ascii=False), "reason": reason})
        except RecursionError:
            found.append({"object": text, "reason": TOO_DEEP})
    return found


#: The result of taking a message apart.
APART = T.ArrayType(T.StructType([T.StructField("object", T.StringType()), T.StructField("reason", T.StringType())]))


@F.pandas_udf(APART)
def taken_apart(texts: pd.Series) -> pd.Series:
    return texts.map(elements_of)


def elements(messages: DataFrame) -> DataFrame:
    """(message, object, reason): the elements of messages as texts; a reason where one cannot be taken further.

    Only arrays and what names a collection are taken apart; a plain object is
    its own text. Blank messages and empty arrays or collections hold nothing
    and give no rows; a collection without features is refused. A value of
    features that is no array counts as its only element.
    """
    text = F.trim("value")
    several = text.startswith("[") | F.contains(text, F.lit("FeatureCollection"))
    plain = messages.where(~several & (text != "")).select(F.col("value").alias("message"), text.alias("object"), F.lit(None).cast("string").alias("reason"))
    apart = messages.where(several).select(F.col("value").alias("message"), F.explode(taken_apart(text)).alias("e")).select("message", "e.*")
    return plain.unionByName(apart)


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once a row. Merely named ones are inlined by the optimizer wherever they are used, in filters too; generated ones are not."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def parsed(objects: DataFrame) -> DataFrame:
    """Adds v, the parse by the declared schema, every, all properties, and kind, the object's type.

    v is null where the element is no readable JSON; only those that do not fit
    the schema are read a second time to tell.
    """
    rows = _once(objects, read=F.from_json("object", OBJECT), every=F.from_json("object", "properties map<string,variant>")["properties"])
    bad = F.col("read._corrupt_record").isNotNull() & F.try_parse_json("object").isNull() | F.col("reason").isNotNull()
    rows = _once(rows, v=F.when(~bad, F.col("read"))).drop("read")
    rows = rows.withColumn("kind", F.try_variant_get("v.type", "$", "string"))
    flat = F.col("kind").isNull() & F.col("v").isNotNull()
    return _once(rows, flat=F.when(flat, F.from_json("object", LEGACY)))


def json_kind(value: str | Column) -> Column:
    """text, number, or the variant's own name; null where nothing stands."""
    own = F.schema_of_variant(value)
    return F.when(own == "STRING", "text").when(own.isin("BIGINT", "DOUBLE", "FLOAT") | own.startswith("DECIMAL"), "number").when(own != "VOID", own)


def wrong_types(paths: dict[str, tuple[str, str]]) -> Column:
    """Names of those of (name: path, expected kind) that are there but of another kind."""
    each = [F.when(json_kind(path) != kind, F.lit(name)) for name, (path, kind) in paths.items()]
    return F.array_compact(F.array(*each))


def typed(value: str | Column, kind: str) -> Column:
    """A variant as string or double; null where it holds another JSON type."""
    return F.when(json_kind(value) == {"string": "text", "double": "number"}[kind], F.try_variant_get(value, "$", kind))


def feature_columns() -> dict[str, Column]:
    """A point's columns from a parsed feature. What has another JSON type than its column's is null and named in wrong_types."""
    checked = {n: (f"v.properties.{PROPERTIES[n][0]}", "text" if PROPERTIES[n][1] == "string" else "number") for n in ("name", "device_id", "time", "unix", "accuracy")}
    place = lambda k: F.try_variant_get("v.geometry.coordinates", f"$[{k}]", "variant")
    others = F.map_filter("every", lambda k, _: ~k.isin([s for s, _ in PROPERTIES.values()]))
    return {
        "type": F.col("kind"), "geometry_type": F.try_variant_get("v.geometry.type", "$", "string"), "lon": typed(place(0), "double"), "lat": typed(place(1), "double"),
        "has_properties": F.coalesce(F.size("every") > 0, F.lit(False)), **{name: typed(f"v.properties.{source}", kind) for name, (source, kind) in PROPERTIES.items()},
        "wrong_types": wrong_types(checked), "extras": F.transform_values(others, lambda _, v: F.to_json(v)),
    }


def with_gyro(points: DataFrame) -> DataFrame:
    """Adds gyro_sum, the sum of the axes' sizes; null unless all three are there."""
    return points.withColumn("gyro_sum", F.abs("gyro_x") + F.abs("gyro_y") + F.abs("gyro_z"))


def identified(points: DataFrame) -> DataFrame:
    """Adds subject_id and unix_s; Unix time is preferred to the text time."""
    parsed = F.unix_timestamp(F.try_to_timestamp("time"))
    return points.withColumn("subject_id", names.subject_id(F.coalesce("name", F.lit("")))).withColumn("unix_s", F.coalesce(F.floor("unix").cast("long"), parsed)).drop("unix")


def has_place() -> Column:
    """Of flat objects: whether they can be points at all."""
    return F.coalesce((json_kind("v.lat") == "number") | (json_kind("v.long") == "number"), F.lit(False))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def legacy_columns() -> dict[str, Column]:
    """A point's columns from an object of the older flat format."""
    checked = {"name": ("v.name", "text"), "device_id": ("v.uuid", "text"), "time": ("v.time", "text"), "accuracy": ("v.accuracy", "number")}
    p = lambda name: F.col(f"flat.{name}")
    note = notes.parsed(p("notes"))
    return {
        "type": F.lit("Feature"), "geometry_type": F.lit("Point"), "lon": p("long"), "lat": p("lat"), "has_properties": F.lit(True),
        "name": p("name"), "device_id": p("uuid"), "time": p("time"), "version": p("version"),
        "speed": truncate(p("speed"), 3), "elevation": truncate(p("elevation"), 2), "heading": truncate(p("heading"), 1), "accuracy": truncate(p("accuracy"), 2),
        "v_accuracy": positive(p("vAccuracy")), "speed_accuracy": positive(p("speed_accuracy")), "heading_accuracy": positive(p("heading_accuracy")),
        "heart_rate": F.coalesce(positive(p("heartrate")), positive(notes.heart_rate(note["heartRateS"]))),
        "activity": note["activity"], "steps": positive(note["numberOfSteps"]), "pressure": positive(note["pressure"]), "distance": positive(note["distance"]),
        "battery_level": notes.battery(note)["level"], "battery_status": notes.battery(note)["status"], "network_info": note["networkInfo"],
        "img_b64": note["imgb64"], "img_s3": note["imgS3"], "gyro_x": note["gyroscopeX"], "gyro_y": note["gyroscopeY"], "gyro_z": note["gyroscopeZ"],
        "accel_x": note["accelerometerX"], "accel_y": note["accelerometerY"], "accel_z": note["accelerometerZ"], "wrong_types": wrong_types(checked),
    }


def to_legacy(points: DataFrame) -> DataFrame:
    """The flat format of points, for older readers."""
    stamp = F.date_format(F.timestamp_seconds("unix_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return points.select(F.col("device_id").alias("uuid"), "name", "lat", F.col("lon").alias("long"), "accuracy", "speed", "heading", "elevation", stamp.alias("time"), F.to_json(F.struct("activity")).alias("notes"))


def sorted_out(messages: DataFrame) -> DataFrame:
    """Every element of a text table, read once: message, object (text), unfit (why it is no point, else null) and a point's columns."""
    rows = parsed(elements(messages))
    unfit = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("v").isNull(), UNREADABLE)
        .when(F.col("kind") == "FeatureCollection", TOO_DEEP)  # its name is spelled so that it was not seen
        .when(F.col("kind").isNotNull() & (F.col("kind") != "Feature"), UNKNOWN_KIND)
        .when(F.col("kind").isNull() & ~has_place(), NO_PLACE)
    )
    feature, flat = feature_columns(), legacy_columns()
    names = list(dict.fromkeys([*feature, *flat]))
    either = [F.when(F.col("kind") == "Feature", feature[n]).when(F.col("kind").isNull(), flat[n]) if n in feature and n in flat else F.when(F.col("kind") == "Feature", feature[n]) if n in feature else F.when(F.col("kind").isNull(), flat[n]) for n in names]
    shown = F.when(F.coalesce(unfit != UNREADABLE, F.lit(True)), F.col("object"))
    return with_gyro(identified(rows.select("message", shown.alias("object"), unfit.alias("unfit"), *(c.alias(n) for n, c in zip(names, either, strict=True)))))


def decode(messages: DataFrame) -> DataFrame:
    """All points of a text table, either format; see rejected for what is none."""
    return sorted_out(messages).where("unfit is null").drop("message", "object", "unfit")


def rejected(messages: DataFrame) -> DataFrame:
    """(invalid_reason, message, object): every element of a text table that decode gives no point for.

    Together with decode's rows this is all that the messages hold.
    """
    return sorted_out(messages).where("unfit is not null").select(F.col("unfit").alias("invalid_reason"), "message", "object")


def malformed(messages: DataFrame) -> DataFrame:
    """Messages that are not JSON."""
    return messages.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))


def whitelisted(points: DataFrame, subjects: list[str] | DataFrame) -> DataFrame:
    if isinstance(subjects, DataFrame):
        return points.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return points.where(F.col("subject_id").isin(subjects))


def last_push(points: DataFrame) -> DataFrame:
    """Every subject's rows of its most recent push."""
    newest = points.groupBy("subject_id").agg(F.max("received_at").alias("received_at"))
    return points.join(newest, ["subject_id", "received_at"], "left_semi")
