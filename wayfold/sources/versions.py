"""Tables that are replaced part by part, and never seen half replaced.

A table is a folder with data of every version and a manifest. A change first
writes its parts beside the old ones and then one small manifest that names the
folder of every part; readers go by the newest manifest. A write that fails
leaves folders that no manifest names. A batch number in the manifest makes
changes idempotent: a batch that is not newer than the last one adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.scratch import materialize

#: Name of the column that deals rows to parts.
PART = "part"


class Manifest(NamedTuple):
    version: int
    batch: int
    parts: dict[str, str]
    note: dict


def manifest(spark: SparkSession, path: str) -> Manifest:
    try:
        rows = spark.read.schema("value string, v int").text(f"{path}/manifest")
        newest = rows.orderBy(F.desc("v")).first()
    except AnalysisException:  # the table is not there yet
        newest = None
    return Manifest(newest.v, *json.loads(newest.value)) if newest else Manifest(0, -1, {}, {})


def commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Makes a version the current one; fails if another writer has made it."""
    text = json.dumps([new.batch, new.parts, new.note])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest/v={new.version}")


def read(spark: SparkSession, path: str, schema: StructType, parts: list[str] | None = None) -> DataFrame:
    """The current rows, of all parts or some."""
    folders = [f for k, f in manifest(spark, path).parts.items() if parts is None or k in parts]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("string")


def replace_parts(spark: SparkSession, path: str, rows: DataFrame, touched: list[str], now: Manifest, batch: int, note: dict | None = None) -> None:
    """Writes the new rows (with part) of the touched parts and makes them current.

    Rows go out with part and a salt, so no part is one writer's alone.
    """
    version = now.version + 1
    rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).repartition(PART, "__salt").drop("__salt").write.mode("overwrite").partitionBy(PART).parquet(f"{path}/data/v={version}")
    found = {r[0] for r in rows.select(PART).distinct().collect()}
    parts = {k: f for k, f in now.parts.items() if k not in touched} | {k: f"data/v={version}/{PART}={k}" for k in touched if k in found}
    commit(spark, path, Manifest(version, batch, parts, note or now.note))


def upsert(spark: SparkSession, path: str, batch_rows: DataFrame, key: str, batch: int, merge: Callable[[DataFrame], DataFrame], parts: int = 64) -> bool:
    """Merges a batch into the table and rewrites only the parts it touches; returns whether it did.

    merge gets the stored rows of these parts and the batch's, united, and gives
    the rows to store, in the same columns.
    """
    now = manifest(spark, path)
    if batch <= now.batch:
        return False
    fresh = materialize(batch_rows, "upsert")
    touched = [r[0] for r in fresh.select(part_of(F.col(key), parts).alias("p")).distinct().collect()]
    stored = read(spark, path, fresh.schema, touched)
    replace_parts(spark, path, materialize(merge(stored.unionByName(fresh)).withColumn(PART, part_of(F.col(key), parts)), "merged"), touched, now, batch)
    return True
