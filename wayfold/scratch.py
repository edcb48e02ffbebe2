"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a private folder on this machine, but only for a master
    known to be local: on a cluster every executor would write to a disk of its
    own, and a session that does not name its master may be on one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfold-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared scratch folder and read it back.

    The written table cuts the lineage and survives lost executors; unlike a
    cached frame it is columnar, so later readers prune columns. options go to
    the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/wayfold/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
