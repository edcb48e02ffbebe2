"""Ingest as a job: python -m wayfold.plans.job --input FOLDER --output FOLDER.

Reads message texts, keeps them raw, and writes points by month, images' rows,
moves, stays, cells, areas, subjects and everything that was refused.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.operators import admin
from wayfold.operators.ordered import bucket_width
from wayfold.plans import pipeline
from wayfold.sources import ingest, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wayfold", description="Points from message texts to all tables.")
    p.add_argument("--input", required=True, help="folder or files of newline-delimited messages, gzip or plain")
    p.add_argument("--output", required=True, help="folder of the tables")
    p.add_argument("--whole", action="store_true", help="messages span lines: a file is one message")
    p.add_argument("--whitelist", nargs="*", help="subjects to keep")
    p.add_argument("--push-limit", type=int, default=0, help="first so many points of a subject, 0 for all")
    p.add_argument("--areas", nargs="*", default=[], metavar="DATASET=FILE", help="areas by dataset")
    p.add_argument("--bucket-s", type=int, default=0, help="width of the time buckets, 0 to choose it by the busiest subject")
    for f in fields(Settings):
        if f.name == "bucket_s":
            continue
        p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    return p


def limited(points: DataFrame, count: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("subject_id").orderBy("unix_s", "device_id", "lon", "lat")
    return points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= count).drop("__n")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = replace(Settings(), **{f.name: getattr(given, f.name) for f in fields(Settings)})
    messages = ingest.read_messages(spark, given.input, given.whole)
    out = lambda name: f"{given.output.rstrip('/')}/{name}"
    sinks.raw_log(messages, out("raw"))
    points = ingest.decode(messages)
    if given.whitelist:
        points = ingest.whitelisted(points, given.whitelist)
    if given.push_limit:
        points = limited(points, given.push_limit)
    # Texts have no row numbers: of points of one second the content decides.
    points = points.withColumn("event_id", F.xxhash64("subject_id", "device_id", "unix_s", "lon", "lat", "accuracy", "activity"))
    areas = None
    for named in given.areas:
        dataset, _, path = named.partition("=")
        more = admin.read_areas(spark, path, dataset)
        areas = more if areas is None else areas.unionByName(more)
    if not settings.bucket_s:
        settings = replace(settings, bucket_s=bucket_width(points))
    made = pipeline.process(points, settings, areas)
    sinks.store_monthly(made.stored, out("tracks"))
    refused = made.quarantined.select("invalid_reason", F.to_json(F.struct(*(c for c in made.quarantined.columns if c != "invalid_reason"))).alias("object"))
    sinks.quarantine(refused.unionByName(ingest.rejected(messages).select("invalid_reason", F.coalesce("object", "message").alias("object"))), out("quarantine"))
    tables = {"snaps": made.snaps, "moves": made.moves, "stays": made.stays, "cells": made.s2, "areas": made.areas, "subjects": made.subjects}
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(out(name))


if __name__ == "__main__":
    main()
