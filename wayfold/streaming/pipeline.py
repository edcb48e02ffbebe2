"""Incremental ingest: files arriving in a folder, state kept by subject."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfold.config import Settings
from wayfold.operators import quality, segments
from wayfold.sources import ingest
from wayfold.streaming import scans

#: transformWithState needs this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def arriving(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Lines of text files as they land."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_trigger).text(folder)


def judged(messages: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """Points with invalid_reason, and every other element with its reason and text (object); valid rows have no object."""
    rows = ingest.sorted_out(messages)
    unfit = F.col("unfit").isNotNull()
    if whitelist:
        rows = rows.where(unfit | F.col("subject_id").isin(whitelist))
    reason = F.coalesce("unfit", quality.invalid_reason(typed=True))
    rows = rows.withColumn("invalid_reason", reason)
    points = [c for c in rows.columns if c not in ("message", "object", "unfit", "invalid_reason")]
    text = F.when(unfit, F.coalesce("object", "message")).when(F.col("invalid_reason").isNotNull(), F.to_json(F.struct(*points)))
    return rows.select(*points, "invalid_reason", text.alias("object"))


def run_batches(messages: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], on_rejected: Callable[[DataFrame, int], None], whitelist: list[str] | None = None, remember: str = "1 day"):
    """Decodes, validates, dedupes and hands every micro-batch on; returns the running query.

    Exact repeats of a point that came within the time to remember are dropped,
    in one push or across pushes; points that differ in anything are kept.
    on_rejected gets (invalid_reason, object) of everything else but subjects
    outside of the whitelist: unreadable messages, elements that are no points,
    and invalid points, as often as they come.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            refused = F.col("invalid_reason").isNotNull()
            on_rejected(batch.where(refused).select("invalid_reason", "object"), number)
            on_batch(quality.stamp(quality.sanitize(batch.where(~refused).drop("invalid_reason", "object")), F.lit(number)), number)
        finally:
            batch.unpersist()

    rows = quality.dedupe_arriving(judged(messages, whitelist), remember, F.col("invalid_reason").isNotNull())
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_segments(points: DataFrame, kind: str, settings: Settings = Settings(), bound_s: int = 0, silence_s: int = 0) -> DataFrame:
    """Finished moves (of active rows) or stays (of inactive ones) of a stream, with all statistics of the batch form.

    Rows may come up to bound_s out of order; what comes later is a row with
    late true and its event_id. An open segment of a subject that is silent for
    silence_s of the clock is finished too, by a query whose trigger goes on; at
    0 it stays open.
    """
    found = scans.scan_stream(points, scans.Moves(settings) if kind == "move" else scans.Stays(settings), bound_s, silence_s)
    return (segments.finished_moves if kind == "move" else segments.finished_stays)(found)


def stream_teleports(points: DataFrame, settings: Settings = Settings(), bound_s: int = 0, silence_s: int = 0) -> DataFrame:
    """(subject_id, late, event_id, accepted) of a stream of points: the last accepted point is kept across pushes."""
    return scans.scan_stream(points, scans.Teleports(settings), bound_s, silence_s)


def stream_improved(points: DataFrame, settings: Settings = Settings(), bound_s: int = 0, silence_s: int = 0) -> DataFrame:
    """(subject_id, late, event_id, activity, acceleration) of a stream of points: averages and modes are kept across pushes, the gyroscope's too."""
    return scans.scan_stream(points, scans.Improved(settings), bound_s, silence_s)


class DeviceWindows(StatefulProcessor):
    """Drops rows inside what is known of their device, and extends it at the end of each push."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "first_s long, last_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        known = tuple(self.known.get()) if self.known.exists() else None
        low = high = None
        kept = []
        for t in new["unix_s"].tolist():
            stored = known is not None and known[0] < t < known[1]
            pushed = low is not None and low < t < high
            kept.append(not stored and not pushed)
            if low is None:
                low = high = t
            elif not stored:
                low, high = min(low, t), max(high, t)
        self.known.update((low, high) if known is None else (min(low, known[0]), max(high, known[1])))
        yield pd.DataFrame({"subject_id": key[0], "device_id": key[1], "event_id": new["event_id"][kept].tolist()})

    def close(self) -> None:
        pass


def stream_unbacktracked(points: DataFrame) -> DataFrame:
    """(subject_id, device_id, event_id) of the rows of a stream that do not go back into a device's known time."""
    return points.groupBy("subject_id", "device_id").transformWithStateInPandas(DeviceWindows(), "subject_id string, device_id string, event_id long", "Append", "None")
