"""Requests for tiling, of which a burst gives one, and meters of a running query."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Debounce(StatefulProcessor):
    """Holds a layer's last request until none has come for wait_s of the clock."""

    def __init__(self, wait_s: int):
        self.wait_s = wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "requested_at long, request string, requests long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        last, count = new.loc[new["requested_at"].idxmax()], len(new)
        at, request = int(last["requested_at"]), last["request"]
        if self.pending.exists():
            held_at, held, held_count, timer = self.pending.get()
            self.handle.deleteTimer(timer)
            count += held_count
            if held_at > at:
                at, request = held_at, held
        timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.wait_s
        self.handle.registerTimer(timer)
        self.pending.update((at, request, count, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, request, count, _ = self.pending.get()
        self.pending.clear()
        yield pd.DataFrame({"layer": [key[0]], "requested_at": [at], "request": [request], "requests": [count]})

    def close(self) -> None:
        pass


def debounced(requests: DataFrame, wait_s: int) -> DataFrame:
    """(layer, requested_at, request, requests) of a stream of (layer, requested_at, request): one row a burst, its last request; needs a trigger that goes on."""
    schema = "layer string, requested_at long, request string, requests long"
    return requests.select("layer", "requested_at", "request").groupBy("layer").transformWithStateInPandas(Debounce(wait_s), schema, "Append", "ProcessingTime")


#: Minutes of the three averages.
MINUTES = (1, 5, 15)


@dataclass
class Meter:
    """Total, mean and moving rates of a count, fed with what came in a time."""

    total: float = 0.0
    seconds: float = 0.0
    rates: dict[int, float] = field(default_factory=dict)

    def add(self, n: float, seconds: float) -> None:
        self.total, self.seconds = self.total + n, self.seconds + seconds
        now = n / seconds
        for m in MINUTES:
            old = self.rates.get(m)
            self.rates[m] = now if old is None else old + (1 - math.exp(-seconds / 60 / m)) * (now - old)

    @property
    def mean(self) -> float:
        return self.total / self.seconds if self.seconds else 0.0


class Throughput(StreamingQueryListener):
    """Rows and bytes a second of metered queries, from the metrics that each micro-batch reports."""

    def __init__(self, name: str, on_progress: Callable[[dict[str, Meter]], None] | None = None):
        self.name, self.on_progress = name, on_progress
        self.meters, self.lock = {"rows": Meter(), "bytes": Meter()}, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        seconds = max(event.progress.batchDuration, 1) / 1000
        with self.lock:
            for what, meter in self.meters.items():
                meter.add(float(seen[what] or 0), seconds)
            if self.on_progress:
                self.on_progress(self.meters)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def metered(messages: DataFrame, name: str) -> DataFrame:
    """A stream of texts whose rows and bytes a listener of that name counts."""
    return messages.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes"))
