"""Sequential scans of a stream's subjects: rows put in order first, typed state, an end for subjects that fall silent."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wayfold.config import ACTIVITIES, DAY, Settings
from wayfold.functions.geo import distance_py
from wayfold.operators import clean, improve
from wayfold.operators.segments import MOVE_QUANTITIES, STAY_QUANTITIES, StayCounter


class Scan:
    """What is done with the rows of one subject in order of time.

    COLUMNS are read of each row, STATE and RESULT are the types of what is kept
    and of what comes out; a state is one row of named, typed fields, so it can
    be read by any later version that knows the names.
    """

    COLUMNS: tuple[str, ...] = ()
    STATE = RESULT = ""

    def load(self, kept: tuple | None) -> Any:
        raise NotImplementedError

    def dump(self, state: Any) -> tuple:
        raise NotImplementedError

    def step(self, state: Any, event_id: int, values: tuple) -> Iterator[tuple]:
        """(event_id, results) of what a row gives."""
        raise NotImplementedError

    def end(self, state: Any) -> Iterator[tuple]:
        """What comes out when the subject has fallen silent."""
        return iter(())


class Teleports(Scan):
    COLUMNS, STATE, RESULT = ("unix_s", "lon", "lat", "speed", "time_offset"), "t long, lon double, lat double", "accepted boolean"

    def __init__(self, settings: Settings):
        self.settings = settings

    def load(self, kept):
        state = clean.LastAccepted(self.settings)
        if kept and kept[0] is not None:
            state.t, state.place = kept[0], tuple(kept[1:])
        return state

    def dump(self, state):
        return (state.t, *(state.place or (None, None)))

    def step(self, state, event_id, values):
        yield event_id, state.accept(*values)


class Improved(Scan):
    """Activity and acceleration; a change of device begins anew, as in the batch form."""

    COLUMNS = ("device_id", "unix_s", "lon", "lat", "time_offset", "accuracy", "speed", "heading", "activity", "gyro_sum")
    STATE, RESULT = f"device string, {improve.Improver.STATE}", "activity string, acceleration double"

    def __init__(self, settings: Settings):
        self.settings = settings

    def load(self, kept):
        state = {"device": None, "improver": improve.Improver(self.settings)}
        if kept:
            state["device"] = kept[0]
            state["improver"].load(kept[1:])
        return state

    def dump(self, state):
        return (state["device"], *state["improver"].dump())

    def step(self, state, event_id, values):
        device, *rest = values
        if state["device"] != device:
            state.update(device=device, improver=improve.Improver(self.settings))
        yield event_id, state["improver"].row(*rest), state["improver"].acceleration


def rounded(x: float) -> float:
    """Half away from zero."""
    return float(int(abs(x) + 0.5)) * (1 if x >= 0 else -1)


class Segment:
    """Running sums of one open move or stay, and how often each value came, for medians."""

    FIELDS = (
        "device_id string, raw_point_count long, start_s long, end_s long, first_lon double, first_lat double, lon double, lat double, height double, activity string, metres double, gain double, loss double, "
        "box array<double>, place array<double>, weights array<double>, seen array<array<double>>, often array<array<long>>, sums array<double>"
    )

    def __init__(self, quantities: tuple[str, ...], kept: tuple | None = None):
        self.quantities = quantities
        if kept:
            (self.device, self.count, self.start, self.end, *first, self.lon, self.lat, self.height, self.activity, self.metres, self.gain, self.loss, self.box, self.place, self.weights, seen, often, self.sums) = kept
            self.first, self.values = tuple(first), [Counter(dict(zip(v, n, strict=True))) for v, n in zip(seen, often, strict=True)]
            self.box, self.place, self.weights, self.sums = list(self.box), list(self.place), list(self.weights), list(self.sums)
        else:
            self.count, self.device, self.activity, self.start, self.end, self.first = 0, None, None, None, None, (None, None)
            self.lon = self.lat = self.height = None
            self.metres, self.gain, self.loss = 0.0, 0.0, 0.0
            self.box, self.place, self.weights = [180.0, 90.0, -180.0, -90.0], [0.0, 0.0], [0.0] * len(ACTIVITIES)
            self.values, self.sums = [Counter() for _ in quantities], [0.0] * len(quantities)

    def dump(self) -> tuple:
        seen, often = [list(v) for v in self.values], [list(v.values()) for v in self.values]
        return (self.device, self.count, self.start, self.end, *self.first, self.lon, self.lat, self.height, self.activity, self.metres, self.gain, self.loss, self.box, self.place, self.weights, seen, often, self.sums)

    def add(self, t: int, lon: float, lat: float, device: str, activity: str, offset: float, accuracy: float, elevation: float, speed: float, heights_rounded: bool) -> None:
        calculated = None
        if self.count:
            step = t - self.end
            step = 1 if step > DAY else max(step, 0)
            away = distance_py(self.lon, self.lat, lon, lat)
            self.metres += away
            if step > 0:
                calculated = away / step
                if known(elevation) and known(self.height):
                    climb = elevation - rounded(self.height)
                    self.gain, self.loss = self.gain + max(climb, 0.0), self.loss + max(-climb, 0.0)
        else:
            self.device, self.start, self.first = device, t, (lon, lat)
        height = rounded(elevation) if heights_rounded and known(elevation) else elevation
        for k, x in enumerate((accuracy, height, speed, calculated)[: len(self.quantities)]):
            if known(x):
                self.values[k][x] += 1
                self.sums[k] += x
        self.box = [min(self.box[0], lon), min(self.box[1], lat), max(self.box[2], lon), max(self.box[3], lat)]
        self.place = [self.place[0] + lon, self.place[1] + lat]
        if activity in ACTIVITIES and known(offset):
            self.weights[ACTIVITIES.index(activity)] += offset
        self.count, self.end, self.lon, self.lat, self.height, self.activity = self.count + 1, t, lon, lat, elevation, activity

    def statistics(self) -> tuple:
        """Mean, median, least and greatest of every quantity."""
        out = []
        for values, total in zip(self.values, self.sums, strict=True):
            n = values.total()
            out += [total / n, median(values, n), min(values), max(values)] if n else [None] * 4
        return tuple(out)


def known(x: float | None) -> bool:
    return x is not None and x == x


def median(values: Counter, n: int) -> float:
    at, low = 0, None
    for v in sorted(values):
        at += values[v]
        if low is None and at >= (n + 1) // 2:
            low = v
        if at >= n // 2 + 1:
            return (low + v) / 2
    raise ValueError("no values")


def statistics_of(quantities: dict[str, int]) -> str:
    return ", ".join(f"{q}_{s} double" for q in quantities for s in ("mean", "median", "min", "max"))


class Moves(Scan):
    """Finished moves with the sums that segments.finished_moves takes."""

    COLUMNS = ("unix_s", "lon", "lat", "device_id", "activity", "time_offset", "accuracy", "elevation", "speed")
    STATE = Segment.FIELDS
    RESULT = (
        f"device_id string, raw_point_count long, start_s long, end_s long, {statistics_of(MOVE_QUANTITIES)}, metres double, first struct<lon:double,lat:double>, last struct<lon:double,lat:double>, gain double, loss double, "
        + ", ".join(f"w_{a.lower()} double" for a in ACTIVITIES)
    )

    def __init__(self, settings: Settings):
        self.settings = settings

    def load(self, kept):
        return [Segment(tuple(MOVE_QUANTITIES), kept)]

    def dump(self, state):
        return state[0].dump()

    def breaks(self, step: int, name: str, last: str) -> bool:
        code, before = (ACTIVITIES.index(a) if a in ACTIVITIES else -1 for a in (name, last))
        joined = 1 <= before <= 3 and (1 <= code <= 3 or code == 4) or abs(before - code) <= 1
        return step > self.settings.move_gap_s or step <= -1 or not joined

    def step(self, state, event_id, values):
        now = state[0]
        if now.count and self.breaks(values[0] - now.end, values[4], now.activity):
            yield from self.end(state)
            state[0] = now = Segment(tuple(MOVE_QUANTITIES))
        now.add(*values, True)

    def end(self, state):
        s = state[0]
        if s.count >= 2:
            yield None, s.device, s.count, s.start, s.end, *s.statistics(), s.metres, {"lon": s.first[0], "lat": s.first[1]}, {"lon": s.lon, "lat": s.lat}, s.gain, s.loss, *s.weights


class Stays(Scan):
    """Finished stays with the sums that segments.finished_stays takes."""

    COLUMNS = Moves.COLUMNS
    STATE = f"x double, y double, n int, {Segment.FIELDS}"
    RESULT = f"device_id string, raw_point_count long, start_s long, end_s long, {statistics_of(STAY_QUANTITIES)}, box struct<w:double,s:double,e:double,n:double>, lon double, lat double"

    def __init__(self, settings: Settings):
        self.settings = settings

    def load(self, kept):
        counter, segment = StayCounter(self.settings), Segment(tuple(STAY_QUANTITIES), kept[3:] if kept else None)
        if kept:
            counter.x, counter.y, counter.n = kept[:3]
            counter.t = segment.end
        return [counter, segment]

    def dump(self, state):
        return (state[0].x, state[0].y, state[0].n, *state[1].dump())

    def step(self, state, event_id, values):
        counter, now = state
        number = counter.stay
        if counter.add(*values[:3]) != number:
            yield from self.end(state)
            state[1] = now = Segment(tuple(STAY_QUANTITIES))
        now.add(*values, False)

    def end(self, state):
        s = state[1]
        if s.count >= 2:
            yield None, s.device, s.count, s.start, s.end, *s.statistics(), dict(zip("wsen", s.box, strict=True)), s.place[0] / s.count, s.place[1] / s.count


class InOrder(StatefulProcessor):
    """Runs a scan over each subject's rows in order of time, though they arrive out of it.

    A row waits until one that is bound_s later has come; then no row that is at
    most so late can come before it any more. Rows later than that come out
    marked as late, with nothing else. A subject without rows for silence_s of
    the clock is closed: what waits is scanned, what is open ends, and its state
    is gone.
    """

    def __init__(self, scan: Scan, schema: StructType, bound_s: int, silence_s: int):
        self.scan, self.schema, self.bound_s, self.silence_s = scan, schema, bound_s, silence_s
        self.columns = ["subject_id", "late", "event_id", *(f.split()[0] for f in split_fields(scan.RESULT))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.scan.STATE)
        self.clock = handle.getValueState("clock", "frontier long, timer long")
        self.waiting = handle.getListState("waiting", self.schema)

    def scanned(self, state: Any, rows: pd.DataFrame) -> list[tuple]:
        ordered = rows.sort_values(["unix_s", "event_id"], kind="stable")
        values = zip(*(plain(ordered[c]) if c in ordered else [None] * len(ordered) for c in self.scan.COLUMNS), strict=True)
        return [out for event_id, row in zip(ordered["event_id"].tolist(), values, strict=True) for out in self.scan.step(state, event_id, row)]

    def frame(self, key, found: list[tuple], late: list[int]) -> pd.DataFrame:
        empty = (None,) * (len(self.columns) - 3)
        return pd.DataFrame([(key[0], False, *row) for row in found] + [(key[0], True, e, *empty) for e in late], columns=self.columns).astype(object).where(lambda x: x.notna(), None)

    def rows_waiting(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], columns=self.schema.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[self.schema.names]
        before, timer = tuple(self.clock.get()) if self.clock.exists() else (None, None)
        late = new["unix_s"] < before if before is not None else pd.Series(False, index=new.index)
        held = new[~late]
        if self.waiting.exists():
            held = pd.concat([self.rows_waiting(), held]) if len(held) else self.rows_waiting()
        frontier = max([int(new["unix_s"].max()) - self.bound_s, *([before] if before is not None else [])])
        state = self.scan.load(tuple(self.kept.get()) if self.kept.exists() else None)
        found = self.scanned(state, held[held["unix_s"] <= frontier])
        self.kept.update(self.scan.dump(state))
        rest = held[held["unix_s"] > frontier]
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False, name=None)])
        else:
            self.waiting.clear()
        if self.silence_s:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.silence_s
            self.handle.registerTimer(timer)
        self.clock.update((frontier, timer))
        yield self.frame(key, found, new["event_id"][late].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.scan.load(tuple(self.kept.get()) if self.kept.exists() else None)
        found = [*self.scanned(state, self.rows_waiting()), *self.scan.end(state)]
        for one in (self.kept, self.clock, self.waiting):
            one.clear()
        yield self.frame(key, found, [])

    def close(self) -> None:
        pass


def plain(column: pd.Series) -> list:
    return [None if x is None or x != x else x for x in column.tolist()]


def split_fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL text."""
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def scan_stream(points: DataFrame, scan: Scan, bound_s: int = 0, silence_s: int = 0) -> DataFrame:
    """(subject_id, late, event_id, results) of a stream of points with event_id and the scan's columns."""
    wanted = [c for c in ("event_id", *scan.COLUMNS) if c in points.columns]
    rows = points.select("subject_id", *wanted)
    kept = StructType([f for f in rows.schema.fields if f.name != "subject_id"])
    processor = InOrder(scan, kept, bound_s, silence_s)
    return rows.groupBy("subject_id").transformWithStateInPandas(processor, f"subject_id string, late boolean, event_id long, {scan.RESULT}", "Append", "ProcessingTime" if silence_s else "None")
