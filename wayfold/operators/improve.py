"""Activity re-inference from reports, speeds and stillness."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold import config as C
from wayfold.config import Settings
from wayfold.functions.activity import closest_py, reasonable_py
from wayfold.functions.geo import distance_py
from wayfold.functions.num import ewma_alpha
from wayfold.operators.clean import with_resets
from wayfold.operators.ordered import scan_runs

ALPHA = ewma_alpha(0.5)
CODES = {name: k for k, name in enumerate(C.ACTIVITIES)} | {C.UNKNOWN: -1}
GYRO_STILL, GYRO_SEEN = 0.01, 60


class Ewma:
    """An average of ticks of varying length; the first tick sets it."""

    def __init__(self, scale: float = 1.0):
        self.scale, self.rate, self.started = scale, 0.0, False

    def tick(self, x: float, seconds: float) -> None:
        now = math.floor(x * self.scale + 0.5) / max(1, int(seconds))
        self.rate, self.started = (self.rate + ALPHA * (now - self.rate), True) if self.started else (now, True)

    @property
    def value(self) -> float:
        return self.rate / self.scale


class Modes:
    """Weights of activities over the last interval, kept in arrival order."""

    def __init__(self, interval: float):
        self.interval, self.rows, self.sums = interval, deque(), {}

    def push(self, t: float, name: str, weight: float) -> None:
        self.rows.append((t, name, weight))
        self.sums[name] = self.sums.get(name, 0) + weight
        while self.rows and t - self.rows[0][0] > self.interval:
            _, old, w = self.rows.popleft()
            self.sums[old] -= w

    def ranked(self) -> list[tuple[str, float]]:
        return sorted(self.sums.items(), key=lambda x: (-x[1], CODES[x[0]]))


    STATE = "t array<long>, name array<string>, weight array<double>, names array<string>, sums array<double>"

    def dump(self) -> tuple:
        t, name, weight = ([r[k] for r in self.rows] for k in range(3))
        return t, name, [float(w) for w in weight], list(self.sums), [float(w) for w in self.sums.values()]

    def load(self, kept: tuple) -> None:
        t, name, weight, names, sums = kept
        self.rows, self.sums = deque(zip(t, name, weight, strict=True)), dict(zip(names, sums, strict=True))


def finite(x, default: float) -> float:
    return default if x is None or not math.isfinite(x) else float(x)


class Improver:
    """The state of one device's stretch of points."""

    def __init__(self, settings: Settings):
        self.settings, self.last_t = settings, None
        self.fresh()

    def fresh(self) -> None:
        s = self.settings
        self.speed, self.calc, self.gyro = Ewma(100), Ewma(100), Ewma(1000)
        self.reported, self.canonical = Modes(s.improver_interval_s), Modes(s.improver_interval_s)
        self.first_t, self.place, self.gyro_seen, self.last_speed, self.activity, self.acceleration = None, None, 0, 0.0, C.UNKNOWN, 0.0

    def add(self, t: int, lon: float, lat: float, row_offset: float, accuracy, speed, heading, name: str, gyro=None) -> str:
        offset = row_offset if self.last_t is None else t - self.last_t
        if self.last_t is not None and (offset <= -1 or offset > self.settings.improver_reset_s):
            self.fresh()
            offset = row_offset
        if self.first_t is None:
            self.first_t = t
        if offset == 0:
            return self.activity
        safe_speed = max(0.0, finite(speed, 0.0))
        self.speed.tick(safe_speed, offset)
        if self.place:
            self.calc.tick(distance_py(*self.place, lon, lat) / offset, offset)
        if max(1.0, finite(accuracy, 100.0)) < 100:
            self.place = (lon, lat)
        if gyro is not None:
            self.gyro.tick(gyro, offset)
            self.gyro_seen += offset
        self.acceleration = (safe_speed - self.last_speed) / offset
        self.reported.push(t, name, offset)
        proposal = self.propose(t, safe_speed, finite(speed, -1.0), finite(heading, -1.0), name, gyro is not None)
        self.activity, self.last_speed, self.last_t = proposal, safe_speed, t
        self.canonical.push(t, proposal, row_offset)
        return proposal

    def row(self, t, lon, lat, offset, accuracy, speed, heading, name, gyro=None) -> str:
        """add() for a table's values, which may be missing."""
        return self.add(t, lon, lat, finite(offset, 1), accuracy, speed, heading, name if name in CODES else C.UNKNOWN, None if gyro is None or math.isnan(gyro) else gyro)

    #: What outlives a push, by name and type.
    STATE = f"last_t long, first_t long, lon double, lat double, gyro_seen long, last_speed double, activity string, acceleration double, rates array<double>, started array<boolean>, reported struct<{Modes.STATE.replace(' ', ':').replace(',:', ', ')}>, canonical struct<{Modes.STATE.replace(' ', ':').replace(',:', ', ')}>"

    def dump(self) -> tuple:
        lon, lat = self.place or (None, None)
        averages = (self.speed, self.calc, self.gyro)
        return self.last_t, self.first_t, lon, lat, int(self.gyro_seen), float(self.last_speed), self.activity, float(self.acceleration), [float(a.rate) for a in averages], [a.started for a in averages], self.reported.dump(), self.canonical.dump()

    def load(self, kept: tuple) -> None:
        self.last_t, self.first_t, lon, lat, self.gyro_seen, self.last_speed, self.activity, self.acceleration, rates, started, reported, canonical = kept
        self.place = None if lon is None else (lon, lat)
        for average, rate, begun in zip((self.speed, self.calc, self.gyro), rates, started, strict=True):
            average.rate, average.started = rate, begun
        self.reported.load(reported)
        self.canonical.load(canonical)

    def propose(self, t: int, safe: float, speed: float, heading: float, name: str, has_gyro: bool) -> str:
        rate, calc = self.speed.value, self.calc.value
        slow = min(rate, calc) if t - self.first_t > self.settings.improver_interval_s else min(rate, safe)
        still = name == "Stationary" or slow < C.WALKING_MIN
        if has_gyro and self.gyro_seen > GYRO_SEEN and self.gyro.value < GYRO_STILL and still:
            return "Stationary"
        if heading < 0 and speed < 0 and still:
            return "Stationary"
        known = name != C.UNKNOWN
        if known and reasonable_py(name, slow):
            return name
        fits = lambda modes, v: next((a for a, w in modes if w > 0 and a != C.UNKNOWN and reasonable_py(a, v)), None)
        if not known:
            ranked = self.reported.ranked()
            if ranked and ranked[0][0] == "Walking" and not reasonable_py("Walking", safe) and reasonable_py("Automotive", slow):
                return "Automotive"
            return fits(ranked, safe) or fits(self.canonical.ranked(), safe) or closest_py(safe)
        if max(rate, calc) > C.DRIVING_FAST:
            return "Fly"
        return fits(self.canonical.ranked(), calc) or closest_py(calc)


#: Upper speeds of activities by what a window's mean speed shows, slowest first; faster than all is a flight.
PACES = ((C.WALKING_MAX, "Walking"), (C.RUNNING_MAX, "Running"), (C.CYCLING_MAX, "Bike"), (C.DRIVING_TOP, "Automotive"))


class WindowImprover:
    """The older form: the leading report of a window of points, looked at once an interval.

    A point within a second of the last one taken changes nothing. Where the
    leading known report moves, it becomes the activity; where it is stationary
    or none is known, the mean of the window's reported and calculated speeds
    decides. Points of a window are summed up only when they are looked at, so
    a window is read once an interval.
    """

    def __init__(self, settings: Settings):
        self.settings = settings
        self.fresh()

    def fresh(self) -> None:
        self.t = self.place = self.checked = None
        self.activity, self.window = C.UNKNOWN, deque()

    def add(self, t: int, lon: float, lat: float, speed, name: str) -> str:
        keep = self.settings.improver_interval_s
        if self.t is not None:
            if not -1 <= t - self.t <= self.settings.improver_reset_s:
                gone_back = t < self.t
                self.fresh()
                if gone_back:
                    return self.activity
            elif t - self.t <= 1:
                return self.activity
        while self.window and t - self.window[0][0] > keep:
            self.window.popleft()
        reported = finite(speed, -1.0)
        offset = 1 if self.t is None else min(t - self.t, keep)
        calculated = distance_py(*self.place, lon, lat) / offset if self.window else max(reported, 0.0)
        self.window.append((t, offset, name, reported * offset, calculated * offset))
        self.t, self.place = t, (lon, lat)
        if self.checked is None or t - self.checked > keep:
            self.checked, self.activity = t, self.decide()
        return self.activity

    def decide(self) -> str:
        weights = dict.fromkeys(C.ACTIVITIES, 0)
        for _, offset, name, _, _ in self.window:
            if name in weights:
                weights[name] += offset
        leader = max(C.ACTIVITIES, key=lambda a: (weights[a], -CODES[a]))
        if leader != "Stationary":
            return leader
        span = sum(row[1] for row in self.window)
        speed = (sum(row[3] for row in self.window) / span + sum(row[4] for row in self.window) / span) / 2
        if speed <= C.WALKING_MIN:
            return leader
        return next((name for top, name in PACES if speed <= top), "Fly")


def improve_by_windows(tracks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Replaces activity by the older form; state resets after a long silence."""
    kept = [f for f in tracks.schema.fields if f.name != "activity"]
    schema = T.StructType([*kept, T.StructField("activity", T.StringType())])
    runs = with_resets(tracks, F.col("unix_s") - F.col("prev.unix_s") > settings.improver_reset_s, settings)
    finish = lambda batch, found: batch.assign(activity=found)
    return scan_runs(runs, ("unix_s", "event_id"), ("unix_s", "lon", "lat", "speed", "activity"), lambda: WindowImprover(settings), WindowImprover.add, finish, schema)


def improve(tracks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Replaces activity and adds acceleration.

    State resets after a long silence and on a change of device, so a subject
    is scanned as many independent stretches.
    """
    kept = [f for f in tracks.schema.fields if f.name not in ("activity", "acceleration")]
    schema = T.StructType([*kept, T.StructField("activity", T.StringType()), T.StructField("acceleration", T.DoubleType())])
    new = (F.col("unix_s") - F.col("prev.unix_s") > settings.improver_reset_s) | ~F.col("device_id").eqNullSafe(F.col("prev.device_id"))
    runs = with_resets(tracks, new, settings, ("unix_s", "device_id"))
    columns = ["unix_s", "lon", "lat", "time_offset", "accuracy", "speed", "heading", "activity", *(["gyro_sum"] if "gyro_sum" in tracks.columns else [])]

    def step(state: Improver, *values) -> tuple[str, float]:
        return state.row(*values), state.acceleration

    def finish(batch: pd.DataFrame, found: list) -> pd.DataFrame:
        return batch.assign(activity=[a for a, _ in found], acceleration=[x for _, x in found])

    return scan_runs(runs, ("unix_s", "event_id"), columns, lambda: Improver(settings), step, finish, schema)
