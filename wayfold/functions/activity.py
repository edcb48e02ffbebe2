"""Activities: names, codes, speed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import config as C

# Name patterns, tried in order.
NAME_PATTERNS = (("Stationary", "(?i)stationary|still"), ("Walking", "(?i)walk"), ("Running", "(?i)run"), ("Bike", "(?i)cycle|bike|biking"), ("Automotive", "(?i)drive|driving|automotive"), ("Fly", "(?i)^fly|^air"))
# Mean speeds; a standing device drifts below zero on this scale.
MEAN_SPEEDS = (("Stationary", -0.207), ("Walking", C.WALKING_MEAN), ("Running", C.RUNNING_MEAN), ("Bike", C.CYCLING_MEAN), ("Automotive", C.DRIVING_CITY), ("Fly", C.DRIVING_TOP))
CLOSEST_WITHIN = 100.0
# Plausible speed ranges, low and high, and which ends belong to them.
PLAUSIBLE = {"Stationary": (None, 0.23), "Walking": (0.0, C.WALKING_MAX), "Running": (1.2, C.RUNNING_MAX), "Bike": (1.2, C.DRIVING_HIGHWAY), "Automotive": (0.23, C.DRIVING_FAST), "Fly": (C.DRIVING_FAST, None)}


def from_string(x: Column) -> Column:
    out = F.lit(C.UNKNOWN)
    for name, pattern in reversed(NAME_PATTERNS):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def code(name: Column) -> Column:
    out = F.lit(-1)
    for k, known in enumerate(C.ACTIVITIES):
        out = F.when(name == known, F.lit(k)).otherwise(out)
    return out


def from_code(x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, C.ACTIVITIES)), F.when(x >= 0, x.cast("int") + 1)), F.lit(C.UNKNOWN))


# A picture of each activity, unknown last.
EMOJI = ("\N{STANDING PERSON}", "\N{PEDESTRIAN}", "\N{RUNNER}", "\N{BICYCLIST}", "\N{AUTOMOBILE}", "\N{AIRPLANE}", "\N{BLACK QUESTION MARK ORNAMENT}")


def emoji(name: Column) -> Column:
    at = code(name)
    return F.element_at(F.array(*map(F.lit, EMOJI)), F.when(at < 0, len(EMOJI)).otherwise(at + 1))


def delta(a: Column, b: Column) -> Column:
    return code(a) - code(b)


def is_active(name: Column) -> Column:
    return code(name) > 0


def is_human(name: Column) -> Column:
    return code(name).between(1, 3)


def reasonable(name: Column, speed: Column) -> Column:
    """Whether a speed is plausible for an activity; anything is for an unknown one."""
    return (
        F.when(name == "Stationary", speed < C.WALKING_MIN)
        .when(name == "Walking", (speed > 0) & (speed < C.WALKING_MAX))
        .when(name == "Running", (speed >= C.WALKING_MEAN) & (speed < C.RUNNING_MAX))
        .when(name == "Bike", (speed >= C.WALKING_MEAN) & (speed < C.DRIVING_HIGHWAY))
        .when(name == "Automotive", (speed >= C.WALKING_MIN) & (speed < C.DRIVING_FAST))
        .when(name == "Fly", speed >= C.DRIVING_FAST)
        .otherwise(F.lit(True))
    )


def from_speed_max(speed: Column, factor: float = 1.0, must_be_active: bool = False) -> Column:
    """The activity by upper speed bounds."""
    out = F.when(speed > C.DRIVING_TOP * factor, "Fly").when(speed > C.CYCLING_MAX * factor, "Automotive")
    out = out.when(speed > (C.RUNNING_MEAN + C.RUNNING_MAX) / 2 * factor, "Bike").when(speed > C.WALKING_MAX * factor, "Running")
    return (out if must_be_active else out.when(speed < C.WALKING_MIN, "Stationary")).otherwise("Walking")


def from_speed_closest(speed: Column) -> Column:
    """The activity with the closest mean speed; ties to the smaller code, nothing near: Stationary."""
    gaps = F.array(*(F.struct(F.abs(speed - m).alias("gap"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, m) in enumerate(MEAN_SPEEDS)))
    best = F.array_min(gaps)
    return F.when(best["gap"] < CLOSEST_WITHIN, best["name"]).otherwise("Stationary")


# The same tables for scans over plain numbers.


def reasonable_py(name: str, v: float) -> bool:
    low, high = PLAUSIBLE.get(name, (None, None))
    above = low is None or (v > low if name == "Walking" else v >= low)
    return above and (high is None or v < high)


def closest_py(v: float) -> str:
    gap, _, name = min((abs(v - m), k, n) for k, (n, m) in enumerate(MEAN_SPEEDS))
    return name if gap < CLOSEST_WITHIN else "Stationary"
