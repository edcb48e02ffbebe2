"""Thresholds and fixed values of the track engine."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400

# Speeds in metres a second and heights in metres.
WALKING_MIN, WALKING_MEAN, WALKING_MAX = 0.23, 1.2, 1.78
RUNNING_MEAN, RUNNING_MAX = 3.35, 5.56
CYCLING_MEAN, CYCLING_MAX = 5.36, 11.76
DRIVING_CITY, DRIVING_HIGHWAY, DRIVING_FAST, DRIVING_TOP = 13.9, 25.29, 44.7, 67.06
SOUND = 343.0
EVEREST, CRUISING, DEAD_SEA = 8848.0, 10668.0, -430.0

# Activity names in code order; an unknown one has code -1.
ACTIVITIES = ("Stationary", "Walking", "Running", "Bike", "Automotive", "Fly")
UNKNOWN = "Unknown"
#: Order in which ties of weights resolve.
TALLY_ORDER = (UNKNOWN, *ACTIVITIES)


@dataclass(frozen=True)
class Settings:
    """Real-world defaults; queries over sparse tables pass scaled ones."""

    accuracy_limit: float = 100.0
    teleport_window_s: int = 60
    teleport_factor: float = 5.0
    teleport_distance_m: float = 25.0
    #: Whether a point far from the one accepted in the same second is always dropped. Where it is not, infinities
    #: are compared as in the original, and a point without a time offset stays unless its speed is negative.
    teleport_same_second: bool = False
    canyon_window_s: int = 60
    canyon_distance_m: float = 200.0
    improver_interval_s: int = 30
    improver_reset_s: int = 300
    move_gap_s: int = 120
    move_min_m: float = 100.0
    stay_gap_s: int = DAY
    stay_radius_m: float = 250.0
    stay_min_s: int = 120
    stay_cap: int = 602
    cell_visit_s: int = 3_600
    admin_visit_s: int = DAY
    simplify_degrees: float = 0.00008
    #: Width of the time buckets that keep one subject from being one task.
    bucket_s: int = 30 * DAY


#: For tables whose points lie hours apart.
SPARSE = Settings(teleport_window_s=6 * 3_600, teleport_same_second=True, canyon_window_s=10 * DAY, improver_interval_s=6 * 3_600, improver_reset_s=DAY, move_gap_s=6 * 3_600, stay_gap_s=DAY, stay_radius_m=5_000.0)
