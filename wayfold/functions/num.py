"""Numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column, places: int = 0) -> Column:
    """Towards zero at a number of decimal places."""
    return F.when(x < 0, F.ceil(x, F.lit(places))).otherwise(F.floor(x, F.lit(places))).cast("double")


def finite_or(x: Column, default: float, least: float | None = None) -> Column:
    """x, or default where it is null, NaN or infinite; not below least."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = F.when(bad, F.lit(default)).otherwise(x)
    return kept if least is None else F.greatest(kept, F.lit(least))


def ewma_alpha(minutes: float, tick_s: float = 5.0) -> float:
    return 1.0 - math.exp(-tick_s / 60.0 / minutes)
