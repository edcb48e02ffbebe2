"""Subject ids from device names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases and the patterns of the names they stand for; the first match wins.
ALIASES = (
    ("rye", "(?i)(^Rye.*|^Kitty.*|^jl$)"),
    ("ia", "(?i)(.*Papa.*|^P2$|^Isaac.*|.*moto.*|^iha$|^ia|^ubp52$)"),
    ("jr", "(?i)(^Big.*Ma.*)"),
    ("kd", "(?i)^Kayleigh.*"),
    ("kk", "(?i)(^KK.*|^kek$)"),
    ("rj", "(?i)(^Bob.*)"),
    ("pr", "(?i)(^Pam.*|^Rathbone.*)"),
    ("chishiki", "(?i)(^chishiki.*)"),
    ("mat", "(?i)(^Twenty7.*)"),
    ("ric", "(?i)(^Ric|QP1A_191005|.*marlin-Pixel-222d.*)"),
    ("jlc", "(?i)(.*Carlomag.*|^JLC$|^jlc$)"),
    ("tester", "(^tester$)"),
)
# Characters that an id may not hold.
ILLEGAL = " /()[]{}'\"`~!@#$%^&*+=|\\;:<>,.?\n\t"


def alias_or_name(name: Column, rules: tuple[tuple[str, str], ...] = ALIASES) -> Column:
    out = name
    for alias, pattern in reversed(rules):
        out = F.when(name.rlike(pattern), F.lit(alias)).otherwise(out)
    return out


def sanitized(name: Column) -> Column:
    return F.when(name == "", F.lit("_")).otherwise(F.translate(name, ILLEGAL, "_" * len(ILLEGAL)))


def subject_id(name: Column, rules: tuple[tuple[str, str], ...] = ALIASES) -> Column:
    return sanitized(alias_or_name(name, rules))
