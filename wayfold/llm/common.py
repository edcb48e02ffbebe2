"""Shared helpers of the training-data operators: let-bindings, model literals; scratch tables come with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.scratch import materialize, scratch_dir

__all__ = ["SPACE_CLASS", "WORD_CLASS", "crc_mod", "double_literal", "free_prefix", "let", "materialize", "number_rows", "scratch_dir", "words_of"]

#: The word separators of the contracts: space and \x09-\x0D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body.

    Projections that are merely named can be inlined by the optimizer, which
    would evaluate them once for each use inside a lambda; a lambda variable
    cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_prefix(columns: Iterable[str]) -> str:
    """Underscores, two at least, that begin none of the names."""
    prefix, names = "__", [c.lower() for c in columns]
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def words_of(text: Column) -> Column:
    """Words of a text (null: none) by the contract's separators."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def double_literal(values: Iterable[float]) -> Column:
    """A constant array<double>; the optimizer folds the cast into one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def number_rows(df: DataFrame, order: list[Column], name: str, into: str) -> DataFrame:
    """Adds a gapless long from 0 by an order over all rows, without a task that sees them all.

    Rows are sorted over range partitions and written with their place in their
    partition; only the partitions' sizes are summed up and broadcast. An order
    that ends with a column of distinct values splits any group of ties.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = free_prefix([*df.columns, into])
    place = F.col(f"{own}place")
    kept = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(f"{own}place", F.monotonically_increasing_id()), name)
    part = F.shiftright(place, 33).alias(f"{own}part")
    sizes = kept.groupBy(part).agg(F.count("*").alias(f"{own}n"))
    before = F.coalesce(F.sum(f"{own}n").over(Window.orderBy(f"{own}part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(f"{own}part", before.alias(f"{own}before"))
    found = kept.withColumn(f"{own}part", part).join(F.broadcast(starts), f"{own}part")
    return found.withColumn(into, F.col(f"{own}before") + place.bitwiseAND(F.lit((1 << 33) - 1))).drop(f"{own}part", f"{own}place", f"{own}before")
