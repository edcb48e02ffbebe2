"""Mixing sources to target weights by hierarchical budgeting.

Budgets flow down a domain-language-source tree. Each node hands its budget to
its children by weight, none above what its subtree can supply (its tokens
times the epochs allowed), and what a child cannot take goes to its siblings
first; only a node whose whole subtree is short passes a shortage up. That is
water-filling at every node, solved in closed form with windows over the
per-leaf sums.

A leaf with budget b and supply s takes floor(b / s) whole epochs and, of the
next epoch, the prefix that holds the rest: documents in that epoch's own
order, a hash of seed, epoch, id and text, until their tokens reach it. The
prefix needs no global sort: the hash is cut into BINS ranges, bins below the
cut are taken whole, and only the leaf's one cut bin is ordered. A leaf that
holds a third of all rows, or an id (null or not) that does, is therefore summed
and cut like any other; only rows that repeat id and text share a bin.

Texts are read once: rows with their token counts are written to the scratch
folder, and sums, cuts and the selection read what they need of that table.

Weights are a dictionary from (domain,), (domain, lang) or (domain, lang,
source) to a number; what is not listed weighs 1, null keys are keys of their
own and are listed as None. Documents without words have no tokens and are
never taken. Repeated rows are rows of their own; ties in the order are broken
by id, then tokens. Empty tables give no rows. Columns of the input are kept,
whatever their names; what is added to them begins with a prefix of your choice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WORD_CLASS, materialize

#: Hash ranges of a leaf, and how many of them are summed together.
BINS, GROUP = 4096, 64
LEVELS = ("__domain", "__lang", "__source")


def order_key(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """60-bit position of a document in the order of an epoch, by its id and its text's MD5."""
    text = F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("-"), digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _tagged(docs: DataFrame, columns: Sequence[str], domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The input's columns as c0, c1 and so on, beside the operator's own; without rows that have no tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]
    return docs.select(
        *kept,
        F.col(id_col).alias("__id"),
        domain.alias("__domain"),
        F.col(lang_col).alias("__lang"),
        F.col(source_col).alias("__source"),
        F.regexp_count(text, F.lit(WORD_CLASS)).cast("long").alias("__tokens"),
        F.md5(text.cast("binary")).alias("__digest"),
    ).where("__tokens > 0")


def _weight(weights: Mapping[tuple, float], depth: int) -> Column:
    listed = [(k, float(w)) for k, w in weights.items() if len(k) == depth]
    out = F.lit(1.0)
    for key, w in listed:
        same = F.lit(True)
        for column, value in zip(LEVELS, key, strict=False):
            same = same & F.col(column).eqNullSafe(F.lit(value))
        out = F.when(same, F.lit(w)).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str], own: str, weights: Mapping[tuple, float], depth: int) -> DataFrame:
    """Adds __budget to children, which have __cap and their parent's __given.

    Children sorted by cap / weight: the first ones are full, the rest share
    what is left by weight. Budgets are whole tokens that add up to the
    parent's.
    """
    weighed = children.withColumn("__w", _weight(weights, depth))
    ratio = F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(F.lit(float("inf")))
    ranked = Window.partitionBy(*parent).orderBy("__ratio", F.col(own).asc_nulls_first())
    before, whole = ranked.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    left = weighed.withColumn("__ratio", ratio).select(
        "*",
        (F.col("__given") - F.coalesce(F.sum("__cap").over(before), F.lit(0))).alias("__left"),
        (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))).alias("__open"),
    )
    full = (F.col("__w") > 0) & (F.col("__cap") * F.col("__open") <= F.col("__left") * F.col("__w") * (1 + 1e-12))
    level = F.min(F.when(~full & (F.col("__w") > 0), F.struct("__ratio", F.col(own).alias("k"), (F.col("__left") / F.col("__open")).alias("level")))).over(whole)["level"]
    exact = left.select("*", F.when(F.col("__w") <= 0, F.lit(0.0)).when(full, F.col("__cap").cast("double")).otherwise(F.col("__w") * level).alias("__exact"))
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    summed = F.floor(F.sum("__exact").over(upto) + 1e-6)
    spent = exact.withColumn("__upto", summed)
    budget = F.least(F.col("__cap"), F.col("__upto") - F.coalesce(F.lag("__upto").over(ranked), F.lit(0)))
    return spent.withColumn("__budget", budget).drop("__w", "__ratio", "__left", "__open", "__exact", "__upto", "__given")


def budgets(leaf: DataFrame, weights: Mapping[tuple, float], fraction: float, max_epochs: int) -> DataFrame:
    """Leaf rows (domain, lang, source, supply, budget) from leaf rows with their supply."""
    total = leaf.agg(F.sum("__supply")).first()[0] or 0
    leaf = leaf.withColumn("__cap", F.col("__supply") * max_epochs)
    lang = leaf.groupBy(*LEVELS[:2]).agg(F.sum("__cap").alias("__cap"))
    domain = lang.groupBy(LEVELS[0]).agg(F.sum("__cap").alias("__cap"))
    one = domain.withColumn("__one", F.lit(1)).withColumn("__given", F.lit(math.floor(total * fraction)).cast("long"))
    domain = _share(one, ["__one"], LEVELS[0], weights, 1).drop("__one")
    lang = _share(_under(lang, domain, LEVELS[:1]), [LEVELS[0]], LEVELS[1], weights, 2)
    return _share(_under(leaf, lang, LEVELS[:2]), list(LEVELS[:2]), LEVELS[2], weights, 3).select(*LEVELS, "__supply", "__budget")


def _under(children: DataFrame, parents: DataFrame, keys: tuple) -> DataFrame:
    given = parents.select(*(F.col(k).alias(f"{k}_p") for k in keys), F.col("__budget").alias("__given"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_p"))
    return children.join(given, same).drop(*(f"{k}_p" for k in keys))


def _starts(bins: DataFrame) -> DataFrame:
    """Adds __start, the tokens of a leaf's earlier bins: summed over GROUP bins at a time, then within them."""
    grouped = bins.withColumn("__group", F.floor(F.col("__bin") / GROUP))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    outer = grouped.groupBy(*LEVELS, "__group").agg(F.sum("__sum").alias("__all"))
    outer = outer.withColumn("__base", F.coalesce(F.sum("__all").over(before(*LEVELS).orderBy("__group")), F.lit(0)))
    outer = outer.select(*(F.col(k).alias(f"{k}_g") for k in LEVELS), F.col("__group").alias("__g"), "__base")
    same = F.col("__group") == F.col("__g")
    for k in LEVELS:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_g"))
    inner = grouped.withColumn("__start", F.coalesce(F.sum("__sum").over(before(*LEVELS, "__group").orderBy("__bin")), F.lit(0)))
    placed = inner.join(outer, same).withColumn("__start", F.col("__start") + F.col("__base"))
    return placed.drop(*(f"{k}_g" for k in LEVELS), "__g", "__group", "__base")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[tuple, float],
    fraction: float = 0.75,
    max_epochs: int = 2,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    prefix: str = "__",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The taken rows of docs with domain, tokens, epochs and taken, each named with the prefix.

    Of the input only columns are kept, all if they are not given.

    epochs counts how often the row is taken, taken its tokens over all
    epochs: the last document of a prefix is taken whole but counts with what
    was left of the budget.
    """
    kept = list(columns or docs.columns)
    tagged = materialize(_tagged(docs, kept, domain, id_col, text_col, lang_col, source_col), "tokens-of-rows")
    leaf = materialize(tagged.groupBy(*LEVELS).agg(F.sum("__tokens").alias("__supply")), "leaves")
    plan = budgets(leaf, weights, fraction, max_epochs).where("__budget > 0").select(
        *(F.col(k).alias(f"{k}_l") for k in LEVELS),
        F.expr("__budget div __supply").alias("__whole"),
        F.pmod("__budget", "__supply").alias("__rest"),
    )
    # Written first, so that Spark knows its size and, while it is small, need not shuffle the texts.
    plan = materialize(plan, "budgets")
    same = F.lit(True)
    for k in LEVELS:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_l"))
    position = order_key(seed, F.col("__whole") + 1, F.col("__id"), F.col("__digest"))
    ordered = lambda rows: rows.withColumn("__order", position).withColumn("__bin", F.shiftright("__order", 60 - (BINS.bit_length() - 1)))
    slim = ordered(tagged.join(plan.where("__rest > 0"), same))
    bins = materialize(slim.groupBy(*LEVELS, "__bin").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest")), "bins")
    start = _starts(bins)
    cut = (
        start.where(F.col("__start") < F.col("__rest")).groupBy(*(F.col(k).alias(f"{k}_c") for k in LEVELS))
        .agg(F.max(F.struct("__bin", "__start")).alias("__cut"))
    )
    known = F.lit(True)
    for k in LEVELS:
        known = known & F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_c"))
    plan = materialize(plan.join(cut, known, "left").drop(*(f"{k}_c" for k in LEVELS)), "cuts")
    placed = ordered(tagged.join(plan, same)).drop(*(f"{k}_l" for k in LEVELS))
    inside = (F.col("__cut").isNotNull()) & (F.col("__bin") == F.col("__cut.__bin"))
    apart = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("__part", F.when(F.col("__bin") < F.col("__cut.__bin"), F.col("__tokens")).otherwise(F.lit(0)))
    ranked = Window.partitionBy(*LEVELS).orderBy("__order", "__id", "__tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__cut.__start") + F.coalesce(F.sum("__tokens").over(ranked), F.lit(0))
    in_cut = placed.where(inside).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("__tokens"), F.col("__rest") - at)))
    both = apart.unionByName(in_cut)
    chosen = both.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)),
        F.col("__domain").alias(f"{prefix}domain"),
        F.col("__tokens").alias(f"{prefix}tokens"),
        (F.col("__whole") + F.when(F.col("__part") > 0, 1).otherwise(0)).cast("int").alias(f"{prefix}epochs"),
        (F.col("__whole") * F.col("__tokens") + F.coalesce("__part", F.lit(0))).alias(f"{prefix}taken"),
    )
    return chosen.where(F.col(f"{prefix}epochs") > 0)
