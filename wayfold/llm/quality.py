"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, native throughout.

The method compares two multinomials over hashed n-grams (single tokens and
pairs): the trusted target, texts labelled as good quality, and the raw corpus,
all documents. A document's score is the mean log ratio of its n-grams, so
length cancels; it is kept when the score reaches a fixed threshold, the same
for every document. Runs of symbols count as tokens of their own.

Everything about a row is computed inside the row, without any shuffle. The
only shuffle is the corpus count, one row per bucket and task. The model is a
fixed number of buckets, so it travels in the plan as a literal.

Null and blank texts have zero counts and fail the base rule. Repeated rows
count each time and get the same verdict. An empty trusted set makes every
ratio zero, which keeps what the base rule keeps. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import double_literal, let, words_of

BUCKETS = 1 << 16
#: Mean log ratio an n-gram that a document must reach.
THRESHOLD = -0.3
#: At most so many trusted texts make the target; the lowest id hashes are taken.
MAX_TRUSTED = 20_000
SYMBOL_RUN = r"([#*$%&|<>!]+)"


def tokens_of(text: Column) -> Column:
    return words_of(F.regexp_replace(text, SYMBOL_RUN, " $1 "))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Each window hash is packed above its position into one long, which drops its
    top bits; after sorting, equal windows are neighbours, and neighbours are
    compared by whole hash. Another window with the same lower bits could stand
    between two equal ones: odds of n^3 / 2^(64 - log n) for n windows, ignored.
    """

    def marked(h: Column, bits: Column) -> Column:
        at = lambda x: F.get(h, F.pmod(x, F.call_function("shiftleft", F.lit(1).cast("long"), bits)).cast("int"))
        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))

        def positions(ranked: Column) -> Column:
            same = lambda x, i: F.coalesce(at(x) == at(F.get(ranked, i)), F.lit(False))
            position = lambda x: F.pmod(x, F.call_function("shiftleft", F.lit(1).cast("long"), bits))
            found = F.transform(ranked, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), position(x)))
            return F.array_compact(found)

        def covered(start: Column) -> Column:
            spread = F.concat(start, F.transform(start, lambda p: p + 1), F.transform(start, lambda p: p + 2))
            return F.size(F.array_distinct(spread))

        return let(let(F.sort_array(packed), positions), covered)

    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    whole = lambda h: let(F.length(F.bin(F.size(h).cast("long"))), lambda bits: marked(h, bits))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(whole(h)))


def base_counts(text: Column, words: Column) -> Column:
    """Struct of the base counts, given a non-null text and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def bucket(h: Column) -> Column:
    """Bucket of a hash; their number is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def bucket_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(bucket, raw, target) counts over all documents; target counts the trusted ones."""
    trusted = (
        labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__t")).where("__t is not null")
        .orderBy(F.xxhash64("__t"), "__t").limit(max_trusted).distinct().withColumn("__good", F.lit(1))
    )
    marked = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__text")).join(F.broadcast(trusted), F.col("__d") == F.col("__t"), "left")
    pairs = marked.select("__good", F.inline(let(tokens_of(F.coalesce("__text", F.lit(""))), lambda t: F.arrays_zip(t.alias("a"), F.slice(t, F.lit(2), F.size(t)).alias("b")))).alias("a", "b"))
    grams = pairs.select("__good", F.explode(F.array(bucket(F.xxhash64("a")), bucket(F.xxhash64("a", "b")))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__good").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> list[float]:
    """Log ratios of the buckets; a fixed-size model.

    The target is smoothed towards the raw corpus by as many counts as there
    are buckets, the raw corpus by one count a bucket.
    """
    counts = {r.bucket: (r.raw, r.target) for r in bucket_counts(docs, labels, **columns).collect()}
    raw, target = (sum(x[k] for x in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * BUCKETS
    model = []
    for b in range(BUCKETS):
        r, t = counts.get(b, (0, 0))
        base = (r + 1) / (raw + BUCKETS)
        model.append(round(math.log((t + BUCKETS * base) / (target + BUCKETS)) - math.log(base), 6))
    return model


def ratio(tokens: Column, model: list[float]) -> Column:
    """Mean log ratio of a token array's n-grams (no tokens: 0)."""
    table = double_literal(model)
    look = lambda h: F.get(table, bucket(h))
    each = F.transform(tokens, lambda t, i: look(F.xxhash64(t)) + look(F.xxhash64(t, F.get(tokens, i + 1))))
    return F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 2 * F.size(tokens)), F.lit(0.0))


def verdict(model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> Column:
    """Struct of base counts, base_failed, ratio and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = lambda w: F.when(text.rlike(SYMBOL_RUN), tokens_of(text)).otherwise(w)
    failed = lambda c: (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    parts = lambda w: F.struct(base_counts(text, w).alias("c"), let(tokens(w), lambda t: ratio(t, model)).alias("ratio"))
    return let(
        let(words_of(text), parts),
        lambda x: F.struct(
            *(x["c"][n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed(x["c"]).alias("base_failed"),
            (~failed(x["c"]) & (x["ratio"] >= threshold)).alias("kept"),
            x["ratio"].alias("ratio"),
        ),
    )


def assess(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the verdict as column __quality, in place of any such column of theirs."""
    return docs.withColumn("__quality", verdict(model, text_col, threshold))


def filter_documents(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules reject."""
    return docs.where(verdict(model, text_col, threshold)["kept"])
