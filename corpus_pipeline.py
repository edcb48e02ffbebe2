"""A corpus from raw documents to token digests: quality, near duplicates, surrogates, mixture, tokens.

Every stage takes all rows its predecessor kept and reads and writes whole
tables. All stages but the last return the columns of documents. Null texts
leave at the quality stage, which keeps no text under 50 words; an empty table
gives an empty result. The near-duplicate stage judges rows by their text, five
words a shingle and similarity 0.8 or more; it keeps rows that repeat an id and
are no near copies. Extra columns pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, mixing, near, pii, quality, recipe
from wayfold.llm.common import free_prefix, materialize

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_documents(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fresh = pii.replace_documents(docs, recipe.surrogate_key(spark))
    return fresh.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else fresh


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = free_prefix(docs.columns)
    taken = mixing.mix(docs, recipe.domain_of(F.col("source")), recipe.WEIGHTS, recipe.FRACTION, recipe.MAX_EPOCHS, recipe.SEED, prefix=own)
    return taken.withColumn(f"{own}epoch", F.explode(F.sequence(F.lit(1), F.col(f"{own}epochs")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, recipe.tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("surrogates", surrogate_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]

#: Models and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
