"""What the registered mixture and the corpus pipeline share: target weights, seeds, tokenizer, key."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import pii

#: Target weights of the mixture tree; what is not listed weighs 1.
WEIGHTS = {
    ("d0",): 3.0,
    ("d1",): 2.0,
    ("d0", "en"): 2.0,
    ("d1", "de"): 2.0,
    ("d2", "es"): 1.5,
    ("d0", "en", "src0"): 2.0,
    ("d1", "en", "src1"): 3.0,
}
#: Share of the corpus's tokens that the mixture holds, epochs a document may be taken, and the order's seed.
FRACTION, MAX_EPOCHS, SEED = 0.75, 2, 20
TOKENIZER = "byte_bpe_50k.json"
#: The setting that holds the surrogates' secret; the demonstration key is for data that needs none.
KEY_SETTING = "spark.wayfold.surrogate.key"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or pii.DEMO_KEY


def domain_of(source: Column) -> Column:
    """The tree's first level: numbered sources fall into four domains."""
    number = F.try_to_number(F.substring(source, 4, 9), F.lit("999999999")).cast("long")
    return F.when(source.rlike(r"^src[0-9]{1,9}$"), F.concat(F.lit("d"), (number % 4).cast("string"))).otherwise(F.lit("other"))
