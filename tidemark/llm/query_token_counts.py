"""op8_token_counts: tokens of every document under the byte-level vocabulary. SQL has no tokenizer; tests compare with the library."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .token_counts import token_counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
