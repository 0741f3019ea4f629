"""op9_bpe_codes: ids and decoded text of every document. SQL has no tokenizer; tests compare with the library."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_codes
from .common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
