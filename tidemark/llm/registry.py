"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module of this subpackage that has `query(spark, sf_dir)` and perhaps `ORACLE_SQL`.
MODULES = {
    "op1_hilbert_ann": "hilbert_ann",
    "op2_repeated_passages": "suffix_dedup",
    "op3_language_id": "language_id",
    "op4_ngram_join": "ngram_join",
    "op5_length_buckets": "packing",
    "op6_url_rules": "url_rules",
    "op7_grace_dedup": "query_exact_dedup",
    "op8_token_counts": "query_token_counts",
    "op9_bpe_codes": "query_bpe",
    "op10_toxicity": "toxicity",
    "op11_embedding_cells": "cell_dedup",
    "op12_vector_codes": "vector_codes",
    "op13_lexical_rank": "lexical_rank",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
