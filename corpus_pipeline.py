"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes all rows that the one before it kept and gives back the columns of documents; packing, the last, gives one
row per document with its bucket and batch. Every row is judged by itself, whether or not others have its id: of a row that
stands twice one stays, and a copy goes without the other rows of its id. Rows are told apart by a 64-bit hash of id and text.

Null, empty and letterless texts go in the first stage. Texts of any length are read whole. Ties, ids that are null among
them, are decided as each stage says. An empty table gives an empty result. Extra columns, whatever their names, stay as they are
until packing, which has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, held_out, row_key
from tidemark.llm.exact_dedup import one_of_each
from tidemark.llm.language_id import UNKNOWN, language_id, learn
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.suffix_dedup import without_repeats

#: Near copies: five-word shingles, 80 per cent.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or without text, go; no other text is rejected for being unusual."""
    profiles = learn(docs, ~held_out(F.col("doc_id")))
    lang = free_name(docs, "predicted")
    return language_id(docs, profiles, pred_col=lang, score_col=free_name(docs, "score", lang)).filter(F.col(lang) != UNKNOWN).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: most code points, then the smallest id."""
    return one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts one row stays: the smallest id, then one by a hash. A null id comes last."""
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_key("doc_id"))
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row")).alias("doc"), "text")
    judged = jaccard_components(named, SHINGLE, PERCENT, id_col="doc", id_type="struct<none:boolean,id:bigint,row:bigint>")
    dropped = judged.filter("doc.row <> component_id.row").select(F.col("doc.row").alias(row))
    return keyed.join(dropped, row, "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand twice or more go from all texts; a text of nothing else goes whole."""
    spans = free_name(docs, "spans")
    cut = without_repeats(docs, spans_col=spans)
    some = F.col(spans).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(some).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack_batches),
]

#: Language ID and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
