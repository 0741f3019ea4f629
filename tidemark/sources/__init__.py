"""Scans with explicit schemas, JSON envelopes, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import nan_to_null


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; NaN in doubles reads as NULL, so that missing has one form."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: nan_to_null(F.col(c)) for c, t in df.dtypes if t == "double"})


def ledger_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, nothing read as missing."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, nullValue="\u0000", emptyValue="")


def typed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def json_records(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """Records of whole-file JSON payloads: a list, `data`, `records` or `result.records`, or one object."""
    rows = ArrayType(record)
    shapes = StructType([StructField("data", rows), StructField("records", rows), StructField("result", StructType([StructField("records", rows)]))])
    raw = spark.read.text(path, wholetext=True)
    enveloped = F.from_json("value", shapes)
    listed = F.from_json("value", rows)
    single = F.array(F.from_json("value", record))
    found = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(enveloped["data"], enveloped["result"]["records"], enveloped["records"], single))
    return raw.select(F.explode(found).alias("r")).select("r.*")


def write_zstd(df: DataFrame, path: str, once: bool = False) -> None:
    """Parquet with zstd; once: an existing target is refused, not replaced."""
    df.write.mode("errorifexists" if once else "overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("lineSep", "\n").csv(path, header=True)


def page_plan(spark: SparkSession, total: int, page: int) -> DataFrame:
    """(offset, rows) of each page of a remote scan; one task can fetch each."""
    return spark.range(0, total, page).select(F.col("id").alias("offset"), F.least(F.lit(page), F.lit(total) - F.col("id")).alias("rows"))


def count_agrees(rows: int, first_count: int, last_count: int, growing: bool = False) -> bool:
    """Whether downloaded rows fit the source's own counts taken ahead of and following the download."""
    return first_count <= rows <= last_count if growing else {rows} == {first_count, last_count}
