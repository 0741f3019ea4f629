"""Writes that report on themselves, and record sets in JSON whose bad files and repeated targets are named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import write_zstd


def write_observed(df: DataFrame, path: str, figures: dict[str, Column], once: bool = True) -> dict:
    """Write df with zstd and return the figures (aggregates) of the rows as they were written: one pass, no second read."""
    watch = Observation("written")
    write_zstd(df.observe(watch, *(c.alias(k) for k, c in figures.items())), path, once)
    return watch.get


def record_set(spark: SparkSession, path: str, record: StructType, key: str, multiline: bool = False) -> DataFrame:
    """JSON records of all files of a folder, each with its file and `fault`: UNREADABLE, MISSING_KEY, REPEATED_TARGET or NULL.

    Of a repeated target all rows are named, with the number of files that hold it. Unreadable ones are counted apart, so a
    folder of broken files sends no task all its rows.
    """
    schema = StructType([*record.fields, StructField("_corrupt", StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)
    rows = raw.withColumn("file", F.col("_metadata.file_path"))
    known = rows.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files")).filter("n_rows > 1")
    met = rows.join(counts, key, "left")
    fault = F.when(F.col("_corrupt").isNotNull(), "UNREADABLE").when(F.col(key).isNull(), "MISSING_KEY").when(F.col("n_rows") > 1, "REPEATED_TARGET")
    return met.select(*record.names, "file", fault.alias("fault"), F.coalesce("n_files", F.lit(1).cast("long")).alias("n_files"))


def sound_records(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records without a fault; the first faulty one ends the job with the name of its file."""
    problem = F.concat_ws(" ", F.col("fault"), F.col("file"))
    return rows.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(problem).cast("string"))).filter("fault is null").select(*names)

