"""Content identity of frames and grids: digests that do not depend on how rows are dealt, and ones that keep their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX = 15


def row_text(columns: Sequence[str]) -> Column:
    """Fields as text, each with its length before it, so that no two rows read alike; NULL has its own mark."""
    return F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))


def row_number_of(text: Column) -> Column:
    """The first 60 bits of a row's SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, HEX), 16, 10).cast("decimal(38,0)")


def digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, total): a count and a sum of row digests for each part, the same in whatever order rows come.

    A sum of 60-bit numbers in 38 digits holds more rows than any table has. Rows are told apart with their repeats, as a sum
    counts each. It adds up on the map side, and a part may hold any share of the rows.
    """
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(row_number_of(row_text(columns))).alias("total"))


def compare(locked: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts of two digests with `state`: SAME, CHANGED, ROWS_ADDED, ROWS_LOST, MISSING (only locked) or NEW (only current)."""
    side = lambda df, k: df.select(*by, F.col("n_rows").alias(f"n_{k}"), F.col("total").alias(f"total_{k}"))
    met = side(locked, "locked").join(side(current, "now"), list(by), "full_outer")
    a, b = F.col("n_locked"), F.col("n_now")
    state = F.when(b.isNull(), "MISSING").when(a.isNull(), "NEW").when(b > a, "ROWS_ADDED").when(b < a, "ROWS_LOST").when(F.col("total_locked") != F.col("total_now"), "CHANGED").otherwise("SAME")
    return met.select(*by, a, b, "total_locked", "total_now", state.alias("state"))


def verdict(parts: DataFrame) -> DataFrame:
    """One row: how many parts there are, how many differ, and whether the frame is the one that was locked."""
    out = parts.agg(F.count("*").alias("n_parts"), F.count_if(F.col("state") != "SAME").alias("n_different"))
    return out.withColumn("status", F.when(F.col("n_different") == 0, "CONTENT_REPRODUCED").otherwise("CONTENT_DIFFERS"))


def ordered_digest(rows: DataFrame, text: str, order: str, bucket: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, sha256): the digest of a sequence, from those of consecutive ranges of it.

    `bucket` rises with the order and bounds how many rows one digest joins. A range gives the SHA-256 of its lines; the whole gives that of its
    ranges' digests in order, so ranges are digested in parallel and only their digests meet.
    """
    lines = lambda x, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(x).alias("x")))), lambda r: r["x"]), "\n")
    ranges = rows.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sha2(lines(text, order), 256).alias("part"))
    return ranges.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sha2(lines("part", "bucket"), 256).alias("sha256"))


def with_unknown_grid(history: DataFrame, grid: DataFrame, key: str, value: str) -> DataFrame:
    """History and the targets of a grid that it does not have yet, these with NULL; known targets of the grid stay known.

    The grid's columns other than the key fill those of the same name.
    """
    unknown = grid.join(history.select(key), key, "left_anti").withColumn(value, F.lit(None).cast(history.schema[value].dataType))
    return history.unionByName(unknown, allowMissingColumns=True)
