"""Block bootstrap. Draws come from md5, so that any engine can repeat them: `md5(seed-replicate-draw)`, first 8 hex digits, modulo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(seed: int, replicate: Column, i: Column, n: Column) -> Column:
    key = F.concat(F.lit(f"{seed}-"), replicate.cast("string"), F.lit("-"), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), n)


def block_means(blocks: DataFrame, value: str, rows: str, replicates: int, seed: int) -> DataFrame:
    """blocks(k = 0 .. n-1, sums, rows) to (replicate, mean): n blocks drawn with replacement in each replicate.

    The draws are made where they are needed and meet the block sums by a join; sums are one row a block, so the join side
    is the number of days, not of rows.
    """
    n = blocks.agg(F.count("*").alias("n"))
    grid = blocks.sparkSession.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(n))  # one row
    draws = grid.filter("n > 0").select("replicate", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    picked = draws.select("replicate", draw(seed, F.col("replicate"), F.col("i"), F.col("n")).alias("k"))
    return picked.join(blocks, "k").groupBy("replicate").agg((F.sum(value) / F.sum(rows)).alias("mean"))


def percentile_interval(means: DataFrame, value: str = "mean") -> DataFrame:
    """95 per cent interval and where it lies."""
    out = means.agg(F.count("*").alias("n_replicates"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.5).alias("middle"), F.percentile(value, 0.975).alias("high"))
    return out.withColumn("classification", F.when(F.col("high") < 0, "NEGATIVE").when(F.col("low") > 0, "POSITIVE").otherwise("INCONCLUSIVE"))


def moving_block_sums(series: DataFrame, value: str, block: int) -> DataFrame:
    """series(k = 0 .. n-1, value): the sum of the `block` values from each start, by prefix sums and one self-join."""
    running = series.select("k", F.sum(value).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.col(value).alias("own"))
    end = running.select((F.col("k") - (block - 1)).alias("k"), F.col("upto").alias("end"))
    return running.join(end, "k").select("k", (F.col("end") - F.col("upto") + F.col("own")).alias("block_sum"))


def moving_means(series: DataFrame, values: Sequence[str], block: int, replicates: int, seed: int, rows: int) -> DataFrame:
    """(replicate, mean of each value): moving blocks of `block` rows of series(k = 0 .. rows-1, values), cut to `rows` in all.

    A replicate draws ceil(rows / block) starts, the same for all values, so that they are compared on the same blocks. Draws meet
    sums of blocks, one row a start, so what is joined is replicates x draws narrow rows, however long a block is.
    """
    if not 0 < block <= rows:
        raise ValueError("a block has between one row and all of them")
    draws = -(-rows // block)
    rest = rows - (draws - 1) * block
    running = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one series: its length is that of its grid
    upto = series.select("k", *(F.sum(v).over(running).alias(v) for v in values))
    before = upto.select((F.col("k") + 1).alias("k"), *(F.col(v).alias(f"{v}_before") for v in values))

    def sums(width: int, suffix: str) -> DataFrame:
        end = upto.select((F.col("k") - (width - 1)).alias("k"), *values).filter("k >= 0")
        return end.join(before, "k", "left").select("k", *((F.col(v) - F.coalesce(F.col(f"{v}_before"), F.lit(0.0))).alias(f"{v}{suffix}") for v in values))

    starts = sums(block, "").join(sums(rest, "_rest"), "k")
    drawn = replicate_grid(series.sparkSession, replicates, draws).withColumn("k", draw(seed, F.col("replicate"), F.col("i"), F.lit(rows - block + 1)))
    part = lambda v: F.when(F.col("i") < draws - 1, F.col(v)).otherwise(F.col(f"{v}_rest"))
    return drawn.join(starts, "k").groupBy("replicate").agg(*((F.sum(part(v)) / rows).alias(v) for v in values))


def intervals(means: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, value, replicates, 95 per cent interval, share above 0, class): a row for each value."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("mean")) for v in values)))
    out = means.select(*by, each.alias("e")).groupBy(*by, F.col("e.value").alias("value")).agg(
        F.count("*").alias("n_replicates"), F.percentile("e.mean", 0.025).alias("low"), F.percentile("e.mean", 0.975).alias("high"), F.avg((F.col("e.mean") > 0).cast("double")).alias("share_above_0"))
    return out.withColumn("classification", F.when(F.col("low") > 0, "SUPPORTS_LOWER_ERROR").when(F.col("high") < 0, "SUPPORTS_HIGHER_ERROR").otherwise("INTERVAL_INCLUDES_ZERO"))


def gated(interval: DataFrame, days: DataFrame, least_days: int, least_rows: int = 0, day_rows: int | None = None, rows: str = "rows") -> DataFrame:
    """The interval with `gate`; its figures are NULL where days (one row each, `rows` half-hours) are too few, or none.

    With day_rows only days of exactly so many rows count.
    """
    counted = days.agg(F.count_if(F.col(rows) == day_rows if day_rows else F.col(rows) > 0).alias("days"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows_in_all"))
    met = counted.join(interval, how="left").fillna(0, ["n_replicates"])  # one row by a few
    gate = F.when(F.col("rows_in_all") < least_rows, "INSUFFICIENT_ROWS").when(F.col("days") < least_days, "INSUFFICIENT_DAYS").otherwise("EVALUATED")
    out = met.withColumn("gate", gate)
    return out.withColumns({c: F.when(F.col("gate") == "EVALUATED", F.col(c)) for c in interval.columns if c not in ("value", "n_replicates")}).drop("rows_in_all")


def replicate_grid(spark: SparkSession, replicates: int, draws: int) -> DataFrame:
    return spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("i"))
