"""Leakage-safe features of half-hourly series.

A frame holds one series or several, told apart by `by`. Windows are partitioned by it; with the default one series is one
partition, which suits the length of a half-hourly series (17,520 rows a year); lags of huge series go by self-join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: Sequence[str], slot: str) -> Window:
    return Window.partitionBy(*by).orderBy(slot)


def lags(df: DataFrame, value: str, wanted: dict[str, int], by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Values a number of rows ago, on a grid without gaps."""
    return df.withColumns({name: F.lag(value, n).over(_order(by, slot)) for name, n in wanted.items()})


def lag_by_join(df: DataFrame, value: str, wanted: dict[str, int], by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """The same by equi join on the slot: any number of partitions serves one series."""
    for name, n in wanted.items():
        past = df.select(*by, (F.col(slot) + n).alias(slot), F.col(value).alias(name))
        df = df.join(past, [*by, slot], "left")
    return df


def rolling(df: DataFrame, value: str, name: str, rows: int, behind: int, how: str, by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Mean or median of `rows` values that end `behind` rows ago; NULL unless all are there."""
    frame = _order(by, slot).rowsBetween(-(behind + rows - 1), -behind)
    out = F.avg(value).over(frame) if how == "mean" else F.percentile(value, F.lit(0.5)).over(frame)
    return df.withColumn(name, F.when(F.count(value).over(frame) == rows, out))


def keyed_day_lag(df: DataFrame, value: str, days: int, name: str, day: str = "settlement_date", period: str = "settlement_period") -> DataFrame:
    """The value of the same period some days ago, by key: NULL where that day has no such period."""
    past = df.select(F.date_add(day, days).alias(day), period, F.col(value).alias(name))
    return df.join(past, [day, period], "left")


def calendar(hour: Column, day_of_week: Column) -> dict[str, Column]:
    """Cyclic hour (with its fraction) and day of week, Monday being 0."""
    turn = 2 * math.pi
    return {"hour_sin": F.sin(hour * turn / 24), "hour_cos": F.cos(hour * turn / 24), "dow_sin": F.sin(day_of_week * turn / 7), "dow_cos": F.cos(day_of_week * turn / 7)}


def safe_frame(df: DataFrame, horizon: int, value: str = "price", by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Lags and rolling statistics that are complete at the decision, `horizon` slots before the target: the slot of the decision is not."""
    safe = horizon + 1
    if not 0 <= horizon < 48:
        raise ValueError("the value of a day ago is not known at a decision 48 slots or more before the target")
    out = lags(df, value, {"lag_last": safe, "lag_second": safe + 1, "lag_day": 48, "lag_week": 336}, by, slot)
    out = rolling(out, value, "mean_six", 6, safe, "mean", by, slot)
    return rolling(out, value, "median_day", 48, safe, "median", by, slot)


def fraction_bounds(n: int, *shares: float) -> list[int]:
    """Row numbers at which the blocks of a chronological split end, `floor(n * share)` of cumulative shares."""
    out, total = [], 0.0
    for s in shares:
        total += s
        out.append(int(math.floor(n * total)))
    return out


def purge(block: DataFrame, next_block: DataFrame, slot: str = "slot", decision: str = "decision_slot") -> DataFrame:
    """Rows whose outcome was known before the first decision of the next block."""
    first = next_block.agg(F.min(decision).alias("_first"))
    return block.join(F.broadcast(first), (F.col(slot) + 1 <= F.col("_first")) | F.col("_first").isNull()).drop("_first")  # one row


def in_folds(df: DataFrame, folds: DataFrame, slot: str = "slot") -> DataFrame:
    """(fold, block, row): each row in the blocks of all folds that it belongs to; folds are a few dozen by construction."""
    s = F.col(slot)
    block = F.when(s < F.col("selection_start"), "train").when(s < F.col("calibration_start"), "selection").when(s < F.col("warmup_start"), "calibration").when(s < F.col("score_start"), "warmup").otherwise("score")
    return df.join(F.broadcast(folds), (s >= F.col("train_start")) & (s < F.col("score_end"))).withColumn("block", block)
