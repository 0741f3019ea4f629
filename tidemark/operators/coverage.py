"""Coverage of expected keys and the gates on it. One row each, lazy; `status` is PASS or BLOCKED unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(x: Column) -> Column:
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def _once(df: DataFrame, keys: Sequence[str], present: Column, name: str) -> DataFrame:
    """A row for each key: whether all its figures are there in any row, and how many rows are beyond the first."""
    return df.groupBy(*keys).agg(F.bool_or(present).alias(name), (F.count("*") - 1).alias(f"{name}_extra"))


def joint_coverage(expected: DataFrame, reference: DataFrame, system: DataFrame, keys: Sequence[str], reference_price: str, buy: str, sell: str, least: float = 0.95, most_duplicates: int = 0) -> DataFrame:
    """Shares of the expected keys with a reference price, with both system prices, and with both sources.

    Duplicates are counted over all rows, expected or not. Status PASS_REAL or BLOCKED.
    """
    ref = _once(reference, keys, F.col(reference_price).isNotNull(), "ref")
    sys = _once(system, keys, F.col(buy).isNotNull() & F.col(sell).isNotNull(), "sys").join(system.groupBy(*keys).agg(F.bool_or(F.col(buy).isNotNull()).alias("buy")), list(keys))
    met = expected.select(*keys, F.lit(1).alias("_e")).join(ref, list(keys), "full").join(sys, list(keys), "full")
    want, has = F.col("_e").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(False))
    out = met.agg(
        F.count("_e").alias("expected_keys"), _share(F.when(want, has("ref"))).alias("reference_coverage"), _share(F.when(want, has("sys"))).alias("system_coverage"), _share(F.when(want, has("ref") & has("buy"))).alias("joint_coverage"),
        F.coalesce(F.sum("ref_extra"), F.lit(0)).alias("duplicate_reference_rows"), F.coalesce(F.sum("sys_extra"), F.lit(0)).alias("duplicate_system_rows"),
    )
    good = (F.least("reference_coverage", "system_coverage", "joint_coverage") >= least) & (F.greatest("duplicate_reference_rows", "duplicate_system_rows") <= most_duplicates)
    return out.withColumn("status", F.when(good, "PASS_REAL").otherwise("BLOCKED"))


def asof_gate(targets: DataFrame, selected: DataFrame, key: str, decision: str, publish: str, least_rows: int = 500, least_coverage: float = 0.8, most_future: int = 0) -> DataFrame:
    """Targets that have a vintage known at their decision, and vintages published after it."""
    met = targets.select(key, decision).join(selected.select(key, publish), key, "left")
    out = met.agg(F.count("*").alias("n_targets"), F.count(publish).alias("n_selected"), _share(F.col(publish).isNotNull()).alias("coverage"), F.count_if(F.col(publish) > F.col(decision)).alias("future_rows"))
    good = (F.col("n_targets") >= least_rows) & (F.col("coverage") >= least_coverage) & (F.col("future_rows") <= most_future)
    return out.withColumn("status", F.when(good, "PASS").otherwise("BLOCKED"))


def stress_gate(rows: DataFrame, regime: str, price: str | None = None, by: Sequence[str] = (), least_rows: int = 500, least_coverage: float = 0.95, least_stress: int = 50) -> DataFrame:
    """Rows, share with a price, and rows of high or extreme regime that have one."""
    priced = F.lit(True) if price is None else F.col(price).isNotNull()
    out = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), _share(priced).alias("price_coverage"), F.count_if(F.col(regime).isin("high", "extreme") & priced).alias("n_stress_rows"))
    good = (F.col("n_rows") >= least_rows) & (F.col("price_coverage") >= least_coverage) & (F.col("n_stress_rows") >= least_stress)
    return out.withColumn("status", F.when(good, "PASS").otherwise("BLOCKED"))


def context_gaps(grid: DataFrame, value: str, slots: int = 9 * 48, by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """For each row the missing values among the `slots` slots before it, whether the rows of those slots exist or not."""
    w = Window.partitionBy(*by).orderBy(slot).rangeBetween(-slots, -1)
    return grid.withColumn("missing_context", F.lit(slots) - F.count(value).over(w))


def decision_clock(rows: DataFrame, target: str, decision: str, horizon: int) -> DataFrame:
    """Rows whose decision is not exactly `horizon` before the target, in the unit of both; a missing one is wrong."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.col(decision) == F.col(target) - horizon, F.lit(False))).alias("wrong_clock_rows"))
