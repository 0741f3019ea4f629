"""Blinded counts and the ladders that turn them into a status, and the live forecast at a decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import agreed_clip


def blinded_counts(rows: DataFrame, grid: DataFrame, required: Sequence[str], key: str, decision: str, publish: str) -> DataFrame:
    """Counts only, no figure of merit: complete rows, distinct ones on the grid, duplicates, off-grid rows, future publications."""
    complete = rows.dropna(subset=list(required))
    marked = complete.join(grid.select(key).withColumn("_on", F.lit(1)), key, "left")
    each = marked.groupBy(key).agg(F.count("*").alias("n"), F.max("_on").alias("on"), F.count_if(F.col(publish) > F.col(decision)).alias("future"))
    out = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("complete_rows"), F.count("on").alias("on_grid_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("on").isNull(), F.col("n"))), F.lit(0)).alias("off_grid_rows"), F.coalesce(F.sum("future"), F.lit(0)).alias("future_rows"),
    )
    return out.join(F.broadcast(grid.agg(F.count("*").alias("expected_rows"))))  # one row by one row


def blinded_status(need: int, least_coverage: float, elapsed: Column) -> Column:
    """Coverage by rows, duplicates included: future, coverage, accumulation, then eligible."""
    coverage = F.col("complete_rows") / F.col("expected_rows")
    blocked = (F.col("future_rows") > 0) | ((F.col("expected_rows") > 0) & (coverage < least_coverage))
    return F.when(blocked, "BLOCKED_EVIDENCE").when(~elapsed | (F.col("complete_rows") < need), "BLINDED_ACCUMULATION").otherwise("REVEAL_ELIGIBLE")


def sealed_status(need: int, least_coverage: float, elapsed: Column) -> Column:
    """Coverage by distinct rows on the grid: duplicates, off-grid, future, coverage, accumulation, missing, then eligible."""
    on, expected = F.col("on_grid_rows"), F.col("expected_rows")
    early = (F.col("duplicate_rows") > 0) | (F.col("off_grid_rows") > 0) | (F.col("future_rows") > 0) | ((expected > 0) & (on / expected < least_coverage))
    return F.when(early, "BLOCKED_EVIDENCE").when(~elapsed | (on < need), "SEALED_ACCUMULATION").when(on < expected, "BLOCKED_EVIDENCE").otherwise("SEALED_REVEAL_ELIGIBLE")


def prospective_status(rows: Column, coverage: Column, future: Column, need: int = 672, least_coverage: float = 0.8) -> Column:
    return F.when((rows == 0) | (coverage < least_coverage) | (future > 0), "BLOCKED_EVIDENCE").when(rows < need, "SHADOW_ONLY").otherwise("PROSPECTIVE_EVIDENCE_READY")


def live_forecasts(grid: DataFrame, price: str, by: Sequence[str] = (), slot: str = "slot", lead: int = 4, day: int = 48, delay: int = 3) -> DataFrame:
    """At every decision slot: the previous day's price of the target `lead` slots on, and its corrections.

    A residual is price minus the previous day's price; it is known `1 + delay` slots after its start. The grid must have
    every slot. Short and long look-backs are 6 and 48 hours of what has become known.
    """
    order = Window.partitionBy(*by).orderBy(slot)
    known = 1 + delay
    past = lambda back: order.rangeBetween(-(known + back) + 1, -known)
    out = grid.withColumn("_day", F.lag(price, day).over(order)).withColumn("_residual", F.col(price) - F.col("_day"))
    out = out.withColumn("_base", F.when(F.col("_residual").isNotNull(), F.col("_day")))
    out = out.withColumns({"baseline": F.lag(price, day - lead).over(order), "short_rows": F.count("_residual").over(past(12)), "long_rows": F.count("_residual").over(past(96)), "short_mean": F.avg("_residual").over(past(12)), "long_mean": F.avg("_residual").over(past(96)), "_anchor": F.last("_base", ignorenulls=True).over(past(96))})
    enough = (F.col("short_rows") >= 8) & (F.col("long_rows") >= 24)
    proposal = F.when(enough, F.coalesce(agreed_clip(F.col("short_mean"), F.col("long_mean")), F.lit(0.0))).otherwise(0.0)
    out = out.filter("baseline is not null").withColumn("proposal", proposal)
    delta = F.col("baseline") - F.col("_anchor")
    aligned = (F.col("proposal") != 0) & (delta != 0) & (F.signum(delta) == F.signum("proposal"))
    reason = F.when(~enough, "INSUFFICIENT_CAUSAL_HISTORY").when(F.col("proposal") == 0, "RESIDUAL_SIGN_DISAGREEMENT").when(F.col("_anchor").isNull(), "NO_CAUSAL_ANCHOR").when(aligned, "DIRECTION_ALIGNED_CORRECTION").otherwise("BASE_DIRECTION_VETO")
    return out.select(*by, slot, (F.col(slot) + lead).alias("target_slot"), "baseline", "short_rows", "long_rows", (F.col("baseline") + F.col("proposal")).alias("consensus"), (F.col("baseline") + F.when(aligned, F.col("proposal")).otherwise(0.0)).alias("direction_veto"), reason.alias("reason"))
