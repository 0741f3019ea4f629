"""Causal residual corrections. A residual is actual minus prediction; at a decision only outcomes that were complete count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import agreed_clip


@dataclass(frozen=True)
class Rule:
    """In half-hours: the horizon, the delay of an outcome, the look-backs; and the rows that each look-back needs."""

    horizon: int = 4
    delay: int = 1
    short: int = 12
    long: int = 96
    least_short: int = 8
    least_long: int = 24


def _past(by: Sequence[str], slot: str, rule: Rule, back: int) -> Window:
    """Targets whose outcome is known at the decision and that began less than `back` before it, the delay allowed for."""
    near = rule.horizon + rule.delay
    return Window.partitionBy(*by).orderBy(slot).rangeBetween(-(near + back) + 1, -near)


def mean_correction(df: DataFrame, actual: str, frozen: str, rule: Rule = Rule(), by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Mean residual of the long look-back, or 0 with too little history."""
    w = _past(by, slot, rule, rule.long)
    out = df.withColumn("residual", F.col(actual) - F.col(frozen)).withColumn("history_rows", F.count("*").over(w))
    out = out.withColumn("correction", F.when(F.col("history_rows") >= rule.least_long, F.avg("residual").over(w)).otherwise(0.0))
    return out.withColumn("corrected", F.col(frozen) + F.col("correction"))


def consensus_correction(df: DataFrame, actual: str, frozen: str, rule: Rule = Rule(), by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """The smaller of the short and the long mean residual where both have one sign, and the reason for what was done."""
    s, w = _past(by, slot, rule, rule.short), _past(by, slot, rule, rule.long)
    out = df.withColumn("residual", F.col(actual) - F.col(frozen)).withColumns({"short_rows": F.count("*").over(s), "long_rows": F.count("*").over(w), "_s": F.avg("residual").over(s), "_l": F.avg("residual").over(w), "anchor": F.last(frozen).over(w)})
    enough = (F.col("short_rows") >= rule.least_short) & (F.col("long_rows") >= rule.least_long)
    out = out.withColumns({"short_mean": F.when(enough, F.col("_s")), "long_mean": F.when(enough, F.col("_l"))}).drop("_s", "_l")
    agreed = (F.signum("short_mean") == F.signum("long_mean")) & (F.col("short_mean") != 0)
    reason = F.when(F.col("short_rows") < rule.least_short, "INSUFFICIENT_SHORT_HISTORY").when(F.col("long_rows") < rule.least_long, "INSUFFICIENT_LONG_HISTORY").when(agreed, "CONSENSUS_CLIPPED_CORRECTION").otherwise("REGIME_DISAGREEMENT_FALLBACK_FROZEN")
    out = out.withColumns({"reason": reason, "correction": F.coalesce(agreed_clip(F.col("short_mean"), F.col("long_mean")), F.lit(0.0))})
    return out.withColumn("corrected", F.col(frozen) + F.col("correction"))


def direction_veto(consensus: DataFrame, frozen: str) -> DataFrame:
    """Keeps a correction only if the prediction has moved its way since the latest row of the long look-back."""
    delta = F.col(frozen) - F.col("anchor")
    aligned = (delta != 0) & (F.signum(delta) == F.signum("correction"))
    reason = F.when(F.col("correction") == 0, F.concat(F.lit("INHERITED_"), "reason")).when(F.col("anchor").isNull(), "MISSING_CAUSAL_DIRECTION_ANCHOR_FALLBACK_FROZEN").when(aligned, "CONSENSUS_DIRECTION_ALIGNED_CORRECTION").otherwise("FROZEN_DIRECTION_VETO_FALLBACK_FROZEN")
    kept = F.when(aligned & (F.col("correction") != 0), F.col("correction")).otherwise(0.0)
    return consensus.withColumns({"veto_reason": reason, "veto_correction": kept}).withColumn("veto_prediction", F.col(frozen) + F.col("veto_correction"))
