"""Metrics as aggregate columns, so that any grouping can take them. Bias is prediction minus actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import null_if_zero


def point(actual: str, prediction: str, last: str | None = None) -> dict[str, Column]:
    e = F.col(prediction) - F.col(actual)
    out = {"n_rows": F.count(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e), "p95_abs_error": F.percentile(F.abs(e), 0.95)}
    if last:
        moved = F.signum(F.col(actual) - F.col(last))
        right = F.signum(F.col(prediction) - F.col(last)) == moved
        out["direction_accuracy"] = F.avg(F.when((moved != 0) & e.isNotNull(), right.cast("double")))
    return out


def interval(actual: str, lower: str, upper: str, coverage: float) -> dict[str, Column]:
    y, lo, hi = F.col(actual), F.col(lower), F.col(upper)
    miss = F.greatest(lo - y, y - hi, F.lit(0.0))
    return {
        "n_rows": F.count("*"), "empirical_coverage": F.avg(((y >= lo) & (y <= hi)).cast("double")), "mean_width": F.avg(hi - lo), "median_width": F.percentile(hi - lo, 0.5),
        "p95_width": F.percentile(hi - lo, 0.95), "mean_interval_score": F.avg(hi - lo + miss * (2.0 / (1.0 - coverage))),
    }


def abstention(actual: str, prediction: str, lower: str, upper: str, last: str) -> dict[str, Column]:
    """Acts only if the whole interval is on one side of the last value."""
    k = F.col(last)
    signal = F.when(F.col(upper) < k, -1).when(F.col(lower) > k, 1).otherwise(0)
    moved, said = F.signum(F.col(actual) - k), F.signum(F.col(prediction) - k)
    return {
        "n_rows": F.count("*"), "n_actions": F.count_if(signal != 0), "action_rate": F.avg((signal != 0).cast("double")),
        "accuracy_on_actions": F.avg(F.when((signal != 0) & (moved != 0), (signal == moved).cast("double"))), "ungated_accuracy": F.avg(F.when(moved != 0, (said == moved).cast("double"))),
    }


def weighted_reference(df: DataFrame, keys: list[str], price: str, volume: str, flags: dict[str, Column]) -> DataFrame:
    """Volume-weighted mean, or the plain mean where the volume is 0; any-flags."""
    total = F.sum(volume)
    mean = F.coalesce(F.sum(F.col(price) * F.col(volume)) / null_if_zero(total), F.avg(price))
    return df.groupBy(*keys).agg(mean.alias("reference_price"), total.alias("reference_volume"), F.count("*").alias("n_rows"), *(F.bool_or(c).alias(k) for k, c in flags.items()))


def conformal_rank(n: int, coverage: float) -> int:
    """1-based rank of the finite-sample quantile."""
    import math

    return min(max(math.ceil((n + 1) * coverage), 1), n)


def conformal_quantile(scores: DataFrame, score: str, coverage: float, by: list[str]) -> DataFrame:
    """The k-th smallest score with k = ceil((n + 1) coverage), clipped to 1 .. n, of each group; never interpolated.

    Only distinct scores with their counts are ranked, so equal scores cost one row.
    """
    from pyspark.sql import Window

    n = scores.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_m"))
    upto = n.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*by).orderBy(score))).withColumn("n", F.sum("_m").over(Window.partitionBy(*by)))
    k = F.least(F.greatest(F.ceil((F.col("n") + 1) * coverage), F.lit(1)), F.col("n"))
    return upto.filter(F.col("_upto") >= k).groupBy(*by, "n").agg(F.min(score).alias("q")).withColumn("k", k.cast("long"))


def spread_regime(x: Column, high: Column, extreme: Column) -> Column:
    return F.when(x >= extreme, "extreme").when(x >= high, "high").when(x.isNotNull(), "normal").otherwise("missing")


def revision_regime(x: Column, tau: Column) -> Column:
    return F.when(x <= -tau, "large_down").when(x >= tau, "large_up").when(x.isNotNull(), "small").otherwise("missing")


def maturity(n: Column) -> Column:
    return F.when(n < 24, "EARLY_ONLY").when(n < 96, "INTRADAY_TO_2DAY_MONITORING").when(n < 336, "MULTIDAY_MONITORING").otherwise("ONE_WEEK_PLUS_FORWARD")
