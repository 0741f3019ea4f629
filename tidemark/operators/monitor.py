"""Monitoring of scored rows: cumulative and rolling errors, segments, runs, alerts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import maturity

WINDOWS = {"last_6h": 12, "last_24h": 48, "last_3d": 144, "last_7d": 336}


def cumulative_and_rolling(df: DataFrame, errors: Sequence[str], hours: Sequence[int] = (24, 72, 168), by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Running means, and means over the rows of the last hours, `(t - W, t]`, of each error column."""
    order = Window.partitionBy(*by).orderBy(slot)
    out = {"rows_so_far": F.row_number().over(order)}
    for e in errors:
        out[f"cumulative_{e}"] = F.avg(e).over(order.rowsBetween(Window.unboundedPreceding, 0))
        out |= {f"rolling_{h}h_{e}": F.avg(e).over(order.rangeBetween(-(2 * h - 1), 0)) for h in hours}
    return df.withColumns(out)


def segment_rows(df: DataFrame, segments: DataFrame, slot: str = "slot") -> DataFrame:
    """Each row in all named segments [start, end) that it is in; segments are a handful."""
    return df.join(F.broadcast(segments), (F.col(slot) >= F.col("start")) & (F.col(slot) < F.col("end")))


def runs(df: DataFrame, flag: str, by: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Maximal runs of an unchanged flag: flag, first and last slot, rows."""
    order = Window.partitionBy(*by).orderBy(slot)
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(order)).cast("int"), F.lit(1))
    marked = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", flag).agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count("*").alias("n_rows"))


def last_windows(df: DataFrame, aggregates: dict[str, Column], windows: dict[str, int] = WINDOWS, slot: str = "slot") -> DataFrame:
    """Aggregates over the last rows of each width; a window with fewer rows says what it needs and has no figures."""
    widest = max(windows.values())
    ends = df.agg(F.count("*").alias("n_all"))
    tail = df.orderBy(F.desc(slot)).limit(widest).withColumn("k", F.row_number().over(Window.orderBy(F.desc(slot))))  # `widest` rows
    spec = F.explode(F.array(*(F.struct(F.lit(n).alias("window"), F.lit(w).alias("width")) for n, w in windows.items()))).alias("w")
    each = ends.select("n_all", spec).select("n_all", "w.*")
    met = each.join(tail, (F.col("k") <= F.col("width")) & (F.col("n_all") >= F.col("width")), "left")
    status = F.when(F.first("n_all") >= F.first("width"), "OK").otherwise(F.concat(F.lit("INSUFFICIENT_ROWS_NEED_"), F.first("width").cast("string")))
    return met.groupBy("window").agg(F.first("n_all").alias("n_all"), status.alias("status"), *(c.alias(k) for k, c in aggregates.items()))


def alert_flags(w: DataFrame) -> DataFrame:
    """Alerts of the 24 hour window, once there are 48 rows: one row, ladder first."""
    trails_ref = F.col("adaptive_mae") > F.col("reference_mae")
    trails_frozen = F.col("adaptive_mae") > F.col("frozen_mae")
    worse_bias = F.abs("adaptive_bias") > F.abs("frozen_bias")
    named = F.concat_ws(",", F.when(trails_ref, "ADAPTIVE_TRAILS_REFERENCE_24H"), F.when(trails_frozen, "ADAPTIVE_TRAILS_FROZEN_24H"), F.when(worse_bias, "BIAS_CORRECTION_WORSENED_24H"))
    status = F.when(F.col("n_all") < 48, "INSUFFICIENT_SAMPLE_FOR_ALERTS").when(trails_ref | trails_frozen | worse_bias, "ALERTS_PRESENT").otherwise("NO_DEGRADATION_ALERTS")
    return w.filter("window = 'last_24h'").select("n_all", maturity(F.col("n_all")).alias("maturity_stage"), status.alias("alert_status"), F.when(F.col("n_all") < 48, "").otherwise(named).alias("alerts"))


def promotion(n: Column, criteria: dict[str, Column], least: int = 336) -> dict[str, Column]:
    """Too few rows come before any criterion; then the names of the failed ones."""
    failed = F.concat_ws(",", *(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in criteria.items()))
    status = F.when(n < least, "NOT_ELIGIBLE_INSUFFICIENT_ROWS").when(failed == "", "ELIGIBLE_FOR_REVIEW").otherwise("NOT_ELIGIBLE_PERFORMANCE_GATES")
    return {"promotion_status": status, "rows_needed": F.greatest(F.lit(least) - n, F.lit(0)), "failed_criteria": F.when(n < least, "NOT_EVALUATED_BEFORE_MINIMUM_SAMPLE").otherwise(failed)}


def pair_reason(gap_minutes: Column, checks: Sequence[tuple[Column, str]], most_gap: float = 15.0) -> Column:
    """Why a pair of records is not compared: the first check that holds, then the gap; NULL if it is accepted."""
    out = None
    for bad, why in [*checks, (gap_minutes > most_gap, "ISSUE_TIMES_TOO_FAR_APART")]:
        out = F.when(bad, why) if out is None else out.when(bad, why)
    return out
