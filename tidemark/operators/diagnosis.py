"""What an applied correction did: gate diagnostics, the cause of an alert, and claims that a global fault blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .monitor import runs

APPLIED, DISAGREEMENT, TOLERANCE = "CONSENSUS_CLIPPED_CORRECTION", "REGIME_DISAGREEMENT_FALLBACK_FROZEN", 1e-9


def _size(c: str) -> Column:
    return F.abs(F.col(c) - F.col("actual"))


def reconstruction(rows: DataFrame) -> DataFrame:
    """rows(actual, frozen, candidate, correction, reason) with `_off`: how far a row is from what its reason allows."""
    off = F.abs(F.col("candidate") - F.col("frozen") - F.col("correction"))
    idle = F.when(F.col("reason") != APPLIED, F.greatest(F.abs("correction"), F.abs(F.col("candidate") - F.col("frozen"))))
    return rows.withColumn("_off", F.greatest(off, F.coalesce(idle, F.lit(0.0))))


def gate_diagnostics(rows: DataFrame, other: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group): how often the gate applied, how applied rows fared, and what falling back avoided against `other`.

    status is RECONSTRUCTION_FAILED if a candidate is not the frozen prediction plus its correction, or a row that fell back is not the frozen one.
    """
    on = F.col("reason") == APPLIED
    better, worse = _size("candidate") < _size("frozen"), _size("candidate") > _size("frozen")
    avoided, delta = _size(other) - _size("frozen"), _size("candidate") - _size("frozen")
    out = reconstruction(rows).groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(on).alias("applied_rows"), F.count_if(~on).alias("fallback_rows"), F.avg(on.cast("double")).alias("applied_rate"), F.count_if(F.col("reason") == DISAGREEMENT).alias("disagreement_rows"),
        F.avg(F.when(on, F.abs("correction"))).alias("mean_correction_applied"), F.count_if(on & better).alias("applied_better"), F.count_if(on & worse).alias("applied_worse"), F.count_if(on & ~better & ~worse).alias("applied_tied"),
        F.count_if(~on & (avoided > 0)).alias("fallback_other_worse"), F.count_if(~on & (avoided < 0)).alias("fallback_other_better"), F.sum(F.when(~on, avoided)).alias("fallback_avoided"), F.sum(_size(other) - _size("candidate")).alias("avoided_in_all"),
        F.sum(delta).alias("excess_error"), F.sum(F.when(on & (delta > 0), delta)).alias("harmful_error"), F.sum(F.when(on & (delta < 0), -delta)).alias("helpful_error"), F.max("_off").alias("_off"))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("mean_correction_applied", "fallback_avoided", "harmful_error", "helpful_error")}
    status = F.when(F.col("_off") > TOLERANCE, "RECONSTRUCTION_FAILED").otherwise("DESCRIPTIVE_GATE_DIAGNOSTIC")
    return out.withColumns(zero).withColumn("status", status).drop("_off")


def longest_run(rows: DataFrame, flag: Column, slot: str = "slot", by: Sequence[str] = ()) -> DataFrame:
    """The longest run of rows for which `flag` holds, the earliest of equal ones: rows, first and last slot."""
    found = runs(rows.withColumn("_flag", flag), "_flag", by, slot).filter("_flag")
    best = F.min_by(F.struct("n_rows", "first_slot", "last_slot"), F.struct(-F.col("n_rows"), F.col("first_slot"))).alias("r")
    return found.groupBy(*by).agg(best).select(*by, F.col("r.n_rows").alias("longest_run"), F.col("r.first_slot").alias("run_first"), F.col("r.last_slot").alias("run_last"))


def blocked(claims: DataFrame, blockers: DataFrame, claim: str = "claim_class", name: str = "blocker") -> DataFrame:
    """Claims with `reason`: any global blocker (a row each: missing sources, missing results) overrides every class that is not blocked."""
    why = blockers.agg(F.array_join(F.array_sort(F.collect_set(name)), "; ").alias("_why"))  # names of sources: a handful
    met = claims.crossJoin(F.broadcast(why))  # one row
    hit = (F.col("_why") != "") & (F.col(claim) != "BLOCKED_EVIDENCE")
    return met.withColumns({claim: F.when(hit, "BLOCKED_EVIDENCE").otherwise(F.col(claim)), "reason": F.when(hit, F.col("_why"))}).drop("_why")


def missing_sources(present: DataFrame, required: Sequence[str], name: str = "source") -> DataFrame:
    """(blocker) of the required sources that are not there or have no rows; present(source, n_rows)."""
    there = present.filter("n_rows > 0").select(F.col(name).alias("_name"))
    wanted = present.sparkSession.createDataFrame([(r,) for r in required], "_name string")
    return wanted.join(there, "_name", "left_anti").select(F.concat(F.lit("missing source: "), F.col("_name")).alias("blocker"))
