"""Scored prediction streams: residual corrections from scored history, comparison of two streams, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import agreed_clip
from .monitor import pair_reason

DAY, BUCKET = 48, 96


def scored_history(decisions: DataFrame, scores: DataFrame, by: Sequence[str] = (), settle: int = 4, short: int = 12, long: int = 96, least_short: int = 8, least_long: int = 24) -> DataFrame:
    """decisions(now, ridge), scores(slot, scored_at, verified, forecast, actual), times in slots: corrections of each decision.

    A score counts if it was verified before its target, its outcome was known (slot + settle <= now) and it had been
    scored by then. It is needed for `long` slots, so it meets decisions by bucket, in an equi join; a stream's history
    can have any length. From the time on that any target stands twice in the eligible history, however long ago it was,
    corrections are blocked (`DUPLICATE_SCORED_TARGET`).
    """
    buckets = F.explode(F.array(F.floor(F.col("known") / BUCKET), F.floor(F.col("known") / BUCKET) + 1))
    if long > BUCKET:
        raise ValueError(f"the long look-back is at most {BUCKET} slots")
    past = scores.filter("verified").select(*by, F.col("slot").alias("past_slot"), (F.col("slot") + settle).alias("known"), "scored_at", F.col("forecast").alias("past_forecast"), (F.col("actual") - F.col("forecast")).alias("residual")).withColumn("bucket", buckets)
    keyed = decisions.select(*by, "now", "ridge").withColumn("bucket", F.floor(F.col("now") / BUCKET))
    near = (F.col("known") <= F.col("now")) & (F.col("known") > F.col("now") - long) & (F.col("scored_at") <= F.col("now"))
    recent = F.col("known") > F.col("now") - short
    met = keyed.join(past, [*by, "bucket"]).filter(near).groupBy(*by, "now").agg(
        F.count_if(recent).alias("short_rows"), F.count("*").alias("long_rows"), F.avg(F.when(recent, F.col("residual"))).alias("short_mean"), F.avg("residual").alias("long_mean"),
        F.max_by("past_forecast", "past_slot").alias("anchor"),
    )
    use = F.greatest(F.col("slot") + settle, F.col("scored_at"))
    again = scores.filter("verified").select(*by, use.alias("_use"), F.row_number().over(Window.partitionBy(*by, "slot").orderBy(use)).alias("_copy")).filter("_copy = 2")
    first = again.groupBy(*by).agg(F.min("_use").alias("repeat_at"))
    out = decisions.join(met, [*by, "now"], "left").fillna(0, ["short_rows", "long_rows"])
    out = out.join(first, list(by), "left") if by else out.join(F.broadcast(first), how="cross")  # one row
    repeated = F.coalesce(F.col("repeat_at") <= F.col("now"), F.lit(False))
    enough = (F.col("short_rows") >= least_short) & (F.col("long_rows") >= least_long)
    out = out.withColumns({"short_mean": F.when(enough, F.col("short_mean")), "long_mean": F.when(enough, F.col("long_mean"))})
    proposal = F.when(repeated, 0.0).otherwise(F.coalesce(agreed_clip(F.col("short_mean"), F.col("long_mean")), F.lit(0.0)))
    out = out.withColumn("proposal", proposal).withColumn("anchor_delta", F.when(F.col("proposal") != 0, F.col("ridge") - F.col("anchor")))
    aligned = (F.col("proposal") != 0) & (F.signum("anchor_delta") == F.signum("proposal"))
    reason = F.when(repeated, "DUPLICATE_SCORED_TARGET").when(~enough, "WAIT_FOR_GENUINE_PRETARGET_SCORES").when(F.col("proposal") == 0, "DISAGREEMENT_FALLBACK_RIDGE").when(aligned, "SAME_SIGN_RESIDUALS").otherwise("FROZEN_RIDGE_DIRECTION_VETO")
    out = out.withColumns({"reason": reason, "ridge_consensus": F.col("ridge") + F.col("proposal"), "ridge_direction_veto": F.col("ridge") + F.when(aligned, F.col("proposal")).otherwise(0.0)})
    return out.drop("anchor", "repeat_at")


#: The evidence classes that a score of either stream must have.
CLASSES = ("SCORED_GENUINE_PRETARGET_SHADOW", "SCORED_LIVE_FORWARD_WITH_DELAY_SAFE_FEATURES")


def compare(scores: tuple[DataFrame, DataFrame], predictions: tuple[DataFrame, DataFrame], methods: tuple[Sequence[str], Sequence[str]], most_gap: float = 15.0) -> DataFrame:
    """Common targets of two streams, each with the first `reason` to reject it (NULL: accepted) and errors by method.

    scores(target, evidence_class, fingerprint, actual, verified), predictions(target, made_for, issued_minute,
    target_minute, previous_day, methods...). Times are whole minutes.
    """
    if most_gap <= 0:
        raise ValueError("the gap allowed must be positive")
    side = lambda df, k: df.select("target", *(F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "target"))
    met = side(scores[0], 1).join(side(scores[1], 2), "target")
    for k in (0, 1):
        met = met.join(side(predictions[k], k + 1).withColumn(f"found_{k + 1}", F.lit(True)), "target", "left")
    differ = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > 1e-8, F.lit(True))
    missing = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    forecasts = ["previous_day_1", *(f"{m}_1" for m in methods[0]), *(f"{m}_2" for m in methods[1])]
    late = [(F.col(f"made_for_{k}") != F.col("target")) | (F.col(f"issued_minute_{k}") >= F.col(f"target_minute_{k}")) for k in (1, 2)]
    gap = F.abs(F.col("issued_minute_1") - F.col("issued_minute_2")).cast("double")
    checks = [
        (F.col("found_1").isNull() | F.col("found_2").isNull(), "MISSING_PRETARGET_RECORD"), (F.coalesce(late[0] | late[1], F.lit(True)), "INVALID_TARGET_OR_ISSUE_TIMING"),
        (~F.col("evidence_class_1").eqNullSafe(CLASSES[0]), "FIRST_NOT_PRETARGET_SCORED"), (~F.col("evidence_class_2").eqNullSafe(CLASSES[1]), "SECOND_NOT_PRETARGET_SCORED"), (~F.coalesce("verified_2", F.lit(False)), "SECOND_COMMIT_NOT_VERIFIED"),
        (missing("fingerprint_1") | missing("fingerprint_2"), "MISSING_PREDICTION_FINGERPRINT"), (differ("actual_1", "actual_2"), "REVISED_REALIZED_PRICE_DISAGREEMENT"), (differ("previous_day_1", "previous_day_2"), "DIFFERENT_PREVIOUS_DAY_REFERENCE"),
    ]
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) for f in forecasts]
    unusable = ~finite[0]
    for f in finite[1:]:
        unusable = unusable | ~f
    reason = F.coalesce(pair_reason(gap, checks, most_gap), F.when(unusable, "NONFINITE_FORECAST"))
    errors = {f"error_{f}": F.when(F.col("reason").isNull(), F.col(f) - F.col("actual_1")) for f in forecasts}
    return met.withColumns({"issue_gap_minutes": gap, "reason": reason}).withColumns(errors).select("target", "reason", "issue_gap_minutes", F.col("actual_1").alias("actual"), *errors)


def long_errors(wide: DataFrame, keys: Sequence[str], errors: dict[str, str], reference: str) -> DataFrame:
    """(keys, method, error, reference_error): a row for each method, in one scan."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("error")) for m, c in errors.items())))
    return wide.select(*keys, F.col(errors[reference]).alias("reference_error"), each.alias("e")).select(*keys, "e.method", "e.error", "reference_error")


def summary(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Figures by group and method: errors, gain over the reference and share of rows that beat it."""
    size, base = F.abs("error"), F.abs("reference_error")
    return errors.groupBy(*by, "method").agg(F.count("*").alias("n_rows"), F.avg(size).alias("mae"), F.percentile(size, 0.95).alias("p95_abs_error"), F.avg("error").alias("bias"), F.avg(base - size).alias("mean_gain"), F.avg((size < base).cast("double")).alias("win_rate"))


def last_rows(wide: DataFrame, rows: int = DAY, slot: str = "slot") -> DataFrame:
    """The latest rows, and all of them again, by `span`; only `rows` rows are sorted."""
    return wide.withColumn("span", F.lit("all")).unionByName(wide.orderBy(F.desc(slot)).limit(rows).withColumn("span", F.lit(f"last_{rows}")))


def fold_consistency(folds: DataFrame, candidate: str, comparators: Sequence[str]) -> DataFrame:
    """folds has a mean error of each method: in how many folds the candidate is better, worse or tied, and by how much."""
    gains = F.explode(F.array(*(F.struct(F.lit(c).alias("comparator"), (F.col(c) - F.col(candidate)).alias("gain")) for c in comparators)))
    return folds.select(gains.alias("g")).groupBy(F.col("g.comparator").alias("comparator")).agg(F.count("*").alias("folds"), F.count_if(F.col("g.gain") > 0).alias("better"), F.count_if(F.col("g.gain") < 0).alias("worse"), F.count_if(F.col("g.gain") == 0).alias("ties"), F.avg("g.gain").alias("mean_gain"), F.percentile("g.gain", 0.5).alias("median_gain"))


def validation_blocks(rows: DataFrame, actual: str, candidate: str, frozen: str, reference: str, vetoed: Column, size: int = DAY, by: str = "block", slot: str = "slot") -> DataFrame:
    """Blocks of `size` slots from `by` * size on. Gates hold only where each slot is there exactly once; figures are NULL elsewhere."""
    e = {n: F.col(c) - F.col(actual) for n, c in (("candidate", candidate), ("frozen", frozen), ("reference", reference))}
    figures = {f"{n}_mae": F.avg(F.abs(x)) for n, x in e.items()} | {f"{n}_p95": F.percentile(F.abs(e[n]), 0.95) for n in ("candidate", "frozen")} | {f"{n}_bias": F.avg(e[n]) for n in ("candidate", "frozen")}
    figures |= {"win_rate_vs_frozen": F.avg((F.abs(e["candidate"]) < F.abs(e["frozen"])).cast("double")), "veto_rate": F.avg(vetoed.cast("double"))}
    out = rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct(slot).alias("_slots"), *(c.alias(k) for k, c in figures.items()))
    whole = (F.col("n_rows") == size) & (F.col("_slots") == size)
    gates = {"mae_beats_frozen": F.col("candidate_mae") < F.col("frozen_mae"), "p95_non_worse": F.col("candidate_p95") <= F.col("frozen_p95"), "bias_non_worse": F.abs("candidate_bias") <= F.abs("frozen_bias"), "mae_beats_reference": F.col("candidate_mae") < F.col("reference_mae")}
    out = out.withColumns({k: F.when(whole, F.col(k)) for k in figures}).withColumns({k: F.coalesce(whole & c, F.lit(False)) for k, c in gates.items()})
    passed = F.col("mae_beats_frozen") & F.col("p95_non_worse") & F.col("bias_non_worse") & F.col("mae_beats_reference")
    return out.withColumns({"launch_allowed": passed, "status": F.when(whole, "VALIDATION_BLOCK_EVALUATED").otherwise("INCOMPLETE_OR_NONCONTIGUOUS_VALIDATION_BLOCK")}).drop("_slots")


def correction_spread(rows: DataFrame, correction: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, least and greatest correction, and the share that is not 0."""
    c = F.col(correction)
    return rows.groupBy(*by).agg(F.count(c).alias("n_rows"), F.avg(c).alias("mean_correction"), F.stddev_pop(c).alias("std_correction"), F.min(c).alias("min_correction"), F.max(c).alias("max_correction"), F.avg((c != 0).cast("double")).alias("applied_rate"))


def complete_days(rows: DataFrame, slot: str = "slot", by: Sequence[str] = ()) -> DataFrame:
    """UTC days with exactly 48 rows."""
    return rows.groupBy(*by, F.floor(F.col(slot) / DAY).alias("day")).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") == DAY).drop("n_rows")


def claim_class(gate: Column, reference_mae: Column, deployed_mae: Column, fallback: Column, promoted: Column) -> Column:
    """What a horizon's result may be used for: gate and figures first, then fallback, then the sign of the improvement."""
    improvement = F.when(reference_mae != 0, (reference_mae - deployed_mae) / reference_mae)
    blocked = ~gate.eqNullSafe("PASS_REAL") | reference_mae.isNull() | deployed_mae.isNull()
    return F.when(blocked, "BLOCKED_EVIDENCE").when(fallback | ~F.coalesce(promoted, F.lit(False)), "REAL_FALLBACK_RESULT").when(improvement > 0, "REAL_CLAIMABLE_POSITIVE").otherwise("REAL_NEGATIVE_RESULT")


def registry_faults(registry: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Snapshots(sequence, rows, new_rows, end): the first rule of an append-only registry that each breaks, or NULL."""
    order = Window.partitionBy(*by).orderBy("sequence")
    before, end = F.coalesce(F.lag("rows").over(order), F.lit(0)), F.lag("end").over(order)
    fault = F.when(F.col("sequence") != F.row_number().over(order), "SEQUENCE_NOT_CONTIGUOUS").when(F.col("rows") <= before, "ROWS_NOT_INCREASING").when(F.col("new_rows") != F.col("rows") - before, "NEW_ROWS_INCONSISTENT").when(F.col("end") <= end, "END_NOT_INCREASING")
    return registry.withColumn("fault", fault)
