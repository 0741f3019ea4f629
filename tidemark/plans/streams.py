"""Queries on scored streams: live corrections from scored history, comparison of two streams, summaries and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import slot_of
from ..operators import asof, causal, metrics, streams
from ..sources import table
from .series import CAUSAL, MON, SERIES, monitored, rounded, scored, series
from .vintages import VINTAGES, targets, vintages


def history_inputs(spark, d):
    """Decisions and scores of two streams: some scores are unverified, some late, and one stream scores some targets twice."""
    s = scored(spark, d).withColumn("stream", F.explode(F.array(F.lit("clean"), F.lit("repeated"))))
    late = F.when(F.col("slot") % 7 == 0, 3).otherwise(0)
    scores = s.select("stream", "slot", (F.col("slot") + 4 + late).alias("scored_at"), (F.col("slot") % 5 != 0).alias("verified"), F.col("frozen").alias("forecast"), F.col("price").alias("actual"))
    scores = scores.unionByName(scores.filter("stream = 'repeated' and slot % 700 = 1").withColumn("scored_at", F.col("scored_at") + 200))
    return s.select("stream", F.col("slot").alias("now"), F.col("frozen").alias("ridge")), scores


HISTORY_FIGURES = ("ridge", "short_mean", "long_mean", "proposal", "anchor_delta", "ridge_consensus", "ridge_direction_veto")


#: Means of six-place numbers over 8, 24 or 96 rows often end in a tie of the seventh place; a nudge decides it, in whatever order sums ran.
NUDGE = 3e-10


def nudged(df, *names):
    return rounded(df.withColumns({n: F.col(n) + NUDGE for n in names}), *names)


def scored_history_live(spark, d):
    """A decision at each scored slot of either stream."""
    return nudged(streams.scored_history(*history_inputs(spark, d), by=["stream"]), *HISTORY_FIGURES)


SCORED_HISTORY = f"""WITH {SERIES}, two AS (SELECT sco.*, stream FROM sco, (VALUES ('clean'), ('repeated')) t(stream)),
sc0 AS (SELECT stream, slot, slot + 4 AS known, slot + 4 + CASE WHEN slot % 7 = 0 THEN 3 ELSE 0 END AS at_, frozen AS f, price - frozen AS res FROM two WHERE slot % 5 <> 0),
sc AS (SELECT * FROM sc0 UNION ALL SELECT stream, slot, known, at_ + 200, f, res FROM sc0 WHERE slot % 700 = 1 AND stream = 'repeated'),
rp AS (SELECT stream, min(u) AS rep FROM (SELECT stream, greatest(known, at_) AS u, row_number() OVER (PARTITION BY stream, slot ORDER BY greatest(known, at_)) AS k FROM sc) WHERE k = 2 GROUP BY 1),
h AS (SELECT a.stream, a.slot AS now, a.frozen AS ridge, count(b.slot) FILTER (b.known > a.slot - 12) AS sr, count(b.slot) AS lr, avg(res) FILTER (b.known > a.slot - 12) AS sm, avg(res) AS lm, arg_max(b.f, b.slot) AS anchor
  FROM two a LEFT JOIN sc b ON a.stream = b.stream AND b.known <= a.slot AND b.known > a.slot - 96 AND b.at_ <= a.slot GROUP BY 1, 2, 3),
p AS (SELECT h.*, sr >= 8 AND lr >= 24 AS ok, coalesce(rep <= now, false) AS dup FROM h LEFT JOIN rp USING (stream)),
q AS (SELECT *, CASE WHEN NOT dup AND ok AND sm <> 0 AND sign(sm) = sign(lm) THEN sign(sm) * least(abs(sm), abs(lm)) ELSE 0.0 END AS prop FROM p),
v AS (SELECT *, prop <> 0 AND sign(ridge - anchor) = sign(prop) AS al FROM q)
SELECT stream, now, round(ridge + {NUDGE}, 7) AS ridge, sr AS short_rows, lr AS long_rows, round(CASE WHEN ok THEN sm END + {NUDGE}, 7) AS short_mean, round(CASE WHEN ok THEN lm END + {NUDGE}, 7) AS long_mean, round(prop + {NUDGE}, 7) AS proposal, round(CASE WHEN prop <> 0 THEN ridge - anchor END + {NUDGE}, 7) AS anchor_delta,
 CASE WHEN dup THEN 'DUPLICATE_SCORED_TARGET' WHEN NOT ok THEN 'WAIT_FOR_GENUINE_PRETARGET_SCORES' WHEN prop = 0 THEN 'DISAGREEMENT_FALLBACK_RIDGE' WHEN al THEN 'SAME_SIGN_RESIDUALS' ELSE 'FROZEN_RIDGE_DIRECTION_VETO' END AS reason,
 round(ridge + prop + {NUDGE}, 7) AS ridge_consensus, round(ridge + CASE WHEN al THEN prop ELSE 0.0 END + {NUDGE}, 7) AS ridge_direction_veto FROM v"""


def stream_comparison(spark, d):
    """Two streams over the scored slots, each rule broken in some of them."""
    s = scored(spark, d).withColumnRenamed("slot", "target")
    t = F.col("target")
    broken = lambda n, k=0: t % n == k
    one = s.select("target", F.when(broken(23), "OTHER").otherwise(streams.CLASSES[0]).alias("evidence_class"), F.when(broken(37), "").otherwise("f").alias("fingerprint"), F.col("price").alias("actual"))
    two = s.filter(~broken(59)).select("target", F.when(~broken(29), streams.CLASSES[1]).alias("evidence_class"), F.lit("g").alias("fingerprint"), (F.col("price") + F.when(broken(41), 1.0).otherwise(0.0)).alias("actual"), (~broken(31)).alias("verified"))
    record = lambda gap: s.select("target", (t + F.when(broken(19), 1).otherwise(0)).alias("made_for"), (t * 30 - 120 + gap).alias("issued_minute"), (t * 30).alias("target_minute"), F.col("reference").alias("previous_day"), F.col("frozen").alias("a"), (F.col("frozen") / 2 + F.col("reference") / 2).alias("b"))
    first = record(F.lit(0)).filter(~broken(17)).withColumn("b", F.when(broken(53), F.lit(None).cast("double")).otherwise(F.col("b")))
    second = record((t % 18).cast("long")).withColumn("previous_day", F.col("previous_day") + F.when(broken(43), 0.5).otherwise(0.0))
    out = streams.compare((one, two), (first, second), (["a", "b"], ["a"]))
    return rounded(out, "actual", *(c for c in out.columns if c.startswith("error")))


COMPARISON = f"""WITH {SERIES}, r AS (SELECT slot AS t, *, CASE WHEN slot % 17 = 0 THEN 'MISSING_PRETARGET_RECORD' WHEN slot % 19 = 0 THEN 'INVALID_TARGET_OR_ISSUE_TIMING' WHEN slot % 23 = 0 THEN 'FIRST_NOT_PRETARGET_SCORED' WHEN slot % 29 = 0 THEN 'SECOND_NOT_PRETARGET_SCORED' WHEN slot % 31 = 0 THEN 'SECOND_COMMIT_NOT_VERIFIED'
  WHEN slot % 37 = 0 THEN 'MISSING_PREDICTION_FINGERPRINT' WHEN slot % 41 = 0 THEN 'REVISED_REALIZED_PRICE_DISAGREEMENT' WHEN slot % 43 = 0 THEN 'DIFFERENT_PREVIOUS_DAY_REFERENCE' WHEN slot % 18 > 15 THEN 'ISSUE_TIMES_TOO_FAR_APART' WHEN slot % 53 = 0 THEN 'NONFINITE_FORECAST' END AS reason FROM sco WHERE slot % 59 <> 0)
SELECT t AS target, reason, CASE WHEN slot % 17 <> 0 THEN CAST(slot % 18 AS DOUBLE) END AS issue_gap_minutes, round(price, 7) AS actual, CASE WHEN reason IS NULL THEN round(reference - price, 7) END AS error_previous_day_1,
 CASE WHEN reason IS NULL THEN round(frozen - price, 7) END AS error_a_1, CASE WHEN reason IS NULL THEN round(frozen / 2 + reference / 2 - price, 7) END AS error_b_1, CASE WHEN reason IS NULL THEN round(frozen - price, 7) END AS error_a_2 FROM r"""


def _vetoed(spark, d):
    return causal.direction_veto(causal.consensus_correction(scored(spark, d), "price", "frozen"), "frozen")


def score_stream_summary(spark, d):
    """All rows and the last 48, by method."""
    rows = _vetoed(spark, d)
    wide = rows.select("slot", *((F.col(c) - F.col("price")).alias(m) for m, c in {"previous_day": "reference", "consensus": "corrected", "direction_veto": "veto_prediction"}.items()))
    long = streams.long_errors(streams.last_rows(wide), ["span"], {m: m for m in ("previous_day", "consensus", "direction_veto")}, "previous_day")
    return rounded(streams.summary(long, ["span"]), "mae", "p95_abs_error", "bias", "mean_gain", "win_rate")


SUMMARY = f"""WITH {CAUSAL}, w AS (SELECT slot, reference - price AS previous_day, frozen + corr - price AS consensus, frozen + veto - price AS direction_veto FROM v), sp AS (SELECT 'all' AS span, * FROM w UNION ALL (SELECT 'last_48', * FROM w ORDER BY slot DESC LIMIT 48)),
l AS (SELECT span, previous_day AS base, m AS method, CASE m WHEN 'previous_day' THEN previous_day WHEN 'consensus' THEN consensus ELSE direction_veto END AS e FROM sp, (VALUES ('previous_day'), ('consensus'), ('direction_veto')) t(m))
SELECT span, method, count(*) AS n_rows, round(avg(abs(e)), 7) AS mae, round(quantile_cont(abs(e), 0.95), 7) AS p95_abs_error, round(avg(e), 7) AS bias, round(avg(abs(base) - abs(e)), 7) AS mean_gain, round(avg(CAST(abs(e) < abs(base) AS INTEGER)), 7) AS win_rate FROM l GROUP BY 1, 2"""


def weekly_fold_consistency(spark, d):
    weeks = monitored(spark, d).groupBy(F.floor(F.col("slot") / 336).alias("week")).agg(*(F.avg(f"{m}_error").alias(m) for m in ("adaptive", "frozen", "reference")))
    return rounded(streams.fold_consistency(weeks, "adaptive", ["frozen", "reference"]), "mean_gain", "median_gain")


FOLD_CONSISTENCY = f"""WITH {MON}, f AS (SELECT slot // 336 AS week, avg(adaptive_error) AS a, avg(frozen_error) AS f, avg(reference_error) AS r FROM m GROUP BY 1), gains AS (SELECT 'frozen' AS comparator, f - a AS g FROM f UNION ALL SELECT 'reference', r - a FROM f)
SELECT comparator, count(*) AS folds, count(*) FILTER (g > 0) AS better, count(*) FILTER (g < 0) AS worse, count(*) FILTER (g = 0) AS ties, round(avg(g), 7) AS mean_gain, round(quantile_cont(g, 0.5), 7) AS median_gain FROM gains GROUP BY 1"""


def validation_block_gates(spark, d):
    """A block a day; days that lack a half-hour are not judged."""
    rows = _vetoed(spark, d).withColumn("block", F.floor(F.col("slot") / 48)).filter("slot % 501 <> 0")
    out = streams.validation_blocks(rows, "price", "veto_prediction", "frozen", "reference", F.col("veto_reason") == "FROZEN_DIRECTION_VETO_FALLBACK_FROZEN")
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


VALIDATION = f"""WITH {CAUSAL}, w AS (SELECT *, slot // 48 AS block, frozen + veto - price AS ce, frozen - price AS fe, reference - price AS re FROM v WHERE slot % 501 <> 0),
b AS (SELECT block, count(*) AS n_rows, avg(abs(ce)) AS candidate_mae, avg(abs(fe)) AS frozen_mae, avg(abs(re)) AS reference_mae, quantile_cont(abs(ce), 0.95) AS candidate_p95, quantile_cont(abs(fe), 0.95) AS frozen_p95, avg(ce) AS candidate_bias, avg(fe) AS frozen_bias,
  avg(CAST(abs(ce) < abs(fe) AS INTEGER)) AS win_rate_vs_frozen, avg(CAST(veto_reason = 'FROZEN_DIRECTION_VETO_FALLBACK_FROZEN' AS INTEGER)) AS veto_rate FROM w GROUP BY 1),
judged AS (SELECT *, n_rows = 48 AS whole, candidate_mae < frozen_mae AS g1, candidate_p95 <= frozen_p95 AS g2, abs(candidate_bias) <= abs(frozen_bias) AS g3, candidate_mae < reference_mae AS g4 FROM b)
SELECT block, n_rows, {", ".join(f"CASE WHEN whole THEN round({c}, 7) END AS {c}" for c in ("candidate_mae", "frozen_mae", "reference_mae", "candidate_p95", "frozen_p95", "candidate_bias", "frozen_bias", "win_rate_vs_frozen", "veto_rate"))},
 whole AND g1 AS mae_beats_frozen, whole AND g2 AS p95_non_worse, whole AND g3 AS bias_non_worse, whole AND g4 AS mae_beats_reference, whole AND g1 AND g2 AND g3 AND g4 AS launch_allowed,
 CASE WHEN whole THEN 'VALIDATION_BLOCK_EVALUATED' ELSE 'INCOMPLETE_OR_NONCONTIGUOUS_VALIDATION_BLOCK' END AS status FROM judged"""


def monthly_metrics(spark, d):
    """Errors of the latest known vintage by month of the decision."""
    t = targets(spark, d)
    met = asof.latest(t, vintages(spark, d), ["price"]).join(t.select("target", "actual"), "target").withColumn("month", F.date_format("decision", "yyyy-MM"))
    out = met.groupBy("month").agg(*(c.alias(k) for k, c in metrics.point("actual", "price").items()))
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "bias", "p95_abs_error")})


MONTHLY = f"""WITH {VINTAGES} SELECT strftime(decision, '%Y-%m') AS month, count(*) AS n_rows, round(avg(abs(price - actual)), 4) AS mae, round(sqrt(avg((price - actual) * (price - actual))), 4) AS rmse, round(avg(price - actual), 4) AS bias, round(quantile_cont(abs(price - actual), 0.95), 4) AS p95_abs_error FROM elig WHERE k = 1 GROUP BY 1"""


def correction_spread(spark, d):
    out = streams.correction_spread(_vetoed(spark, d).withColumn("week", F.floor(F.col("slot") / 336)), "veto_correction", ["week"])
    return rounded(out, "mean_correction", "std_correction", "min_correction", "max_correction", "applied_rate")


SPREAD = f"""WITH {CAUSAL} SELECT slot // 336 AS week, count(*) AS n_rows, round(avg(veto), 7) AS mean_correction, round(stddev_pop(veto), 7) AS std_correction, round(min(veto), 7) AS min_correction, round(max(veto), 7) AS max_correction, round(avg(CAST(veto <> 0 AS INTEGER)), 7) AS applied_rate FROM v GROUP BY 1"""


def complete_utc_days(spark, d):
    return streams.complete_days(series(spark, d).filter("price is not null and slot % 500 <> 0"))


COMPLETE = f"WITH {SERIES} SELECT slot // 48 AS day FROM ser WHERE price IS NOT NULL AND slot % 500 <> 0 GROUP BY 1 HAVING count(*) = 48"


def horizon_claims(spark, d):
    """A result for each day: some have no gate, no error of the reference, or were not promoted."""
    day = F.floor(F.col("slot") / 48)
    days = monitored(spark, d).groupBy(day.alias("day")).agg(F.avg("reference_error").alias("r"), F.avg("adaptive_error").alias("a"))
    gate = F.when(F.col("day") % 5 != 0, F.when(F.col("day") % 7 == 0, "BLOCKED").otherwise("PASS_REAL"))
    claim = streams.claim_class(gate, F.when(F.col("day") % 11 != 0, F.col("r")), F.col("a"), F.col("day") % 4 == 0, F.when(F.col("day") % 6 != 0, True))
    return days.select("day", claim.alias("claim_class"))


CLAIMS = f"""WITH {MON}, x AS (SELECT slot // 48 AS day, avg(reference_error) AS r, avg(adaptive_error) AS a FROM m GROUP BY 1)
SELECT day, CASE WHEN day % 5 = 0 OR day % 7 = 0 OR day % 11 = 0 THEN 'BLOCKED_EVIDENCE' WHEN day % 4 = 0 OR day % 6 = 0 THEN 'REAL_FALLBACK_RESULT' WHEN r <> 0 AND (r - a) / r > 0 THEN 'REAL_CLAIMABLE_POSITIVE' ELSE 'REAL_NEGATIVE_RESULT' END AS claim_class FROM x"""


def registry_check(spark, d):
    """Each user's events as snapshots that should grow; half-hours repeat, and every 11th and 13th event breaks a rule."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("k"), slot_of("ts").alias("end"))
    shift = lambda n, by: F.when(F.col("event_id") % n == 0, by).otherwise(0)
    snaps = e.select("user_id", (F.col("k") * 2 + shift(11, 1)).cast("long").alias("twice"), (F.col("k") * 10 - shift(13, 25)).cast("long").alias("rows"), F.lit(10).cast("long").alias("new_rows"), "end", "event_id")
    snaps = snaps.withColumn("sequence", F.when(F.col("twice") % 2 == 0, (F.col("twice") / 2).cast("double")).otherwise(F.col("twice") / 2))
    return streams.registry_faults(snaps.drop("twice"), ["user_id"]).select("user_id", "event_id", "fault")


REGISTRY = """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) // 1800000000 AS en FROM events),
s AS (SELECT *, k + CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0 END AS sq, k * 10 - CASE WHEN event_id % 13 = 0 THEN 25 ELSE 0 END AS ro FROM e),
p AS (SELECT *, coalesce(lag(ro) OVER (PARTITION BY user_id ORDER BY k), 0) AS before, lag(en) OVER (PARTITION BY user_id ORDER BY k) AS le FROM s)
SELECT user_id, event_id, CASE WHEN sq <> k THEN 'SEQUENCE_NOT_CONTIGUOUS' WHEN ro <= before THEN 'ROWS_NOT_INCREASING' WHEN ro - before <> 10 THEN 'NEW_ROWS_INCONSISTENT' WHEN en <= le THEN 'END_NOT_INCREASING' END AS fault FROM p"""

QUERIES = {
    "scored_history_live": (scored_history_live, SCORED_HISTORY), "stream_comparison": (stream_comparison, COMPARISON), "score_stream_summary": (score_stream_summary, SUMMARY), "weekly_fold_consistency": (weekly_fold_consistency, FOLD_CONSISTENCY),
    "validation_block_gates": (validation_block_gates, VALIDATION), "monthly_metrics": (monthly_metrics, MONTHLY), "correction_spread": (correction_spread, SPREAD), "complete_utc_days": (complete_utc_days, COMPLETE),
    "horizon_claims": (horizon_claims, CLAIMS), "registry_check": (registry_check, REGISTRY),
}
