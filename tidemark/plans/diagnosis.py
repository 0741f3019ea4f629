"""Queries on rules of the clock, gate diagnostics, and claims under global blockers."""

from pyspark.sql import functions as F

from ..functions import SLOT_US, micros, slot_of
from ..operators import causal, clock, diagnosis, streams
from ..sources import table
from .series import CAUSAL, MON, monitored, scored
from .streams import NUDGE, nudged


def clock_rules(spark, d):
    """For each event as a decision or a lock: target, cutoffs, first forward target, freeze window and labels."""
    e = table(spark, d, "events").select("event_id", micros("ts").alias("us"), slot_of("ts").alias("slot"))
    middle = e.agg(F.floor((F.min("slot") + F.max("slot")) / 2).cast("long").alias("lock"))
    us, lock = F.col("us"), F.col("lock")
    e = e.join(F.broadcast(middle))  # one row
    return e.select(
        "event_id", clock.target_after(us).alias("target"), clock.market_end(us, 90).alias("market_end"), clock.market_end(us, 30).alias("market_end_early"), clock.safe_boundary(us).alias("safe_boundary"), clock.forward_start(us).alias("forward_start"),
        clock.freeze_window(us, lock, lock + 4).alias("freeze"), clock.period_class(F.col("slot"), lock, "LOCKED_HISTORICAL_OOS", "POST_LOCK_FORWARD_MONITORING").alias("segment"))


CLOCK = f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // {SLOT_US} AS slot FROM events), l AS (SELECT (min(slot) + max(slot)) // 2 AS lock FROM e)
SELECT event_id, (us + 7200000000 + {SLOT_US - 1}) // {SLOT_US} AS target, (us - 5400000000) // {SLOT_US} AS market_end, (us - 1800000000) // {SLOT_US} AS market_end_early, (us - 5400000000) // {SLOT_US} AS safe_boundary, slot + 5 AS forward_start,
 CASE WHEN us < lock * {SLOT_US} THEN 'FIRST_DECISION_NOT_REACHED' WHEN us >= (lock + 4) * {SLOT_US} THEN 'FIRST_TARGET_ALREADY_STARTED' ELSE 'FREEZE_ALLOWED' END AS freeze, CASE WHEN slot < lock THEN 'LOCKED_HISTORICAL_OOS' ELSE 'POST_LOCK_FORWARD_MONITORING' END AS segment FROM e, l"""

SUMS = ("applied_rate", "mean_correction_applied", "fallback_avoided", "avoided_in_all", "excess_error", "harmful_error", "helpful_error")


def gate_diagnosis(spark, d):
    """By week and over all: what the gate did, with the longest run of corrections; one copy is tampered with."""
    rows = causal.mean_correction(scored(spark, d), "price", "frozen").withColumnRenamed("corrected", "mean_48h").drop("residual", "history_rows", "correction")
    rows = causal.consensus_correction(rows, "price", "frozen").withColumn("week", F.floor(F.col("slot") / 336).cast("string"))
    rows = rows.select("week", "slot", F.col("price").alias("actual"), "frozen", F.col("corrected").alias("candidate"), "correction", "reason", "mean_48h")
    bad = rows.withColumns({"week": F.lit("tampered"), "candidate": F.col("candidate") + F.when(F.col("slot") % 500 == 0, 0.25).otherwise(0.0)})
    each = rows.unionByName(rows.withColumn("week", F.lit("all"))).unionByName(bad)
    out = diagnosis.gate_diagnostics(each, "mean_48h", ["week"]).join(diagnosis.longest_run(each, F.col("reason") == diagnosis.APPLIED, by=["week"]), "week", "left")
    return nudged(out, *SUMS)


_ON = "reason = 'CONSENSUS_CLIPPED_CORRECTION'"
GATE = f"""WITH {CAUSAL}, b AS (SELECT slot, price, frozen, frozen + corr AS cand, corr, frozen + mean_corr AS other, reason FROM v), r AS (SELECT CAST(slot // 336 AS VARCHAR) AS week, * FROM b UNION ALL SELECT 'all', * FROM b UNION ALL SELECT 'tampered', slot, price, frozen, cand + CASE WHEN slot % 500 = 0 THEN 0.25 ELSE 0 END, corr, other, reason FROM b),
x AS (SELECT *, {_ON} AS ap, abs(cand - price) - abs(frozen - price) AS dl, abs(other - price) - abs(frozen - price) AS av, abs(other - price) - abs(cand - price) AS aa, abs(cand - price) < abs(frozen - price) AS be, abs(cand - price) > abs(frozen - price) AS wo,
  greatest(abs(cand - frozen - corr), CASE WHEN NOT ({_ON}) THEN greatest(abs(corr), abs(cand - frozen)) ELSE 0 END) AS off_, row_number() OVER (PARTITION BY week ORDER BY slot) - row_number() OVER (PARTITION BY week, {_ON} ORDER BY slot) AS isl FROM r),
ru AS (SELECT week, isl, count(*) AS n, min(slot) AS a, max(slot) AS z FROM x WHERE ap GROUP BY 1, 2), lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, a) AS k FROM ru) WHERE k = 1),
gg AS (SELECT week, count(*) AS n_rows, count(*) FILTER (ap) AS applied_rows, count(*) FILTER (NOT ap) AS fallback_rows, avg(CAST(ap AS INTEGER)) AS applied_rate, count(*) FILTER (reason = 'REGIME_DISAGREEMENT_FALLBACK_FROZEN') AS disagreement_rows, coalesce(avg(abs(corr)) FILTER (ap), 0) AS mean_correction_applied,
  count(*) FILTER (ap AND be) AS applied_better, count(*) FILTER (ap AND wo) AS applied_worse, count(*) FILTER (ap AND NOT be AND NOT wo) AS applied_tied, count(*) FILTER (NOT ap AND av > 0) AS fallback_other_worse, count(*) FILTER (NOT ap AND av < 0) AS fallback_other_better,
  coalesce(sum(av) FILTER (NOT ap), 0) AS fallback_avoided, sum(aa) AS avoided_in_all, sum(dl) AS excess_error, coalesce(sum(dl) FILTER (ap AND dl > 0), 0) AS harmful_error, coalesce(-sum(dl) FILTER (ap AND dl < 0), 0) AS helpful_error, max(off_) AS off_ FROM x GROUP BY 1)
SELECT gg.* EXCLUDE (off_) REPLACE ({", ".join(f"round({c} + {NUDGE}, 7) AS {c}" for c in SUMS)}), CASE WHEN off_ > 1e-9 THEN 'RECONSTRUCTION_FAILED' ELSE 'DESCRIPTIVE_GATE_DIAGNOSTIC' END AS status, lo.n AS longest_run, lo.a AS run_first, lo.z AS run_last FROM gg LEFT JOIN lo USING (week)"""


def blocked_claims(spark, d):
    """Claims by day: as they are, and with the blockers that a missing source and an empty result give."""
    day = F.floor(F.col("slot") / 48)
    days = monitored(spark, d).groupBy(day.alias("day")).agg(F.avg("reference_error").alias("r"), F.avg("adaptive_error").alias("a"))
    claim = streams.claim_class(F.when(F.col("day") % 7 != 0, "PASS_REAL"), F.col("r"), F.col("a"), F.col("day") % 4 == 0, F.lit(True))
    claims = days.select("day", claim.alias("claim_class"))
    sources = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n_rows"))
    kinds = [r.source for r in sources.orderBy("source").collect()]  # kinds of events: a handful
    none = sources.withColumn("n_rows", F.when(F.col("source") == kinds[0], 0).otherwise(F.col("n_rows")))
    cases = {"sound": diagnosis.missing_sources(sources, kinds), "faulty": diagnosis.missing_sources(none, [*kinds, "real_prices"])}
    out = None
    for name, blockers in cases.items():
        one = diagnosis.blocked(claims, blockers).withColumn("case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


CLAIMS = f"""WITH {MON}, x AS (SELECT slot // 48 AS day, avg(reference_error) AS r, avg(adaptive_error) AS a FROM m GROUP BY 1),
cc AS (SELECT day, CASE WHEN day % 7 = 0 THEN 'BLOCKED_EVIDENCE' WHEN day % 4 = 0 THEN 'REAL_FALLBACK_RESULT' WHEN r <> 0 AND (r - a) / r > 0 THEN 'REAL_CLAIMABLE_POSITIVE' ELSE 'REAL_NEGATIVE_RESULT' END AS claim_class FROM x)
SELECT day, claim_class, NULL AS reason, 'sound' AS "case" FROM cc UNION ALL
SELECT day, 'BLOCKED_EVIDENCE', CASE WHEN claim_class <> 'BLOCKED_EVIDENCE' THEN 'missing source: ' || (SELECT min(event_type) FROM events) || '; missing source: real_prices' END, 'faulty' FROM cc"""

QUERIES = {"clock_rules": (clock_rules, CLOCK), "gate_diagnosis": (gate_diagnosis, GATE), "blocked_claims": (blocked_claims, CLAIMS)}
