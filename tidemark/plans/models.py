"""Queries on models, paired streams, bootstrap, ledgers, streaming and sinks."""

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import fixed_nine, slot_of
from ..operators import bootstrap, clock, experiment, features, governance, ledger, monitor, ridge
from ..sources import table, write_zstd
from ..streaming import daily, read_sink, run_available
from . import series as s
from .series import SERIES, blocks, rounded, scored, series


def shared(spark):
    """A new folder that executors and the driver share: below spark.checkpoint.dir; a temporary one where that is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ridge_fit(spark, d):
    """Price on quantity of line items, with a penalty of 10."""
    m = ridge.solve(ridge.moments(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), 10.0)
    return spark.createDataFrame([(m.mean[0], m.scale[0], m.coef[0], m.coef[1])], "mean double, scale double, intercept double, slope double").select(*(F.round(c, 4).alias(c) for c in ("mean", "scale", "intercept", "slope")))


RIDGE_FIT = """SELECT round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS scale, round(avg(l_extendedprice), 4) AS intercept,
 round(covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) * count(*) / (count(*) + 10), 4) AS slope FROM lineitem"""


def ridge_score(spark, d):
    """A model of two features, fitted on the first block, on all later rows."""
    b = blocks(spark, d)
    m = ridge.solve(ridge.moments(b["train"], ["frozen", "reference"], "price"), 1.0)
    out = b["selection"].unionByName(b["calibration"]).unionByName(b["final"])
    return rounded(out.select("slot", m.predict().alias("prediction"), (m.predict() - F.col("price")).alias("error")), "prediction", "error")


#: Two features: the standardised system [[n + 1, g], [g, n + 1]] b = (c1, c2) in closed form.
RIDGE_SCORE = f"""WITH {SERIES}, nb AS (SELECT *, slot - (SELECT min(slot) FROM sco) AS k FROM sco), m AS (SELECT count(*) AS n, avg(frozen) AS m1, stddev_pop(frozen) AS s1, avg(reference) AS m2, stddev_pop(reference) AS s2, avg(price) AS y, corr(frozen, reference) * count(*) AS g,
 covar_pop(frozen, price) / stddev_pop(frozen) * count(*) AS c1, covar_pop(reference, price) / stddev_pop(reference) * count(*) AS c2 FROM nb WHERE k < 600),
p AS (SELECT slot, price, y + (frozen - m1) / s1 * (c1 * (n + 1) - g * c2) / ((n + 1) * (n + 1) - g * g) + (reference - m2) / s2 * (c2 * (n + 1) - g * c1) / ((n + 1) * (n + 1) - g * g) AS prediction FROM nb, m WHERE k >= 600)
SELECT slot, round(prediction, 7) AS prediction, round(prediction - price, 7) AS error FROM p"""


def ridge_select_alpha(spark, d):
    b = blocks(spark, d)
    best, maes = ridge.select_alpha(ridge.moments(b["train"], ["frozen"], "price"), b["selection"], "price")
    return maes.select("alpha", F.round("mae", 6).alias("mae"), (F.col("alpha") == best.alpha).alias("selected"))


SELECT_ALPHA = f"""WITH {SERIES}, nb AS (SELECT *, slot - (SELECT min(slot) FROM sco) AS k FROM sco), m AS (SELECT avg(frozen) AS mu, stddev_pop(frozen) AS sd, avg(price) AS y, covar_pop(frozen, price) / stddev_pop(frozen) * count(*) AS c, count(*) AS n FROM nb WHERE k < 600),
e AS (SELECT alpha, avg(abs(y + (frozen - mu) / sd * c / (n + alpha) - price)) AS mae FROM nb, m, (VALUES (0.0), (1.0), (10.0), (100.0)) a(alpha) WHERE k >= 600 AND k < 850 GROUP BY 1)
SELECT CAST(alpha AS DOUBLE) AS alpha, round(mae, 6) AS mae, alpha = (SELECT arg_min(alpha, (mae, alpha)) FROM e) AS selected FROM e"""


def _experiment(spark, d, **more):
    base = features.safe_frame(series(spark, d), s.HORIZON).dropna(subset=["price", "lag_last", "lag_second", "lag_day", "mean_six"])
    first = base.agg(F.min("slot").alias("first"))
    rows = base.crossJoin(F.broadcast(first)).withColumn("k", F.col("slot") - F.col("first")).withColumn("decision_slot", F.col("slot") - s.HORIZON)  # one row
    parts = {name: rows.filter((F.col("k") >= a) & (F.col("k") < b)) for name, (a, b) in s.BLOCKS.items()}
    simple = {"history": ["lag_last", "lag_day"], "levels": ["lag_last", "lag_day", "mean_six"]}
    out = experiment.run(parts, simple, {"revisions": ["lag_last", "lag_day", "mean_six", "lag_second"]}, "price", "lag_day", "lag_last", **more)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def experiment_fixed_window(spark, d):
    return _experiment(spark, d)


def experiment_local_scale(spark, d):
    """The same choice, with intervals that widen where errors are expected to be large."""
    return _experiment(spark, d, scale_floor=0.5, least_calibration=100)


def paired_streams(spark, d):
    """Two streams of one series, by parity of the event; each half-hour pair is accepted or rejected for the first reason that holds."""
    e = table(spark, d, "events").withColumn("slot", slot_of("ts"))
    one, two = (e.filter(F.col("event_id") % 2 == k).groupBy("slot").agg(F.count("*").alias(f"n{k}"), F.min("ts").alias(f"t{k}"), F.avg("value").alias(f"v{k}")) for k in (0, 1))
    gap = F.abs(F.unix_micros(F.col("t0").cast("timestamp")) - F.unix_micros(F.col("t1").cast("timestamp"))) / 6e7
    reason = monitor.pair_reason(gap, [(F.col("n0") < 2, "FIRST_NOT_SCORED"), (F.col("n1") < 2, "SECOND_NOT_SCORED"), (F.abs(F.col("v0") - F.col("v1")) > 60, "VALUE_DISAGREEMENT")])
    met = one.join(two, "slot").withColumn("reason", F.coalesce(reason, F.lit("ACCEPTED"))).withColumn("gap", gap)
    return rounded(met.groupBy("reason").agg(F.count("*").alias("n_pairs"), F.avg("gap").alias("mean_gap"), F.avg(F.abs(F.col("v0") - F.col("v1"))).alias("mean_difference")), "mean_gap", "mean_difference")


PAIRED = """WITH e AS (SELECT *, epoch_us(ts) // 1800000000 AS slot FROM events), p AS (SELECT slot, count(*) FILTER (event_id % 2 = 0) AS n0, count(*) FILTER (event_id % 2 = 1) AS n1, min(ts) FILTER (event_id % 2 = 0) AS t0, min(ts) FILTER (event_id % 2 = 1) AS t1, avg(value) FILTER (event_id % 2 = 0) AS v0, avg(value) FILTER (event_id % 2 = 1) AS v1 FROM e GROUP BY 1),
r AS (SELECT *, abs(epoch_us(t0) - epoch_us(t1)) / 6e7 AS gap FROM p WHERE n0 > 0 AND n1 > 0)
SELECT CASE WHEN n0 < 2 THEN 'FIRST_NOT_SCORED' WHEN n1 < 2 THEN 'SECOND_NOT_SCORED' WHEN abs(v0 - v1) > 60 THEN 'VALUE_DISAGREEMENT' WHEN gap > 15 THEN 'ISSUE_TIMES_TOO_FAR_APART' ELSE 'ACCEPTED' END AS reason,
 count(*) AS n_pairs, round(avg(gap), 7) AS mean_gap, round(avg(abs(v0 - v1)), 7) AS mean_difference FROM r GROUP BY 1"""

REPLICATES, SEED, BLOCK = 300, 17, 48


def _gains(spark, d):
    return scored(spark, d).withColumn("gain", F.abs(F.col("reference") - F.col("price")) - F.abs(F.col("frozen") - F.col("price")))


def block_bootstrap_day(spark, d):
    days = _gains(spark, d).groupBy(F.floor(F.col("slot") / 48).alias("day")).agg(F.sum("gain").alias("gain"), F.count("*").alias("rows"))
    from pyspark.sql import Window

    numbered = days.withColumn("k", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))
    return rounded(bootstrap.percentile_interval(bootstrap.block_means(numbered, "gain", "rows", REPLICATES, SEED)), "low", "middle", "high")


_GAINS = f"{SERIES}, gains AS (SELECT slot, abs(reference - price) - abs(frozen - price) AS gain FROM sco)"
_DRAW = f"CAST(('0x' || substr(md5('{SEED}-' || r || '-' || i), 1, 8)) AS BIGINT)"
_INTERVAL = "count(*) AS n_replicates, round(quantile_cont(mean, 0.025), 7) AS low, round(quantile_cont(mean, 0.5), 7) AS middle, round(quantile_cont(mean, 0.975), 7) AS high, CASE WHEN quantile_cont(mean, 0.975) < 0 THEN 'NEGATIVE' WHEN quantile_cont(mean, 0.025) > 0 THEN 'POSITIVE' ELSE 'INCONCLUSIVE' END AS classification"
BOOT_DAY = f"""WITH {_GAINS}, dd AS (SELECT slot // 48 AS day, sum(gain) AS gain, count(*) AS n, row_number() OVER (ORDER BY slot // 48) - 1 AS k FROM gains GROUP BY 1),
dr AS (SELECT r, {_DRAW} % (SELECT count(*) FROM dd) AS k FROM range({REPLICATES}) a(r), range((SELECT count(*) FROM dd)) b(i)), m AS (SELECT r, sum(gain) / sum(n) AS mean FROM dr JOIN dd ON dd.k = dr.k GROUP BY 1) SELECT {_INTERVAL} FROM m"""


def block_bootstrap_moving(spark, d):
    from pyspark.sql import Window

    g = _gains(spark, d).select("gain", (F.row_number().over(Window.orderBy("slot")) - 1).cast("long").alias("k"))
    n = g.count()
    draws = -(-n // BLOCK)
    rest = n - (draws - 1) * BLOCK  # the last block is cut so that a replicate has n rows
    sums = bootstrap.moving_block_sums(g, "gain", BLOCK).join(bootstrap.moving_block_sums(g, "gain", rest).withColumnRenamed("block_sum", "rest_sum"), "k")
    drawn = bootstrap.replicate_grid(spark, REPLICATES, draws).withColumn("k", bootstrap.draw(SEED, F.col("replicate"), F.col("i"), F.lit(n - BLOCK + 1)))
    means = drawn.join(sums, "k").groupBy("replicate").agg((F.sum(F.when(F.col("i") < draws - 1, F.col("block_sum")).otherwise(F.col("rest_sum"))) / n).alias("mean"))
    return rounded(bootstrap.percentile_interval(means), "low", "middle", "high")


BOOT_MOVING = f"""WITH {_GAINS}, g AS (SELECT gain, row_number() OVER (ORDER BY slot) - 1 AS k, count(*) OVER () AS n FROM gains), c AS (SELECT max(n) AS n, CAST(ceil(max(n) / {BLOCK}.0) AS BIGINT) AS dn FROM g),
dr AS (SELECT r, i, {_DRAW} % (SELECT n - {BLOCK - 1} FROM c) AS a, CASE WHEN i < (SELECT dn FROM c) - 1 THEN {BLOCK} ELSE (SELECT n - (dn - 1) * {BLOCK} FROM c) END AS len FROM range({REPLICATES}) x(r), range((SELECT dn FROM c)) y(i)),
m AS (SELECT r, sum(gain) / max(n) AS mean FROM dr JOIN g ON g.k >= dr.a AND g.k < dr.a + dr.len GROUP BY 1) SELECT {_INTERVAL} FROM m"""

COLUMNS, CHAIN_SEED = ["price", "slot"], "tidemark-ledger-v1"


def _rows(spark, d):
    return series(spark, d).filter("price is not null").select(F.col("slot").cast("string").alias("slot"), fixed_nine(F.col("price") / 7).alias("price"), F.col("slot").alias("position"))


def ledger_build(spark, d):
    return ledger.build(_rows(spark, d), COLUMNS, "position", CHAIN_SEED).select("slot", "price", "row_sha256", "chain_sha256")


_LEDGER = f"""RECURSIVE {SERIES}, rows_ AS (SELECT CAST(slot AS VARCHAR) AS slot, printf('%.9f', price / 7) AS price, row_number() OVER (ORDER BY slot) AS k FROM ser WHERE price IS NOT NULL),
dig AS (SELECT *, sha256('{{"price":"' || price || '","slot":"' || slot || '"}}') AS row_sha256 FROM rows_),
ch AS (SELECT k, slot, price, row_sha256, sha256(sha256('{CHAIN_SEED}') || chr(10) || row_sha256) AS chain_sha256 FROM dig WHERE k = 1
  UNION ALL SELECT d.k, d.slot, d.price, d.row_sha256, sha256(ch.chain_sha256 || chr(10) || d.row_sha256) FROM ch JOIN dig d ON d.k = ch.k + 1)"""
LEDGER = f"WITH {_LEDGER} SELECT slot, price, row_sha256, chain_sha256 FROM ch"


def ledger_verify(spark, d):
    """The ledger with an amount, a link and the order tampered with, and the check of the prefix that was locked before."""
    good = ledger.build(_rows(spark, d), COLUMNS, "position", CHAIN_SEED)
    at = lambda n: F.col("position") % 200 == n
    edited = good.withColumns({
        "price": F.when(at(17), F.lit("1.000000000")).otherwise(F.col("price")), "chain_sha256": F.when(at(58), F.lit("0" * 64)).otherwise(F.col("chain_sha256")),
        "slot": F.when(at(101), (F.col("position") - 60).cast("string")).otherwise(F.col("slot"))})
    bad = ledger.verify(edited, COLUMNS, "slot", CHAIN_SEED)
    return bad.crossJoin(ledger.verify_prefix(edited, good.filter("position < 947000")))  # one row by one row


_AT = "CAST(slot AS BIGINT) % 200"
LEDGER_VERIFY = f"""WITH {_LEDGER}, n AS (SELECT *, CAST(slot AS BIGINT) AS p, lag(CAST(slot AS BIGINT)) OVER (ORDER BY k) AS before FROM ch)
SELECT count(*) AS n_rows, count(*) FILTER ({_AT} IN (17, 101)) AS bad_digests, count(*) FILTER ({_AT} = 58) + count(*) FILTER (before % 200 = 58) AS bad_links, count(*) FILTER ({_AT} = 101 AND before >= p - 60) AS bad_order,
 count(*) FILTER (p < 947000) AS locked_rows, count(*) AS current_rows, count(*) FILTER (p < 947000 AND {_AT} = 58) AS changed_rows, count(*) FILTER (p >= 947000) AS new_rows, CASE WHEN count(*) FILTER (p < 947000 AND {_AT} = 58) = 0 THEN 'LOCKED_PREFIX_REPRODUCED' ELSE 'LOCKED_PREFIX_CHANGED' END AS status FROM n"""


def stream_daily_cycle(spark, d):
    """Events as a file stream, all that is there taken once, to tumbling days."""
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    path = shared(spark)
    run_available(daily(stream, "ts", "value"), f"{path}/rows", f"{path}/checkpoint", "complete")
    return rounded(read_sink(spark, f"{path}/rows", latest=True).withColumn("day_start", F.col("day_start").cast("timestamp_ntz")), "mean_value")


STREAM = "SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, count(*) AS n_rows, round(avg(value), 7) AS mean_value FROM events GROUP BY 1"


def parquet_roundtrip(spark, d):
    path = shared(spark)
    write_zstd(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), path, once=True)
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


ROUNDTRIP = "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2"



def blinded_availability(spark, d):
    """Counts of the scored rows against their grid, one of them doubled, and both ladders."""
    rows = scored(spark, d).withColumns({"decision": F.col("slot") - s.HORIZON, "publish": F.col("slot") - s.HORIZON - 1})
    doubled = rows.unionByName(rows.orderBy("slot").limit(1))
    counts = governance.blinded_counts(doubled, clock.slot_grid(table(spark, d, "events"), "ts"), ["price", "frozen"], "slot", "decision", "publish")
    return counts.select("*", governance.blinded_status(672, 0.9, F.lit(True)).alias("blinded"), governance.sealed_status(672, 0.9, F.lit(True)).alias("sealed"), governance.prospective_status(F.col("complete_rows"), F.col("complete_rows") / F.col("expected_rows"), F.col("future_rows")).alias("prospective"))


BLINDED = f"""WITH {SERIES}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM ser) AS e FROM sco)
SELECT n + 1 AS complete_rows, n AS on_grid_rows, CAST(2 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS off_grid_rows, CAST(0 AS BIGINT) AS future_rows, e AS expected_rows,
 CASE WHEN (n + 1) / e < 0.9 THEN 'BLOCKED_EVIDENCE' WHEN n + 1 < 672 THEN 'BLINDED_ACCUMULATION' ELSE 'REVEAL_ELIGIBLE' END AS blinded, 'BLOCKED_EVIDENCE' AS sealed,
 CASE WHEN (n + 1) / e < 0.8 THEN 'BLOCKED_EVIDENCE' WHEN n + 1 < 672 THEN 'SHADOW_ONLY' ELSE 'PROSPECTIVE_EVIDENCE_READY' END AS prospective FROM c"""


def live_shadow(spark, d):
    return rounded(governance.live_forecasts(series(spark, d), "price"), "baseline", "consensus", "direction_veto")


LIVE = f"""WITH {SERIES}, r AS (SELECT slot, price, lag(price, 48) OVER w AS day, price - lag(price, 48) OVER w AS res, lag(price, 44) OVER w AS baseline FROM ser WINDOW w AS (ORDER BY slot)),
h AS (SELECT a.slot, a.baseline, count(b.res) FILTER (b.slot > a.slot - 16) AS sr, count(b.res) AS lr, avg(b.res) FILTER (b.slot > a.slot - 16) AS sm, avg(b.res) AS lm, arg_max(b.day, b.slot) FILTER (b.res IS NOT NULL) AS anchor
  FROM r a LEFT JOIN r b ON b.slot <= a.slot - 4 AND b.slot > a.slot - 100 WHERE a.baseline IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN sr >= 8 AND lr >= 24 AND sm <> 0 AND sign(sm) = sign(lm) THEN sign(sm) * least(abs(sm), abs(lm)) ELSE 0.0 END AS prop FROM h),
v AS (SELECT *, prop <> 0 AND anchor IS NOT NULL AND sign(baseline - anchor) = sign(prop) AS ok FROM p)
SELECT slot, slot + 4 AS target_slot, round(baseline, 7) AS baseline, sr AS short_rows, lr AS long_rows, round(baseline + prop, 7) AS consensus, round(baseline + CASE WHEN ok THEN prop ELSE 0.0 END, 7) AS direction_veto,
 CASE WHEN sr < 8 OR lr < 24 THEN 'INSUFFICIENT_CAUSAL_HISTORY' WHEN prop = 0 THEN 'RESIDUAL_SIGN_DISAGREEMENT' WHEN anchor IS NULL THEN 'NO_CAUSAL_ANCHOR' WHEN ok THEN 'DIRECTION_ALIGNED_CORRECTION' ELSE 'BASE_DIRECTION_VETO' END AS reason FROM v"""

QUERIES = {
    "blinded_availability": (blinded_availability, BLINDED), "live_shadow": (live_shadow, LIVE),
    "ridge_fit": (ridge_fit, RIDGE_FIT), "ridge_score": (ridge_score, RIDGE_SCORE), "ridge_select_alpha": (ridge_select_alpha, SELECT_ALPHA), "experiment_fixed_window": (experiment_fixed_window, None), "experiment_local_scale": (experiment_local_scale, None), "paired_streams": (paired_streams, PAIRED),
    "block_bootstrap_day": (block_bootstrap_day, BOOT_DAY), "block_bootstrap_moving": (block_bootstrap_moving, BOOT_MOVING), "ledger_build": (ledger_build, LEDGER), "ledger_verify": (ledger_verify, LEDGER_VERIFY),
    "stream_daily_cycle": (stream_daily_cycle, STREAM), "parquet_roundtrip": (parquet_roundtrip, ROUNDTRIP),
}
