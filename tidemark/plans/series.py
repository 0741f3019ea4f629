"""Queries on the half-hourly series: the mean event value of each half-hour, on the full grid, empty half-hours NULL."""

from pyspark.sql import functions as F

from ..functions import slot_of
from ..operators import causal, clock, features, metrics, monitor
from ..sources import table
from .vintages import rounded as _rounded

#: In half-hours: horizon of the frames below, and the blocks of the chronological experiments as row numbers.
HORIZON = 4
BLOCKS = {"train": (0, 600), "selection": (600, 850), "calibration": (850, 1100), "final": (1100, 1_000_000)}


def rounded(df, *names):
    """Seven places: prices have six, so that no figure ends in a tie."""
    return _rounded(df, *names, places=7)


def series(spark, d):
    events = table(spark, d, "events")
    mean = events.groupBy(slot_of("ts").alias("slot")).agg(F.round(F.avg("value"), 6).alias("price"))
    grid = clock.slot_grid(events, "ts")
    return grid.join(mean, "slot", "left")


def scored(spark, d):
    """Series with a frozen prediction (the last value known at the decision) and the reference (a day ago), complete rows."""
    s = features.lags(series(spark, d), "price", {"frozen": HORIZON + 1, "reference": 48})
    return s.dropna(subset=["price", "frozen", "reference"])


SERIES = """
s0 AS (SELECT epoch_us(ts) // 1800000000 AS slot, round(avg(value), 6) AS price FROM events GROUP BY 1),
ser AS (SELECT g.slot, s0.price FROM (SELECT unnest(generate_series((SELECT min(slot) FROM s0), (SELECT max(slot) FROM s0))) AS slot) g LEFT JOIN s0 ON s0.slot = g.slot),
sco AS (SELECT slot, price, frozen, reference FROM (SELECT slot, price, lag(price, 5) OVER (ORDER BY slot) AS frozen, lag(price, 48) OVER (ORDER BY slot) AS reference FROM ser)
        WHERE price IS NOT NULL AND frozen IS NOT NULL AND reference IS NOT NULL)
"""


def safe_lag_frame(spark, d):
    out = features.safe_frame(series(spark, d), HORIZON)
    return rounded(out, "price", "lag_last", "lag_second", "lag_day", "lag_week", "mean_six", "median_day")


def _safe(h):
    return f"""slot, round(price, 7) AS price, round(lag(price, {h + 1}) OVER w, 7) AS lag_last, round(lag(price, {h + 2}) OVER w, 7) AS lag_second, round(lag(price, 48) OVER w, 7) AS lag_day, round(lag(price, 336) OVER w, 7) AS lag_week,
  CASE WHEN count(price) OVER (ORDER BY slot ROWS BETWEEN {h + 6} PRECEDING AND {h + 1} PRECEDING) = 6 THEN round(avg(price) OVER (ORDER BY slot ROWS BETWEEN {h + 6} PRECEDING AND {h + 1} PRECEDING), 7) END AS mean_six,
  CASE WHEN count(price) OVER (ORDER BY slot ROWS BETWEEN {h + 48} PRECEDING AND {h + 1} PRECEDING) = 48 THEN round(quantile_cont(price, 0.5) OVER (ORDER BY slot ROWS BETWEEN {h + 48} PRECEDING AND {h + 1} PRECEDING), 7) END AS median_day"""


SAFE = f"WITH {SERIES} SELECT {_safe(HORIZON)} FROM ser WINDOW w AS (ORDER BY slot)"
HORIZONS = (1, 4, 12, 24)


def multi_horizon_frame(spark, d):
    each = series(spark, d).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    parts = [features.safe_frame(each.filter(F.col("horizon") == h), h, by=["horizon"]) for h in HORIZONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, "price", "lag_last", "lag_second", "lag_day", "lag_week", "mean_six", "median_day")


MULTI = f"WITH {SERIES} " + " UNION ALL ".join(f"SELECT {h} AS horizon, {_safe(h)} FROM ser WINDOW w AS (ORDER BY slot)" for h in HORIZONS)


def keyed_lag_frame(spark, d):
    s = series(spark, d).select("slot", "price")
    ends = s.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    days = ends.select(F.explode(F.sequence(F.to_date(F.timestamp_micros(F.col("a") * 1_800_000_000)), F.to_date(F.timestamp_micros(F.col("b") * 1_800_000_000)))).alias("settlement_date"))
    keyed = clock.settlement_days(days).withColumn("slot", slot_of("target_start_utc")).join(s, "slot").select("slot", "settlement_date", "settlement_period", "price")
    for k, name in ((1, "lag_1d"), (7, "lag_7d")):
        keyed = features.keyed_day_lag(keyed, "price", k, name)
    out = keyed.withColumn("settlement_date", F.col("settlement_date").cast("string"))
    return rounded(out, "price", "lag_1d", "lag_7d")


#: The events lie in winter, when local time is UTC.
KEYED = f"""WITH {SERIES}, k AS (SELECT slot, CAST(make_timestamp(slot * 1800000000) AS DATE) AS d, CAST(slot % 48 + 1 AS INTEGER) AS p, price FROM ser)
SELECT k.slot, CAST(k.d AS VARCHAR) AS settlement_date, k.p AS settlement_period, round(k.price, 7) AS price, round(a.price, 7) AS lag_1d, round(b.price, 7) AS lag_7d
FROM k LEFT JOIN k a ON a.d = k.d - 1 AND a.p = k.p LEFT JOIN k b ON b.d = k.d - 7 AND b.p = k.p"""


def point_metrics(spark, d):
    s = scored(spark, d).withColumn("series", F.lit("frozen"))
    out = s.agg(*(c.alias(k) for k, c in metrics.point("price", "reference", "frozen").items()))
    return rounded(out, "mae", "rmse", "bias", "p95_abs_error", "direction_accuracy")


_POINT = """count(*) AS n_rows, round(avg(abs(reference - price)), 7) AS mae, round(sqrt(avg((reference - price) * (reference - price))), 7) AS rmse, round(avg(reference - price), 7) AS bias, round(quantile_cont(abs(reference - price), 0.95), 7) AS p95_abs_error"""
POINT = f"WITH {SERIES} SELECT {_POINT}, round(avg(CASE WHEN sign(reference - frozen) = sign(price - frozen) THEN 1.0 ELSE 0.0 END) FILTER (price <> frozen), 7) AS direction_accuracy FROM sco"


def tail_metrics(spark, d):
    s = scored(spark, d)
    cut = s.agg(F.percentile(F.abs(F.col("price") - F.col("frozen")), 0.9).alias("threshold"))
    tail = s.crossJoin(F.broadcast(cut)).filter(F.abs(F.col("price") - F.col("frozen")) >= F.col("threshold"))  # one row
    out = tail.agg(F.first("threshold").alias("threshold"), *(c.alias(k) for k, c in metrics.point("price", "reference").items()))
    return rounded(out, "threshold", "mae", "rmse", "bias", "p95_abs_error")


TAIL = f"WITH {SERIES}, t AS (SELECT quantile_cont(abs(price - frozen), 0.9) AS threshold FROM sco) SELECT round(max(threshold), 7) AS threshold, {_POINT} FROM sco, t WHERE abs(price - frozen) >= threshold"


def _intervals(spark, d):
    """A constant interval round the reference, from the conformal quantile of the first half."""
    s = scored(spark, d).withColumn("score", F.abs(F.col("price") - F.col("reference"))).withColumn("g", F.lit(1))
    n = s.agg((F.min("slot") + F.floor((F.max("slot") - F.min("slot")) / 2)).cast("long").alias("half"))
    s = s.crossJoin(F.broadcast(n))  # one row
    q = metrics.conformal_quantile(s.filter("slot < half"), "score", 0.9, ["g"])
    return s.filter("slot >= half").join(F.broadcast(q.select("g", "q")), "g").withColumns({"lower": F.col("reference") - F.col("q"), "upper": F.col("reference") + F.col("q")}), q


_INTERVALS = f"""{SERIES}, sc AS (SELECT *, abs(price - reference) AS score, (SELECT min(slot) + (max(slot) - min(slot)) // 2 FROM sco) AS half FROM sco),
ranked AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM sc WHERE slot < half),
q AS (SELECT n, score AS q, least(greatest(CAST(ceil((n + 1) * 0.9) AS BIGINT), 1), n) AS k FROM ranked WHERE r = least(greatest(CAST(ceil((n + 1) * 0.9) AS BIGINT), 1), n)),
iv AS (SELECT sc.*, reference - q AS lower, reference + q AS upper FROM sc, q WHERE slot >= half)"""


def conformal_quantile(spark, d):
    return rounded(_intervals(spark, d)[1].select("n", "k", "q"), "q")


CONFORMAL = f"WITH {_INTERVALS} SELECT n, k, round(q, 7) AS q FROM q"


def interval_metrics(spark, d):
    out = _intervals(spark, d)[0].agg(*(c.alias(k) for k, c in metrics.interval("price", "lower", "upper", 0.9).items()))
    return rounded(out, "empirical_coverage", "mean_width", "median_width", "p95_width", "mean_interval_score")


INTERVAL = f"""WITH {_INTERVALS} SELECT count(*) AS n_rows, round(avg(CASE WHEN price >= lower AND price <= upper THEN 1.0 ELSE 0.0 END), 7) AS empirical_coverage, round(avg(upper - lower), 7) AS mean_width, round(quantile_cont(upper - lower, 0.5), 7) AS median_width,
  round(quantile_cont(upper - lower, 0.95), 7) AS p95_width, round(avg(upper - lower + greatest(lower - price, price - upper, 0) * (2.0 / (1 - 0.9))), 7) AS mean_interval_score FROM iv"""


def abstention_metrics(spark, d):
    s = _intervals(spark, d)[0].withColumns({"lower": F.col("reference") - F.col("q") / 8, "upper": F.col("reference") + F.col("q") / 8})
    return rounded(s.agg(*(c.alias(k) for k, c in metrics.abstention("price", "reference", "lower", "upper", "frozen").items())), "action_rate", "accuracy_on_actions", "ungated_accuracy")


ABSTENTION = f"""WITH {_INTERVALS}, a AS (SELECT *, CASE WHEN reference + (upper - reference) / 8 < frozen THEN -1 WHEN reference - (upper - reference) / 8 > frozen THEN 1 ELSE 0 END AS sig FROM iv)
SELECT count(*) AS n_rows, count(*) FILTER (sig <> 0) AS n_actions, round(avg(CASE WHEN sig <> 0 THEN 1.0 ELSE 0.0 END), 7) AS action_rate,
  round(avg(CASE WHEN sig = sign(price - frozen) THEN 1.0 ELSE 0.0 END) FILTER (sig <> 0 AND price <> frozen), 7) AS accuracy_on_actions, round(avg(CASE WHEN sign(reference - frozen) = sign(price - frozen) THEN 1.0 ELSE 0.0 END) FILTER (price <> frozen), 7) AS ungated_accuracy FROM a"""


def blocks(spark, d):
    """Rows of the scored series with their number, and the blocks they are in."""
    s = scored(spark, d)
    first = s.agg(F.min("slot").alias("first"))
    s = s.crossJoin(F.broadcast(first)).withColumn("k", F.col("slot") - F.col("first")).withColumn("decision_slot", F.col("slot") - HORIZON)  # one row
    return {name: s.filter((F.col("k") >= a) & (F.col("k") < b)) for name, (a, b) in BLOCKS.items()}


def split_and_purge(spark, d):
    b = blocks(spark, d)
    names = list(BLOCKS)
    out = None
    for name, after in zip(names, [*names[1:], None], strict=True):
        kept = features.purge(b[name], b[after]) if after else b[name]
        row = b[name].agg(F.lit(name).alias("block"), F.count("*").alias("n_before")).crossJoin(kept.agg(F.count("*").alias("n_after"), F.max("slot").alias("last_slot")))  # one row by one row
        out = row if out is None else out.unionByName(row)
    return out


def _purged(name, after):
    a, b = BLOCKS[name]
    known = f"slot + 1 <= (SELECT min(slot - {HORIZON}) FROM nb WHERE k >= {BLOCKS[after][0]} AND k < {BLOCKS[after][1]})" if after else "true"
    known = f"({known} OR NOT EXISTS (SELECT 1 FROM nb WHERE k >= {BLOCKS[after][0]} AND k < {BLOCKS[after][1]}))" if after else known
    return f"SELECT '{name}' AS block, count(*) AS n_before, count(*) FILTER ({known}) AS n_after, max(slot) FILTER ({known}) AS last_slot FROM nb WHERE k >= {a} AND k < {b}"


SPLIT = f"WITH {SERIES}, nb AS (SELECT *, slot - (SELECT min(slot) FROM sco) AS k FROM sco) " + " UNION ALL ".join(_purged(n, a) for n, a in zip(BLOCKS, [*list(BLOCKS)[1:], None]))


def rolling_origin_folds(spark, d):
    s = scored(spark, d)
    base = 1_704_067_200 // 1800  # 2024-01-01
    folds = clock.rolling_folds(spark, base, base + 48 * 17, base + 48 * 30, 48 * 5, 48 * 4, 48 * 4, 48 * 3)
    out = features.in_folds(s, folds).groupBy("fold", "block").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.avg("price").alias("mean_price"))
    return rounded(out, "mean_price")


FOLDS = f"""WITH {SERIES}, f AS (SELECT CAST(i + 1 AS INTEGER) AS fold, 946704 + 48 * 17 + i * 240 AS ss, least(946704 + 48 * 17 + i * 240 + 240, 946704 + 1440) AS se FROM range(3) t(i)),
j AS (SELECT fold, slot, price, CASE WHEN slot < ss - 144 - 192 - 192 THEN 'train' WHEN slot < ss - 144 - 192 THEN 'selection' WHEN slot < ss - 144 THEN 'calibration' WHEN slot < ss THEN 'warmup' ELSE 'score' END AS block FROM sco, f WHERE slot >= 946704 AND slot < se)
SELECT fold, block, count(*) AS n_rows, min(slot) AS first_slot, max(slot) AS last_slot, round(avg(price), 7) AS mean_price FROM j GROUP BY 1, 2"""


def causal_mean_48h(spark, d):
    out = causal.mean_correction(scored(spark, d), "price", "frozen")
    return rounded(out.select("slot", "residual", "history_rows", "correction", "corrected"), "residual", "correction", "corrected")


def causal_consensus(spark, d):
    out = causal.consensus_correction(scored(spark, d), "price", "frozen")
    return rounded(out.select("slot", "short_rows", "long_rows", "short_mean", "long_mean", "reason", "correction", "corrected"), "short_mean", "long_mean", "correction", "corrected")


def causal_direction_veto(spark, d):
    out = causal.direction_veto(causal.consensus_correction(scored(spark, d), "price", "frozen"), "frozen")
    return rounded(out.select("slot", "anchor", "veto_reason", "veto_correction", "veto_prediction"), "anchor", "veto_correction", "veto_prediction")


CAUSAL = f"""{SERIES}, h AS (SELECT a.slot, a.price, a.frozen, a.reference, count(b.slot) AS lr, count(b.slot) FILTER (b.slot > a.slot - 17) AS sr, avg(b.price - b.frozen) AS lm, avg(b.price - b.frozen) FILTER (b.slot > a.slot - 17) AS sm, arg_max(b.frozen, b.slot) AS anchor
  FROM sco a LEFT JOIN sco b ON b.slot <= a.slot - 5 AND b.slot > a.slot - 101 GROUP BY ALL),
c AS (SELECT *, CASE WHEN lr >= 24 THEN lm ELSE 0 END AS mean_corr,
  CASE WHEN sr < 8 THEN 'INSUFFICIENT_SHORT_HISTORY' WHEN lr < 24 THEN 'INSUFFICIENT_LONG_HISTORY' WHEN sm = 0 OR lm = 0 OR sign(sm) <> sign(lm) THEN 'REGIME_DISAGREEMENT_FALLBACK_FROZEN' ELSE 'CONSENSUS_CLIPPED_CORRECTION' END AS reason FROM h),
g AS (SELECT *, CASE WHEN reason = 'CONSENSUS_CLIPPED_CORRECTION' THEN sign(sm) * least(abs(sm), abs(lm)) ELSE 0.0 END AS corr FROM c),
v AS (SELECT *, CASE WHEN corr = 0 THEN 'INHERITED_' || reason WHEN anchor IS NULL THEN 'MISSING_CAUSAL_DIRECTION_ANCHOR_FALLBACK_FROZEN' WHEN sign(frozen - anchor) = sign(corr) THEN 'CONSENSUS_DIRECTION_ALIGNED_CORRECTION' ELSE 'FROZEN_DIRECTION_VETO_FALLBACK_FROZEN' END AS veto_reason,
  CASE WHEN corr <> 0 AND sign(frozen - anchor) = sign(corr) THEN corr ELSE 0.0 END AS veto FROM g)"""
MEAN48 = f"WITH {CAUSAL} SELECT slot, round(price - frozen, 7) AS residual, lr AS history_rows, round(mean_corr, 7) AS correction, round(frozen + mean_corr, 7) AS corrected FROM c"
CONSENSUS = f"WITH {CAUSAL} SELECT slot, sr AS short_rows, lr AS long_rows, round(CASE WHEN sr >= 8 AND lr >= 24 THEN sm END, 7) AS short_mean, round(CASE WHEN sr >= 8 AND lr >= 24 THEN lm END, 7) AS long_mean, reason, round(corr, 7) AS correction, round(frozen + corr, 7) AS corrected FROM g"
VETO = f"WITH {CAUSAL} SELECT slot, round(anchor, 7) AS anchor, veto_reason, round(veto, 7) AS veto_correction, round(frozen + veto, 7) AS veto_prediction FROM v"


def monitored(spark, d):
    out = causal.consensus_correction(scored(spark, d), "price", "frozen")
    e = lambda c: F.abs(F.col(c) - F.col("price"))
    return out.withColumns({"adaptive_error": e("corrected"), "frozen_error": e("frozen"), "reference_error": e("reference"), "applied": F.col("correction") != 0})


def cumulative_and_rolling_monitor(spark, d):
    out = monitor.cumulative_and_rolling(monitored(spark, d).select("slot", "adaptive_error", "frozen_error"), ["adaptive_error", "frozen_error"])
    return rounded(out, *(c for c in out.columns if c.endswith("error")))


def _roll(e):
    return f"round(avg({e}) OVER (ORDER BY slot ROWS UNBOUNDED PRECEDING), 7) AS cumulative_{e}, " + ", ".join(f"round(avg({e}) OVER (ORDER BY slot RANGE BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW), 7) AS rolling_{h}h_{e}" for h in (24, 72, 168))


MON = f"{CAUSAL}, m AS (SELECT *, abs(frozen + corr - price) AS adaptive_error, abs(frozen - price) AS frozen_error, abs(reference - price) AS reference_error, corr <> 0 AS applied FROM g)"
ROLLING = f"WITH {MON} SELECT slot, round(adaptive_error, 7) AS adaptive_error, round(frozen_error, 7) AS frozen_error, CAST(row_number() OVER (ORDER BY slot) AS INTEGER) AS rows_so_far, {_roll('adaptive_error')}, {_roll('frozen_error')} FROM m"
SEGMENTS = [("first_week", 946704, 946704 + 336), ("second_week", 946704 + 336, 946704 + 672), ("first_half", 946704, 946704 + 720), ("all", 0, 10_000_000), ("tail", 946704 + 1300, 10_000_000), ("none", 0, 1)]


def segment_metrics(spark, d):
    seg = spark.createDataFrame(SEGMENTS, "segment string, start long, end long")
    out = monitor.segment_rows(scored(spark, d), seg).groupBy("segment").agg(*(c.alias(k) for k, c in metrics.point("price", "reference").items()))
    return rounded(out, "mae", "rmse", "bias", "p95_abs_error")


SEGMENT = f"WITH {SERIES}, seg(segment, a, b) AS (VALUES {', '.join(map(str, SEGMENTS))}) SELECT segment, {_POINT} FROM sco JOIN seg ON slot >= a AND slot < b GROUP BY 1"


def daily_metrics(spark, d):
    s = scored(spark, d).withColumn("day", F.date_format(F.timestamp_micros(F.col("slot") * 1_800_000_000), "yyyy-MM-dd"))
    out = s.groupBy("day").agg(F.first(F.col("day").substr(1, 7)).alias("month"), *(c.alias(k) for k, c in metrics.point("price", "reference").items())).withColumn("complete", F.col("n_rows") == 48)
    return rounded(out, "mae", "rmse", "bias", "p95_abs_error")


DAILY = f"WITH {SERIES} SELECT strftime(make_timestamp(slot * 1800000000), '%Y-%m-%d') AS day, strftime(make_timestamp(slot * 1800000000), '%Y-%m') AS month, {_POINT}, count(*) = 48 AS complete FROM sco GROUP BY 1, 2"


def _windows(spark, d):
    bias = lambda c: F.avg(F.col(c) - F.col("price"))
    return monitor.last_windows(monitored(spark, d), {"n_rows": F.count("slot"), "adaptive_mae": F.avg("adaptive_error"), "frozen_mae": F.avg("frozen_error"), "reference_mae": F.avg("reference_error"), "adaptive_bias": bias("corrected"), "frozen_bias": bias("frozen"), "adaptive_p95": F.percentile("adaptive_error", 0.95), "reference_p95": F.percentile("reference_error", 0.95)})


MEASURES = ["adaptive_mae", "frozen_mae", "reference_mae", "adaptive_bias", "frozen_bias", "adaptive_p95", "reference_p95"]


def last_n_monitor(spark, d):
    return rounded(_windows(spark, d), *MEASURES)


WINS = f"""{MON}, t AS (SELECT *, row_number() OVER (ORDER BY slot DESC) AS k, count(*) OVER () AS n_all FROM m), w(win, width) AS (VALUES ('last_6h', 12), ('last_24h', 48), ('last_3d', 144), ('last_7d', 336)),
wm AS (SELECT win, max(na) AS n_all, CASE WHEN max(na) >= max(width) THEN 'OK' ELSE 'INSUFFICIENT_ROWS_NEED_' || max(width) END AS status, count(slot) AS n_rows, avg(adaptive_error) AS adaptive_mae, avg(frozen_error) AS frozen_mae, avg(reference_error) AS reference_mae,
  avg(frozen + corr - price) AS adaptive_bias, avg(frozen - price) AS frozen_bias, quantile_cont(adaptive_error, 0.95) AS adaptive_p95, quantile_cont(reference_error, 0.95) AS reference_p95
  FROM w CROSS JOIN (SELECT count(*) AS na FROM m) LEFT JOIN t ON k <= width AND na >= width GROUP BY 1)"""
LAST_N = f"WITH {WINS} SELECT win AS \"window\", n_all, status, n_rows, {', '.join(f'round({c}, 7) AS {c}' for c in MEASURES)} FROM wm"


def monitor_alerts(spark, d):
    return monitor.alert_flags(_windows(spark, d))


_MATURITY = "CASE WHEN n_all < 24 THEN 'EARLY_ONLY' WHEN n_all < 96 THEN 'INTRADAY_TO_2DAY_MONITORING' WHEN n_all < 336 THEN 'MULTIDAY_MONITORING' ELSE 'ONE_WEEK_PLUS_FORWARD' END"
_ALERTS = "CASE WHEN n_all < 48 THEN '' ELSE concat_ws(',', CASE WHEN adaptive_mae > reference_mae THEN 'ADAPTIVE_TRAILS_REFERENCE_24H' END, CASE WHEN adaptive_mae > frozen_mae THEN 'ADAPTIVE_TRAILS_FROZEN_24H' END, CASE WHEN abs(adaptive_bias) > abs(frozen_bias) THEN 'BIAS_CORRECTION_WORSENED_24H' END) END"
ALERTS = f"WITH {WINS}, a AS (SELECT *, {_ALERTS} AS alerts FROM wm WHERE win = 'last_24h') SELECT n_all, {_MATURITY} AS maturity_stage, CASE WHEN n_all < 48 THEN 'INSUFFICIENT_SAMPLE_FOR_ALERTS' WHEN alerts <> '' THEN 'ALERTS_PRESENT' ELSE 'NO_DEGRADATION_ALERTS' END AS alert_status, alerts FROM a"


def promotion_gate(spark, d):
    w = _windows(spark, d)
    all_ = monitored(spark, d).agg(*(F.avg(f"{k}_error").alias(f"all_{k}") for k in ("adaptive", "frozen", "reference")))
    week = w.filter("window = 'last_7d'").crossJoin(all_).crossJoin(monitor.alert_flags(w).select("alert_status"))  # one row each
    less = lambda a, b: F.col(a) < F.col(b)
    criteria = {
        "cumulative_mae_beats_reference": less("all_adaptive", "all_reference"), "cumulative_mae_beats_frozen": less("all_adaptive", "all_frozen"), "last_7d_mae_beats_reference": less("adaptive_mae", "reference_mae"), "last_7d_mae_beats_frozen": less("adaptive_mae", "frozen_mae"),
        "last_7d_p95_non_worse_than_reference": F.col("adaptive_p95") <= F.col("reference_p95"), "last_7d_bias_non_worse_than_frozen": F.abs("adaptive_bias") <= F.abs("frozen_bias"), "no_degradation_alerts": F.col("alert_status") == "NO_DEGRADATION_ALERTS",
    }
    return week.select("n_all", *(c.alias(k) for k, c in monitor.promotion(F.col("n_all"), criteria).items()))


_FAILED = "concat_ws(',', CASE WHEN NOT (aa < ar) THEN 'cumulative_mae_beats_reference' END, CASE WHEN NOT (aa < af) THEN 'cumulative_mae_beats_frozen' END, CASE WHEN NOT (adaptive_mae < reference_mae) THEN 'last_7d_mae_beats_reference' END, CASE WHEN NOT (adaptive_mae < frozen_mae) THEN 'last_7d_mae_beats_frozen' END, CASE WHEN NOT (adaptive_p95 <= reference_p95) THEN 'last_7d_p95_non_worse_than_reference' END, CASE WHEN NOT (abs(adaptive_bias) <= abs(frozen_bias)) THEN 'last_7d_bias_non_worse_than_frozen' END, CASE WHEN al <> '' OR n_all < 48 THEN 'no_degradation_alerts' END)"
PROMOTION = f"""WITH {WINS}, x AS (SELECT wm.*, aa, af, ar, al FROM wm, (SELECT avg(adaptive_error) AS aa, avg(frozen_error) AS af, avg(reference_error) AS ar FROM m), (SELECT {_ALERTS} AS al FROM wm WHERE win = 'last_24h') WHERE win = 'last_7d'), f AS (SELECT n_all, {_FAILED} AS f FROM x)
SELECT n_all, CASE WHEN n_all < 336 THEN 'NOT_ELIGIBLE_INSUFFICIENT_ROWS' WHEN f = '' THEN 'ELIGIBLE_FOR_REVIEW' ELSE 'NOT_ELIGIBLE_PERFORMANCE_GATES' END AS promotion_status, greatest(336 - n_all, 0) AS rows_needed, CASE WHEN n_all < 336 THEN 'NOT_EVALUATED_BEFORE_MINIMUM_SAMPLE' ELSE f END AS failed_criteria FROM f"""


def applied_runs(spark, d):
    return monitor.runs(monitored(spark, d).select("slot", "applied"), "applied")


RUNS = f"WITH {MON}, r AS (SELECT slot, applied, CASE WHEN applied <> lag(applied) OVER (ORDER BY slot) OR lag(applied) OVER (ORDER BY slot) IS NULL THEN 1 ELSE 0 END AS c FROM m), i AS (SELECT *, CAST(sum(c) OVER (ORDER BY slot) AS BIGINT) AS run FROM r) SELECT run, applied, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_rows FROM i GROUP BY 1, 2"


def gate_streaks(spark, d):
    m = monitored(spark, d)
    longest = monitor.runs(m.select("slot", "applied"), "applied").groupBy("applied").agg(F.max("n_rows").alias("longest_run"), F.count("*").alias("n_runs"))
    better, worse = F.col("adaptive_error") < F.col("frozen_error"), F.col("adaptive_error") > F.col("frozen_error")
    gained = m.groupBy("applied").agg(F.count("*").alias("n_rows"), F.count_if(better).alias("better"), F.count_if(worse).alias("worse"), F.count_if(~better & ~worse).alias("tied"), F.sum(F.col("frozen_error") - F.col("adaptive_error")).alias("avoided_error"))
    return rounded(gained.join(longest, "applied"), "avoided_error")


STREAKS = f"""WITH {MON}, r AS (SELECT *, row_number() OVER (ORDER BY slot) - row_number() OVER (PARTITION BY applied ORDER BY slot) AS island FROM m),
l AS (SELECT applied, max(c) AS longest_run, count(*) AS n_runs FROM (SELECT applied, island, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT m.applied, count(*) AS n_rows, count(*) FILTER (adaptive_error < frozen_error) AS better, count(*) FILTER (adaptive_error > frozen_error) AS worse, count(*) FILTER (adaptive_error = frozen_error) AS tied, round(sum(frozen_error - adaptive_error), 7) AS avoided_error, max(longest_run) AS longest_run, max(n_runs) AS n_runs FROM m JOIN l ON l.applied = m.applied GROUP BY 1"""

QUERIES = {
    "safe_lag_frame": (safe_lag_frame, SAFE), "multi_horizon_frame": (multi_horizon_frame, MULTI), "keyed_lag_frame": (keyed_lag_frame, KEYED), "point_metrics": (point_metrics, POINT), "tail_metrics": (tail_metrics, TAIL),
    "conformal_quantile": (conformal_quantile, CONFORMAL), "interval_metrics": (interval_metrics, INTERVAL), "abstention_metrics": (abstention_metrics, ABSTENTION), "split_and_purge": (split_and_purge, SPLIT), "rolling_origin_folds": (rolling_origin_folds, FOLDS),
    "causal_mean_48h": (causal_mean_48h, MEAN48), "causal_consensus": (causal_consensus, CONSENSUS), "causal_direction_veto": (causal_direction_veto, VETO), "cumulative_and_rolling_monitor": (cumulative_and_rolling_monitor, ROLLING),
    "segment_metrics": (segment_metrics, SEGMENT), "daily_metrics": (daily_metrics, DAILY), "last_n_monitor": (last_n_monitor, LAST_N), "monitor_alerts": (monitor_alerts, ALERTS), "promotion_gate": (promotion_gate, PROMOTION),
    "applied_runs": (applied_runs, RUNS), "gate_streaks": (gate_streaks, STREAKS),
}
