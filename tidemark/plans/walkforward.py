"""Walk-forward queries on the half-hourly series: folds follow from the first and last half-hour that the events have."""

from pyspark.sql import functions as F

from ..operators import clock, features
from ..operators import walkforward as wf
from . import series as s
from .series import SERIES, series
from .streams import NUDGE, nudged

DAY, FIRST, FOLD, SELECTION, CALIBRATION, WARMUP = 48, 15, 4, 4, 4, 3
PLAN = wf.Plan((wf.Family("last", ("lag_last",)), wf.Family("day", ("lag_day",)), wf.Family("smooth", ("mean_six",), richer=True)), "price", "lag_day", "lag_last")
WIDE = wf.Plan((*PLAN.families, wf.Family("levels", ("lag_last", "lag_day", "mean_six"), richer=True), wf.Family("history", ("lag_last", "lag_second", "lag_day", "mean_six"), richer=True)), "price", "lag_day", "lag_last")


def frame(spark, d):
    return features.safe_frame(series(spark, d), s.HORIZON).withColumn("decision_slot", F.col("slot") - s.HORIZON)


def folds(spark, d):
    a, b = series(spark, d).agg(F.min("slot"), F.max("slot")).first()
    return clock.rolling_folds(spark, a, a + DAY * FIRST, b + 1, DAY * FOLD, DAY * SELECTION, DAY * CALIBRATION, DAY * WARMUP)


def walkforward_choices(spark, d):
    """What each fold chooses and whether it is promoted."""
    out, _, _ = wf.run(frame(spark, d), folds(spark, d), PLAN)
    return nudged(out.select("fold", "family", "alpha", "reason", "selection_mae", "reference_mae", "selection_rows", "promoted"), "selection_mae", "reference_mae")


FIGURES = ("mae", "rmse", "bias", "p95_abs_error", "improvement_vs_frozen_pct", "improvement_vs_reference_pct", "win_rate_vs_frozen", "win_rate_vs_reference")


def walkforward_suite(spark, d):
    """Figures of each fold's scored rows: the reference, what is deployed, and the three causal candidates on it."""
    _, _, rows = wf.run(frame(spark, d), folds(spark, d), PLAN)
    return nudged(wf.fold_summary(rows.filter("block = 'score'")), *FIGURES)


def walkforward_wide(spark, d):
    """The same with families of several features, whose systems have no short form in SQL; a test compares it with numpy."""
    out, models, rows = wf.run(frame(spark, d), folds(spark, d), WIDE)
    scored = wf.fold_summary(rows.filter("block = 'score'")).filter("method = 'direction_veto'").select("fold", "n_rows", "mae", "improvement_vs_reference_pct")
    return nudged(out.join(scored, "fold").select("fold", "family", "alpha", "promoted", "selection_mae", "n_rows", "mae", "improvement_vs_reference_pct"), "selection_mae", "mae", "improvement_vs_reference_pct")


_MODEL = "y + (x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END * cv / CASE WHEN sd = 0 THEN 1 ELSE sd END * n / (n + alpha)"
WALK = f"""{SERIES}, fr AS (SELECT slot, price, lag(price, 5) OVER w AS l1, lag(price, 48) OVER w AS ld, CASE WHEN count(price) OVER v = 6 THEN avg(price) OVER v END AS m6 FROM ser WINDOW w AS (ORDER BY slot), v AS (ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 5 PRECEDING)),
ends AS (SELECT min(slot) AS a, max(slot) AS b FROM ser), fo AS (SELECT CAST(i + 1 AS INTEGER) AS fold, a AS ts, a + {DAY * FIRST} + i * {DAY * FOLD} AS ss, least(a + {DAY * FIRST} + (i + 1) * {DAY * FOLD}, b + 1) AS se FROM ends, range(10000) t(i) WHERE a + {DAY * FIRST} + i * {DAY * FOLD} < b + 1),
fb AS (SELECT *, ss - {DAY * (WARMUP + CALIBRATION + SELECTION)} AS sel, ss - {DAY * (WARMUP + CALIBRATION)} AS cal, ss - {DAY * WARMUP} AS wu FROM fo),
cm AS (SELECT slot, price, l1, ld, m6, unnest(['last', 'day', 'smooth']) AS fam, unnest([l1, ld, m6]) AS x, unnest([1, 2, 3]) AS ord FROM fr WHERE price IS NOT NULL AND l1 IS NOT NULL AND ld IS NOT NULL AND m6 IS NOT NULL),
fd AS (SELECT fold, min(slot - 4) FILTER (slot >= sel AND slot < cal) AS s1, min(slot - 4) FILTER (slot >= cal AND slot < wu) AS c1 FROM fb JOIN cm ON slot >= sel AND slot < wu GROUP BY 1),
fc AS (SELECT fb.*, least(sel, coalesce(s1, sel)) AS te, least(cal, coalesce(c1, cal)) AS send FROM fb LEFT JOIN fd USING (fold)),
ft AS (SELECT fold, fam, kind, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd, avg(price) AS y, covar_pop(x, price) AS cv FROM fc, cm, (VALUES ('train'), ('point')) k(kind)
  WHERE (slot >= ts AND slot < te) OR (kind = 'point' AND slot >= sel AND slot < send) GROUP BY 1, 2, 3),
tc AS (SELECT fold, quantile_cont(abs(price - l1), 0.9) AS cut FROM fc JOIN cm ON slot >= ts AND slot < te AND fam = 'last' GROUP BY 1),
ju AS (SELECT fold, fam, ord, alpha, avg(err) AS mae, count(*) AS n, avg(base) AS base, count(*) FILTER (tl) AS nt, avg(err) FILTER (tl) AS te, avg(base) FILTER (tl) AS tb FROM (
  SELECT fold, cm.fam, ord, alpha, abs(price - ({_MODEL})) AS err, abs(price - ld) AS base, abs(price - l1) >= cut AS tl FROM fc JOIN cm ON slot >= sel AND slot < send JOIN ft USING (fold, fam) JOIN tc USING (fold), (VALUES (0.0::DOUBLE), (1.0), (10.0), (100.0)) al(alpha) WHERE kind = 'train') GROUP BY 1, 2, 3, 4),
be AS (SELECT *, CASE WHEN nt < 20 THEN 'INSUFFICIENT_TAIL_ROWS' WHEN te > tb * 1.05 THEN 'TAIL_DEGRADATION' ELSE 'TAIL_GUARD_PASSED' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY fold, fam ORDER BY mae, alpha) AS k FROM ju) WHERE k = 1),
si AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY reason <> 'TAIL_GUARD_PASSED', mae, ord) AS kk FROM be WHERE fam <> 'smooth') WHERE kk = 1),
ch AS (SELECT s.fold, CASE WHEN r.up THEN r.fam ELSE s.fam END AS family, CASE WHEN r.up THEN r.alpha ELSE s.alpha END AS alpha, CASE WHEN r.up THEN r.reason ELSE s.reason END AS reason, CASE WHEN r.up THEN r.mae ELSE s.mae END AS mae, s.base, s.n
  FROM si s LEFT JOIN (SELECT b.*, b.reason = 'TAIL_GUARD_PASSED' AND s.mae <> 0 AND 100 * (s.mae - b.mae) / s.mae >= 0.5 AS up FROM be b JOIN si s ON s.fold = b.fold WHERE b.fam = 'smooth') r ON r.fold = s.fold),
cho AS (SELECT *, n >= 100 AND coalesce(100 * (base - mae) / base >= 5, false) AND reason = 'TAIL_GUARD_PASSED' AS promoted FROM ch)"""
CHOICES = f"WITH {WALK} SELECT fold, family, alpha, reason, round(mae + {NUDGE}, 7) AS selection_mae, round(base + {NUDGE}, 7) AS reference_mae, n AS selection_rows, promoted FROM cho"

_VALUE = "CASE method WHEN 'reference' THEN ld WHEN 'frozen' THEN frozen WHEN 'mean_48h' THEN frozen + mc WHEN 'consensus' THEN frozen + corr ELSE frozen + veto END"
SUITE = f"""WITH {WALK}, dep AS (SELECT fold, promoted, alpha, fam, n, mu, sd, y, cv FROM (SELECT fold, family AS fam, alpha, promoted FROM cho) JOIN ft USING (fold, fam) WHERE kind = 'point'),
bs AS (SELECT * FROM (SELECT fold, slot, slot >= ss AS sc, price, ld, CASE WHEN promoted THEN {_MODEL} ELSE ld END AS frozen FROM (SELECT fold, slot, ss, price, ld, l1, promoted, alpha, n, mu, sd, y, cv, CASE fam WHEN 'last' THEN l1 WHEN 'day' THEN ld ELSE m6 END AS x FROM fb JOIN fr ON slot >= wu AND slot < se JOIN dep USING (fold)) WHERE price IS NOT NULL AND ld IS NOT NULL AND l1 IS NOT NULL) WHERE frozen IS NOT NULL),
h AS (SELECT a.fold, a.slot, a.sc, a.price, a.ld, a.frozen, count(b.slot) AS lr, count(b.slot) FILTER (b.slot > a.slot - 17) AS sr, avg(b.price - b.frozen) AS lm, avg(b.price - b.frozen) FILTER (b.slot > a.slot - 17) AS sm, arg_max(b.frozen, b.slot) AS anchor
  FROM bs a LEFT JOIN bs b ON b.fold = a.fold AND b.slot <= a.slot - 5 AND b.slot > a.slot - 101 GROUP BY ALL),
g AS (SELECT *, CASE WHEN lr >= 24 THEN lm ELSE 0 END AS mc, CASE WHEN sr >= 8 AND lr >= 24 AND sm <> 0 AND sign(sm) = sign(lm) THEN sign(sm) * least(abs(sm), abs(lm)) ELSE 0.0 END AS corr FROM h),
v AS (SELECT *, CASE WHEN corr <> 0 AND sign(frozen - anchor) = sign(corr) THEN corr ELSE 0.0 END AS veto FROM g WHERE sc),
l AS (SELECT fold, method, price, frozen, ld, {_VALUE} AS p FROM v, (VALUES ('reference'), ('frozen'), ('mean_48h'), ('consensus'), ('direction_veto')) m(method)),
z AS (SELECT fold, method, count(*) AS n_rows, avg(abs(p - price)) AS mae, sqrt(avg((p - price) * (p - price))) AS rmse, avg(p - price) AS bias, quantile_cont(abs(p - price), 0.95) AS p95_abs_error,
  100 * (avg(abs(frozen - price)) - avg(abs(p - price))) / nullif(avg(abs(frozen - price)), 0) AS improvement_vs_frozen_pct, 100 * (avg(abs(ld - price)) - avg(abs(p - price))) / nullif(avg(abs(ld - price)), 0) AS improvement_vs_reference_pct,
  avg(CAST(abs(p - price) < abs(frozen - price) AS INTEGER)) AS win_rate_vs_frozen, avg(CAST(abs(p - price) < abs(ld - price) AS INTEGER)) AS win_rate_vs_reference FROM l GROUP BY 1, 2)
SELECT fold, method, n_rows, {", ".join(f"round({c} + {NUDGE}, 7) AS {c}" for c in FIGURES)} FROM z"""

QUERIES = {"walkforward_choices": (walkforward_choices, CHOICES), "walkforward_suite": (walkforward_suite, SUITE), "walkforward_wide": (walkforward_wide, None)}
