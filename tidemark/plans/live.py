"""A live forecast at every half-hour, each rule of its input broken at some of them."""

from pyspark.sql import functions as F

from ..functions import SLOT_US
from ..operators import live
from ..operators.ridge import Ridge
from .series import SERIES, series
from .streams import NUDGE, nudged

VALUES, GAP = ("wind", "solar"), 600
FEATURES = (*live.PRICES, *VALUES, "age_minutes")
#: Any fixed model serves; its coefficients are plain numbers so that SQL can repeat them.
MODEL = Ridge(FEATURES, 1.0, (0.0,) * 13, (1.0,) * 13, (2.0, 0.25, 0.125, 0.0625, 0.0625, 0.25, 0.125, 1.0, -1.0, 0.5, 0.25, 0.03125, -0.03125, 0.015625))


def inputs(spark, d):
    """A decision seven minutes into each half-hour; its prices end three half-hours before, and two vintages of its target are out by about then."""
    s = series(spark, d).withColumn("k", F.col("slot") - series(spark, d).agg(F.min("slot")).first()[0])
    history = s.filter(F.col("k") != GAP).select("slot", F.coalesce("price", F.lit(50.0)).alias("price"))
    slot, start = F.col("slot"), lambda c: c * F.lit(SLOT_US)
    late = F.when(slot % 41 == 0, 1).otherwise(0)
    decisions = s.select((start(slot) + 7 * live.MINUTE).alias("decision"), (slot - 3 + late).alias("cutoff"), (slot - 4 + late - F.when(slot % 43 == 0, 1).otherwise(0)).alias("last_slot"))
    t = slot + 5
    early = s.filter((slot + 5) % 47 != 0).select(t.alias("target"), start(t - 6).alias("publish"), F.when(t % 53 == 0, float("nan")).otherwise((t % 100).cast("double")).alias("wind"), (t % 17).cast("double").alias("solar"))
    second = s.filter((slot + 5) % 47 != 0).select(t.alias("target"), (start(t - 5) + F.when(t % 3 == 0, 5).otherwise(10) * live.MINUTE).alias("publish"), (t % 90).cast("double").alias("wind"), (t % 19).cast("double").alias("solar"))
    return decisions, history, early.unionByName(second)


def live_forecasts_asof(spark, d):
    out = live.forecasts(*inputs(spark, d), MODEL, VALUES)
    return nudged(out.select("decision", "cutoff", "target", "reason", "publish", "previous_day", "ridge", "age_minutes", "median_day", "mean_six"), "previous_day", "ridge", "age_minutes", "median_day", "mean_six")


_TERMS = {
    "lag_last": "p1", "lag_second": "p2", "mean_six": "m6", "median_day": "m48", "lag_day": "ld", "lag_week": "lw", "hour_sin": "sin(2 * pi() * hh / 24)", "hour_cos": "cos(2 * pi() * hh / 24)",
    "dow_sin": "sin(2 * pi() * dw / 7)", "dow_cos": "cos(2 * pi() * dw / 7)", "wind": "wind", "solar": "solar", "age_minutes": "age",
}
_RIDGE = " + ".join([str(MODEL.coef[0]), *(f"{c} * {_TERMS[f]}" for f, c in zip(FEATURES, MODEL.coef[1:], strict=True))])
_ON = "CASE WHEN reason IS NULL THEN"
#: The events lie in winter, when local time is UTC and settlement keys are a fixed number of half-hours apart.
LIVE = f"""WITH {SERIES}, s AS (SELECT slot, price, slot - (SELECT min(slot) FROM ser) AS k FROM ser), hi AS (SELECT slot, coalesce(price, 50.0) AS price FROM s WHERE k <> {GAP}),
cx AS (SELECT slot, price AS p1, lag(price) OVER w AS p2, avg(price) OVER (ORDER BY slot ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6, quantile_cont(price, 0.5) OVER (ORDER BY slot ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS m48,
  count(*) OVER (ORDER BY slot ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS cn, count(*) OVER (ORDER BY slot RANGE BETWEEN 431 PRECEDING AND CURRENT ROW) AS gr FROM hi WINDOW w AS (ORDER BY slot)),
de AS (SELECT slot * 1800000000 + 420000000 AS decision, slot + 5 AS t, slot - 3 + CASE WHEN slot % 41 = 0 THEN 1 ELSE 0 END AS cutoff, slot - 4 + CASE WHEN slot % 41 = 0 THEN 1 ELSE 0 END - CASE WHEN slot % 43 = 0 THEN 1 ELSE 0 END AS ls FROM s),
vi AS (SELECT slot + 5 AS t, (slot - 1) * 1800000000 AS pub, CASE WHEN (slot + 5) % 53 = 0 THEN 'NaN'::DOUBLE ELSE (slot + 5) % 100 END AS wind, ((slot + 5) % 17)::DOUBLE AS solar FROM s WHERE (slot + 5) % 47 <> 0
  UNION ALL SELECT slot + 5, slot * 1800000000 + CASE WHEN (slot + 5) % 3 = 0 THEN 300000000 ELSE 600000000 END, (slot + 5) % 90, (slot + 5) % 19 FROM s WHERE (slot + 5) % 47 <> 0),
nv AS (SELECT decision, max(pub) AS publish, arg_max(wind, pub) AS wind, arg_max(solar, pub) AS solar FROM de JOIN vi USING (t) WHERE pub <= decision GROUP BY 1),
j AS (SELECT de.*, cx.*, publish, wind, solar, (de.decision - publish) / 6e7 AS age, a.price AS ld, b.price AS lw, t % 48 / 2.0 AS hh, (t // 48 + 3) % 7 AS dw FROM de LEFT JOIN cx ON cx.slot = ls LEFT JOIN nv USING (decision) LEFT JOIN hi a ON a.slot = t - 48 LEFT JOIN hi b ON b.slot = t - 336),
r AS (SELECT *, CASE WHEN cutoff > (decision - 5400000000) // 1800000000 THEN 'PRICE_HISTORY_EXCEEDS_AVAILABILITY' WHEN gr IS NULL OR ls <> cutoff - 1 THEN 'LATEST_PRICE_NOT_AT_CUTOFF' WHEN gr < 432 THEN 'PRICE_GRID_INCOMPLETE' WHEN ld IS NULL OR lw IS NULL THEN 'MISSING_DAY_OR_WEEK_KEY'
  WHEN cn < 48 THEN 'INSUFFICIENT_PRICE_CONTEXT' WHEN publish IS NULL THEN 'NO_VINTAGE_BEFORE_DECISION' WHEN isnan(wind) THEN 'NONFINITE_VINTAGE' END AS reason FROM j)
SELECT decision, cutoff, t AS target, reason, publish, {_ON} round(ld + {NUDGE}, 7) END AS previous_day, {_ON} round({_RIDGE} + {NUDGE}, 7) END AS ridge, {_ON} round(age + {NUDGE}, 7) END AS age_minutes, {_ON} round(m48 + {NUDGE}, 7) END AS median_day, {_ON} round(m6 + {NUDGE}, 7) END AS mean_six FROM r"""

QUERIES = {"live_forecasts_asof": (live_forecasts_asof, LIVE)}
