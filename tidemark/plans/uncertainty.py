"""Uncertainty of the causal candidate against four comparators: moving blocks of a day and a week, and gated day blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap, causal
from .series import CAUSAL, scored
from .streams import NUDGE, nudged

REPLICATES, DAILY, SEED, BLOCKS = 10_000, 2_000, 202, (48, 336)
AGAINST = {"reference": "reference", "frozen": "frozen", "mean_48h": "mean_48h", "consensus": "consensus"}


def gains(spark, d):
    """By scored half-hour, how much smaller the error of the direction veto is than that of each comparator."""
    rows = causal.mean_correction(scored(spark, d), "price", "frozen").withColumnRenamed("corrected", "mean_48h").drop("residual", "history_rows", "correction")
    rows = causal.direction_veto(causal.consensus_correction(rows, "price", "frozen"), "frozen").withColumnRenamed("corrected", "consensus")
    size = lambda c: F.abs(F.col(c) - F.col("price"))
    return rows.select("slot", *(F.round(size(c) - size("veto_prediction"), 9).alias(n) for n, c in AGAINST.items()))


def uncertainty_moving(spark, d):
    """10,000 replicates of blocks of 48 and of 336 rows; a block that is longer than the series is left out."""
    rows = gains(spark, d).withColumn("k", (F.row_number().over(Window.orderBy("slot")) - 1).cast("long"))
    n = rows.count()
    parts = [bootstrap.moving_means(rows, list(AGAINST), b, REPLICATES if b <= n else 0, SEED + b, max(n, b)).withColumn("block_rows", F.lit(b)) for b in BLOCKS]
    out = bootstrap.intervals(parts[0].unionByName(parts[1]), list(AGAINST), ["block_rows"])
    return nudged(out, "low", "high", "share_above_0")


def uncertainty_daily(spark, d):
    """2,000 replicates of days; given only with 672 rows on 14 days at least, and once more with whole days alone, of which there must be 7."""
    rows = gains(spark, d).withColumn("day", F.floor(F.col("slot") / 48))
    days = rows.groupBy("day").agg(F.count("*").alias("rows"), F.sum("reference").alias("gain"))
    few = days.filter(F.col("day") < days.agg(F.min("day")).first()[0] + 10)
    whole = F.col("rows") == 48
    out = None
    for name, some, gate in (("all", days, {"least_days": 14, "least_rows": 672}), ("ten_days", few, {"least_days": 14, "least_rows": 672}), ("whole_days", days.filter(whole), {"least_days": 7, "day_rows": 48}), ("few_whole_days", few.filter(whole & (F.col("day") % 2 == 0)), {"least_days": 7, "day_rows": 48})):
        numbered = some.withColumn("k", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))  # a row a day
        means = bootstrap.block_means(numbered, "gain", "rows", DAILY, SEED).withColumnRenamed("mean", "reference")
        one = bootstrap.gated(bootstrap.intervals(means, ["reference"]), some, **gate).withColumn("rows_used", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return nudged(out.drop("value"), "low", "high", "share_above_0")


_G = f"""{CAUSAL}, gn AS (SELECT slot, round(abs(reference - price) - e, 9) AS reference, round(abs(frozen - price) - e, 9) AS frozen, round(abs(frozen + mean_corr - price) - e, 9) AS mean_48h, round(abs(frozen + corr - price) - e, 9) AS consensus FROM (SELECT *, abs(frozen + veto - price) AS e FROM v))"""


def _draw(seed, r="r", i="i"):
    return f"CAST(('0x' || substr(md5('{seed}-' || {r} || '-' || {i}), 1, 8)) AS BIGINT)"


_BLOCK = " UNION ALL ".join(
    f"SELECT {b} AS bl, r, i, {_draw(SEED + b)} % (n - {b - 1}) AS a, CASE WHEN i < dn - 1 THEN {b} ELSE n - (dn - 1) * {b} END AS len FROM (SELECT n, CAST(ceil(n / {b}.0) AS BIGINT) AS dn FROM sz), range({REPLICATES}) x(r), range((SELECT CAST(ceil(n / {b}.0) AS BIGINT) FROM sz)) y(i) WHERE n >= {b}"
    for b in BLOCKS
)
_STATS = f"round(quantile_cont(m, 0.025) + {NUDGE}, 7) AS low, round(quantile_cont(m, 0.975) + {NUDGE}, 7) AS high, round(avg(CAST(m > 0 AS INTEGER)) + {NUDGE}, 7) AS share_above_0, CASE WHEN quantile_cont(m, 0.025) > 0 THEN 'SUPPORTS_LOWER_ERROR' WHEN quantile_cont(m, 0.975) < 0 THEN 'SUPPORTS_HIGHER_ERROR' ELSE 'INTERVAL_INCLUDES_ZERO' END AS classification"
MOVING = f"""WITH {_G}, sz AS (SELECT count(*) AS n FROM gn), lg AS (SELECT row_number() OVER (PARTITION BY value ORDER BY slot) AS k, value, g FROM (SELECT slot, unnest({list(AGAINST)}) AS value, unnest([{", ".join(AGAINST)}]) AS g FROM gn)),
cs AS (SELECT k, value, sum(g) OVER (PARTITION BY value ORDER BY k) AS c FROM lg UNION ALL SELECT 0, value, 0.0 FROM lg WHERE k = 1), dr AS ({_BLOCK}),
mm AS (SELECT bl, value, r, sum(e.c - s.c) / max(n) AS m FROM dr JOIN cs s ON s.k = a JOIN cs e USING (value), sz WHERE e.k = a + len GROUP BY 1, 2, 3)
SELECT CAST(bl AS INTEGER) AS block_rows, value, count(*) AS n_replicates, {_STATS} FROM mm GROUP BY 1, 2"""


def _days(name, where, gate, counted):
    part = f"(SELECT *, row_number() OVER (ORDER BY day) - 1 AS k FROM dy WHERE {where})"
    stats = ", ".join(f"CASE WHEN gate = 'EVALUATED' THEN {c} END AS {c}" for c in ("low", "high", "share_above_0", "classification"))
    return f"""SELECT n_replicates, {stats}, days, gate, '{name}' AS rows_used FROM (SELECT count(*) AS n_replicates, {_STATS} FROM (SELECT r, sum(gain) / sum(n) AS m FROM (SELECT r, {_draw(SEED)} % (SELECT count(*) FROM {part}) AS k FROM range({DAILY}) x(r), range((SELECT count(*) FROM {part})) y(i)) JOIN {part} USING (k) GROUP BY 1)),
 (SELECT days, CASE {gate} ELSE 'EVALUATED' END AS gate FROM (SELECT {counted} AS days, sum(n) AS al FROM dy WHERE {where}))"""


_ROWS = "WHEN al < 672 THEN 'INSUFFICIENT_ROWS' WHEN days < 14 THEN 'INSUFFICIENT_DAYS'"
_FEW = "day < (SELECT min(day) FROM dy) + 10"
DAYS = f"WITH {_G}, dy AS (SELECT slot // 48 AS day, count(*) AS n, sum(reference) AS gain FROM gn GROUP BY 1) " + " UNION ALL ".join(
    [_days("all", "true", _ROWS, "count(*)"), _days("ten_days", _FEW, _ROWS, "count(*)"), _days("whole_days", "n = 48", "WHEN days < 7 THEN 'INSUFFICIENT_DAYS'", "count(*)"), _days("few_whole_days", f"n = 48 AND day % 2 = 0 AND {_FEW}", "WHEN days < 7 THEN 'INSUFFICIENT_DAYS'", "count(*)")]
)

QUERIES = {"uncertainty_moving": (uncertainty_moving, MOVING), "uncertainty_daily": (uncertainty_daily, DAYS)}
