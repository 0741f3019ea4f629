"""Queries on vintages: orders are targets with a decision time, their line items are vintages with a publication time.

Line items of one order that were published together are one vintage, the first by line number, part, supplier and price.
"""

from pyspark.sql import functions as F

from ..operators import asof, clock, contracts, metrics
from ..sources import table

TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def targets(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderdate").alias("decision"), F.col("o_totalprice").alias("actual"))


def vintages(spark, d):
    line = table(spark, d, "lineitem")
    first = F.min_by(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")), F.struct(*TIE)).alias("v")
    return line.groupBy(F.col("l_orderkey").alias("target"), F.col("l_shipdate").alias("publish")).agg(first).select("target", "publish", "v.*")


def rounded(df, *names, places=4):
    return df.withColumns({n: F.round(n, places) for n in names})


VINTAGES = """
vint AS (SELECT target, publish, price, quantity FROM (
  SELECT l_orderkey AS target, l_shipdate AS publish, l_extendedprice AS price, l_quantity AS quantity,
         row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1),
elig AS (SELECT o_orderkey AS target, o_orderdate AS decision, o_totalprice AS actual, publish, price, quantity,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY publish DESC) AS k
  FROM orders JOIN vint ON target = o_orderkey WHERE publish <= o_orderdate)
"""


def asof_latest_prev(spark, d):
    out = asof.latest_and_previous(targets(spark, d), vintages(spark, d), ["price", "quantity"])
    return rounded(out, "price_delta", "abs_price_delta", "age_minutes", "minutes_between").select("target", "decision", "latest_publish", "previous_publish", "latest_price", "previous_price", "price_delta", "abs_price_delta", "latest_quantity", "age_minutes", "minutes_between")


ASOF_LATEST_PREV = f"""WITH {VINTAGES}
SELECT a.target, a.decision, a.publish AS latest_publish, b.publish AS previous_publish, a.price AS latest_price, b.price AS previous_price,
       round(a.price - b.price, 4) AS price_delta, round(abs(a.price - b.price), 4) AS abs_price_delta, a.quantity AS latest_quantity,
       round((epoch_us(a.decision) - epoch_us(a.publish)) / 6e7, 4) AS age_minutes, round((epoch_us(a.publish) - epoch_us(b.publish)) / 6e7, 4) AS minutes_between
FROM (SELECT * FROM elig WHERE k = 1) a LEFT JOIN (SELECT * FROM elig WHERE k = 2) b ON a.target = b.target"""


def asof_latest_only(spark, d):
    return asof.latest(targets(spark, d), vintages(spark, d), ["price", "quantity"])


ASOF_LATEST_ONLY = f"WITH {VINTAGES} SELECT target, decision, publish, price, quantity FROM elig WHERE k = 1"

AT = "1998-06-01 00:00:00"


def asof_point_in_time(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.max("l_extendedprice").alias("price"))
    out = asof.point_in_time(line, F.lit(AT).cast("timestamp_ntz"), "price", "l_shipdate", "l_partkey")
    return rounded(out, "mean_six", "median_value")


ASOF_POINT_IN_TIME = f"""WITH s AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AT}' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC) AS k FROM s QUALIFY k <= 48)
SELECT l_partkey, max(price) FILTER (k = 1) AS last_value, max(price) FILTER (k = 2) AS second_value,
       CASE WHEN count(*) >= 6 THEN round(avg(price) FILTER (k <= 6), 4) END AS mean_six, round(quantile_cont(price, 0.5), 4) AS median_value, count(*) AS n FROM r GROUP BY 1"""


def asof_coverage_metrics(spark, d):
    t = targets(spark, d)
    met = t.join(asof.latest(t, vintages(spark, d), ["price"]).select("target", "publish", "price"), "target", "left")
    out = met.agg(F.count("*").alias("n_targets"), F.count("publish").alias("n_selected"), F.avg(F.col("publish").isNotNull().cast("double")).alias("coverage"), F.count_if(F.col("publish") > F.col("decision")).alias("future_rows"), *(c.alias(k) for k, c in metrics.point("actual", "price").items()))
    return rounded(out, "coverage", "mae", "rmse", "bias", "p95_abs_error")


ASOF_COVERAGE = f"""WITH {VINTAGES}, m AS (SELECT o_orderkey, o_totalprice AS actual, e.price, e.publish, e.decision FROM orders LEFT JOIN (SELECT * FROM elig WHERE k = 1) e ON e.target = o_orderkey)
SELECT count(*) AS n_targets, count(publish) AS n_selected, round(count(publish) / count(*), 4) AS coverage, count(*) FILTER (publish > decision) AS future_rows, count(price) AS n_rows,
       round(avg(abs(price - actual)), 4) AS mae, round(sqrt(avg((price - actual) * (price - actual))), 4) AS rmse, round(avg(price - actual), 4) AS bias, round(quantile_cont(abs(price - actual), 0.95), 4) AS p95_abs_error FROM m"""


def _sources(spark, d):
    line = table(spark, d, "lineitem")
    cols = [F.col("l_partkey").alias("series"), F.col("l_shipdate").alias("target"), F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber", "l_suppkey"]
    return line.filter("l_linenumber <= 3").select(*cols), line.filter("l_linenumber > 3 and l_shipdate >= timestamp_ntz'1997-01-01'").select(*cols)


def stitch_hard_cut(spark, d):
    out = asof.stitch_hard_cut(*_sources(spark, d))
    return rounded(out.groupBy("series").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"), F.min("target").alias("first_target")), "total", places=2)


STITCH_HARD_CUT = """WITH new AS (SELECT * FROM lineitem WHERE l_linenumber > 3 AND l_shipdate >= TIMESTAMP '1997-01-01'),
u AS (SELECT * FROM lineitem WHERE l_linenumber <= 3 AND (l_shipdate < (SELECT min(l_shipdate) FROM new) OR (SELECT count(*) FROM new) = 0) UNION ALL SELECT * FROM new)
SELECT l_partkey AS series, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first_target FROM u GROUP BY 1"""


def stitch_causal_priority(spark, d):
    out = asof.stitch_priority(*_sources(spark, d), ["series", "target"], ["l_orderkey", "l_linenumber", "l_suppkey", "value"])
    return out.select("series", "target", "value", "source_priority")


STITCH_PRIORITY = """WITH u AS (SELECT *, 1 AS source_priority FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT *, 2 FROM lineitem WHERE l_linenumber > 3 AND l_shipdate >= TIMESTAMP '1997-01-01')
SELECT l_partkey AS series, l_shipdate AS target, l_extendedprice AS value, source_priority FROM u
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY source_priority DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1"""


def settlement_clock_dim(spark, d):
    """The half-hours of every day with an order, in local time: days of 46 and 50 of them are among these."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("settlement_date")).distinct()
    return clock.settlement_days(days).withColumn("settlement_date", F.col("settlement_date").cast("string"))


CLOCK = """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
b AS (SELECT d, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP))) AS a, timezone('UTC', timezone('Europe/London', CAST(d + 1 AS TIMESTAMP))) AS z FROM days),
s AS (SELECT d, a, unnest(generate_series(a, z - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS t FROM b)
SELECT CAST(d AS VARCHAR) AS settlement_date, CAST(date_diff('minute', a, t) // 30 + 1 AS INTEGER) AS settlement_period, t AS target_start_utc, t + INTERVAL 30 MINUTE AS target_end_utc FROM s"""


def slot_grid_completeness(spark, d):
    from ..functions import slot_of

    events = table(spark, d, "events")
    half = events.agg(F.floor(F.max("event_id") / 2).alias("half"))
    early = events.join(F.broadcast(half), F.col("event_id") < F.col("half"))  # one row
    return contracts.grid_counts(clock.slot_grid(early, "ts"), events.select(slot_of("ts").alias("slot")), "slot")


GRID = """WITH s AS (SELECT DISTINCT epoch_us(ts) // 1800000000 AS slot FROM events), g AS (SELECT min(epoch_us(ts) // 1800000000) AS a, max(epoch_us(ts) // 1800000000) AS b FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events))
SELECT max(b) - max(a) + 1 AS expected, count(*) FILTER (slot BETWEEN a AND b) AS on_grid, count(*) FILTER (slot NOT BETWEEN a AND b) AS off_grid, max(b) - max(a) + 1 - count(*) FILTER (slot BETWEEN a AND b) AS missing FROM s, g"""


def contract_audit(spark, d):
    line = table(spark, d, "lineitem")
    dup = contracts.duplicate_counts(line, "l_orderkey", "l_linenumber")
    met = targets(spark, d).join(line.select(F.col("l_orderkey").alias("target"), F.col("l_shipdate").alias("publish")), "target", "left")
    return dup.crossJoin(F.broadcast(contracts.publication_audit(met, "decision", "publish").drop("publish_column")))  # one row by one row


AUDIT = """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS extra_rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_groups,
  (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate) AS future_rows, (SELECT count(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate IS NULL) AS missing_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def weighted_reference(spark, d):
    line = table(spark, d, "lineitem").withColumn("volume", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")))
    out = metrics.weighted_reference(line, ["l_shipdate"], "l_extendedprice", "volume", {"has_a": F.col("l_returnflag") == "A", "has_n": F.col("l_returnflag") == "N"})
    return rounded(out, "reference_price", places=7)


WEIGHTED = """WITH l AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS volume FROM lineitem)
SELECT l_shipdate, round(coalesce(sum(l_extendedprice * volume) / nullif(sum(volume), 0), avg(l_extendedprice)), 7) AS reference_price, sum(volume) AS reference_volume,
       count(*) AS n_rows, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag = 'N') AS has_n FROM l GROUP BY 1"""


def spread_regimes(spark, d):
    orders = table(spark, d, "orders").withColumn("spread", F.abs(F.col("o_totalprice") - 250_000))
    cut = orders.filter("o_orderdate < timestamp_ntz'1998-01-01'").agg(F.percentile("spread", F.array(F.lit(0.8), F.lit(0.95))).alias("q"))
    marked = orders.crossJoin(F.broadcast(cut)).withColumn("regime", metrics.spread_regime(F.col("spread"), F.col("q")[0], F.col("q")[1]))  # one row
    out = marked.groupingSets([[], ["regime"]], "regime").agg(F.grouping("regime").cast("int").alias("is_total"), F.count("*").alias("n_rows"), F.avg("o_totalprice").alias("mean_price"), F.percentile("o_totalprice", 0.5).alias("median_price"), F.sum(F.col("spread") * 0.5).alias("exposure"))
    return rounded(rounded(out, "mean_price", "median_price"), "exposure", places=1)


SPREAD = """WITH o AS (SELECT *, abs(o_totalprice - 250000) AS spread FROM orders), q AS (SELECT quantile_cont(spread, 0.8) AS hi, quantile_cont(spread, 0.95) AS ex FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01'),
m AS (SELECT o.*, CASE WHEN spread >= ex THEN 'extreme' WHEN spread >= hi THEN 'high' WHEN spread IS NOT NULL THEN 'normal' ELSE 'missing' END AS regime FROM o, q)
SELECT regime, CAST(grouping(regime) AS INTEGER) AS is_total, count(*) AS n_rows, round(avg(o_totalprice), 4) AS mean_price, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price, round(sum(spread * 0.5), 1) AS exposure FROM m GROUP BY GROUPING SETS ((), (regime))"""


def revision_regimes(spark, d):
    two = asof.latest_and_previous(targets(spark, d), vintages(spark, d), ["price"])
    tau = two.agg(F.percentile("abs_price_delta", 0.9).alias("tau"))
    marked = two.crossJoin(F.broadcast(tau)).withColumn("regime", metrics.revision_regime(F.col("price_delta"), F.col("tau")))  # one row
    out = marked.groupBy("regime").agg(F.count("*").alias("n_rows"), F.avg("latest_price").alias("mean_price"), F.percentile("latest_price", 0.5).alias("median_price"), F.avg((F.col("latest_price") > 50_000).cast("double")).alias("share_above"))
    return rounded(out, "mean_price", "median_price", "share_above")


REVISION = f"""WITH {VINTAGES}, two AS (SELECT a.price, a.price - b.price AS delta FROM (SELECT * FROM elig WHERE k = 1) a LEFT JOIN (SELECT * FROM elig WHERE k = 2) b ON a.target = b.target),
t AS (SELECT quantile_cont(abs(delta), 0.9) AS tau FROM two)
SELECT CASE WHEN delta <= -tau THEN 'large_down' WHEN delta >= tau THEN 'large_up' WHEN delta IS NOT NULL THEN 'small' ELSE 'missing' END AS regime, count(*) AS n_rows,
       round(avg(price), 4) AS mean_price, round(quantile_cont(price, 0.5), 4) AS median_price, round(avg(CASE WHEN price > 50000 THEN 1.0 ELSE 0.0 END), 4) AS share_above FROM two, t GROUP BY 1"""


def json_event_scan(spark, d):
    k = F.from_json("props", "k long")["k"]
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.avg("value").alias("mean_value")), "mean_value")


JSON_SCAN = """SELECT event_type, count(*) AS n_rows, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(props->>'$.k' AS BIGINT)) AS max_k, round(avg(value), 4) AS mean_value FROM events GROUP BY 1"""


def ship_calendar(spark, d):
    """Calendar features in market time and in UTC."""
    from ..operators.features import calendar

    ts = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(ts, "Europe/London")
    e = table(spark, d, "events").select("event_id", "ts", local.alias("local"))
    hour = lambda t: F.hour(t) + F.minute(t) / 60
    cols = {f"local_{k}": c for k, c in calendar(hour("local"), F.weekday("local")).items()} | {f"utc_{k}": c for k, c in calendar(hour("ts"), F.weekday("ts")).items()}
    return rounded(e.withColumns(cols).drop("ts", "local"), *cols)


def _cyc(name, h, w):
    return f"round(sin({h} * 2 * pi() / 24), 4) AS {name}_hour_sin, round(cos({h} * 2 * pi() / 24), 4) AS {name}_hour_cos, round(sin({w} * 2 * pi() / 7), 4) AS {name}_dow_sin, round(cos({w} * 2 * pi() / 7), 4) AS {name}_dow_cos"


CALENDAR = f"""WITH e AS (SELECT event_id, ts, timezone('Europe/London', timezone('UTC', ts)) AS local FROM events)
SELECT event_id, {_cyc("local", "(hour(local) + minute(local) / 60)", "(isodow(local) - 1)")}, {_cyc("utc", "(hour(ts) + minute(ts) / 60)", "(isodow(ts) - 1)")} FROM e"""

QUERIES = {
    "asof_latest_prev": (asof_latest_prev, ASOF_LATEST_PREV), "asof_latest_only": (asof_latest_only, ASOF_LATEST_ONLY), "asof_point_in_time": (asof_point_in_time, ASOF_POINT_IN_TIME),
    "asof_coverage_metrics": (asof_coverage_metrics, ASOF_COVERAGE), "stitch_hard_cut": (stitch_hard_cut, STITCH_HARD_CUT), "stitch_causal_priority": (stitch_causal_priority, STITCH_PRIORITY),
    "settlement_clock_dim": (settlement_clock_dim, CLOCK), "slot_grid_completeness": (slot_grid_completeness, GRID), "contract_audit": (contract_audit, AUDIT), "weighted_reference": (weighted_reference, WEIGHTED),
    "spread_regimes": (spread_regimes, SPREAD), "revision_regimes": (revision_regimes, REVISION), "json_event_scan": (json_event_scan, JSON_SCAN), "calendar_features": (ship_calendar, CALENDAR),
}
