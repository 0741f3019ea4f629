"""Providers' normalisers and coverage gates. Raw records are made from orders and line items, with rows that break each contract."""

from pyspark.sql import functions as F

from ..functions import finite, slot_start
from ..operators import asof, clock, coverage, providers
from ..sources import table
from .series import SERIES, scored, series
from .vintages import VINTAGES, rounded, targets, vintages


def _orders(spark, d):
    """Orders as payload records: keys as text, starts in two spellings, half of the year an hour off the settlement clock."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    start = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(mins=key % 50 * 30)
    text = F.when(key % 3 == 0, F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(start, "yyyy-MM-dd HH:mm:ss'+00:00'"))
    price = F.when(key % 13 == 0, "NaN").when(key % 17 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.alias("startTime"), day.alias("settlementDate"), (key % 50 + 1).cast("string").alias("settlementPeriod"), F.when(key % 11 == 0, "OTHER").when(key % 2 == 0, "APXMIDP").otherwise("N2EXMIDP").alias("dataProvider"),
        price.alias("price"), F.when(key % 19 == 0, -1.0).otherwise(F.col("o_custkey").cast("double")).alias("volume"),
    )


_RAW = """raw AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 50 + 1 AS INTEGER) AS p, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 30 MINUTE * (o_orderkey % 50) AS st,
  CASE WHEN o_orderkey % 11 = 0 THEN 'OTHER' WHEN o_orderkey % 2 = 0 THEN 'APXMIDP' ELSE 'N2EXMIDP' END AS prov, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 19 = 0 THEN -1.0 ELSE CAST(o_custkey AS DOUBLE) END AS volume, o_custkey FROM orders),
ca AS (SELECT *, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP))) AS a, timezone('UTC', timezone('Europe/London', CAST(d + 1 AS TIMESTAMP))) AS z FROM raw),
cl AS (SELECT *, CASE WHEN a + INTERVAL 30 MINUTE * (p - 1) < z THEN abs(epoch_us(st) - epoch_us(a + INTERVAL 30 MINUTE * (p - 1))) / 1e6 END AS err FROM ca)"""
_KEY = "CAST(d AS VARCHAR) AS settlement_date, p AS settlement_period, st AS target_start_utc, st + INTERVAL 30 MINUTE AS target_end_utc"


def text_date(df):
    return df.withColumn("settlement_date", F.col("settlement_date").cast("string"))


def market_index_rows(spark, d):
    out = providers.market_index(_orders(spark, d))
    return text_date(out).withColumn("price", F.when(finite(F.col("price")), F.col("price")))


MARKET_INDEX = f"""WITH {_RAW} SELECT {_KEY}, prov AS data_provider, price, volume, err AS clock_error_seconds,
 CASE WHEN prov = 'OTHER' THEN 'UNEXPECTED_PROVIDER' WHEN count(*) OVER (PARTITION BY d, p, prov) > 1 THEN 'DUPLICATE_KEY' WHEN price IS NULL THEN 'NON_FINITE_PRICE' WHEN volume < 0 THEN 'NEGATIVE_VOLUME' WHEN err > 1 OR err IS NULL THEN 'CLOCK_MISMATCH' END AS fault FROM cl"""


def system_price_rows(spark, d):
    raw = _orders(spark, d).withColumnRenamed("volume", "system_buy_price").withColumn("niv", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("12.5"))
    out = providers.system_prices(raw)
    return text_date(out).withColumn("sell_price", F.when(finite(F.col("sell_price")), F.col("sell_price")))


SYSTEM_PRICES = f"""WITH {_RAW} SELECT {_KEY}, volume AS buy_price, price AS sell_price, CASE WHEN k % 7 <> 0 THEN 12.5 END AS imbalance_volume, err AS clock_error_seconds,
 CASE WHEN count(*) OVER (PARTITION BY d, p) > 1 THEN 'DUPLICATE_KEY' WHEN err > 1 OR err IS NULL THEN 'CLOCK_MISMATCH' END AS fault FROM cl"""


def reference_rows(spark, d):
    out = providers.canonical_reference(_orders(spark, d).selectExpr("startTime AS target_start_utc", "settlementDate AS settlement_date", "settlementPeriod AS settlement_period", "price AS reference_price"))
    return text_date(out).withColumn("reference_price", F.when(finite(F.col("reference_price")), F.col("reference_price")))


REFERENCE = f"""WITH {_RAW} SELECT CAST(d AS VARCHAR) AS settlement_date, p AS settlement_period, st AS target_start_utc, price AS reference_price,
 CASE WHEN count(*) OVER (PARTITION BY st) > 1 OR count(*) OVER (PARTITION BY d, p) > 1 THEN 'DUPLICATE_KEY' WHEN price IS NULL THEN 'NON_FINITE_PRICE' END AS fault FROM raw"""


def _forecasts(spark, d):
    """Line items as forecast records: the raw end on the UTC clock, published from three days before to weeks after."""
    period = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50 + 1
    day = F.col("l_shipdate").cast("date")
    end = day.cast("timestamp_ntz") + F.make_dt_interval(mins=period * 30)
    return table(spark, d, "lineitem").select(
        F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss").alias("DATE_GMT"), F.date_format(end + F.make_dt_interval(hours=F.when(F.col("l_linenumber") == 5, 3).otherwise(0)), "HH:mm").alias("TIME_GMT"), F.date_format(day, "yyyy-MM-dd'T'00:00:00").alias("SETTLEMENT_DATE"), period.alias("SETTLEMENT_PERIOD"), F.date_format(day.cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("l_suppkey") % 20 - 3).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("Forecast_Datetime"),
        F.col("l_quantity").alias("EMBEDDED_WIND_FORECAST"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_tax").cast("string")).alias("EMBEDDED_WIND_CAPACITY"), F.col("l_extendedprice").alias("EMBEDDED_SOLAR_FORECAST"), F.col("l_discount").alias("EMBEDDED_SOLAR_CAPACITY"),
        F.when(F.col("l_linenumber") == 1, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("FORECAST_ACTUAL_INDICATOR"), F.col("l_quantity").alias("EMBEDDED_WIND_GENERATION"), F.col("l_tax").alias("EMBEDDED_SOLAR_GENERATION"),
    )


_FC = """fc AS (SELECT *, CAST(l_shipdate AS DATE) AS d, CAST((l_orderkey * 7 + l_linenumber) % 50 + 1 AS INTEGER) AS p FROM lineitem),
fr AS (SELECT *, CAST(d AS TIMESTAMP) + INTERVAL 30 MINUTE * p AS re, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY * (l_suppkey % 20 - 3) AS pub FROM fc),
fl AS (SELECT *, CAST(timezone('Europe/London', timezone('UTC', re - INTERVAL 30 MINUTE)) AS DATE) AS ld FROM fr),
fe AS (SELECT *, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP))) + INTERVAL 30 MINUTE * p AS e0, timezone('UTC', timezone('Europe/London', CAST(d + 1 AS TIMESTAMP))) AS z0, timezone('UTC', timezone('Europe/London', CAST(ld AS TIMESTAMP))) + INTERVAL 30 MINUTE * p AS e1, timezone('UTC', timezone('Europe/London', CAST(ld + 1 AS TIMESTAMP))) AS z1 FROM fl),
fk AS (SELECT *, CASE WHEN e0 <= z0 THEN e0 END AS legacy_end, CASE WHEN e1 <= z1 THEN e1 END AS current_end FROM fe)"""
_MW = "l_quantity AS wind_mw, CASE WHEN l_linenumber <> 3 THEN l_tax END AS wind_capacity_mw, l_extendedprice AS solar_mw, l_discount AS solar_capacity_mw"


def vintage_archive_rows(spark, d):
    return text_date(providers.vintage_archive(_forecasts(spark, d), *providers.REGIMES))


VINTAGE_ARCHIVE = f"""WITH {_FC},
u AS (SELECT d AS sd, legacy_end AS te, 0.0 AS diff, 'legacy' AS source_regime, * FROM fk UNION ALL SELECT ld, re, abs(epoch_us(re) - epoch_us(current_end)) / 1e6, 'current', * FROM fk)
SELECT CAST(sd AS VARCHAR) AS settlement_date, p AS settlement_period, pub AS publish_time_utc, {_MW}, te AS target_end_utc, te - INTERVAL 30 MINUTE AS target_start_utc, diff AS clock_difference_seconds, source_regime,
 CASE WHEN te IS NULL THEN 'UNREADABLE_KEY' WHEN diff > 1 OR diff IS NULL THEN 'CLOCK_MISMATCH' WHEN count(*) OVER (PARTITION BY source_regime, te, pub) > 1 THEN 'DUPLICATE_KEY' WHEN pub > te + INTERVAL 14 DAY THEN 'IMPLAUSIBLE_PUBLICATION' END AS fault FROM u"""


def vintage_chunk_rows(spark, d):
    return text_date(providers.vintage_chunk(_forecasts(spark, d), "legacy"))


VINTAGE_CHUNK = f"""WITH {_FC}, o AS (SELECT *, (((epoch_us(re) + CASE WHEN l_linenumber = 5 THEN 10800000000 ELSE 0 END - epoch_us(legacy_end)) // 1000000 + 43200) % 86400 + 86400) % 86400 - 43200 AS off FROM fk)
SELECT CAST(d AS VARCHAR) AS settlement_date, p AS settlement_period, pub AS publish_time_utc, {_MW}, legacy_end AS target_end_utc, legacy_end - INTERVAL 30 MINUTE AS target_start_utc, CAST(off AS DOUBLE) AS raw_clock_offset_seconds, 'legacy' AS source_regime,
 CASE WHEN legacy_end IS NULL THEN 'UNREADABLE_KEY' WHEN abs(off) > 3601 THEN 'CLOCK_MISMATCH' END AS fault FROM o"""


def outturn_rows(spark, d):
    return text_date(providers.outturn(_forecasts(spark, d)))


OUTTURN = f"""WITH {_FC} SELECT CAST(d AS VARCHAR) AS settlement_date, p AS settlement_period, l_quantity AS actual_wind_mw, l_tax AS actual_solar_mw, legacy_end AS target_end_utc, legacy_end - INTERVAL 30 MINUTE AS target_start_utc,
 CASE WHEN legacy_end IS NULL THEN 'UNREADABLE_KEY' WHEN count(*) OVER (PARTITION BY legacy_end) > 1 THEN 'DUPLICATE_KEY' END AS fault FROM fk WHERE l_returnflag = 'A'"""


def joint_coverage_gate(spark, d):
    """The half-hours of the events' days; one source has some slots twice, the other lacks some prices."""
    at = series(spark, d).withColumn("target_start_utc", slot_start("slot"))
    days = at.select(F.col("target_start_utc").cast("date").alias("settlement_date")).distinct()
    keys = clock.settlement_days(days).select("settlement_date", "settlement_period", "target_start_utc")
    rows = at.join(keys, "target_start_utc")
    twice = rows.unionByName(rows.filter("slot % 300 = 0"))
    system = rows.withColumns({"buy": F.when(F.col("slot") % 90 != 0, F.col("price")), "sell": F.when(F.col("slot") % 70 != 0, F.col("price"))})
    keyed = ["settlement_date", "settlement_period"]
    gate = lambda reference, other, case: coverage.joint_coverage(keys, reference, other, keyed, "price", "buy", "sell").withColumn("case", F.lit(case))
    out = gate(rows, system, "once").unionByName(gate(twice, system, "twice")).unionByName(gate(rows, system.unionByName(system.filter("slot % 250 = 0")), "system_twice"))
    return rounded(out, "reference_coverage", "system_coverage", "joint_coverage")


JOINT = f"""WITH {SERIES}, pts AS (SELECT slot, price, make_timestamp(slot * 1800000000) AS st FROM ser), dd AS (SELECT DISTINCT CAST(st AS DATE) AS d FROM pts),
b AS (SELECT timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP))) AS a, timezone('UTC', timezone('Europe/London', CAST(d + 1 AS TIMESTAMP))) AS z FROM dd),
k AS (SELECT unnest(generate_series(a, z - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS st FROM b),
m AS (SELECT k.st, slot, price IS NOT NULL AS r, price IS NOT NULL AND slot % 90 <> 0 AS buy, price IS NOT NULL AND slot % 90 <> 0 AND slot % 70 <> 0 AS s FROM k LEFT JOIN pts ON pts.st = k.st),
g AS (SELECT count(*) AS n, round(count(*) FILTER (r) / count(*), 4) AS rc, round(count(*) FILTER (s) / count(*), 4) AS sc, round(count(*) FILTER (r AND buy) / count(*), 4) AS jc, least(count(*) FILTER (r), count(*) FILTER (s), count(*) FILTER (r AND buy)) / count(*) AS low, count(*) FILTER (slot % 300 = 0) AS dup, count(*) FILTER (slot % 250 = 0) AS sdup FROM m)
SELECT c AS "case", n AS expected_keys, rc AS reference_coverage, sc AS system_coverage, jc AS joint_coverage, CASE WHEN c = 'twice' THEN dup ELSE 0 END AS duplicate_reference_rows, CASE WHEN c = 'system_twice' THEN sdup ELSE 0 END AS duplicate_system_rows,
 CASE WHEN low >= 0.95 AND (c = 'once' OR (c = 'twice' AND dup = 0) OR (c = 'system_twice' AND sdup = 0)) THEN 'PASS_REAL' ELSE 'BLOCKED' END AS status FROM g, (VALUES ('once'), ('twice'), ('system_twice')) t(c)"""


def asof_feature_gate(spark, d):
    """Latest vintages known at the decision, and first vintages whenever published: those come too late for some."""
    t, v = targets(spark, d), vintages(spark, d)
    some = lambda df, case: coverage.asof_gate(t, df, "target", "decision", "publish").withColumn("case", F.lit(case))
    return rounded(some(asof.latest(t, v, ["price"]), "known").unionByName(some(v.groupBy("target").agg(F.min("publish").alias("publish")), "first")), "coverage")


ASOF_GATE = f"""WITH {VINTAGES}, f AS (SELECT target, min(publish) AS publish FROM vint GROUP BY 1), m AS (SELECT 'known' AS c, o_orderdate AS dec, e.publish FROM orders LEFT JOIN (SELECT * FROM elig WHERE k = 1) e ON e.target = o_orderkey UNION ALL SELECT 'first', o_orderdate, f.publish FROM orders LEFT JOIN f ON f.target = o_orderkey)
SELECT c AS "case", count(*) AS n_targets, count(publish) AS n_selected, round(count(publish) / count(*), 4) AS coverage, count(*) FILTER (publish > dec) AS future_rows,
 CASE WHEN count(*) >= 500 AND count(publish) / count(*) >= 0.8 AND count(*) FILTER (publish > dec) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM m GROUP BY 1"""


def stress_population_gate(spark, d):
    """Regimes of the move since a day ago, in blocks of 600 half-hours: the last block is short."""
    move = F.abs(F.col("price") - F.col("reference"))
    rows = scored(spark, d).withColumns({"regime": F.when(move >= 20, "extreme").when(move >= 10, "high").otherwise("normal"), "block": F.floor(F.col("slot") / 600), "known": F.when(F.col("slot") % 50 != 0, F.col("price"))})
    return rounded(coverage.stress_gate(rows, "regime", "known", ["block"]), "price_coverage")


STRESS = f"""WITH {SERIES}, r AS (SELECT slot // 600 AS block, abs(price - reference) >= 10 AS s, slot % 50 <> 0 AS k FROM sco)
SELECT block, count(*) AS n_rows, round(count(*) FILTER (k) / count(*), 4) AS price_coverage, count(*) FILTER (s AND k) AS n_stress_rows,
 CASE WHEN count(*) >= 500 AND count(*) FILTER (k) / count(*) >= 0.95 AND count(*) FILTER (s AND k) >= 50 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM r GROUP BY 1"""


def trailing_context_gaps(spark, d):
    return coverage.context_gaps(series(spark, d), "price").select("slot", "missing_context")


CONTEXT = f"WITH {SERIES} SELECT slot, 432 - count(price) OVER (ORDER BY slot RANGE BETWEEN 432 PRECEDING AND 1 PRECEDING) AS missing_context FROM ser"


def decision_clock_check(spark, d):
    rows = series(spark, d).withColumn("decision", F.when(F.col("slot") % 97 == 0, F.col("slot")).when(F.col("slot") % 101 != 0, F.col("slot") - 4))
    return coverage.decision_clock(rows, "slot", "decision", 4)


DECISION = f"WITH {SERIES} SELECT count(*) AS n_rows, count(*) FILTER (slot % 97 = 0 OR slot % 101 = 0) AS wrong_clock_rows FROM ser"

QUERIES = {
    "market_index_rows": (market_index_rows, MARKET_INDEX), "system_price_rows": (system_price_rows, SYSTEM_PRICES), "reference_rows": (reference_rows, REFERENCE), "vintage_archive_rows": (vintage_archive_rows, VINTAGE_ARCHIVE),
    "vintage_chunk_rows": (vintage_chunk_rows, VINTAGE_CHUNK), "outturn_rows": (outturn_rows, OUTTURN), "joint_coverage_gate": (joint_coverage_gate, JOINT), "asof_feature_gate": (asof_feature_gate, ASOF_GATE),
    "stress_population_gate": (stress_population_gate, STRESS), "trailing_context_gaps": (trailing_context_gaps, CONTEXT), "decision_clock_check": (decision_clock_check, DECISION),
}
