"""Queries on sources and sinks: paged stores, observed writes, record sets with faults, and download windows."""

from pyspark.sql import functions as F

from ..sources import table
from ..sources.observed import record_set, write_observed
from ..sources.paged import outside_window, read_index, read_pages, windows, write_pages
from .models import shared

PAGES, LOW, HIGH = 24, 500, 3_000


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderstatus")


def paged_orders(spark, d):
    """Orders as a store of pages: all of it, a range of keys, and a download that goes on after half of its pages."""
    path = shared(spark)
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    orders = _orders(spark, d)
    write_pages(orders, path, "o_orderkey", PAGES)
    done = [p["file"] for p in sorted(read_index(path), key=lambda p: p["first"])][: PAGES // 2]
    read = lambda done=(): read_pages(spark, path, orders.schema, "o_orderkey", done)
    inside = read().filter((F.col("o_orderkey") >= LOW) & (F.col("o_orderkey") < HIGH))
    rest = read(done)
    early = orders.join(rest.select("o_orderkey"), "o_orderkey", "left_anti")
    parts = {"all": read(), "range": inside, "early_and_rest": early.unionByName(rest)}
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_ALL = "SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents"
PAGED = f"{_ALL}, 'all' AS part FROM orders GROUP BY 1 UNION ALL {_ALL}, 'range' FROM orders WHERE o_orderkey >= {LOW} AND o_orderkey < {HIGH} GROUP BY 1 UNION ALL {_ALL}, 'early_and_rest' FROM orders GROUP BY 1"


def observed_write(spark, d):
    """Line items are written with zstd; counts, the largest delay after the order and mismatches come from that one pass."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = line.join(orders, "l_orderkey", "left").withColumn("delay", F.datediff("l_shipdate", "o_orderdate"))
    path = shared(spark)
    figures = write_observed(rows, path, {
        "n_rows": F.count("*"), "largest_delay_days": F.max("delay"), "smallest_delay_days": F.min("delay"), "shipped_before_order": F.count_if(F.col("delay") < 0), "without_order": F.count_if(F.col("o_orderdate").isNull()), "quantity": F.sum(F.col("l_quantity").cast("long"))})
    written = spark.read.parquet(path).agg(F.count("*").alias("written_rows"), F.count("l_shipdate").alias("written_dates"))
    return written.select(*(F.lit(v).cast("int" if k.endswith("_days") else "long").alias(k) for k, v in figures.items()), "written_rows", "written_dates")


OBSERVED = """SELECT count(*) AS n_rows, CAST(max(dl) AS INTEGER) AS largest_delay_days, CAST(min(dl) AS INTEGER) AS smallest_delay_days, count(*) FILTER (dl < 0) AS shipped_before_order, count(*) FILTER (o_orderdate IS NULL) AS without_order, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS written_rows, count(l_shipdate) AS written_dates
FROM (SELECT l.*, o_orderdate, date_diff('day', o_orderdate, l_shipdate) AS dl FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey)"""


def record_set_faults(spark, d):
    """A record for each half-hour in a file a day; of each seventh one the line is cut off, and one in 50 targets stands in two files."""
    from ..functions import slot_of

    slots = table(spark, d, "events").groupBy(slot_of("ts").alias("target")).agg(F.count("*").alias("n"))
    text = F.to_json(F.struct("target", "n"))
    lines = slots.select(F.floor(F.col("target") / 48).alias("day"), F.when(F.col("target") % 7 == 0, F.substring(text, 1, 9)).otherwise(text).alias("value"))
    again = slots.filter("target % 50 = 0 and target % 7 <> 0").select(F.floor(F.col("target") / 48 + 1).alias("day"), text.alias("value"))
    path = shared(spark)
    lines.unionByName(again).repartition("day").write.partitionBy("day").text(path)
    schema = spark.createDataFrame([], "target long, n long").schema
    return record_set(spark, f"{path}/day=*", schema, "target").groupBy(F.coalesce("fault", F.lit("NONE")).alias("fault")).agg(F.count("*").alias("n_records"), F.count("target").alias("n_with_target"), F.sum("n").alias("events"), F.max("n_files").alias("most_files"))


RECORDS = """WITH s AS (SELECT epoch_us(ts) // 1800000000 AS target, count(*) AS n FROM events GROUP BY 1), r AS (SELECT target, n, CASE WHEN target % 7 = 0 THEN 'UNREADABLE' WHEN target % 50 = 0 THEN 'REPEATED_TARGET' ELSE 'NONE' END AS fault FROM s UNION ALL SELECT target, n, 'REPEATED_TARGET' FROM s WHERE target % 50 = 0 AND target % 7 <> 0)
SELECT fault, count(*) AS n_records, count(*) FILTER (fault <> 'UNREADABLE') AS n_with_target, CAST(sum(n) FILTER (fault <> 'UNREADABLE') AS BIGINT) AS events, CAST(CASE WHEN fault = 'REPEATED_TARGET' THEN 2 ELSE 1 END AS BIGINT) AS most_files FROM r GROUP BY 1"""

SPAN = 90


def download_windows(spark, d):
    """Half-open windows of 90 days over all orders, what each payload holds, and the records that it should not hold."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    a, b = orders.agg(F.min("day"), F.date_add(F.max("day"), 1)).first()
    plan = windows(spark, str(a), str(b), SPAN)
    payload = orders.withColumn("window", F.floor(F.datediff("day", F.lit(str(a)).cast("date")) / SPAN).cast("int") + F.when(F.col("o_orderkey") % 1000 == 1, 1).otherwise(0))
    wrong = outside_window(payload, plan, "window", "day").groupBy("window").agg(F.count("*").alias("n_outside"))
    held = payload.groupBy("window").agg(F.count("*").alias("n_records"))
    out = plan.withColumnRenamed("number", "window").join(held.join(wrong, "window", "left"), "window", "full_outer")
    return out.select("window", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n_records", F.coalesce("n_outside", F.lit(0)).alias("n_outside"))


WINDOWS = f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders), e AS (SELECT min(day) AS a, max(day) + 1 AS b FROM o), p AS (SELECT CAST(i AS INTEGER) AS win, a + CAST(i * {SPAN} AS INTEGER) AS s, least(a + CAST((i + 1) * {SPAN} AS INTEGER), b) AS t FROM e, range(1000) r(i) WHERE a + CAST(i * {SPAN} AS INTEGER) < b),
h AS (SELECT CAST((day - a) // {SPAN} + CASE WHEN o_orderkey % 1000 = 1 THEN 1 ELSE 0 END AS INTEGER) AS win, o_orderkey % 1000 = 1 AS odd FROM o, e), g AS (SELECT win, count(*) AS n, count(*) FILTER (odd) AS x FROM h GROUP BY 1)
SELECT coalesce(p.win, g.win) AS "window", CAST(s AS VARCHAR) AS start, CAST(t AS VARCHAR) AS "end", n AS n_records, coalesce(x, 0) AS n_outside FROM p FULL OUTER JOIN g ON p.win = g.win"""

QUERIES = {"paged_orders": (paged_orders, PAGED), "observed_write": (observed_write, OBSERVED), "record_set_faults": (record_set_faults, RECORDS), "download_windows": (download_windows, WINDOWS)}
