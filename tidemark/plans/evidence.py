"""Queries on evidence: content identity, sealed grids, frozen state and its replay, and figures that are revealed once."""

from pyspark.sql import functions as F

from ..functions import SLOT_US
from ..operators import bootstrap, frozen, governance, identity, reveal, ridge
from ..sources import table
from .models import shared
from .series import SERIES, blocks, rounded, scored, series

FIELDS = ["l_orderkey", "l_linenumber", "cents", "quantity"]


def _lines(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("quantity"), F.year("l_shipdate").alias("ship_year"))


def content_identity(spark, d):
    """Line items are locked by year and then tampered with: an amount edited, rows lost, rows doubled, a year moved to another."""
    rows = _lines(spark, d)
    odd, year = F.col("l_orderkey") % 100 == 7, F.col("ship_year")
    now = rows.filter(~((year == 1997) & odd)).withColumn("cents", F.when((year == 1996) & odd, F.col("cents") + 1).otherwise(F.col("cents")))
    now = now.unionByName(rows.filter((year == 1998) & odd)).withColumn("ship_year", F.when(year == 1999, 2099).otherwise(year))
    parts = identity.compare(identity.digest(rows, FIELDS, ["ship_year"]), identity.digest(now.repartition(7), FIELDS, ["ship_year"]), ["ship_year"])
    return parts.withColumns({c: F.col(c).cast("string") for c in ("total_locked", "total_now")})


_TEXT = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_DIGEST = f"SELECT ship_year, count(*) AS n, sum(CAST('0x' || substr(sha256({_TEXT}), 1, 15) AS BIGINT)::HUGEINT) AS t"
IDENTITY = f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS quantity, CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_orderkey % 100 = 7 AS odd FROM lineitem),
nw AS (SELECT l_orderkey, l_linenumber, CASE WHEN ship_year = 1996 AND odd THEN cents + 1 ELSE cents END AS cents, quantity, CASE WHEN ship_year = 1999 THEN 2099 ELSE ship_year END AS ship_year FROM (SELECT * FROM r WHERE NOT (ship_year = 1997 AND odd) UNION ALL SELECT * FROM r WHERE ship_year = 1998 AND odd)),
a AS ({_DIGEST} FROM r GROUP BY 1), b AS ({_DIGEST} FROM nw GROUP BY 1)
SELECT coalesce(a.ship_year, b.ship_year) AS ship_year, a.n AS n_locked, b.n AS n_now, CAST(a.t AS VARCHAR) AS total_locked, CAST(b.t AS VARCHAR) AS total_now,
 CASE WHEN b.n IS NULL THEN 'MISSING' WHEN a.n IS NULL THEN 'NEW' WHEN b.n > a.n THEN 'ROWS_ADDED' WHEN b.n < a.n THEN 'ROWS_LOST' WHEN a.t <> b.t THEN 'CHANGED' ELSE 'SAME' END AS state FROM a FULL OUTER JOIN b ON a.ship_year = b.ship_year"""

WEEK, SEALED = 336, 672


def sealed_grid(spark, d):
    """The half-hours that events have and the 672 that follow, as one grid: digests of its weeks in order, and their digest."""
    known = series(spark, d).filter("price is not null")
    after = known.agg(F.max("slot").alias("b")).select(F.explode(F.sequence(F.col("b") - 47, F.col("b") + SEALED)).alias("slot"))
    grid = identity.with_unknown_grid(known.select("slot", "price"), after, "slot", "price")
    text = F.date_format(F.timestamp_micros(F.col("slot") * F.lit(SLOT_US)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    whole = identity.ordered_digest(grid.withColumn("line", text), "line", "slot", F.floor(F.col("slot") / WEEK))
    counts = grid.agg(F.count("price").alias("known_rows"), F.count_if(F.col("price").isNull()).alias("unknown_rows"))
    return whole.crossJoin(F.broadcast(counts))  # one row by one row


GRID = f"""WITH {SERIES}, k AS (SELECT slot, price FROM ser WHERE price IS NOT NULL), e AS (SELECT max(slot) AS b FROM k), g AS (SELECT slot, price FROM k UNION ALL SELECT s, NULL FROM (SELECT unnest(generate_series(b - 47, b + {SEALED})) AS s FROM e) WHERE s NOT IN (SELECT slot FROM k)),
w AS (SELECT slot // {WEEK} AS wk, count(*) AS n, sha256(string_agg(strftime(make_timestamp(slot * 1800000000), '%Y-%m-%dT%H:%M:%S+00:00'), chr(10) ORDER BY slot)) AS p FROM g GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(p, chr(10) ORDER BY wk)) AS sha256, (SELECT count(price) FROM g) AS known_rows, (SELECT count(*) - count(price) FROM g) AS unknown_rows FROM w"""

FAMILIES = {"LAST_AND_DAY": ("frozen", "reference"), "DAY": ("reference",)}


def frozen_replay(spark, d):
    """A state is fitted, written once, read back and replayed; then every refusal is provoked, on real text and rows."""
    b = blocks(spark, d)
    features = FAMILIES["LAST_AND_DAY"]
    model = ridge.solve(ridge.moments(b["train"].unionByName(b["selection"]), features, "price"), 10.0)
    scores = b["calibration"].select(F.abs(model.predict() - F.col("price")).alias("score"), F.lit(1).alias("g"))
    state = frozen.Frozen("LAST_AND_DAY", 120, model, frozen.metrics.conformal_quantile(scores, "score", 0.9, ["g"]).first().q)
    path = shared(spark)
    locked = frozen.write_state(spark, state, path)
    text = frozen.read_state(spark, path)
    same = frozen.load(text, locked, FAMILIES, 120)
    frozen.same_quantile(same, b["calibration"], "price")
    old = b["final"].select("slot", model.predict().alias("prediction"))
    cases = [("intact", b["final"], old), ("row_lost", b["final"].filter("slot % 97 <> 0"), old), ("prediction_edited", b["final"], old.withColumn("prediction", F.col("prediction") + F.when(F.col("slot") % 97 == 0, 1e-6).otherwise(0.0)))]
    out = None
    for name, rows, predictions in cases:
        one = frozen.replay(same, rows, predictions).select(F.lit(name).alias("case"), "status", "locked_rows", "replayed_rows")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(spark.createDataFrame([(name, _refusal(text, locked, change, b["calibration"]), None, None) for name, change in REFUSALS.items()], "case string, status string, locked_rows long, replayed_rows long"))


def _seal(change):
    """A text that was changed ahead of its lock, so that later checks than that of its bytes see it."""
    return lambda text, locked: (changed := change(text), frozen.hashlib.sha256(changed.encode()).hexdigest())


REFUSALS = {
    "byte_changed": lambda text, locked: (text.replace("10.0", "10.5", 1), locked),
    "schema_changed": _seal(lambda t: t.replace(frozen.SCHEMA, "other")),
    "family_unknown": _seal(lambda t: t.replace("LAST_AND_DAY", "OTHER")),
    "features_swapped": _seal(lambda t: t.replace('["frozen","reference"]', '["reference","frozen"]')),
    "scale_negative": _seal(lambda t: t.replace('"scale":[', '"scale":[-')),
    "quantile_changed": _seal(lambda t: t.replace('"q":', '"q":1')),
}


def _refusal(text, locked, change, calibration):
    try:
        frozen.same_quantile(frozen.load(*change(text, locked), FAMILIES, 120), calibration, "price")
    except frozen.StateRefused as e:
        return e.reason
    return "ACCEPTED"


REPLAY = f"""WITH {SERIES}, f AS (SELECT slot FROM (SELECT slot, slot - (SELECT min(slot) FROM sco) AS k FROM sco) WHERE k >= 1100), n AS (SELECT count(*) AS n, count(*) FILTER (slot % 97 <> 0) AS m FROM f)
SELECT 'intact' AS "case", 'PASS' AS status, n AS locked_rows, n AS replayed_rows FROM n UNION ALL SELECT 'row_lost', CASE WHEN m < n THEN 'ROW_COUNT_MISMATCH' ELSE 'PASS' END, n, m FROM n UNION ALL SELECT 'prediction_edited', CASE WHEN m < n THEN 'PREDICTION_MISMATCH' ELSE 'PASS' END, n, n FROM n
UNION ALL SELECT * FROM (VALUES ('byte_changed', 'BYTES_NOT_LOCKED', NULL, NULL), ('schema_changed', 'UNSUPPORTED_SCHEMA', NULL, NULL), ('family_unknown', 'UNEXPECTED_FAMILY_OR_HORIZON', NULL, NULL), ('features_swapped', 'FEATURE_ORDER', NULL, NULL), ('scale_negative', 'BAD_NUMBERS', NULL, NULL), ('quantile_changed', 'QUANTILE_NOT_REPRODUCED', NULL, NULL))"""

REPLICATES, SEED = 1000, 23


def sealed_reveal(spark, d):
    """The first 672 scored half-hours as a sealed window: too early, then revealed, then asked for again."""
    rows = scored(spark, d).orderBy("slot").limit(SEALED).withColumns({"decision": F.col("slot") - 4, "publish": F.col("slot") - 5})
    path = f"{shared(spark)}/revealed"
    count = lambda some, elapsed: governance.blinded_counts(some, rows, ["price", "frozen"], "slot", "decision", "publish").withColumn("status", governance.sealed_status(SEALED, 0.95, F.lit(elapsed)))
    gain = F.abs(F.col("frozen") - F.col("price")) - F.abs(F.col("reference") - F.col("price"))

    def evaluate():
        days = rows.groupBy(F.floor(F.col("slot") / 48).alias("day")).agg(F.sum(gain).alias("gain"), F.count("*").alias("rows"))
        from pyspark.sql import Window

        numbered = days.withColumn("k", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))  # a row a day
        interval = bootstrap.percentile_interval(bootstrap.block_means(numbered, "gain", "rows", REPLICATES, SEED))
        return rows.agg(F.count("*").alias("n_rows"), F.avg(gain).alias("mean_difference")).crossJoin(interval.select("low", "high", reveal.classify().alias("classification")))

    def attempt(name, some, elapsed):
        try:
            out = reveal.reveal(spark, count(some, elapsed), path, name, evaluate)
        except reveal.AlreadyRevealed:
            out = spark.range(1).select(F.lit("ALREADY_REVEALED").alias("status"))
        kinds = {"status": "string", "n_rows": "long", "mean_difference": "double", "low": "double", "high": "double", "classification": "string"}
        return out.select(F.lit(name).alias("attempt"), *(F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))

    first = rows.filter("slot % 19 <> 0")
    tries = [attempt("too_few_rows", first, True), attempt("too_early", rows, False), attempt("repeated", rows.unionByName(rows.filter("slot % 97 = 0")), True), attempt("complete", rows, True), attempt("again", rows, True)]
    out = tries[0]
    for t in tries[1:]:
        out = out.unionByName(t)
    return rounded(out, "mean_difference", "low", "high")


_DRAW = f"CAST(('0x' || substr(md5('{SEED}-' || r || '-' || i), 1, 8)) AS BIGINT)"
REVEAL = f"""WITH {SERIES}, w AS (SELECT *, abs(frozen - price) - abs(reference - price) AS gain FROM (SELECT * FROM sco ORDER BY slot LIMIT {SEALED})), c AS (SELECT count(*) AS n, count(*) FILTER (slot % 19 <> 0) AS few, count(*) FILTER (slot % 97 = 0) AS twice FROM w),
dd AS (SELECT slot // 48 AS day, sum(gain) AS gain, count(*) AS n, row_number() OVER (ORDER BY slot // 48) - 1 AS k FROM w GROUP BY 1), dr AS (SELECT r, {_DRAW} % (SELECT count(*) FROM dd) AS k FROM range({REPLICATES}) a(r), range((SELECT count(*) FROM dd)) b(i)),
q AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT r, sum(gain) / sum(n) AS m FROM dr JOIN dd ON dd.k = dr.k GROUP BY 1))
SELECT 'complete' AS attempt, CASE WHEN full_ THEN 'SEALED_CONFIRMATORY_REVEALED' ELSE 'SEALED_ACCUMULATION' END AS status, CASE WHEN full_ THEN (SELECT n FROM c) END AS n_rows, CASE WHEN full_ THEN round((SELECT avg(gain) FROM w), 7) END AS mean_difference, CASE WHEN full_ THEN round(low, 7) END AS low, CASE WHEN full_ THEN round(high, 7) END AS high,
 CASE WHEN NOT full_ THEN NULL WHEN high < 0 THEN 'CONFIRMATORY_POSITIVE' WHEN low > 0 THEN 'CONFIRMATORY_NEGATIVE' ELSE 'CONFIRMATORY_INCONCLUSIVE' END AS classification FROM (SELECT *, (SELECT n = {SEALED} FROM c) AS full_ FROM q)
UNION ALL SELECT 'again', CASE WHEN n = {SEALED} THEN 'ALREADY_REVEALED' ELSE 'SEALED_ACCUMULATION' END, NULL, NULL, NULL, NULL, NULL FROM c UNION ALL SELECT 'too_early', 'SEALED_ACCUMULATION', NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 'repeated', CASE WHEN twice > 0 THEN 'BLOCKED_EVIDENCE' END, NULL, NULL, NULL, NULL, NULL FROM c UNION ALL SELECT 'too_few_rows', CASE WHEN few / n < 0.95 THEN 'BLOCKED_EVIDENCE' ELSE 'SEALED_ACCUMULATION' END, NULL, NULL, NULL, NULL, NULL FROM c"""

QUERIES = {"content_identity": (content_identity, IDENTITY), "sealed_grid": (sealed_grid, GRID), "frozen_replay": (frozen_replay, REPLAY), "sealed_reveal": (sealed_reveal, REVEAL)}
