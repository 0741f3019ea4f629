"""Queries on forms: text sinks and scans, settlement keys, chronological splits, and models as text with strict prediction."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_nine, null_if_zero, round_trip, slot_of
from ..operators import clock, contracts, experiment, ridge
from ..operators.features import lags
from ..sources import ledger_csv, table, typed_csv, write_csv
from .models import shared
from .series import SERIES, blocks, rounded, scored

LEDGER = ["key", "status", "exact", "nine"]


def text_roundtrip(spark, d):
    """Order totals as text of 17 digits and of nine places: as a ledger, where nothing reads as missing, and as typed columns."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 == 0, 'said "x", twice').otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") / 3).alias("third"))
    path = shared(spark)
    write_csv(rows.select("key", "status", round_trip("third").alias("exact"), fixed_nine("third").alias("nine")), path)
    as_text = ledger_csv(spark, path, LEDGER)
    typed = typed_csv(spark, path, "key long, status string, exact double, nine double")
    same = rows.select(F.col("key").cast("long").alias("key"), "third").join(typed, "key").agg(F.count("*").alias("n_typed"), F.count_if(F.col("third") == F.col("exact")).alias("n_exact"), F.count_if(F.abs(F.col("third") - F.col("nine")) < 1e-8).alias("n_near"))
    read = as_text.agg(F.count("*").alias("n_rows"), F.count("status").alias("n_status"), F.count_if(F.col("status") == "").alias("n_empty"), F.count_if(F.col("status").contains('"')).alias("n_quoted"), F.count_if(F.col("nine").rlike(r"^[0-9]+\.[0-9]{9}$")).alias("n_nine"))
    return read.crossJoin(same)  # one row by one row


TEXT = """SELECT count(*) AS n_rows, count(*) AS n_status, count(*) FILTER (o_orderkey % 5 = 0) AS n_empty, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) AS n_quoted, count(*) FILTER (regexp_full_match(printf('%.9f', o_totalprice / 3), '[0-9]+\\.[0-9]{9}')) AS n_nine,
 count(*) AS n_typed, count(*) FILTER (CAST(printf('%.17g', o_totalprice / 3) AS DOUBLE) = o_totalprice / 3) AS n_exact, count(*) FILTER (abs(CAST(printf('%.9f', o_totalprice / 3) AS DOUBLE) - o_totalprice / 3) < 1e-8) AS n_near FROM orders"""


def canonical_ends(spark, d):
    """Half-hours by day and period, to the end that the clock gives them; a period no day has fails, so these are all of the clock."""
    e = table(spark, d, "events").select(slot_of("ts").alias("slot")).distinct()
    keys = e.select(F.to_date(F.timestamp_micros(F.col("slot") * F.lit(1_800_000_000))).alias("settlement_date"), (F.col("slot") % 48 + 1).cast("int").alias("settlement_period"))
    days = clock.settlement_days(keys.select("settlement_date").distinct(), "UTC")
    out = contracts.require_unique(clock.canonical_end(keys, days), "settlement_date", "settlement_period")
    return out.select(F.col("settlement_date").cast("string").alias("settlement_date"), "settlement_period", "target_end_utc")


ENDS = """SELECT DISTINCT CAST(CAST(make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) AS DATE) AS VARCHAR) AS settlement_date, CAST(epoch_us(ts) // 1800000000 % 48 + 1 AS INTEGER) AS settlement_period, make_timestamp((epoch_us(ts) // 1800000000 + 1) * 1800000000) AS target_end_utc FROM events"""


def split_blocks(spark, d):
    """60, 20 and 20 per cent in the order of time, the same in four blocks with a minimum of rows, and blocks between dates."""
    s = scored(spark, d)
    a = s.agg(F.min("slot")).first()[0]
    named = {f"three_{k}": b for k, b in enumerate(experiment.fraction_split(s, 0.6, 0.2))}
    named |= {f"four_{k}": b for k, b in enumerate(experiment.fraction_split(s, 0.5, 0.2, 0.15, least=80))}
    named |= {f"dated_{n}": b for n, b in experiment.dated_blocks(s, [a, a + 480, a + 720, a + 960, a + 1200]).items()}
    out = None
    for name, block in named.items():
        one = block.agg(F.lit(name).alias("block"), F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
        out = one if out is None else out.unionByName(one)
    return out


def _fractions(name, shares):
    ends, total = [], 0.0
    for x in shares:
        total += x
        ends.append(total)
    low, high = [0.0, *ends], [*ends, None]
    cut = lambda x: f"CAST(floor((SELECT count(*) FROM sco) * {x!r}) AS BIGINT)"
    return [f"SELECT '{name}_{k}' AS block, count(*) AS n_rows, min(slot) AS first_slot, max(slot) AS last_slot FROM nk WHERE k >= {cut(a)}" + (f" AND k < {cut(b)}" if b else "") for k, (a, b) in enumerate(zip(low, high, strict=True))]


SPLITS = f"WITH {SERIES}, nk AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS k, slot - min(slot) OVER () AS s FROM sco) " + " UNION ALL ".join(
    [*_fractions("three", (0.6, 0.2)), *_fractions("four", (0.5, 0.2, 0.15)), *(f"SELECT 'dated_{n}', count(*), min(slot), max(slot) FROM nk WHERE s >= {a} AND s < {a + 240 if a else 480}" for n, a in (("train", 0), ("selection", 480), ("calibration", 720), ("final", 960)))]
)


def strict_scores(spark, d):
    """A model of one feature that was written as JSON and read back, its strict prediction, and the change from row to row."""
    b = blocks(spark, d)
    model = ridge.Ridge.from_json(ridge.solve(ridge.moments(b["train"], ["frozen"], "price"), 5.0).to_json())
    rows = contracts.require_none(b["selection"].unionByName(b["calibration"]).unionByName(b["final"]), F.col("frozen").isNull(), "a row without its feature")
    out = lags(rows.withColumn("prediction", model.predict_strict()), "prediction", {"before": 1})
    change = F.col("prediction") - F.col("before")
    return rounded(out.select("slot", "prediction", change.alias("change"), (change / null_if_zero(F.col("before"))).alias("relative_change")), "prediction", "change", "relative_change")


STRICT = f"""WITH {SERIES}, nb AS (SELECT *, slot - (SELECT min(slot) FROM sco) AS k FROM sco), m AS (SELECT count(*) AS n, avg(frozen) AS mu, stddev_pop(frozen) AS sd, avg(price) AS y, covar_pop(frozen, price) AS cv FROM nb WHERE k < 600),
p AS (SELECT slot, y + (frozen - mu) / sd * cv / sd * n / (n + 5) AS prediction FROM nb, m WHERE k >= 600), l AS (SELECT *, lag(prediction) OVER (ORDER BY slot) AS before FROM p)
SELECT slot, round(prediction, 7) AS prediction, round(prediction - before, 7) AS change, round((prediction - before) / nullif(before, 0), 7) AS relative_change FROM l"""


def duplicate_events(spark, d):
    """Rows that share user, kind and half-hour, counted by the two contracts: beyond the first, and in groups; and the newest of each."""
    e = table(spark, d, "events").withColumn("slot", slot_of("ts"))
    keys = ["user_id", "event_type", "slot"]
    counts = contracts.duplicate_counts(e, *keys)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    newest = e.withColumn("_k", last).filter("_k = 1").agg(F.count("*").alias("n_newest"), F.sum("event_id").alias("sum_newest"))
    return counts.crossJoin(newest)  # one row by one row


DUPLICATES = """WITH g AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, event_type, epoch_us(ts) // 1800000000 ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id, event_type, epoch_us(ts) // 1800000000))
SELECT count(*) AS n_rows, count(*) - count(*) FILTER (k = 1) AS extra_rows, count(*) FILTER (n > 1) AS rows_in_groups, count(*) FILTER (k = 1) AS n_newest, CAST(sum(event_id) FILTER (k = 1) AS BIGINT) AS sum_newest FROM g"""

QUERIES = {
    "text_roundtrip": (text_roundtrip, TEXT), "canonical_ends": (canonical_ends, ENDS), "split_blocks": (split_blocks, SPLITS), "strict_scores": (strict_scores, STRICT), "duplicate_events": (duplicate_events, DUPLICATES),
}
