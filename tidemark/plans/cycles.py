"""Streaming queries: files of derived rows arrive one after the other, and the stream's answer is that of the batch form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SLOT_US, slot_start
from ..streaming import history, read_sink, run_available, score_matured, sliding_means
from .models import shared
from .series import MON, SERIES, monitored, rounded, scored
from .streams import HISTORY_FIGURES, NUDGE, SCORED_HISTORY, history_inputs, nudged

PARTS, LATE_HOURS = 4, 3


def arrive(parts: list[DataFrame], path: str) -> None:
    """Each frame as one file, later ones with later times of modification, which is the order in which a file stream reads."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(path)


def follow(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)


def cut_by(rows: DataFrame, column: str, parts: int) -> list[DataFrame]:
    """Frames of equal ranges of a column; two numbers come to the driver."""
    a, b = rows.agg(F.min(column), F.max(column)).first()
    ends = [a + (b - a) * k // parts for k in range(1, parts)]
    low, high = [None, *ends], [*ends, None]
    return [rows.filter((F.lit(True) if x is None else F.col(column) >= x) & (F.lit(True) if y is None else F.col(column) < y)) for x, y in zip(low, high, strict=True)]


def residual_history_stream(spark, d):
    """The corrections of scored_history_live from a stream with state: rows come by the time at which they can be used."""
    path = shared(spark)
    rows = history.messages(*history_inputs(spark, d), by="stream").repartition(4)
    last = rows.agg(F.max("usable")).first()[0]
    arrive([*cut_by(rows, "usable", PARTS), history.ticks(spark, ["clean", "repeated"], "stream", last + 200)], f"{path}/in")
    run_available(history.corrections(follow(spark, f"{path}/in", rows), "stream"), f"{path}/out", f"{path}/checkpoint")
    return nudged(read_sink(spark, f"{path}/out"), *HISTORY_FIGURES)


def _cycle_inputs(spark, d):
    """Predictions, one in 11 of them recorded too late, and outcomes, of which one in 13 never comes."""
    s = scored(spark, d)
    start, end = slot_start("slot").cast("timestamp"), slot_start(F.col("slot") + 1).cast("timestamp")
    recorded = F.timestamp_micros((F.col("slot") + F.when(F.col("slot") % 11 == 0, 0).otherwise(-4)) * F.lit(SLOT_US))
    predictions = s.select(F.col("slot").alias("target"), start.alias("target_start"), end.alias("target_end"), recorded.alias("recorded_at"), F.col("frozen").alias("prediction"))
    outcomes = s.filter("slot % 13 <> 0").select(F.col("slot").alias("outcome_target"), end.alias("outcome_end"), F.col("price").alias("actual"))
    return predictions, outcomes


def shadow_cycle_restart(spark, d):
    """The cycle is stopped and started again from its checkpoint, while predictions wait for their outcomes.

    Outcomes come three slots after predictions, so each run leaves some in the join's state. Each target has one row: scored, blocked (not
    recorded before its target) or pending.
    """
    path = shared(spark)
    predictions, outcomes = _cycle_inputs(spark, d)
    p, o = cut_by(predictions, "target", 2), cut_by(outcomes.withColumn("due", F.col("outcome_target") + 3), "due", 2)
    for k in range(2):
        arrive([p[k]], f"{path}/p")
        arrive([o[k].drop("due")], f"{path}/o")
        met = score_matured(follow(spark, f"{path}/p", predictions), follow(spark, f"{path}/o", outcomes), "400 days")
        run_available(met, f"{path}/out", f"{path}/checkpoint")
    out = read_sink(spark, f"{path}/out").groupBy("target").agg(F.count("*").alias("n_scores"), F.first("abs_error").alias("abs_error"))
    state = F.when(F.col("recorded_at") >= F.col("target_start"), "NOT_RECORDED_BEFORE_TARGET").when(F.col("n_scores").isNull(), "PENDING").otherwise("SCORED")
    return rounded(predictions.join(out, "target", "left").select("target", state.alias("status"), F.coalesce("n_scores", F.lit(0)).alias("n_scores"), "abs_error"), "abs_error")


CYCLE = f"""WITH {SERIES} SELECT slot AS target, CASE WHEN slot % 11 = 0 THEN 'NOT_RECORDED_BEFORE_TARGET' WHEN slot % 13 = 0 THEN 'PENDING' ELSE 'SCORED' END AS status,
 CAST(slot % 11 <> 0 AND slot % 13 <> 0 AS BIGINT) AS n_scores, CASE WHEN slot % 11 <> 0 AND slot % 13 <> 0 THEN round(abs(frozen - price), 7) END AS abs_error FROM sco"""

ERRORS = ("adaptive_error", "frozen_error")


def sliding_monitor_stream(spark, d):
    """Means of the last 24, 72 and 168 hours. Two rows come in a file of their own: one an hour late, which counts, one nine days late, which does not.

    What is late is judged by the watermark of the batch before the last one, so three files come ahead of it.
    """
    path = shared(spark)
    rows = monitored(spark, d).select("slot", F.timestamp_micros((F.col("slot")) * F.lit(SLOT_US)).alias("at"), *ERRORS)
    a, b = rows.agg(F.min("slot"), F.max("slot")).first()
    cut = b - 336
    kept = rows.filter(F.col("slot") < b - 2).agg(F.max("slot")).first()[0]
    dropped = rows.filter(F.col("slot") < cut - 432).agg(F.max("slot")).first()[0]
    late = F.col("slot").isin(kept, dropped)
    first = rows.filter((F.col("slot") < cut) & ~late)
    arrive([*cut_by(first, "slot", 2), rows.filter((F.col("slot") >= cut) & ~late), rows.filter(late)], f"{path}/in")
    stream = sliding_means(follow(spark, f"{path}/in", rows), "at", ERRORS, late=f"{LATE_HOURS} hours")
    run_available(stream, f"{path}/out", f"{path}/checkpoint")
    out = read_sink(spark, f"{path}/out").select(F.floor(F.unix_micros("window_end") / SLOT_US - 1).cast("long").alias("slot"), "hours", "n_rows", *ERRORS)
    return nudged(out, *ERRORS)


SLIDING = f"""WITH {MON}, e AS (SELECT max(slot) AS b, max(slot) - 336 AS cut FROM m), gone AS (SELECT max(slot) AS g FROM m, e WHERE slot < cut - 432), r AS (SELECT slot, adaptive_error, frozen_error FROM m, gone WHERE slot <> g),
w AS ({" UNION ALL ".join(f"SELECT slot, CAST({h} AS INTEGER) AS hours, count(*) OVER w AS n_rows, " + ", ".join(f"round(avg({e}) OVER w + {NUDGE}, 7) AS {e}" for e in ERRORS) + f" FROM r WINDOW w AS (ORDER BY slot RANGE BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW)" for h in (24, 72, 168))})
SELECT w.* FROM w, e WHERE slot + 1 <= b - {2 * LATE_HOURS}"""

QUERIES = {
    "residual_history_stream": (residual_history_stream, SCORED_HISTORY), "shadow_cycle_restart": (shadow_cycle_restart, CYCLE),
    "sliding_monitor_stream": (sliding_monitor_stream, SLIDING),
}
