"""The recurring score-and-freeze cycle as Structured Streaming: joins, windows, state with timers, and a sink that survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_matured(predictions: DataFrame, outcomes: DataFrame, delay: str = "90 minutes") -> DataFrame:
    """Stream-stream join on the target: a prediction waits in state until its outcome has come, and not longer than the delay.

    Only predictions that were recorded before their target began count; the watermark is what bounds the state.
    """
    p = predictions.withWatermark("target_end", delay).filter(F.col("recorded_at") < F.col("target_start"))
    o = outcomes.withWatermark("outcome_end", delay).dropDuplicatesWithinWatermark(["outcome_target"])
    met = p.join(o, (F.col("target") == F.col("outcome_target")) & (F.col("outcome_end") == F.col("target_end")))
    return met.select("target", "target_start", "target_end", "prediction", "actual", F.abs(F.col("prediction") - F.col("actual")).alias("abs_error"))


def daily(events: DataFrame, ts: str, value: str, late: str = "90 minutes") -> DataFrame:
    """Tumbling UTC-day counts and means."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    return w.agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean_value")).select(F.col("window.start").alias("day_start"), "n_rows", "mean_value")


def sliding_means(rows: DataFrame, ts: str, errors: Sequence[str], hours: Sequence[int] = (24, 72, 168), late: str = "3 hours", minutes: int = 30) -> DataFrame:
    """(window_end, hours, n_rows, mean of each error) over the last hours, `(end - hours, end]` in steps of a slot.

    A row goes to the ends of all windows that it is in, of all widths, in one aggregation. The watermark is on these ends:
    the last of them is the widest window ahead of the row, so it lags by that width and `late`. A window is final once the watermark has
    passed its end, and is given if a row stands in its last step; a row that comes late counts in windows that are not final.
    """
    step, widest = F.expr(f"INTERVAL {minutes} MINUTES"), max(hours)
    begin = F.window(ts, f"{minutes} minutes")["start"]
    ends = lambda h: F.transform(F.sequence(begin + step, begin + F.expr(f"INTERVAL {h} HOURS"), step), lambda e: F.struct(F.lit(h).alias("hours"), e.alias("end")))
    each = rows.withColumn("_w", F.explode(F.concat(*map(ends, hours)))).select(F.col("_w.end").alias("window_end"), F.col("_w.hours").alias("hours"), F.col(ts).alias("_at"), *errors)
    marked = each.withWatermark("window_end", f"{widest * 60} minutes {late}")
    out = marked.groupBy("window_end", "hours").agg(F.count("*").alias("n_rows"), F.max("_at").alias("_latest"), *(F.avg(e).alias(e) for e in errors))
    return out.filter(F.col("_latest") >= F.col("window_end") - step).drop("_latest")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every batch has a folder of its own, which it replaces whole.

    A batch that is run again after a crash, between its write and its commit, finds its own folder and no other, so each
    row stands once however often the stream is restarted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take all that is there now to `path`, from where `checkpoint` says that an earlier run ended."""
    stream.writeStream.foreachBatch(batch_sink(path)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_sink(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """What a stream has left; `latest`: only the last batch, which in complete mode has the whole result."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if latest:
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return rows.drop("batch")
