"""The settlement clock: half-hours of a civil day, 46, 48 or 50 of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import SLOT_US, ceil_slot, slot_of


def settlement_days(days: DataFrame, zone: str = "Europe/London") -> DataFrame:
    """days(settlement_date) to (settlement_date, settlement_period, target_start_utc, target_end_utc), from local midnight to local midnight."""
    step = F.expr("INTERVAL 30 MINUTES")
    at = F.sequence(F.to_utc_timestamp("settlement_date", zone), F.to_utc_timestamp(F.date_add("settlement_date", 1), zone) - step, step)
    out = days.select("settlement_date", F.posexplode(at).alias("k", "at"))
    return out.select("settlement_date", (F.col("k") + 1).alias("settlement_period"), F.col("at").cast("timestamp_ntz").alias("target_start_utc"), (F.col("at") + step).cast("timestamp_ntz").alias("target_end_utc"))


def settlement_clock(spark: SparkSession, start: str, end_exclusive: str, zone: str = "Europe/London") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end_exclusive)), 1))).alias("settlement_date"))
    return settlement_days(days, zone)


def canonical_end(keys: DataFrame, clock: DataFrame) -> DataFrame:
    """Keys with target_end_utc; a period that the day does not have fails when the row is read."""
    known = clock.select("settlement_date", "settlement_period", "target_end_utc")
    met = keys.join(known, ["settlement_date", "settlement_period"], "left")
    bad = F.raise_error(F.concat(F.lit("no such settlement period: "), F.col("settlement_period").cast("string"))).cast("timestamp_ntz")
    return met.withColumn("target_end_utc", F.coalesce("target_end_utc", bad))


def slot_grid(observed: DataFrame, ts: str) -> DataFrame:
    """(slot) from the first to the last observed half-hour, made on the executors from two numbers."""
    ends = observed.agg(F.min(slot_of(ts)).alias("a"), F.max(slot_of(ts)).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("slot"))


def rolling_folds(spark: SparkSession, train_start: int, score_start: int, score_end: int, fold: int, selection: int, calibration: int, warmup: int) -> DataFrame:
    """Rolling-origin folds in slots: expanding training, then selection, calibration, warm-up and scoring."""
    if score_end <= score_start:
        raise ValueError("the scored interval is empty")
    if score_start - warmup - calibration - selection <= train_start:
        raise ValueError("nothing is left to train on ahead of the first selection block")
    start = F.col("id")
    return spark.range(score_start, score_end, fold).select(
        ((start - score_start) / fold + 1).cast("int").alias("fold"), F.lit(train_start).cast("long").alias("train_start"), (start - warmup - calibration - selection).alias("selection_start"),
        (start - warmup - calibration).alias("calibration_start"), (start - warmup).alias("warmup_start"), start.alias("score_start"), F.least(start + fold, F.lit(score_end)).cast("long").alias("score_end"),
    )


MINUTE = 60_000_000


def target_after(decision_us: Column, lead: int = 120) -> Column:
    """The first slot that begins `lead` minutes after the decision or later."""
    if lead < 120:
        raise ValueError("the lead is 120 minutes at least")
    return ceil_slot(decision_us + lead * MINUTE)


def market_end(decision_us: Column, delay: int = 90) -> Column:
    """The slot before which prices are known: a half-hour counts once it has ended and `delay` minutes have passed."""
    if delay < 30:
        raise ValueError("the delay is 30 minutes at least")
    return F.floor((decision_us - delay * MINUTE) / F.lit(SLOT_US)).cast("long")


def safe_boundary(now_us: Column, lag: int = 90) -> Column:
    """The slot that `lag` minutes ago was in."""
    return F.floor((now_us - lag * MINUTE) / F.lit(SLOT_US)).cast("long")


def forward_start(lock_us: Column, horizon: int = 4) -> Column:
    """The first target after a lock: its decision is on the first grid point strictly after it, so the start cannot be picked."""
    return (F.floor(lock_us / F.lit(SLOT_US)) + 1 + horizon).cast("long")


def freeze_window(now_us: Column, decision_slot: Column, target_slot: Column) -> Column:
    """Whether a first prediction may be frozen now: not ahead of its decision, and not once its target has begun."""
    return F.when(now_us < decision_slot.cast("long") * F.lit(SLOT_US), "FIRST_DECISION_NOT_REACHED").when(now_us >= target_slot.cast("long") * F.lit(SLOT_US), "FIRST_TARGET_ALREADY_STARTED").otherwise("FREEZE_ALLOWED")


def period_class(slot: Column, threshold: Column, before: str, after: str) -> Column:
    """One of two labels, by whether the slot is ahead of a threshold."""
    return F.when(slot < threshold, before).otherwise(after)
