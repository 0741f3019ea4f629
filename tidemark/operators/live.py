"""A live forecast at one decision or at many: features as they were known, the newest vintage, and the first rule that refuses it.

A decision at `decision` (microseconds) has an input of prices that ends before the slot `cutoff`. Every rule is judged for every decision, and
`reason` names the first that is broken; NULL means that the forecast may be issued. Nothing is scanned for each decision: what
the input ends with is computed once a slot and met by an equi join, and vintages meet their target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SLOT_US, ceil_slot, finite
from .clock import settlement_days
from .features import calendar
from .ridge import Ridge

MINUTE, DELAY, LEAD, CONTEXT = 60_000_000, 90, 120, 432
#: Refusals in the order in which they are judged.
REFUSALS = (
    "PRICE_HISTORY_EXCEEDS_AVAILABILITY", "LATEST_PRICE_NOT_AT_CUTOFF", "PRICE_GRID_INCOMPLETE", "LEAD_BELOW_MINIMUM", "MISSING_DAY_OR_WEEK_KEY",
    "INSUFFICIENT_PRICE_CONTEXT", "NO_VINTAGE_BEFORE_DECISION", "NONFINITE_VINTAGE", "NONFINITE_PREDICTION",
)
PRICES = ("lag_last", "lag_second", "mean_six", "median_day", "lag_day", "lag_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos")


def price_context(history: DataFrame, price: str = "price") -> DataFrame:
    """history(slot, price), observed slots only, to (last_slot, ...): what an input that ends with that slot holds."""
    order = Window.orderBy("slot")  # one series of half-hours; rows of several are told apart by their own calls
    rows, span = order.rowsBetween, order.rangeBetween(-(CONTEXT - 1), 0)
    day = F.percentile(price, F.lit(0.5)).over(rows(-47, 0))
    return history.select(
        F.col("slot").alias("last_slot"), F.col(price).alias("lag_last"), F.lag(price).over(order).alias("lag_second"), F.avg(price).over(rows(-5, 0)).alias("mean_six"), day.alias("median_day"),
        F.count(price).over(rows(-47, 0)).alias("_context"), F.count(price).over(span).alias("_grid"))


def keyed_prices(history: DataFrame, targets: DataFrame, zone: str = "Europe/London", price: str = "price") -> DataFrame:
    """(target, lag_day, lag_week, hour, day of week): prices of the target's settlement period a day and a week before.

    Settlement keys are those of civil days, so a period that the earlier day does not have is NULL.
    """
    slots = history.select("slot").union(targets.select("target"))
    ends = slots.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).filter("a is not null")
    local = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.col(c) * F.lit(SLOT_US)), zone))
    days = ends.select(F.explode(F.sequence(local("a"), local("b"))).alias("settlement_date"))
    clock = settlement_days(days, zone).select("settlement_date", "settlement_period", F.floor(F.unix_micros(F.col("target_start_utc").cast("timestamp")) / SLOT_US).cast("long").alias("slot"))
    known = clock.join(history.select("slot", F.col(price).alias("_price")), "slot").select("settlement_date", "settlement_period", "_price")
    out = targets.select("target").distinct().join(clock.withColumnRenamed("slot", "target"), "target", "left")
    for days_ago, name in ((1, "lag_day"), (7, "lag_week")):
        out = out.join(known.select(F.date_add("settlement_date", days_ago).alias("settlement_date"), "settlement_period", F.col("_price").alias(name)), ["settlement_date", "settlement_period"], "left")
    at = F.from_utc_timestamp(F.timestamp_micros(F.col("target") * F.lit(SLOT_US)), zone)
    return out.select("target", "lag_day", "lag_week", *(c.alias(k) for k, c in calendar(F.hour(at) + F.minute(at) / 60, F.weekday(at)).items()))


def newest_vintage(decisions: DataFrame, vintages: DataFrame, values: Sequence[str]) -> DataFrame:
    """vintages(target, publish, values) to (decision, target, publish, values): the last one published at the decision or before."""
    met = decisions.select("decision", "target").distinct().join(vintages, "target").filter(F.col("publish") <= F.col("decision"))
    last = F.max_by(F.struct("publish", *values), "publish").alias("v")
    return met.groupBy("decision", "target").agg(last).select("decision", "target", "v.*")


def forecasts(decisions: DataFrame, history: DataFrame, vintages: DataFrame, model: Ridge, values: Sequence[str], delay: int = DELAY, lead: int = LEAD) -> DataFrame:
    """decisions(decision, cutoff, last_slot) to one row each: target, reason, features, previous_day and ridge (NULL where refused).

    history has the observed prices, vintages the forecasts of the target; the model's features must be those that are made here.
    """
    if delay < DELAY:
        raise ValueError(f"prices are known {DELAY} minutes after their half-hour at the earliest")
    made = {*PRICES, *values, "age_minutes"}
    if set(model.features) != made:
        raise ValueError(f"features of the model and of the input differ: {sorted(set(model.features) ^ made)}")
    target = ceil_slot(F.col("decision") + lead * MINUTE)
    asked = decisions.withColumn("target", target)
    met = asked.join(price_context(history), "last_slot", "left").join(keyed_prices(history, asked), "target", "left").join(newest_vintage(asked, vintages, values), ["decision", "target"], "left")
    met = met.withColumn("age_minutes", (F.col("decision") - F.col("publish")) / MINUTE).withColumn("_ridge", model.predict())
    sound = F.lit(True)
    for v in values:
        sound = sound & finite(F.col(v))
    available = F.floor((F.col("decision") - delay * MINUTE) / F.lit(SLOT_US))
    broken = [
        F.col("cutoff") > available, F.col("_grid").isNull() | (F.col("last_slot") != F.col("cutoff") - 1), F.col("_grid") < CONTEXT, F.col("target") * F.lit(SLOT_US) - F.col("decision") < (lead * MINUTE - 1_000_000),
        F.col("lag_day").isNull() | F.col("lag_week").isNull(), F.col("_context") < 48, F.col("publish").isNull(), ~sound, ~finite(F.col("_ridge")),
    ]
    reason = F.coalesce(*(F.when(b, r) for b, r in zip(broken, REFUSALS, strict=True)))
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return met.withColumn("reason", reason).select("decision", "cutoff", "target", "reason", "publish", *(shown(c).alias(c) for c in model.features), shown("lag_day").alias("previous_day"), shown("_ridge").alias("ridge"))


def issued(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Forecasts with the corrections of scored_history at the slot of their decision; what was refused stays refused."""
    by_slot = corrections.select(F.col("now").alias("_now"), "ridge_consensus", "ridge_direction_veto", F.col("reason").alias("correction_reason"))
    met = rows.withColumn("_now", F.floor(F.col("decision") / F.lit(SLOT_US))).join(by_slot, "_now", "left").drop("_now")
    return met.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("ridge_consensus", "ridge_direction_veto", "correction_reason")})


def refusal_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("ISSUED")).alias("reason")).agg(F.count("*").alias("n_decisions"))

