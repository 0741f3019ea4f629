"""As-of selection: what was known at a decision time.

Vintages have a target and a publication time; a target has a decision time. A vintage is eligible if it was published at or
before the decision. The equi join is on the target; the bound on publication stands before the window, so that ranks are
among eligible vintages only and Spark limits each group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros


def one_vintage(vintages: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row by `order` of each key; the order must be total. Also stitches sources by priority."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return vintages.withColumn("_k", k).filter("_k = 1").drop("_k")


def eligible(targets: DataFrame, vintages: DataFrame, target: str = "target", decision: str = "decision", publish: str = "publish") -> DataFrame:
    return targets.select(target, decision).join(vintages, target).filter(F.col(publish) <= F.col(decision))


def latest(targets: DataFrame, vintages: DataFrame, values: Sequence[str], target: str = "target", decision: str = "decision", publish: str = "publish") -> DataFrame:
    """One row for each target with an eligible vintage: its latest publication and values, by an aggregation without a sort."""
    last = F.max_by(F.struct(publish, *values), F.col(publish)).alias("v")
    return eligible(targets, vintages, target, decision, publish).groupBy(target, decision).agg(last).select(target, decision, "v.*")


def latest_and_previous(targets: DataFrame, vintages: DataFrame, values: Sequence[str], target: str = "target", decision: str = "decision", publish: str = "publish") -> DataFrame:
    """Latest and previous eligible vintage side by side, with age, revision and minutes between; NULL without a previous one."""
    k = F.row_number().over(Window.partitionBy(target).orderBy(F.desc(publish)))
    two = eligible(targets, vintages, target, decision, publish).withColumn("_k", k).filter("_k <= 2")
    pick = lambda c, n: F.max(F.when(F.col("_k") == n, F.col(c)))
    wide = two.groupBy(target, decision).agg(pick(publish, 1).alias("latest_publish"), pick(publish, 2).alias("previous_publish"), *(pick(v, n).alias(f"{name}_{v}") for v in values for n, name in ((1, "latest"), (2, "previous"))))
    change = {f"{v}_delta": F.col(f"latest_{v}") - F.col(f"previous_{v}") for v in values}
    minutes = lambda a, b: (micros(a) - micros(b)) / 6e7
    return wide.withColumns({**change, **{f"abs_{k}": F.abs(c) for k, c in change.items()}, "age_minutes": minutes(decision, "latest_publish"), "minutes_between": minutes("latest_publish", "previous_publish")})


def stitch_hard_cut(old: DataFrame, new: DataFrame, target: str = "target") -> DataFrame:
    """The old source up to the first target of the new one, then the new one."""
    first = new.agg(F.min(target).alias("_first"))
    return old.join(F.broadcast(first), (F.col(target) < F.col("_first")) | F.col("_first").isNull()).drop("_first").unionByName(new)  # one row


def stitch_priority(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Both sources; where both have a key the new one wins."""
    both = old.withColumn("source_priority", F.lit(1)).unionByName(new.withColumn("source_priority", F.lit(2)))
    return one_vintage(both, keys, [F.desc("source_priority"), *tie])


def point_in_time(history: DataFrame, at: Column, value: str, publish: str, by: str, most: int = 48) -> DataFrame:
    """Of each series, from its last `most` values published by `at`: last, second last, mean of six, median of all."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(publish), F.desc(value)))
    last = history.filter(F.col(publish) <= at).withColumn("_k", k).filter(F.col("_k") <= most)
    six = F.when(F.count_if(F.col("_k") <= 6) == 6, F.avg(F.when(F.col("_k") <= 6, F.col(value))))
    return last.groupBy(by).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("last_value"), F.max(F.when(F.col("_k") == 2, F.col(value))).alias("second_value"), six.alias("mean_six"), F.percentile(value, 0.5).alias("median_value"), F.count("*").cast("long").alias("n"))
