"""Scalar functions: clocks in whole microseconds and slots, signs, guarded division, canonical text."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SLOT_MINUTES = 30
SLOT_US = SLOT_MINUTES * 60_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a time zone, read as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def slot_of(ts: str | Column) -> Column:
    """Number of the half-hour since the epoch."""
    return F.floor(micros(ts) / F.lit(SLOT_US)).cast("long")


def slot_start(slot: str | Column) -> Column:
    return F.timestamp_micros((F.col(slot) if isinstance(slot, str) else slot) * F.lit(SLOT_US)).cast("timestamp_ntz")


def ceil_slot(us: Column) -> Column:
    return F.ceil(us / F.lit(SLOT_US)).cast("long")


def null_if_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def signed_day_wrap(seconds: Column) -> Column:
    """Difference of two clocks brought to [-12 h, 12 h)."""
    return F.pmod(seconds + 43_200, F.lit(86_400)) - 43_200


def agreed_clip(short: Column, long: Column) -> Column:
    """The smaller in magnitude of two numbers of the same sign, else 0."""
    same = (F.signum(short) == F.signum(long)) & (short != 0)
    return F.when(same, F.signum(short) * F.least(F.abs(short), F.abs(long))).otherwise(0.0)


def improvement_pct(base: Column, candidate: Column) -> Column:
    return 100 * (base - candidate) / null_if_zero(base)


def _text(pattern: str):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "nan" if v is None or math.isnan(v) else pattern % v)

    return F.pandas_udf(run, StringType())


def fixed_nine(x: str | Column) -> Column:
    """Nine decimals, rounded half to even on the binary value; a null reads `nan`. Spark's own formatting rounds otherwise."""
    return _text("%.9f")(x)


def round_trip(x: str | Column) -> Column:
    """Seventeen significant digits, which a reader turns back into the same double."""
    return _text("%.17g")(x)
