"""Typed rows from providers' raw records.

Every normaliser is lazy and gives each row a `fault`: the first contract that it breaks, or NULL. `fault_counts` reports
them; `accepted` fails closed when there is one. Clocks are computed from the settlement key row by row, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, micros, signed_day_wrap
from .contracts import require_columns

#: The providers of the market index.
INDEX_PROVIDERS = ("APXMIDP", "N2EXMIDP")
ZONE = "Europe/London"
HALF_HOUR = "INTERVAL 30 MINUTES"


def period_start(day: Column, period: Column, zone: str = ZONE) -> Column:
    """UTC start of a settlement period; NULL where the civil day has no such period (it has 46, 48 or 50)."""
    midnight = micros(F.to_utc_timestamp(day, zone))
    start = midnight + (period - 1).cast("long") * F.lit(1_800_000_000)
    inside = (period >= 1) & (start < micros(F.to_utc_timestamp(F.date_add(day, 1), zone)))
    return F.when(inside, F.timestamp_micros(start).cast("timestamp_ntz"))


def period_end(day: Column, period: Column, zone: str = ZONE) -> Column:
    return period_start(day, period, zone) + F.expr(HALF_HOUR)


def utc_time(text: str | Column) -> Column:
    """An instant from the usual spellings: T or space, seconds or none, a fraction, Z or an offset, or a date alone.
    Without an offset it is UTC; what cannot be read is NULL."""
    whole = (F.col(text) if isinstance(text, str) else text).cast("string")
    #: yyyy-MM-dd HH:mm:ss, which most records have, needs no repair: it is NULL to the patterns, and they cost nothing.
    at = lambda i: whole.substr(i, 1)
    plain = (F.length(whole) == 19) & (at(5) == "-") & (at(8) == "-") & at(11).isin("T", " ") & (at(14) == ":") & (at(17) == ":") & at(19).between("0", "9")
    t = F.when(~plain, whole)
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00")
    t = F.regexp_replace(t, r"^([^:]*:\d{2})(?=$|[zZ]|[+-])", "$1:00")
    t = F.when(t.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    t = F.coalesce(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), F.concat(whole, F.lit("Z")))
    return F.timestamp_micros(F.unix_micros(t.try_cast("timestamp"))).cast("timestamp_ntz")


def clock_error(start: Column, day: Column, period: Column) -> Column:
    """Seconds between a start and that of its settlement key; NULL for a key that does not exist."""
    return F.abs(micros(start) - micros(period_start(day, period))) / 1e6


def alias(df: DataFrame, *names: str) -> Column | None:
    """The first of the names that the frame has."""
    return next((F.col(n) for n in names if n in df.columns), None)


def _number(x: Column) -> Column:
    return x.try_cast("double")


def _repeated(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def _fault(*checks: tuple[Column, str]) -> Column:
    """The first check that holds or cannot be judged."""
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return out


def fault_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("fault", F.lit("ACCEPTED")).alias("fault")).agg(F.count("*").alias("n_rows"))


def accepted(df: DataFrame) -> DataFrame:
    """The rows without their fault column; any fault stops the job, with the first few named."""
    if bad := df.filter("fault is not null").groupBy("fault").count().orderBy("fault").limit(10).collect():
        raise ValueError("rejected rows: " + ", ".join(f"{r.fault} {r['count']}" for r in bad))
    return df.drop("fault")


def _keyed(raw: DataFrame, day: str, period: str, *more: Column) -> DataFrame:
    return raw.select(F.col(day).cast("string").substr(1, 10).try_cast("date").alias("settlement_date"), F.col(period).try_cast("int").alias("settlement_period"), *more)


def market_index(raw: DataFrame, tolerance_seconds: float = 1.0, providers: Sequence[str] = INDEX_PROVIDERS) -> DataFrame:
    """Prices and volumes by settlement key and provider."""
    require_columns(raw, "startTime", "dataProvider", "settlementDate", "settlementPeriod", "price", "volume")
    out = _keyed(raw, "settlementDate", "settlementPeriod", utc_time("startTime").alias("target_start_utc"), F.col("dataProvider").alias("data_provider"), _number(F.col("price")).alias("price"), _number(F.col("volume")).alias("volume"))
    out = out.withColumn("clock_error_seconds", clock_error(F.col("target_start_utc"), F.col("settlement_date"), F.col("settlement_period")))
    fault = _fault(
        (F.col("target_start_utc").isNull() | F.col("settlement_date").isNull() | F.col("settlement_period").isNull(), "UNREADABLE_KEY"), (~F.col("data_provider").isin(*providers), "UNEXPECTED_PROVIDER"),
        (_repeated("settlement_date", "settlement_period", "data_provider"), "DUPLICATE_KEY"), (~finite(F.col("price")), "NON_FINITE_PRICE"), (F.col("volume") < 0, "NEGATIVE_VOLUME"), (F.col("clock_error_seconds") > tolerance_seconds, "CLOCK_MISMATCH"),
    )
    return out.withColumns({"target_end_utc": F.col("target_start_utc") + F.expr(HALF_HOUR), "fault": fault})


def system_prices(raw: DataFrame, tolerance_seconds: float = 1.0) -> DataFrame:
    """Buy and sell prices, whichever of their names the payload uses; one price serves as both. The imbalance may be missing."""
    require_columns(raw, "startTime", "settlementDate", "settlementPeriod")
    buy, sell = alias(raw, "systemBuyPrice", "system_buy_price", "price"), alias(raw, "systemSellPrice", "system_sell_price", "price")
    if buy is None or sell is None:
        raise ValueError("no column holds a buy or sell price")
    niv = alias(raw, "netImbalanceVolume", "net_imbalance_volume", "niv")
    out = _keyed(raw, "settlementDate", "settlementPeriod", utc_time("startTime").alias("target_start_utc"), _number(buy).alias("buy_price"), _number(sell).alias("sell_price"), _number(F.lit(None) if niv is None else niv).alias("imbalance_volume"))
    out = out.withColumn("clock_error_seconds", clock_error(F.col("target_start_utc"), F.col("settlement_date"), F.col("settlement_period")))
    fault = _fault((F.col("target_start_utc").isNull() | F.col("settlement_date").isNull() | F.col("settlement_period").isNull(), "UNREADABLE_KEY"), (_repeated("settlement_date", "settlement_period"), "DUPLICATE_KEY"), (F.col("clock_error_seconds") > tolerance_seconds, "CLOCK_MISMATCH"))
    return out.withColumns({"target_end_utc": F.col("target_start_utc") + F.expr(HALF_HOUR), "fault": fault})


EMBEDDED = {"wind_mw": "EMBEDDED_WIND_FORECAST", "wind_capacity_mw": "EMBEDDED_WIND_CAPACITY", "solar_mw": "EMBEDDED_SOLAR_FORECAST", "solar_capacity_mw": "EMBEDDED_SOLAR_CAPACITY"}


def _embedded() -> list[Column]:
    return [_number(F.col(c)).alias(n) for n, c in EMBEDDED.items()]


REGIMES = ("legacy", "current")


def vintage_archive(raw: DataFrame, *regimes: str, tolerance_seconds: float = 1.0, latest_days: int = 14) -> DataFrame:
    """Vintages of one regime, or of both from one scan. `legacy`: the settlement key gives the target. `current`: the raw
    period end does, once the key of its local date agrees; the local date is that of the period's start."""
    require_columns(raw, "DATE_GMT", "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", "Forecast_Datetime", *EMBEDDED.values())
    if wrong := [r for r in regimes if r not in REGIMES]:
        raise ValueError(f"regime {wrong[0]!r} is neither legacy nor current")
    if not regimes or len(set(regimes)) < len(regimes):
        raise ValueError("name each regime once, and at least one regime")
    out = _keyed(raw, "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", utc_time("DATE_GMT").alias("_raw"), utc_time("Forecast_Datetime").alias("publish_time_utc"), *_embedded())
    local = F.from_utc_timestamp(F.col("_raw") - F.expr(HALF_HOUR), ZONE).cast("date")
    day, period = F.col("settlement_date"), F.col("settlement_period")
    of = {"legacy": (day, period_end(day, period), F.lit(0.0)), "current": (local, F.col("_raw"), clock_error(F.col("_raw") - F.expr(HALF_HOUR), local, period))}
    names = "settlement_date", "target_end_utc", "clock_difference_seconds"
    cases = [F.struct(F.lit(REGIMES.index(r)).alias("regime"), *(x.alias(n) for x, n in zip(of[r], names, strict=True))) for r in regimes]
    out = out.withColumn("_case", F.explode(F.array(*cases))).withColumns({n: F.col(f"_case.{n}") for n in names} | {"_regime": F.col("_case.regime")})
    fault = _fault(
        (F.col("target_end_utc").isNull() | F.col("publish_time_utc").isNull(), "UNREADABLE_KEY"), (F.col("clock_difference_seconds") > tolerance_seconds, "CLOCK_MISMATCH"),
        (_repeated("target_end_utc", "publish_time_utc", "_regime"), "DUPLICATE_KEY"), (micros("publish_time_utc") > micros("target_end_utc") + latest_days * 86_400_000_000, "IMPLAUSIBLE_PUBLICATION"),
    )
    regime = F.when(F.col("_regime") == 0, REGIMES[0]).otherwise(F.lit(REGIMES[1]))
    return out.withColumns({"target_start_utc": F.col("target_end_utc") - F.expr(HALF_HOUR), "source_regime": regime, "fault": fault}).drop("_raw", "_case", "_regime")


def vintage_chunk(raw: DataFrame, regime: str) -> DataFrame:
    """Vintages whose settlement key decides; the raw clock's offset is kept for audit, and more than an hour is a fault."""
    require_columns(raw, "DATE_GMT", "TIME_GMT", "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", "Forecast_Datetime", *EMBEDDED.values())
    at = utc_time(F.concat_ws(" ", F.col("DATE_GMT").cast("string").substr(1, 10), F.col("TIME_GMT").cast("string")))
    out = _keyed(raw, "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", at.alias("_raw"), utc_time("Forecast_Datetime").alias("publish_time_utc"), *_embedded())
    out = out.withColumn("target_end_utc", period_end(F.col("settlement_date"), F.col("settlement_period")))
    out = out.withColumn("raw_clock_offset_seconds", signed_day_wrap((micros("_raw") - micros("target_end_utc")) / 1e6))
    fault = _fault((F.col("target_end_utc").isNull() | F.col("publish_time_utc").isNull(), "UNREADABLE_KEY"), (F.abs("raw_clock_offset_seconds") > 3601, "CLOCK_MISMATCH"))
    return out.withColumns({"target_start_utc": F.col("target_end_utc") - F.expr(HALF_HOUR), "source_regime": F.lit(regime), "fault": fault}).drop("_raw")


def outturn(raw: DataFrame) -> DataFrame:
    """Actual rows only; unreadable megawatts are NULL, not a fault. Without any actual row the frame is empty: see `require_rows`."""
    require_columns(raw, "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", "FORECAST_ACTUAL_INDICATOR", "EMBEDDED_WIND_GENERATION", "EMBEDDED_SOLAR_GENERATION")
    actual = raw.filter(F.upper("FORECAST_ACTUAL_INDICATOR") == "A")
    out = _keyed(actual, "SETTLEMENT_DATE", "SETTLEMENT_PERIOD", _number(F.col("EMBEDDED_WIND_GENERATION")).alias("actual_wind_mw"), _number(F.col("EMBEDDED_SOLAR_GENERATION")).alias("actual_solar_mw"))
    out = out.withColumn("target_end_utc", period_end(F.col("settlement_date"), F.col("settlement_period")))
    fault = _fault((F.col("target_end_utc").isNull(), "UNREADABLE_KEY"), (_repeated("target_end_utc"), "DUPLICATE_KEY"))
    return out.withColumns({"target_start_utc": F.col("target_end_utc") - F.expr(HALF_HOUR), "fault": fault})


def canonical_reference(df: DataFrame, price: str = "reference_price") -> DataFrame:
    """Start, settlement key and price; starts and keys are each unique, prices finite."""
    require_columns(df, "target_start_utc", "settlement_date", "settlement_period", price)
    out = _keyed(df, "settlement_date", "settlement_period", utc_time("target_start_utc").alias("target_start_utc"), _number(F.col(price)).alias(price))
    return out.withColumn("fault", _fault((F.col("target_start_utc").isNull() | F.col("settlement_date").isNull() | F.col("settlement_period").isNull(), "UNREADABLE_KEY"), (_repeated("target_start_utc") | _repeated("settlement_date", "settlement_period"), "DUPLICATE_KEY"), (~finite(F.col(price)), "NON_FINITE_PRICE")))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df
