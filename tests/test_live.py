import datetime as dt
import hashlib
import math
import time
from collections import Counter
from statistics import median
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, ledger, live
from tidemark.operators.ridge import Ridge
from tidemark.plans import live as plans

LONDON, US = ZoneInfo("Europe/London"), 1_800_000_000
FEATURES = (*live.PRICES, "wind", "age_minutes")
MODEL = Ridge(FEATURES, 1.0, (0.5,) * 12, (2.0,) * 12, (1.0, *np.linspace(-1, 1, 12).tolist()))


def key(slot):
    """Settlement date and period of a half-hour, counted from local midnight."""
    start = dt.datetime.fromtimestamp(slot * 1800, dt.UTC)
    day = start.astimezone(LONDON).date()
    midnight = dt.datetime(day.year, day.month, day.day, tzinfo=LONDON)
    return day, int((start - midnight.astimezone(dt.UTC)).total_seconds() // 1800) + 1


def plain(decisions, history, vintages):
    """One decision after the other, as a live cycle would do it."""
    by_key = {key(s): p for s, p in history.items()}
    out = {}
    for d, cutoff, last in decisions:
        target = -(-(d + 120 * 60_000_000) // US)
        past = [s for s in sorted(history) if s <= last]
        day, period = key(target)
        yesterday, week = (by_key.get((day - dt.timedelta(days=n), period)) for n in (1, 7))
        known = [v for v in vintages if v[0] == target and v[1] <= d]
        newest = max(known, key=lambda v: v[1], default=None)
        if cutoff > (d - 90 * 60_000_000) // US:
            out[d] = "PRICE_HISTORY_EXCEEDS_AVAILABILITY"
        elif last != cutoff - 1 or last not in history:
            out[d] = "LATEST_PRICE_NOT_AT_CUTOFF"
        elif any(s not in history for s in range(cutoff - 432, cutoff)):
            out[d] = "PRICE_GRID_INCOMPLETE"
        elif yesterday is None or week is None:
            out[d] = "MISSING_DAY_OR_WEEK_KEY"
        elif newest is None:
            out[d] = "NO_VINTAGE_BEFORE_DECISION"
        elif newest[2] is None or not math.isfinite(newest[2]):
            out[d] = "NONFINITE_VINTAGE"
        else:
            local = dt.datetime.fromtimestamp(target * 1800, dt.UTC).astimezone(LONDON)
            hour, dow = local.hour + local.minute / 60, local.weekday()
            p = [history[s] for s in past]
            turn = 2 * math.pi
            x = [p[-1], p[-2], sum(p[-6:]) / 6, median(p[-48:]), yesterday, week, math.sin(turn * hour / 24), math.cos(turn * hour / 24), math.sin(turn * dow / 7), math.cos(turn * dow / 7), newest[2], (d - newest[1]) / 60_000_000]
            y = MODEL.coef[0] + sum((a - m) / s * b for a, m, s, b in zip(x, MODEL.mean, MODEL.scale, MODEL.coef[1:], strict=True))
            out[d] = y if math.isfinite(y) else "NONFINITE_PREDICTION"
    return out


@pytest.mark.parametrize("start", [dt.datetime(2024, 1, 10), dt.datetime(2024, 3, 25), dt.datetime(2024, 10, 21)])
def test_decisions_one_by_one(spark, start):
    """Across both clock changes: the periods of the day before are found by key, and the 49th and 50th have none."""
    first = int(start.replace(tzinfo=dt.UTC).timestamp()) // 1800 - 440
    rng = np.random.default_rng(1)
    history = {s: float(p) for s, p in zip(range(first, first + 900), rng.normal(50, 9, 900), strict=True) if s != first + 800}
    at = lambda s, m=7: s * US + m * 60_000_000
    decisions = [(at(s, 7 + s % 5), s - 3 + (s % 29 == 0), s - 4 + (s % 29 == 0) - (s % 31 == 0)) for s in range(first + 430, first + 850)]
    vintages = [(s + 5, at(s - 1, 0), float(s % 9) if s % 13 else [None, float("nan"), float("inf"), 1e308][s // 13 % 4]) for s in range(first, first + 900) if s % 17]
    vintages += [(s + 5, at(s, 9), -1.0) for s in range(first, first + 900)]
    want = plain(decisions, history, vintages)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((decisions, "decision long, cutoff long, last_slot long"), (list(history.items()), "slot long, price double"), (vintages, "target long, publish long, wind double"))]
    out = live.forecasts(*frames, MODEL, ["wind"])
    got = {r.decision: r.reason or r.ridge for r in out.collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        assert got[d] == w if isinstance(w, str) else got[d] == pytest.approx(w, rel=1e-9), d
    kinds = Counter(w if isinstance(w, str) else "ISSUED" for w in want.values())
    assert {"ISSUED", "PRICE_GRID_INCOMPLETE", "NONFINITE_VINTAGE", "PRICE_HISTORY_EXCEEDS_AVAILABILITY"} <= set(kinds)
    assert {r.reason: r.n_decisions for r in live.refusal_counts(out).collect()} == kinds
    assert ("MISSING_DAY_OR_WEEK_KEY" in kinds) == (start.month == 10)


def test_what_stops_before_any_row(spark):
    none = spark.createDataFrame([], "decision long, cutoff long, last_slot long"), spark.createDataFrame([], "slot long, price double"), spark.createDataFrame([], "target long, publish long, wind double")
    assert live.forecasts(*none, MODEL, ["wind"]).collect() == []
    with pytest.raises(ValueError, match="90"):
        live.forecasts(*none, MODEL, ["wind"], delay=60)
    with pytest.raises(ValueError, match="differ"):
        live.forecasts(*none, Ridge(("lag_last",), 1.0, (0.0,), (1.0,), (0.0, 1.0)), ["wind"])


def test_corrections_meet_their_decision(spark):
    rows = spark.createDataFrame([(5 * US + 7, None, 2.0), (6 * US + 7, "NO_VINTAGE_BEFORE_DECISION", None)], "decision long, reason string, ridge double")
    fixed = spark.createDataFrame([(5, 2.5, 2.0, "SAME_SIGN_RESIDUALS"), (6, 1.0, 1.0, "X")], "now long, ridge_consensus double, ridge_direction_veto double, reason string")
    assert [(r.reason, r.ridge_consensus, r.correction_reason) for r in live.issued(rows, fixed).orderBy("decision").collect()] == [(None, 2.5, "SAME_SIGN_RESIDUALS"), ("NO_VINTAGE_BEFORE_DECISION", None, None)]


def test_every_planted_refusal_of_the_query(spark):
    got = {r.reason for r in plans.live_forecasts_asof(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert got == {None, "PRICE_HISTORY_EXCEEDS_AVAILABILITY", "LATEST_PRICE_NOT_AT_CUTOFF", "PRICE_GRID_INCOMPLETE", "NO_VINTAGE_BEFORE_DECISION", "NONFINITE_VINTAGE"}


def test_a_chain_of_100_000_links_takes_linear_time(spark):
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("position"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartition(4)
    began = time.time()
    got = {r.position: r.chain_sha256 for r in ledger.build(rows, ["v"], "position", "seed").select("position", "chain_sha256").collect()}
    assert time.time() - began < 60
    last = hashlib.sha256(b"seed").hexdigest()
    for k in range(n):
        row = hashlib.sha256(f'{{"v":"v{k}"}}'.encode()).hexdigest()
        last = hashlib.sha256(f"{last}\n{row}".encode()).hexdigest()
        assert got[k] == last or k % 5000
    assert got[n - 1] == last


def test_chains_by_key_start_anew(spark):
    rows = spark.createDataFrame([(c, i, f"{c}{i}") for c in "ab" for i in range(5)], "c string, position long, v string").repartition(3)
    both = {(r.c, r.position): r.chain_sha256 for r in ledger.build(rows, ["v"], "position", "s", ["c"]).collect()}
    for c in "ab":
        alone = {r.position: r.chain_sha256 for r in ledger.build(rows.filter(F.col("c") == c), ["v"], "position", "s").collect()}
        assert alone == {p: h for (k, p), h in both.items() if k == c}


def test_moving_blocks_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2)).round(6)
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double")
    for block in (1, 7, 50):
        got = {r.replicate: (r.a, r.b) for r in bootstrap.moving_means(rows, ["a", "b"], block, 20, 5, 50).collect()}
        draws = -(-50 // block)
        for r in range(20):
            at = [int(hashlib.md5(f"5-{r}-{i}".encode()).hexdigest()[:8], 16) % (50 - block + 1) for i in range(draws)]
            index = np.concatenate([np.arange(a, a + block) for a in at])[:50]
            assert got[r] == pytest.approx(tuple(x[index].mean(axis=0)), abs=1e-12)
    with pytest.raises(ValueError):
        bootstrap.moving_means(rows, ["a"], 51, 20, 5, 50)
