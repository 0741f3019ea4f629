import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clock, diagnosis

US, M = 1_800_000_000, 60_000_000


def test_clock_rules_against_datetimes(spark):
    """Ceilings, floors and strictness at and around the grid, before and after the epoch."""
    at = [k * US + j for k in (0, 1, 5, -3, 946_704) for j in (-1, 0, 1, 7 * M, 29 * M)]
    df = spark.createDataFrame([(x,) for x in at], "us long")
    us = F.col("us")
    got = {r.us: r for r in df.select("us", clock.target_after(us).alias("t"), clock.market_end(us, 90).alias("e"), clock.market_end(us, 30).alias("e30"), clock.safe_boundary(us).alias("s"), clock.forward_start(us).alias("f")).collect()}
    epoch, step = dt.datetime(1970, 1, 1), dt.timedelta(minutes=30)
    for x in at:
        d = epoch + dt.timedelta(microseconds=x)
        floor = lambda t: (t - epoch) // step
        ceil = lambda t: -((epoch - t) // step)
        assert got[x].t == ceil(d + dt.timedelta(minutes=120))
        assert got[x].e == floor(d - dt.timedelta(minutes=120)) + 1 and got[x].e30 == floor(d - dt.timedelta(minutes=60)) + 1
        assert got[x].s == floor(d - dt.timedelta(minutes=90)) and got[x].f == floor(d) + 5
    with pytest.raises(ValueError):
        clock.target_after(us, 60)
    with pytest.raises(ValueError):
        clock.market_end(us, 10)
    window = df.select("us", clock.freeze_window(us, F.lit(1), F.lit(5)).alias("w")).collect()
    assert {r.us: r.w for r in window} == {x: "FIRST_DECISION_NOT_REACHED" if x < US else "FIRST_TARGET_ALREADY_STARTED" if x >= 5 * US else "FREEZE_ALLOWED" for x in at}


def test_gate_diagnostics_against_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(200):
        y, f, o = (float(x) for x in rng.integers(-20, 20, 3))
        on = s % 5 < 2
        c = float(rng.integers(-3, 4)) if on else 0.0
        rows.append((s, y, f, f + c, c, diagnosis.APPLIED if on else diagnosis.DISAGREEMENT if s % 5 == 2 else "INSUFFICIENT_SHORT_HISTORY", o))
    df = spark.createDataFrame(rows, "slot long, actual double, frozen double, candidate double, correction double, reason string, other double")
    got = diagnosis.gate_diagnostics(df, "other").first()
    on = [r for r in rows if r[5] == diagnosis.APPLIED]
    off = [r for r in rows if r[5] != diagnosis.APPLIED]
    delta = lambda r: abs(r[3] - r[1]) - abs(r[2] - r[1])
    avoided = lambda r: abs(r[6] - r[1]) - abs(r[2] - r[1])
    assert (got.applied_rows, got.fallback_rows, got.disagreement_rows) == (len(on), len(off), 40)
    assert (got.applied_better, got.applied_worse, got.applied_tied) == tuple(sum(f(delta(r)) for r in on) for f in (lambda x: x < 0, lambda x: x > 0, lambda x: x == 0))
    assert (got.fallback_other_worse, got.fallback_other_better) == (sum(avoided(r) > 0 for r in off), sum(avoided(r) < 0 for r in off))
    assert (got.fallback_avoided, got.harmful_error, got.helpful_error) == (sum(map(avoided, off)), sum(max(0, delta(r)) for r in on), -sum(min(0, delta(r)) for r in on))
    assert got.status == "DESCRIPTIVE_GATE_DIAGNOSTIC" and got.excess_error == got.harmful_error - got.helpful_error
    for change in (F.col("candidate") + F.when(F.col("slot") == 3, 1e-6).otherwise(0.0), F.col("candidate") + F.when(F.col("slot") == 0, 1e-6).otherwise(0.0)):
        assert diagnosis.gate_diagnostics(df.withColumn("candidate", change), "other").first().status == "RECONSTRUCTION_FAILED"
    run = diagnosis.longest_run(df, F.col("reason") == diagnosis.APPLIED).first()
    assert (run.longest_run, run.run_first, run.run_last) == (2, 0, 1)


def test_blockers_override_and_name_what_is_missing(spark):
    claims = spark.createDataFrame([(1, "REAL_CLAIMABLE_POSITIVE"), (2, "BLOCKED_EVIDENCE")], "day int, claim_class string")
    present = spark.createDataFrame([("a", 3), ("b", 0)], "source string, n_rows long")
    none = diagnosis.blocked(claims, diagnosis.missing_sources(present, ["a"]))
    assert sorted(map(tuple, none.collect())) == [(1, "REAL_CLAIMABLE_POSITIVE", None), (2, "BLOCKED_EVIDENCE", None)]
    some = diagnosis.blocked(claims, diagnosis.missing_sources(present, ["c", "a", "b"]))
    assert sorted(map(tuple, some.collect())) == [(1, "BLOCKED_EVIDENCE", "missing source: b; missing source: c"), (2, "BLOCKED_EVIDENCE", None)]
