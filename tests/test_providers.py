import datetime as dt
import math
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, experiment, features, providers, ridge, streams

LONDON = ZoneInfo("Europe/London")


@pytest.mark.parametrize("day, periods", [("2026-03-29", 46), ("2026-10-25", 50), ("2026-07-01", 48)])
def test_period_start_on_days_of_all_lengths(spark, day, periods):
    got = spark.range(0, 53).select(F.col("id"), providers.period_start(F.lit(day).cast("date"), F.col("id")).alias("at")).collect()
    midnight = dt.datetime.fromisoformat(day).replace(tzinfo=LONDON).astimezone(dt.timezone.utc).replace(tzinfo=None)
    for r in got:
        assert r["at"] == (midnight + dt.timedelta(minutes=30 * (r.id - 1)) if 1 <= r.id <= periods else None)


def test_spellings_of_an_instant(spark):
    same = ["2026-05-01T10:30:00Z", "2026-05-01 10:30", "2026-05-01T10:30Z", "2026-05-01 10:30:00.000", "2026-05-01T11:30:00+01:00", "2026-05-01T05:30-0500"]
    rows = spark.createDataFrame([(t,) for t in [*same, "2026-05-01", "soon", None]], "t string").select(providers.utc_time("t").alias("t")).collect()
    assert [r.t for r in rows] == [dt.datetime(2026, 5, 1, 10, 30)] * len(same) + [dt.datetime(2026, 5, 1), None, None]


def test_plain_instants_and_those_that_only_look_so(spark):
    texts = ["2026-05-01 10:30:00", "2026-05-01T10:30:00", "2026-05-01 10:30:0Z", "2026-05-01 10:30+00", "2026-13-01 10:30:00", "2026-05-01x10:30:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", providers.utc_time("t").alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [dt.datetime(2026, 5, 1, 10, 30)] * 3 + [None] * 3


def test_both_regimes_come_from_one_scan(spark, tmp_path):
    row = ("2026-07-01T00:30:00", "2026-07-01T00:00:00", 1, "2026-06-30 12:00:00", 1.0, "n/a", 2.0, 3.0)
    names = "DATE_GMT string, SETTLEMENT_DATE string, SETTLEMENT_PERIOD int, Forecast_Datetime string, EMBEDDED_WIND_FORECAST double, EMBEDDED_WIND_CAPACITY string, EMBEDDED_SOLAR_FORECAST double, EMBEDDED_SOLAR_CAPACITY double"
    rows = [row, row, ("2026-07-01T01:00:00", *row[1:2], 4, *row[3:]), ("2026-07-01T00:30:00", *row[1:2], 49, *row[3:]), (None, *row[1:])]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    both = providers.vintage_archive(raw, *providers.REGIMES)
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    apart = providers.vintage_archive(raw, "legacy").unionByName(providers.vintage_archive(raw, "current"))
    assert both.columns == apart.columns and both.exceptAll(apart).count() == apart.exceptAll(both).count() == 0
    faults = lambda r: sorted(str(x.fault) for x in both.filter(F.col("source_regime") == r).collect())
    assert faults("legacy") == ["DUPLICATE_KEY"] * 3 + ["None", "UNREADABLE_KEY"]
    assert faults("current") == ["CLOCK_MISMATCH"] * 3 + ["None", "UNREADABLE_KEY"]
    for wrong in ((), ("legacy", "legacy"), ("other",)):
        with pytest.raises(ValueError, match="regime"):
            providers.vintage_archive(raw, *wrong)


def test_accepted_fails_closed_and_passes_clean_rows(spark):
    row = ("2026-10-25T00:30:00Z", "2026-10-25", "4", "APXMIDP", "50.5", "3")
    raw = lambda *rows: providers.market_index(spark.createDataFrame(rows, "startTime string, settlementDate string, settlementPeriod string, dataProvider string, price string, volume string"))
    assert [(r.price, r.clock_error_seconds, str(r.target_end_utc)) for r in providers.accepted(raw(row)).collect()] == [(50.5, 0.0, "2026-10-25 01:00:00")]
    for bad, why in [((row, row), "DUPLICATE_KEY"), ((("2026-10-25T01:30:00Z", *row[1:]),), "CLOCK_MISMATCH"), (((*row[:4], "inf", "3"),), "NON_FINITE_PRICE"), (((*row[:5], "-1"),), "NEGATIVE_VOLUME"), (((*row[:3], "X", *row[4:]),), "UNEXPECTED_PROVIDER"), (((None, *row[1:]),), "UNREADABLE_KEY")]:
        assert [r.fault for r in providers.fault_counts(raw(*bad)).collect()] == [why]
        with pytest.raises(ValueError, match=why):
            providers.accepted(raw(*bad))
    with pytest.raises(ValueError, match="missing columns"):
        providers.market_index(spark.range(1))
    with pytest.raises(ValueError, match="no rows"):
        providers.require_rows(spark.range(0), "outturn")


def test_joint_coverage_of_nothing_is_blocked(spark):
    none = spark.createDataFrame([], "k int, p double, b double, s double")
    assert coverage.joint_coverage(none.select("k"), none, none, ["k"], "p", "b", "s").select("expected_keys", "reference_coverage", "status").first() == (0, 0.0, "BLOCKED")


def test_choice_of_family():
    c = lambda name, mae, guard=True: experiment.Candidate(name, None, mae, guard, "")
    pick = lambda simple, richer, ref=10.0, rows=100: (lambda r: (r[0].family, r[1]))(experiment.choose(simple, richer, ref, rows))
    assert pick([c("a", 9.0), c("b", 8.0, False)], [c("r", 8.99)]) == ("a", True)
    assert pick([c("a", 9.0)], [c("r", 8.95)]) == ("r", True) and pick([c("a", 9.0)], [c("r", 8.0, False)]) == ("a", True)
    assert pick([c("a", 9.0, False), c("b", 8.0, False)], []) == ("b", False)
    assert pick([c("a", 9.51)], []) == ("a", False) and pick([c("a", 9.0)], [], rows=99) == ("a", False)


@pytest.mark.parametrize("gain, floor", [(1.0, None), (1.0, 0.5), (0.0, None)])
def test_experiment_against_numpy(spark, gain, floor):
    rng = np.random.default_rng(5)
    n = 900
    last, ref, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n) * (0.2 if gain else 1)
    y = (gain * 3 * last + noise) if gain else ref + noise * 0.05
    df = spark.createDataFrame([(i, i - 1, *map(float, (y[i], last[i], ref[i]))) for i in range(n)], "slot long, decision_slot long, y double, last double, ref double")
    bounds = [0, 400, 600, 750, 900]
    got = experiment.run(experiment.dated_blocks(df, bounds), {"last": ["last"]}, {}, "y", "ref", "last", scale_floor=floor).first()
    idx = [np.arange(a, b - (k < 3)) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]  # purge takes the row that ends after the next decision
    train, sel, cal, fin = idx

    def fit(rows, target, alpha):
        x = last[rows]
        m, s = x.mean(), x.std()
        b = ((x - m) / s) @ (target - target.mean()) / (len(rows) + alpha)
        return lambda r: target.mean() + (last[r] - m) / s * b

    maes = {a: np.abs(fit(train, y[train], a)(sel) - y[sel]).mean() for a in (0.0, 1.0, 10.0, 100.0)}
    alpha = min(maes, key=lambda a: (maes[a], a))
    promoted = gain > 0
    both = np.concatenate([train, sel])
    point = fit(both, y[both], alpha) if promoted else lambda r: ref[r]
    early = fit(train, y[train], alpha) if promoted else lambda r: ref[r]
    scale = lambda r: np.ones(len(r))
    if floor:
        log = fit(sel, np.log1p(np.abs(y[sel] - early(sel))), 10.0)
        scale = lambda r: np.maximum(np.expm1(np.clip(log(r), np.log1p(floor), 20)), floor)
    scores = np.sort(np.abs(y[cal] - point(cal)) / scale(cal))
    q = scores[min(math.ceil((len(cal) + 1) * 0.9), len(cal)) - 1]
    assert (got.promoted, got.alpha, got.deployed) == (promoted, alpha, "last" if promoted else "REFERENCE_FALLBACK")
    assert got.q == pytest.approx(q) and got.model_mae == pytest.approx(np.abs(point(fin) - y[fin]).mean())
    assert got.interval_mean_width == pytest.approx((2 * q * scale(fin)).mean())


def test_splits_and_refusals(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("slot"))
    parts = experiment.fraction_split(df, 0.6, 0.2)
    assert [p.count() for p in parts] == [60, 20, 20] and parts[1].agg(F.min("slot")).first()[0] == 180
    with pytest.raises(ValueError, match="too few"):
        experiment.fraction_split(df, 0.6, least=101)
    with pytest.raises(ValueError, match="empty"):
        experiment.fraction_split(df, 0.6, 0.4)
    with pytest.raises(ValueError, match="increase"):
        experiment.dated_blocks(df, [0, 5, 5, 7, 9])
    with pytest.raises(ValueError, match="not known"):
        features.safe_frame(df, 48)


def test_ridge_refusals_and_text(spark):
    model = ridge.Ridge(("x",), 1.0, (0.1,), (2.0,), (1.0, 3.0))
    assert model.to_text() == "1\n0.10000000000000001\n2\n1 3\n"
    row = lambda *v: spark.createDataFrame([(x,) for x in v], "x double").select(model.predict_strict().alias("p"))
    assert row(0.1).first().p == 1.0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="not finite"):
            row(0.1, bad).collect()
    with pytest.raises(ValueError, match="penalty"):
        ridge.solve(ridge.Moments(("x",), 1, np.zeros(1), np.ones(1), np.ones((1, 1)), np.ones(1), 0.0), -1.0)


def test_scored_history_refuses_a_wide_look_back(spark):
    with pytest.raises(ValueError, match="look-back"):
        streams.scored_history(spark.range(0), spark.range(0), long=97)
