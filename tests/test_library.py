import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sources
from tidemark.operators import asof, bootstrap, causal, clock, contracts, experiment, features, ledger, metrics, monitor, ridge
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(columns, rows):
    """Rows as text, columns in the order of their names."""
    at = [columns.index(c) for c in sorted(columns)]
    text = lambda v: "-" if v is None or v != v else repr(round(v + 0.0, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns) and plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


def slots(spark, values, columns="slot long, price double, frozen double"):
    return spark.createDataFrame(values, columns)


def random_rows(n=160, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, float(rng.normal()), float(rng.normal())) for i in range(n) if i % 37]


def test_causal_windows_against_a_loop(spark):
    rows = random_rows()
    got = {r.slot: r for r in causal.consensus_correction(slots(spark, rows), "price", "frozen").collect()}
    for t, y, f in rows:
        past = [(s, p - q) for s, p, q in rows if s + 1 <= t - 4]
        short, long = [x for s, x in past if s > t - 4 - 12 - 1], [x for s, x in past if s > t - 4 - 96 - 1]
        assert (got[t].short_rows, got[t].long_rows) == (len(short), len(long))
        if len(short) >= 8 and len(long) >= 24:
            a, b = np.mean(short), np.mean(long)
            want = math.copysign(min(abs(a), abs(b)), a) if a * b > 0 else 0
            assert got[t].correction == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("apply", [lambda d: causal.mean_correction(d, "price", "frozen"), lambda d: causal.direction_veto(causal.consensus_correction(d, "price", "frozen"), "frozen"), lambda d: features.safe_frame(d, 4)])
def test_future_outcomes_change_nothing(spark, apply):
    rows, at = random_rows(), 100
    changed = [(s, y + 1000 if s > at - 5 else y, f) for s, y, f in rows]
    keep = lambda out: [{k: v for k, v in r.asDict().items() if k not in ("price", "residual")} for r in out.filter(F.col("slot") <= at).orderBy("slot").collect()]
    assert keep(apply(slots(spark, rows))) == keep(apply(slots(spark, changed)))


def test_clock_days(spark):
    n = {str(r.settlement_date): r["count"] for r in clock.settlement_clock(spark, "2026-03-28", "2026-10-27").groupBy("settlement_date").count().collect()}
    assert (n["2026-03-28"], n["2026-03-29"], n["2026-10-25"], n["2026-10-26"]) == (48, 46, 50, 48)
    known = clock.settlement_clock(spark, "2026-03-29", "2026-03-30")
    keys = spark.createDataFrame([("2026-03-29", 47)], "d string, settlement_period int").select(F.to_date("d").alias("settlement_date"), "settlement_period")
    with pytest.raises(Exception, match="no such settlement period"):
        clock.canonical_end(keys, known).collect()


def test_keyed_lag_after_a_short_day(spark):
    days = clock.settlement_clock(spark, "2026-03-29", "2026-03-31").withColumn("price", F.col("settlement_period").cast("double"))
    got = {r.settlement_period: r.lag_1d for r in features.keyed_day_lag(days, "price", 1, "lag_1d").filter("settlement_date = date'2026-03-30'").collect()}
    assert got[46] == 46 and got[47] is None and got[48] is None


def test_asof_edges(spark):
    t = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "target int, decision int")
    v = spark.createDataFrame([(1, 10, 1.0), (1, 11, 9.0), (1, 4, 2.0), (2, 11, 5.0), (3, 9, 7.0)], "target int, publish int, x double")
    out = {r.target: r for r in asof.eligible(t, v).collect()}
    assert set(out) == {1, 3} and {r.x for r in asof.latest(t, v, ["x"]).collect()} == {1.0, 7.0}
    stitched = asof.stitch_priority(v, v.withColumn("x", F.col("x") + 100), ["target", "publish"], ["x"])
    assert stitched.count() == 5 and stitched.agg(F.min("x")).first()[0] == 101


def test_windows_are_limited_before_the_shuffle(spark):
    t = spark.createDataFrame([(1, 10)], "target int, decision int")
    v = spark.createDataFrame([(1, i, 1.0) for i in range(9)], "target int, publish int, x double")
    k = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("target").orderBy(F.desc("publish")))
    plan = asof.eligible(t, v).withColumn("k", k).filter("k <= 2")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("alpha", [0.0, 1.0, 100.0])
def test_ridge_against_numpy(spark, alpha):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 3, 9]
    y = x @ [2.0, -1.0, 4.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = ridge.solve(ridge.moments(df, ["a", "b", "c"], "y"), alpha)
    z = np.hstack([np.ones((200, 1)), (x - x.mean(0)) / x.std(0)])
    want = np.linalg.solve(z.T @ z + alpha * np.diag([0, 1, 1, 1]), z.T @ y)
    assert np.allclose(m.coef, want, atol=1e-8) and ridge.Ridge.from_json(m.to_json()) == m
    assert np.allclose([r[0] for r in df.select(m.predict()).collect()], z @ want, atol=1e-8)


def test_ridge_of_equal_features_has_least_norm(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(20)], "a double, b double, y double")
    m = ridge.solve(ridge.moments(df, ["a", "b"], "y"), 0.0)
    assert m.coef[1] == pytest.approx(m.coef[2])
    with pytest.raises(ValueError):
        ridge.Ridge(("a",), 1.0, (0.0,), (0.0,), (1.0, 1.0))


def test_conformal_and_labels(spark):
    df = spark.createDataFrame([(float(x), 1) for x in [5, 1, 3, 3, 9, 2]], "s double, g int")
    r = metrics.conformal_quantile(df, "s", 0.7, ["g"]).first()
    assert (r.n, r.k, r.q) == (6, metrics.conformal_rank(6, 0.7), sorted([5, 1, 3, 3, 9, 2])[4])
    w = spark.createDataFrame([("k", 12.0, 50.0), ("k", 30.0, 10.0), ("z", 5.0, 0.0), ("z", 7.0, 0.0)], "k string, p double, v double")
    assert {r.k: r.reference_price for r in metrics.weighted_reference(w, ["k"], "p", "v", {}).collect()} == {"k": 15.0, "z": 6.0}


def test_ledger_tampering(spark):
    rows = spark.createDataFrame([(i, f"{i:03d}", 'a"b') for i in range(9)], "position long, t string, v string")
    good = ledger.build(rows, ["t", "v"], "position", "seed")
    zero = dict.fromkeys(["bad_digests", "bad_links", "bad_order"], 0)
    counts = lambda df: {k: v for k, v in ledger.verify(df, ["t", "v"], "t", "seed").first().asDict().items() if k != "n_rows"}
    assert counts(good) == zero
    first = good.orderBy("position").first()
    import hashlib

    row = hashlib.sha256(json.dumps({"t": "000", "v": 'a"b'}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert first.row_sha256 == row and first.chain_sha256 == hashlib.sha256(f"{hashlib.sha256(b'seed').hexdigest()}\n{row}".encode()).hexdigest()
    assert counts(good.withColumn("v", F.when(F.col("position") == 4, "x").otherwise(F.col("v"))))["bad_digests"] == 1
    swapped = good.withColumn("position", F.when(F.col("position") == 4, 5).when(F.col("position") == 5, 4).otherwise(F.col("position")))
    assert counts(swapped)["bad_links"] == 3 and counts(swapped)["bad_order"] == 1
    assert ledger.verify_prefix(good, swapped.filter("position < 5")).first().status == "LOCKED_PREFIX_CHANGED"


def test_contracts_fail_closed(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "k int, v double")
    for act in (lambda: contracts.require_unique(df, "k"), lambda: contracts.require_columns(df, "nope"), lambda: contracts.require_none(df, F.col("v").isNull(), "null")):
        with pytest.raises(ValueError):
            act()
    assert contracts.duplicate_counts(df, "k").first().asDict() == {"n_rows": 3, "extra_rows": 1, "rows_in_groups": 2}
    nested = spark.range(1).select(F.struct(F.array(F.struct(F.lit(1).alias("mae")))).alias("a"))
    assert contracts.forbidden_fields(nested, "mae") and not contracts.forbidden_fields(nested, "rmse")
    grid = spark.range(5).withColumnRenamed("id", "slot")
    seen = spark.createDataFrame([(1,), (1,), (9,)], "slot long")
    assert contracts.grid_counts(grid, seen, "slot").first().asDict() == {"expected": 5, "on_grid": 1, "off_grid": 1, "missing": 4}


def test_envelopes_and_text(spark, tmp_path):
    shapes = {"a": [{"x": 1}], "b": {"data": [{"x": 2}, {"x": 3}]}, "c": {"x": 4}, "d": {"result": {"records": [{"x": 5}]}}, "e": {"records": [{"x": 6}]}}
    for name, payload in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    kind = spark.createDataFrame([], "x long").schema
    assert sorted(r.x for r in sources.json_records(spark, str(tmp_path), kind).collect()) == [1, 2, 3, 4, 5, 6]
    text = spark.createDataFrame([(1.005,), (0.5,), (None,)], "x double").select(fn.fixed_nine("x"), fn.round_trip("x")).collect()
    assert [tuple(r) for r in text] == [("1.005000000", "1.0049999999999999"), ("0.500000000", "0.5"), ("nan", "nan")]
    wraps = spark.createDataFrame([(43_200,), (-43_200,), (3_600,), (86_000,)], "s long").select(fn.signed_day_wrap(F.col("s"))).collect()
    assert [r[0] for r in wraps] == [-43_200, -43_200, 3_600, -400]
    assert sources.count_agrees(2, 1, 3, growing=True) and not sources.count_agrees(2, 1, 3) and sources.count_agrees(3, 3, 3)
    assert [tuple(r) for r in sources.page_plan(spark, 7, 3).collect()] == [(0, 3), (3, 3), (6, 1)]


def test_runs_pairs_and_gates(spark):
    flags = spark.createDataFrame([(i, i in (2, 3, 6)) for i in range(8)], "slot long, f boolean")
    assert sorted((r.first_slot, r.n_rows) for r in monitor.runs(flags, "f").filter("f").collect()) == [(2, 2), (6, 1)]
    assert experiment.tail_guard(5, 1, 1) == (False, "INSUFFICIENT_TAIL_ROWS") and experiment.tail_guard(30, 1.2, 1)[1] == "TAIL_DEGRADATION" and experiment.tail_guard(30, 1.04, 1)[0]
    series = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, x double")
    assert {r.k: r.block_sum for r in bootstrap.moving_block_sums(series, "x", 3).collect()} == {k: 3.0 * k + 3 for k in range(8)}
    joined = features.lag_by_join(spark.range(6).select(F.col("id").alias("slot"), F.col("id").cast("double").alias("v")), "v", {"a": 2}).orderBy("slot").collect()
    assert [r.a for r in joined] == [None, None, 0, 1, 2, 3]


def test_local_scale_stays_above_its_floor(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(40)], "x double, r double")
    m = ridge.fit_local_scale(df, ["x"], "r", 1.0)
    scales = [r[0] for r in df.union(spark.createDataFrame([(1e9, 0.0), (-1e9, 0.0)], df.schema)).select(ridge.local_scale(m, 0.25)).collect()]
    assert min(scales) == pytest.approx(0.25) and all(np.isfinite(scales))
    want = math.expm1(m.coef[0] + (7.0 - m.mean[0]) / m.scale[0] * m.coef[1])
    assert scales[7] == pytest.approx(max(want, 0.25))


def test_stream_scores_only_what_was_recorded_before_its_target(spark, tmp_path):
    from tidemark.streaming import read_sink, run_available, score_matured

    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    p = spark.createDataFrame([(1, at(60), at(90), at(50), 1.0), (2, at(90), at(120), at(95), 2.0), (3, at(120), at(150), at(60), 3.0)], "target int, a string, b string, c string, prediction double")
    p = p.select("target", F.to_timestamp("a").alias("target_start"), F.to_timestamp("b").alias("target_end"), F.to_timestamp("c").alias("recorded_at"), "prediction")
    o = spark.createDataFrame([(1, at(90), 1.5), (1, at(90), 1.5), (2, at(120), 9.0)], "outcome_target int, e string, actual double").select("outcome_target", F.to_timestamp("e").alias("outcome_end"), "actual")
    p.write.parquet(str(tmp_path / "p"))
    o.write.parquet(str(tmp_path / "o"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    run_available(score_matured(read("p", p), read("o", o)), str(tmp_path / "out"), str(tmp_path / "c"))
    assert [(r.target, r.abs_error) for r in read_sink(spark, str(tmp_path / "out")).collect()] == [(1, 0.5)]
