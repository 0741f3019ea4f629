import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import frozen, identity, reveal
from tidemark.operators.ridge import Ridge


def frame(spark, rows):
    return spark.createDataFrame(rows, "part int, a string, b long")


def test_digests_do_not_depend_on_order_and_see_every_change(spark):
    rows = [(i % 3, f"x{i}", i) for i in range(60)]
    one = identity.digest(frame(spark, rows), ["a", "b"], ["part"])
    state = lambda changed: {r.part: r.state for r in identity.compare(one, identity.digest(frame(spark, changed).repartition(5), ["a", "b"], ["part"]), ["part"]).collect()}
    same = dict.fromkeys(range(3), "SAME")
    assert state(rows[::-1]) == same
    assert state([(p, a, b + (b == 7)) for p, a, b in rows]) == same | {1: "CHANGED"}
    assert state(rows[1:]) == same | {0: "ROWS_LOST"}
    assert state([*rows, rows[2]]) == same | {2: "ROWS_ADDED"}
    assert state([(p + 3 * (p == 2), a, b) for p, a, b in rows]) == {0: "SAME", 1: "SAME", 2: "MISSING", 5: "NEW"}
    swapped = [(p, {"x0": "x3", "x3": "x0"}.get(a, a), b) for p, a, b in rows]
    assert state(swapped) == same | {0: "CHANGED"}
    verdict = lambda changed: identity.verdict(identity.compare(one, identity.digest(frame(spark, changed), ["a", "b"], ["part"]), ["part"])).first()
    assert verdict(rows).status == "CONTENT_REPRODUCED" and verdict(rows[1:]).n_different == 1


def test_rows_that_read_alike_are_told_apart(spark):
    of = lambda *fields: {r.t for r in spark.createDataFrame(fields, "a string, b string").select(identity.row_text(["a", "b"]).alias("t")).collect()}
    assert len(of(("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc"), ("-", "abc"), ("1:a", "bc"))) == 6


def test_ordered_digest_is_that_of_its_ranges(spark):
    rows = spark.range(10).select("id", F.concat(F.lit("line "), F.col("id")).alias("t")).repartition(4)
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    got = identity.ordered_digest(rows, "t", "id", F.floor(F.col("id") / 4)).first()
    assert (got.n_rows, got.sha256) == (10, sha([sha([f"line {i}" for i in range(a, min(10, a + 4))]) for a in (0, 4, 8)]))
    assert identity.ordered_digest(rows.withColumn("k", F.lit(1)), "t", "id", F.lit(0), ["k"]).first().sha256 == sha([sha([f"line {i}" for i in range(10)])])


def test_unknown_targets_are_added_once(spark):
    history = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "slot long, price double, note string")
    grid = spark.range(2, 5).select(F.col("id").alias("slot"))
    assert sorted(map(tuple, identity.with_unknown_grid(history, grid, "slot", "price").collect()), key=lambda r: r[0]) == [(1, 2.0, "x"), (2, None, "y"), (3, None, None), (4, None, None)]


FAMILIES = {"PAIR": ("a", "b"), "ONE": ("a",)}
STATE = frozen.Frozen("PAIR", 120, Ridge(("a", "b"), 1.0, (1.0, 2.0), (0.5, 4.0), (3.0, 0.25, -1.0)), 0.75)


def test_state_round_trip_and_order_of_refusals(spark, tmp_path):
    digest = frozen.write_state(spark, STATE, str(tmp_path / "s"))
    assert frozen.load(frozen.read_state(spark, str(tmp_path / "s")), digest, FAMILIES, 120) == STATE
    with pytest.raises(Exception, match="exists"):
        frozen.write_state(spark, STATE, str(tmp_path / "s"))
    text = STATE.to_text()

    def reason(changed, horizon=120, families=FAMILIES):
        with pytest.raises(frozen.StateRefused) as e:
            frozen.load(changed, hashlib.sha256(changed.encode()).hexdigest(), families, horizon)
        return e.value.reason

    assert reason(text.replace(frozen.STATUS, "DRAFT")) == "UNSUPPORTED_SCHEMA"
    assert reason(text, horizon=60) == reason(text, families={"ONE": ("a",)}) == "UNEXPECTED_FAMILY_OR_HORIZON"
    assert reason(text, families={"PAIR": ("b", "a")}) == "FEATURE_ORDER"
    assert reason(text.replace("[0.5,4.0]", "[0.5]")) == reason(text.replace("[0.5,4.0]", "[0.0,4.0]")) == "BAD_NUMBERS"
    with pytest.raises(frozen.StateRefused, match="BYTES"):
        frozen.load(text + " ", digest, FAMILIES, 120)
    with pytest.raises(ValueError):
        frozen.Frozen("PAIR", 120, STATE.model, float("nan")).to_text()


def test_quantile_and_replay(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 3), None) for i in range(10)], "slot long, a double, b double, prediction double").drop("prediction")
    locked = rows.select("slot", STATE.model.predict().alias("prediction"))
    assert frozen.replay(STATE, rows, locked).first().status == "PASS"
    assert frozen.replay(STATE, rows.filter("slot > 0"), locked).first().status == "ROW_COUNT_MISMATCH"
    assert frozen.replay(STATE, rows, locked.withColumn("prediction", F.col("prediction") + 1e-7)).first().status == "PREDICTION_MISMATCH"
    calibration = rows.withColumn("y", STATE.model.predict() + F.when(F.col("slot") % 2 == 0, 0.75).otherwise(-0.75))
    frozen.same_quantile(STATE, calibration, "y")
    with pytest.raises(frozen.StateRefused, match="QUANTILE"):
        frozen.same_quantile(STATE, calibration.withColumn("y", F.col("y") + 0.1), "y")


def test_of_many_who_ask_at_once_one_reveals(spark, tmp_path):
    won, lost = [], []

    def ask(k):
        try:
            reveal.claim(spark, str(tmp_path / "claim"), f"driver {k}")
            won.append(k)
        except reveal.AlreadyRevealed:
            lost.append(k)

    threads = [threading.Thread(target=ask, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and (tmp_path / "claim").read_text() == f"driver {won[0]}"


def test_figures_only_once_and_never_early(spark, tmp_path):
    asked = []
    evaluate = lambda: asked.append(1) or spark.range(1).select(F.lit(2.5).alias("mae"))
    status = lambda s: spark.range(1).select(F.lit(3).alias("complete_rows"), F.lit(s).alias("status"))
    path = str(tmp_path / "claim")
    early = reveal.reveal(spark, status("SEALED_ACCUMULATION"), path, "x", evaluate)
    assert "mae" not in early.columns and not asked
    assert reveal.reveal(spark, status("SEALED_REVEAL_ELIGIBLE"), path, "x", evaluate).first().mae == 2.5
    with pytest.raises(reveal.AlreadyRevealed):
        reveal.reveal(spark, status("SEALED_REVEAL_ELIGIBLE"), path, "x", evaluate)
    assert len(asked) == 1
