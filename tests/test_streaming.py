import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import streams
from tidemark.plans import cycles
from tidemark.streaming import batch_sink, history, read_sink, run_available, sliding_means

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def test_state_gives_the_batch_answer_and_stays_bounded():
    """1,500 slots of scores, some twice, in shuffled batches: the same decisions as by scanning all scores, in bounded state."""
    rng = np.random.default_rng(1)
    scores = [(s, int(s + 4 + rng.integers(0, 3)), float(f), float(r)) for s, f, r in zip(range(1500), rng.normal(size=1500), rng.normal(size=1500) + 0.3, strict=True) if s % 9]
    scores.append((700, 1200, 0.0, 0.5))  # a target of 250 hours ago is scored again
    book, got, most = history.History(None), [], 0
    for end in range(40, 1700, 40):
        mine = [s for s in scores if end - 40 <= s[1] < end]
        for k in rng.permutation(len(mine)):
            s, use, f, r = mine[k]
            book.scores.append((s, s + 4, use, f, r))
            book._see(s, use)
        book.decisions += [(n, 1.0) for n in range(end - 40, end)]
        got += book.answer(end - 10)
        book = history.History(book.held())
        most = max(most, len(book.scores))
        assert len(book.seen) <= end // 64 + 1
    assert most <= history.LONG + 60
    assert [g[0] for g in got] == list(range(got[0][0], got[-1][0] + 1)) and book.repeat_at == 1200
    for now, _, short, long, *_, reason, _, _ in got:
        known = [s for s in scores if s[1] <= now and now - 96 < s[0] + 4 <= now]
        assert (short, long) == (sum(s[0] + 4 > now - 12 for s in known), len(known))
        assert (reason == "DUPLICATE_SCORED_TARGET") == (now >= 1200)


def test_bits_of_targets_before_and_after_the_epoch():
    book = history.History(None)
    for slot in (-1, 0, 63, 64, 127, -64, 10**9 + 63):
        book._see(slot, slot)
    assert book.repeat_at is None
    book = history.History(book.held())
    assert all(-(2**63) <= b < 2**63 for b in book.held()[8])
    for slot in (-1, 63, 10**9 + 63):
        book.repeat_at = None
        book._see(slot, 5)
        assert book.repeat_at == 5


def test_repeats_block_the_batch_form_for_good(spark):
    scores = spark.createDataFrame([("a", s, s + 4, True, 1.0, 1.5) for s in range(300)] + [("a", 10, 150, True, 1.0, 1.5), ("b", 5, 9, True, 1.0, 1.5), ("b", 5, 400, False, 1.0, 1.5)], "k string, slot long, scored_at long, verified boolean, forecast double, actual double")
    decisions = spark.createDataFrame([(k, n, 2.0) for k in "ab" for n in (100, 149, 150, 299)], "k string, now long, ridge double")
    got = {(r.k, r.now): r.reason for r in streams.scored_history(decisions, scores, by=["k"]).collect()}
    assert {n for (k, n), r in got.items() if r == "DUPLICATE_SCORED_TARGET"} == {150, 299} and "DUPLICATE_SCORED_TARGET" not in {r for (k, _), r in got.items() if k == "b"}
    alone = streams.scored_history(decisions.filter("k = 'a'").drop("k"), scores.filter("k = 'a'").drop("k")).collect()
    assert {r.now: r.reason for r in alone} == {n: r for (k, n), r in got.items() if k == "a"}


def test_history_stream_equals_batch(spark):
    decisions, scores = cycles.history_inputs(spark, BIG)
    want = streams.scored_history(decisions, scores, by=["stream"])
    got = cycles.residual_history_stream(spark, BIG)
    assert rows_of(got.select("stream", "now", "short_rows", "long_rows", "reason")) == rows_of(want.select("stream", "now", "short_rows", "long_rows", "reason"))
    assert {"DUPLICATE_SCORED_TARGET", "WAIT_FOR_GENUINE_PRETARGET_SCORES"} < {r.reason for r in got.select("reason").distinct().collect()}


def test_a_batch_that_runs_again_leaves_no_second_copy(spark, tmp_path):
    write = batch_sink(str(tmp_path / "s"))
    rows = spark.range(10)
    for batch, some in ((0, rows.filter("id < 4")), (1, rows.filter("id >= 4")), (1, rows.filter("id >= 4"))):
        write(some, batch)
    assert sorted(r.id for r in read_sink(spark, str(tmp_path / "s")).collect()) == list(range(10))
    assert sorted(r.id for r in read_sink(spark, str(tmp_path / "s"), latest=True).collect()) == [4, 5, 6, 7, 8, 9]


def test_cycle_survives_a_restart(spark):
    got = {r.target: (r.status, r.n_scores) for r in cycles.shadow_cycle_restart(spark, SF).collect()}
    assert set(got.values()) == {("SCORED", 1), ("PENDING", 0), ("NOT_RECORDED_BEFORE_TARGET", 0)}
    assert all(v[0] == ("NOT_RECORDED_BEFORE_TARGET" if t % 11 == 0 else "PENDING" if t % 13 == 0 else "SCORED") for t, v in got.items())


@pytest.mark.parametrize("hours", [(2,), (1, 3)])
def test_sliding_means(spark, tmp_path, hours):
    at = lambda slot: F.timestamp_micros(slot * F.lit(1_800_000_000))
    rows = spark.range(1000, 1040).filter("id % 10 <> 3").select(at(F.col("id")).alias("at"), F.col("id").cast("double").alias("x"))
    cycles.arrive([rows.filter("x < 1020"), rows.filter("x >= 1020")], str(tmp_path / "in"))
    run_available(sliding_means(cycles.follow(spark, str(tmp_path / "in"), rows), "at", ["x"], hours, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {((r.window_end.timestamp() / 1800) - 1, r.hours): (r.n_rows, r.x) for r in read_sink(spark, str(tmp_path / "out")).collect()}
    there = [s for s in range(1000, 1040) if s % 10 != 3]
    last = max(there) - 2
    want = {(float(s), h): (len(m := [t for t in there if s - 2 * h < t <= s]), sum(m) / len(m)) for s in there if s + 1 <= last for h in hours}
    assert got == want
