import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clock
from tidemark.operators import walkforward as wf
from tidemark.plans import walkforward as plans

H = 4
PLAN = wf.Plan((wf.Family("one", ("a",)), wf.Family("two", ("a", "b")), wf.Family("three", ("a", "b", "c"), richer=True)), "y", "a", "b", least_tail=5, least_rows=20)


def table(spark, rows):
    names = ["slot", "decision_slot", "y", "a", "b", "c"]
    return spark.createDataFrame(rows, "slot long, decision_slot long, y double, a double, b double, c double").select(*names)


def made(rng, n=600, gaps=True):
    x = rng.normal(size=(n, 3)) * [1, 3, 0.5] + [40, 1000, 0]
    y = 0.7 * x[:, 0] + 0.02 * x[:, 1] + 2 * x[:, 2] + rng.normal(size=n)
    rows = [[s, s - H, float(y[s]), *map(float, x[s])] for s in range(n)]
    if gaps:
        for s in rng.integers(0, n, 40):
            rows[s][rng.integers(2, 6)] = None
    return [tuple(r) for r in rows]


def plain(rows, folds, plan):
    """Each fold on its own with numpy, from the rows of its blocks."""
    get = {c: i for i, c in enumerate(["slot", "decision_slot", "y", "a", "b", "c"])}
    out = {}
    for f in folds:
        common = [r for r in rows if all(v is not None for v in r)]
        block = lambda a, b, rs=common: [r for r in rs if a <= r[0] < b]
        purge = lambda rs, nxt: [r for r in rs if r[0] + 1 <= min(x[1] for x in nxt)]
        raw_sel, cal = block(f.selection_start, f.calibration_start), block(f.calibration_start, f.warmup_start)
        train, sel = purge(block(f.train_start, f.selection_start), raw_sel), purge(raw_sel, cal)
        column = lambda rs, *c: np.array([[r[get[k]] for k in c] for r in rs])

        def ridge(rs, names, alpha):
            x, y = column(rs, *names), column(rs, "y")[:, 0]
            m, s = x.mean(axis=0), x.std(axis=0)
            z = (x - m) / s
            b = np.linalg.solve(z.T @ z + alpha * np.eye(len(names)), z.T @ (y - y.mean()))
            return lambda rs: y.mean() + (column(rs, *names) - m) / s @ b

        cut = np.quantile(np.abs(column(train, "y") - column(train, "b")), 0.9)
        y, ref, last = (column(sel, c)[:, 0] for c in ("y", "a", "b"))
        tail = np.abs(y - last) >= cut
        found = []
        for k, family in enumerate(plan.families):
            mae, alpha = min((float(np.abs(ridge(train, family.features, a)(sel) - y).mean()), a) for a in plan.alphas)
            p = ridge(train, family.features, alpha)(sel)
            good = tail.sum() >= plan.least_tail and np.abs(p - y)[tail].mean() <= np.abs(ref - y)[tail].mean() * 1.05
            found.append((mae, k, family, alpha, good))
        simple = [c for c in found if not c[2].richer]
        best = min([c for c in simple if c[4]] or simple)
        for c in found:
            if c[2].richer and c[4] and 100 * (best[0] - c[0]) / best[0] >= plan.margin:
                best = c
        base = float(np.abs(ref - y).mean())
        promoted = len(sel) >= plan.least_rows and 100 * (base - best[0]) / base >= plan.least_gain and best[4]
        need = ["y", "a", "b", *(best[2].features if promoted else ())]
        final = [r for r in block(f.warmup_start, f.score_end, rows) if all(r[get[c]] is not None for c in need)]
        value = ridge(train + sel, best[2].features, best[3])(final) if promoted else column(final, "a")[:, 0]
        out[f.fold] = (best[2].name, best[3], promoted, best[0], len(sel), {r[0]: v for r, v in zip(final, value, strict=True)})
    return out


@pytest.mark.parametrize("seed,noise", [(1, False), (2, True)])
def test_folds_against_numpy(spark, seed, noise):
    rows = made(np.random.default_rng(seed))
    if noise:
        rows = [(s, d, None if y is None or a is None else a + (s * 7919 % 13 - 6) / 10, a, b, c) for s, d, y, a, b, c in rows]  # the reference is best: nothing is promoted
    folds = clock.rolling_folds(spark, 0, 300, 600, 70, 60, 50, 40)
    choices, models, scored = wf.run(table(spark, rows), folds, PLAN)
    want = plain(rows, folds.collect(), PLAN)
    got = {r.fold: r for r in choices.collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 5}
    values = {}
    for r in scored.collect():
        values.setdefault(r.fold, {})[r.slot] = r.frozen
    for fold, (family, alpha, promoted, mae, n, value) in want.items():
        r = got[fold]
        assert (r.family, r.promoted, r.selection_rows) == (family, promoted, n) and r.selection_mae == pytest.approx(mae, rel=1e-9, abs=1e-9)
        assert r.alpha == alpha or noise
        assert values[fold] == pytest.approx(value, rel=1e-8)
    assert any(r.promoted for r in got.values()) != noise
    assert models.filter("kind = 'point'").count() == 5 * 3 * 4


def test_sums_of_segments_are_those_of_blocks(spark):
    rows = made(np.random.default_rng(3), 200, gaps=False)
    t = table(spark, rows)
    got = {r.segment: r for r in wf.sums_by_segment(t, [10, 50, 120], ["a", "y"], [40.0, 1.0]).collect()}
    for a, b in ((10, 50), (50, 120), (120, 1000)):
        x = np.array([[r[3] - 40, r[2] - 1] for r in rows if a <= r[0] < b])
        assert got[a].n == len(x) and [got[a].s0, got[a].p0_1, got[a].p1_1] == pytest.approx([x[:, 0].sum(), (x[:, 0] * x[:, 1]).sum(), (x[:, 1] ** 2).sum()])


def test_a_missing_feature_counts_only_where_it_is_used(spark):
    rows = [(s, s - H, float(s % 7), 3.0 + s % 2, float(s % 5), None if s > 520 else float(s % 3)) for s in range(600)]
    folds = clock.rolling_folds(spark, 0, 500, 600, 100, 100, 60, 40)
    _, _, scored = wf.run(table(spark, rows), folds, PLAN)
    assert scored.filter("block = 'score'").count() in (100, 21)
    assert scored.select("slot").distinct().count() == scored.count()


def test_registered_query_with_wide_families(spark):
    frame, folds = plans.frame(spark, "/root/testdata/sf0.01"), plans.folds(spark, "/root/testdata/sf0.01")
    names = ["lag_last", "lag_second", "lag_day", "mean_six"]
    rows = [tuple(r) for r in frame.select("slot", "decision_slot", "price", *names).collect()]
    choices, _, _ = wf.run(frame, folds, plans.WIDE)
    for r in choices.collect():
        f = folds.filter(F.col("fold") == r.fold).first()
        common = [x for x in rows if None not in x]
        sel = [x for x in common if f.selection_start <= x[0] < f.calibration_start]
        sel_end = min(x[1] for x in common if f.calibration_start <= x[0] < f.warmup_start)
        train = [x for x in common if f.train_start <= x[0] < f.selection_start and x[0] + 1 <= min(s[1] for s in sel)]
        sel = [x for x in sel if x[0] + 1 <= sel_end]
        at = [3 + names.index(n) for n in next(k.features for k in plans.WIDE.families if k.name == r.family)]
        x, y = np.array([[t[i] for i in at] for t in train]), np.array([t[2] for t in train])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        b = np.linalg.solve(z.T @ z + r.alpha * np.eye(len(at)), z.T @ (y - y.mean()))
        p = y.mean() + (np.array([[t[i] for i in at] for t in sel]) - x.mean(axis=0)) / x.std(axis=0) @ b
        assert np.abs(p - [t[2] for t in sel]).mean() == pytest.approx(r.selection_mae, rel=1e-9)
