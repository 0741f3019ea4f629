import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import hilbert_ann as ha


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_is_a_hilbert_curve(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = ha.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(ids, v, queries, k=20):
    out = {}
    for q in queries:
        i = ids.index(q)
        scores = np.einsum("d,vd->v", v[i], v)
        out[q] = [(ids[j], scores[j]) for j in np.lexsort((ids, -scores)) if j != i][:k]
    return out


def test_recall_on_the_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, v = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)
    want = brute(ids, v, [i for i in ids if i % 20 == 0])
    got = {}
    for r in ha.query(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(sorted(x)[k][0] == k + 1 for x in got.values() for k in range(len(x)))
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = dict(((q, i), s) for q in want for i, s in brute(ids, v, [q], len(ids))[q])
    assert all(abs(exact[q, i] - s) < 1e-12 for q, x in got.items() for _, i, s in x)


def test_odd_rows_ties_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), 1) for i in range(200)] + [(i, [1.0, 2.0, 3.0], 1) for i in range(200, 260)]
    odd = [(300, None, 1), (320, [0.0, 0.0, 0.0], 1), (340, [1.0, None, 2.0], 1), (360, [float("nan"), 1.0, 1.0], 1), (380, [float("inf"), 1.0, 1.0], 1), (400, [1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (420, [], 1)]
    vectors = spark.createDataFrame([*rows, *odd, rows[5]], "vec_id long, embedding array<double>, label int")
    #: The row that stands twice is a candidate twice; the vector of two components has nobody to be compared with.
    want = brute([r[0] for r in [*rows, rows[5]]], np.array([r[1] for r in [*rows, rows[5]]]), range(0, 260, 20))
    monkeypatch.setattr(ha, "TILE_VECTORS", 7)
    monkeypatch.setattr(ha, "TILE_QUERIES", 3)
    got = {}
    for r in ha.nearest(vectors, lambda i: i % 20 == 0, blocks=4, reach=4, curves=1).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q: [i for _, (i, _) in sorted(x.items())] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    few = ha.nearest(vectors.filter("vec_id < 3"), lambda i: i % 20 == 0).collect()
    assert len(few) == 2
    for none in (vectors.limit(0), vectors.filter("vec_id = 300")):
        assert ha.nearest(none, lambda i: i % 20 == 0).count() == 0


def test_recall_with_a_hot_vector(spark):
    """Four rows in ten are copies of one vector: those of the smallest ids are met by all others."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16))
    v[0] *= 3
    v[rng.permutation(1500)[:600]] = v[0]
    ids = list(range(1500))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    asked = [i for i in ids if i % 20 == 0 and (v[i] == v[0]).all()]
    want = brute(ids, v, asked)
    got = {q: set() for q in asked}
    for r in ha.nearest(vectors, lambda i: i % 20 == 0).filter(f"query_id in ({','.join(map(str, asked))})").collect():
        got[r.query_id].add(r.vec_id)
    recall = sum(len(got[q] & {i for i, _ in want[q]}) for q in asked) / (20 * len(asked))
    assert recall >= 0.95, recall


def norms(kind, rng, n):
    if kind == "even":
        return np.ones(n)
    if kind == "lognormal":
        return rng.lognormal(size=n)
    out = np.ones(n)
    out[7] = 1000
    return out


@pytest.mark.parametrize("kind", ["even", "lognormal", "outlier"])
def test_recall_on_norms(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 64))
    v *= (norms(kind, rng, 3000) / np.linalg.norm(v, axis=1))[:, None]
    ids = list(range(3000))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    want = brute(ids, v, ids[::20])
    got = {q: set() for q in want}
    for r in ha.nearest(vectors, lambda i: i % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    print(kind, recall)
    assert recall >= 0.9, recall


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=2 + i % 2) * 1e200 ** (i % 3 - 1)).tolist()) for i in range(120)] + [(20, [1.0, 2.0])]
    got = {}
    for r in ha.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, nearest=3, blocks=2, reach=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 120, 20):
        assert sorted({k for k, _, _ in got[q]}) == [1, 2, 3]
        assert len(got[q]) == (6 if q == 20 else 3)
        #: Products of two vectors of about 1e200 overflow and are answers like others; infinite ones tie by id.
        with np.errstate(over="ignore", invalid="ignore"):
            of = [(-np.nan_to_num(np.dot(rows[q][1], v), nan=-np.inf, posinf=np.inf, neginf=-np.inf), i) for k, (i, v) in enumerate(rows) if len(v) == 2 and k != q]
        if q != 20:
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in sorted(of)[:3]]


def test_infinite_products_are_answers(spark):
    big = 1.5e308
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 2.0])]
    got = {r.rank: (r.vec_id, r.score) for r in ha.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()}
    assert got == {1: (1, float("inf")), 2: (3, big + 1.0), 3: (4, 2.0), 4: (2, -float("inf"))}
