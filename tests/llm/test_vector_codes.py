import math

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc


def plain(rows, rounds=2):
    """Every distance of every round in Python's integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v], lab) for i, v, lab in rows if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    at = lambda: [[min((far(part(v, p), c), k) for k, c in enumerate(books[p])) for p in range(16)] for _, v, _ in kept]
    for _ in range(rounds):
        found = at()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [part(kept[i][1], p) for i in range(len(kept)) if found[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = at()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), min(sum(s for s, _ in f), 2**63 - 1), str(lab)) for (i, _, lab), f in zip(kept, found, strict=True)), vc.digest(np.array(books, object))


@pytest.mark.parametrize("scale,kind", [(1, "float"), (1, "double"), (3e4, "double"), (1e9, "double"), (1e25, "double")])
def test_codes_against_full_scans(spark, scale, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 32)) * scale
    v[20:40] = v[3]
    v[40:60, :16] = v[4, :16]
    v[60:70] = np.round(v[60:70])
    if kind == "float":
        v = v.astype(np.float32).astype(float)
    odd = [(900, None, 1), (901, [1.0] * 31, 1), (902, [], 1), (903, [None] + [1.0] * 31, 1), (904, [float("nan")] * 32, 1), (905, [float("-inf")] + [1.0] * 31, 2), (906, [0.0] * 32, None), (None, [0.5] * 32, None), (7, [0.25] * 32, 3), (-(2**63), [0.125] * 32, 3)]
    rows = [*((i, x.tolist(), i % 3) for i, x in enumerate(v)), *odd]
    df = spark.createDataFrame([(*r, "code") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(3)
    coded, books = vc.encode(df)
    want, digest = plain(rows)
    assert sorted((str(r.id), r.code, r.error, str(r.label)) for r in coded.collect()) == want
    assert vc.digest(books[32]) == digest
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    for most in (100, 0):
        vc.MOST_LABELS, before = most, vc.MOST_LABELS
        assert {(str(r.label), r.label_error) for r in vc.with_label_error(coded).collect()} == {(k, min(s, 2**63 - 1)) for k, s in sums.items()}
        assert vc.with_label_error(coded).count() == len(want)
        vc.MOST_LABELS = before


def test_dimensions_and_small_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16 + 16 * (i % 2)).tolist(), None) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vc.encode(df)
    got = {(str(r.id), r.code, r.error) for r in coded.collect()}
    for odd in (0, 1):
        want, digest = plain([r for r in rows if r[0] % 2 == odd])
        assert {w[:3] for w in want} <= got and vc.digest(books[16 + 16 * odd]) == digest
    none, books = vc.encode(df.limit(0))
    assert none.collect() == [] and books == {}
    assert vc.encode(df.drop("label"), label_col=None)[0].count() == 40
    with pytest.raises(Exception, match="too large"):
        vc.encode(spark.createDataFrame([(1, [1e200] * 16, 1)], df.schema))


def test_bounds_save_scans_and_keep_ties():
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, size=(64, 4)).astype(float)
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, size=(3000, 4))
    old = centres + rng.integers(-30, 30, size=centres.shape)
    new = centres.copy()
    new[9] = new[5]
    at, upper, lower = vc.scan(x, old)
    scanned = vc.reassign(x, new, at, upper, lower, vc.moved(old, new))
    want = ((x[:, None] - new[None]) ** 2).sum(axis=2)
    assert (at == want.argmin(axis=1)).all() and not (at == 9).any()
    assert 0 < scanned < len(x) / 5, scanned
    assert (upper.astype(float) ** 2 >= want.min(axis=1)).all() and (lower <= np.sqrt(np.partition(want, 1, axis=1)[:, 1])).all()


def test_query_on_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    want, digest = plain([(r["vec_id"], r["embedding"], r["label"]) for r in t])
    got = vc.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == [w[:3] for w in want] and {r.codebooks_sha256 for r in got} == {digest}
