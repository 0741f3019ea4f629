import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import cell_dedup as cd


def judge(rows, cosine=0.95):
    """Links and components by comparing all pairs; rows are (id, vector)."""
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if s else None for (_, v), s in zip(rows, sound, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                group[root(i)] = root(j)
    ids = {}
    for i, (id_, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(id_)
    least = {r: min((x for x in xs if x is not None), default=None) for r, xs in ids.items()}
    return sorted((str(id_), links[i], str(least[root(i)]), id_ == least[root(i)]) for i, (id_, _) in enumerate(rows)), len(ids)


def planted(rng, d=24):
    """Independent vectors, one tight hot group, loose groups around the linking angle, and a chain whose ends are far apart."""
    near = lambda v, noise, n: v + noise * rng.normal(size=(n, d)) / math.sqrt(d)
    unit = lambda v: v / np.linalg.norm(v)
    out = [rng.normal(size=(120, d))]
    out.append(near(unit(rng.normal(size=d)), 0.05, 90))
    out += [near(unit(rng.normal(size=d)), noise, 12) for noise in (0.15, 0.22, 0.3, 0.4)]
    a, b = unit(rng.normal(size=d)), unit(rng.normal(size=d))
    b = unit(b - (a @ b) * a)
    out.append(np.array([math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 3, 0.3)]))
    v = np.concatenate(out) * rng.lognormal(size=(sum(map(len, out)), 1))
    return v[rng.permutation(len(v))]


@pytest.mark.parametrize("visits,home,probes", [(1.5, 16_384, 65_536), (1e9, 16, 10), (1e9, 7, 1000)])
def test_all_links_are_found(spark, monkeypatch, visits, home, probes):
    v = planted(np.random.default_rng(1))
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0] * 23 + [None]), (904, []), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 0.0]), (907, [1e300, 0.0]), (908, [0.0, 1e-300]), (None, [0.0, 5.0]), (None, None)]
    rows = [*((i, x.tolist()) for i, x in enumerate(v)), *odd, (5, v[5].tolist()), (999, v[6].tolist())]
    for name, value in (("VISITS", visits), ("HOME", home), ("PROBES", probes)):
        monkeypatch.setattr(cd, name, value)
    df = spark.createDataFrame([(i, x, "r", 1) for i, x in rows], "vec_id long, embedding array<double>, row string, n long").repartition(3)
    got = cd.near_duplicates(df).collect()
    want, components = judge(rows)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert sum(r.representative for r in got) == components
    assert any(n > 40 for _, n, _, _ in want) and len({n for _, n, _, _ in want}) > 8


def test_single_precision_and_thresholds(spark):
    v = planted(np.random.default_rng(2), 16).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for cosine in (0.8, 1.0):
        want, _ = judge(rows, cosine)
        if cosine < 1:
            assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in cd.near_duplicates(df, cosine).collect()) == want
    with pytest.raises(ValueError):
        cd.near_duplicates(df, 0.0)
    assert cd.near_duplicates(df.limit(0)).collect() == []


def test_hot_group_costs_no_pairs(spark):
    """Members of a core are counted: of 3,000 near copies only those outside it are sent to tiles."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=32)
    v = np.concatenate([hot + 0.02 * rng.normal(size=(3000, 32)), rng.normal(size=(500, 32))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = cd.near_duplicates(df).filter("vec_id < 3000").collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)}


def test_a_tile_gives_a_forest():
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(3, 8)), 40, axis=0)
    row = np.arange(len(v))
    make = lambda kind: pa.RecordBatch.from_arrays([pa.array(row), pa.array(row), pa.array(np.zeros(len(v), bool)), pa.array(np.full(len(v), kind)), pa.array(v.tolist())], ["row", "node", "core", "kind", "v"])
    out = pa.Table.from_batches(list(cd.tile([make(0), make(1)], 0.95))).to_pylist()
    edges = [(r["a"], r["b"]) for r in out if r["a"] is not None]
    assert len(edges) <= 2 * len(v) and {a // 40 == b // 40 for a, b in edges} == {True}
    assert {r["row"]: r["n"] for r in out if r["n"]} == dict.fromkeys(range(120), 39)


def test_query_on_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    want, _ = judge(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in cd.query(spark, "/root/testdata/sf0.1").collect()) == want
