import random
from collections import Counter

import corpus_pipeline as cp

from . import test_ngram_join, test_suffix_dedup


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "packing":
            got = out.collect()
            assert sorted(r.doc_id for r in got) == sorted(texts)
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            want = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact dedup":
            best = {}
            for i, t in sorted(texts.items()):
                best.setdefault("".join(t.split()), []).append((-len(t), i))
            want = {i: texts[i] for _, i in map(min, best.values())}
        elif name == "n-gram Jaccard join":
            want = {i: texts[i] for i, _, c in test_ngram_join.brute(list(texts.items()), cp.SHINGLE, cp.PERCENT) if i == c}
        else:
            removed = {i: (n, gone) for i, n, gone, *_ in test_suffix_dedup.brute(list(texts.items()), 200)}
            assert all(abs(removed[i][0] - removed[i][1] - len(t.encode())) <= 6 for i, t in got.items())
            want = {i: got.get(i, "") for i, (n, gone) in removed.items() if n - gone > 6 or i in got}
        assert got == want, name
        texts = got


def test_repeated_rows_and_ids(spark):
    """Of every class one row stays, whatever ids repeat, and a copy does not take other rows of its id along."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    a, b, c, d, e, f = (" ".join(word() for _ in range(60)) for _ in range(6))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [
        (1, a), (1, a), (1, a), (9, a + " "),  # a row three times, and a copy with more code points: that one stays
        (2, b), (3, b), (3, c),  # (3, b) goes, (3, c) stays
        (4, d), (4, d), (4, d.replace(" ", "  ", 1)),  # equal texts under one id
        (5, e), (None, e), (None, f), (None, f),
        (9, near),  # near copy under the id of what it copies
    ]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    once = cp.drop_exact_copies(spark, docs, "").collect()
    stay = [(9, a + " "), (2, b), (3, c), (4, d.replace(" ", "  ", 1)), (5, e), (None, f)]
    assert Counter((r.doc_id, r.text) for r in once) == Counter([*stay, (9, near)])
    docs = spark.createDataFrame(once, docs.schema)
    left = Counter((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect())
    assert left in (Counter(stay), Counter([*stay[1:], (9, near)]))
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in left], docs.schema)
    assert Counter((r.doc_id, r.text) for r in cp.cut_repeated_passages(spark, docs, "").collect()) == left


def test_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, and columns that are named like those of the stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, __row long, row string, copy int, spans int, predicted string, score double, id long, kept boolean"
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(80))
    a, b = text(), text()
    rows = [(i, t, None if i == 2 else "en", None, None, 70 + i, f"r{i}", i, i, "p", 0.5, -i, None) for i, t in enumerate([a, b, text(), a, None, "", text() + " " + b[:300], "12 .."])]
    full = spark.createDataFrame([*rows, (None, text(), "en", "s", 1, None, None, None, None, None, None, None, None)], schema)
    for docs in (full, full.limit(0)):
        for k, (name, stage) in enumerate(cp.STAGES):
            before = docs
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.write.parquet(path := str(tmp_path / f"{before is full}-{k}-{id(before)}"))
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == before.columns
                own = {r.doc_id: r for r in docs.select("doc_id", "__row", "row", "copy", "spans", "predicted", "score", "id", "kept").collect()}
                assert all(tuple(r) == (i, 70 + i, f"r{i}", i, i, "p", 0.5, -i, None) for i, r in own.items() if i is not None), name
        if before.count():
            assert {r.doc_id for r in docs.collect()} == {0, 1, 2, 6, None}
