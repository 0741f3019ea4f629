import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lexical_rank as lr

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, most=50, once=True):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum((1 if once else q) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(str(item), k + 1, str(s[3]), -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:most])]
    return sorted(out)


@given(st.text())
@settings(max_examples=300)
def test_words_are_the_matches_of_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in lr.words(text.encode())] == terms(text)


WORDS = "alpha Beta gamma delta Épée naïve 42 x-ray ÀB ab 東京 東 mu nu".split()
DOCS = [(i, " ".join(WORDS[(i * k * k + k) % len(WORDS)] for k in range(i % 9))) for i in range(120)]
ODD = [(500, None), (501, ""), (502, "  ..- "), (None, "alpha alpha"), (None, "beta"), (5, DOCS[5][1]), (5, "gamma gamma 東京"), (-(2**63), "alpha delta"), (600, "alpha " * 30_000 + "東京"), (601, "É" * 5000)]
ITEMS = [(1, "Alpha beta BETA 東京"), (2, None), (3, "..."), (4, "unseen words"), (5, "gamma naïve épée Épée ab ÀB 42 x ray"), (5, "delta"), (None, "mu nu nu")]


@pytest.mark.parametrize("most,once,pairs", [(50, True, 250_000), (7, True, 3), (200, False, 5)])
def test_ranks_against_all_scores(spark, monkeypatch, most, once, pairs):
    monkeypatch.setattr(lr, "ITEM_PAIRS", pairs)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in [*DOCS, *ODD]], "doc_id long, text string, n long, place int").repartition(5)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")
    got = lr.ranked(items, docs, most, once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got.collect()) == plain(ITEMS, [*DOCS, *ODD], most, once)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for i, d in ((items.limit(0), docs), (items, docs.limit(0)), (items.filter("item_id = 2"), docs)):
        assert lr.ranked(i, d).collect() == []


def test_blocks_bound_documents_and_pairs():
    def batch(n, each):
        return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([each * 4 * b"x"] * n, pa.binary())], ["id", "terms"])

    sizes = [b.num_rows for b in lr._blocks([batch(30_000, 1), batch(3000, 900)])]
    assert sum(sizes) == 33_000 and max(sizes) <= lr.BLOCK_DOCS and all(s <= 4096 for s in sizes[2:])
