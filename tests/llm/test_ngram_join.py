import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join as nj
from tidemark.llm.common import connected_components


def brute(rows, k, percent):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def fixture(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(rng.choice([1, 2, 4, 10, 40, 120, 300]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        rows.append((1000 - i, rng.choice([" ", "\n", "  "]).join(words)))
    return [*rows, (1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (6, "a"), (7, "x " * 20_000), (8, "x " * 19_000 + "y"), (9, "a b c\x85d\xa0e f"), (10, "a b c\x85d\xa0e F")]


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5), (70, 2)])
def test_partners_share_a_signature(percent, k):
    rng, bands = random.Random(percent), nj.Bands(percent, nj.WIDTH)
    for _ in range(300):
        n = rng.choice([2, 5, 20, 60, 200])
        a = np.unique(nj.mix(np.array([rng.randrange(1 << 62) for _ in range(n)], np.uint64)))
        gone = rng.randint(0, max(1, n * (100 - percent) // 100))
        more = nj.mix(np.array([rng.randrange(1 << 62) for _ in range(rng.randint(0, max(1, n // 10)))], np.uint64))
        b = np.unique(np.concatenate([a[gone:], more]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * len(np.union1d(a, b)) and nj.set_hash(a) != nj.set_hash(b):
            assert np.intersect1d(nj.signatures(a, bands), nj.signatures(b, bands)).size
        bits = sum(int(x).bit_count() for x in (nj.sketch(a) ^ nj.sketch(b)).view(np.uint64))
        assert bits <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("percent", [95, 90, 80, 60])
def test_partners_at_the_limit_share_a_signature(percent):
    """As many differences as a link allows, on either side or both, at every size."""
    rng, bands = np.random.default_rng(percent), nj.Bands(percent, nj.WIDTH)
    for n in [*range(2, 80), *range(80, 900, 41)]:
        a = rng.integers(1 << 62, size=n, dtype=np.uint64)
        for less in (n - n * percent // 100 - (n * percent % 100 > 0), 0, n // 15):
            more = max(0, 100 * (n - less) // percent - n)
            b = np.concatenate([a[less:], rng.integers(1 << 62, size=more, dtype=np.uint64)])
            if less + more and 100 * (n - less) >= percent * (n + more):
                assert np.intersect1d(nj.signatures(np.unique(a), bands), nj.signatures(np.unique(b), bands)).size, (n, less, more)


@pytest.mark.parametrize("percent,k,rounds,hot", [(90, 3, 3, 32), (80, 5, 0, 1)])
def test_against_brute_force(spark, monkeypatch, percent, k, rounds, hot):
    monkeypatch.setattr(nj, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(nj, "HOT", hot)
    rows = fixture(percent)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(tuple(r) for r in nj.jaccard_components(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_a_pair_of_many_signatures_is_made_once(spark):
    """30 classes, each two of which share 40 signatures and more; two classes that share a late one only still meet."""
    rows = [(s, n, n) for s in range(60) for n in range(30) if (s + n) % 10] + [(1000 + s, 40 + n, 40 + n) for n in (0, 1) for s in range(20 + n, 60, 2)]
    rows += [(5000, 40, 40), (5000, 41, 41)]
    at = spark.createDataFrame(rows, "sig long, node long, component long").repartition(3)
    light = spark.createDataFrame([(n, 100, [0] * nj.SKETCH_LONGS) for n in {r[1] for r in rows}], "node long, n long, sketch array<long>")
    made = sorted((r.a, r.b) for r in nj._meetings(at, light, 80).collect())
    assert made == [*((a, b) for a in range(30) for b in range(a + 1, 30)), (40, 41)]
    assert sorted((r.a, r.b) for r in nj._across(at, light, 80).collect()) == made


def test_components_and_empty_tables(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(3, 2), (2, 1), (3, 3)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 1: 1, 2: 1, 3: 1, **{i: 500 for i in range(500, 540)}}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_components(none).count() == 0
