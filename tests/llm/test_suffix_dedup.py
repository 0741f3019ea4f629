import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd


def brute(rows, length):
    places = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((d, i))
    gone = [np.zeros(len(raw), bool) for raw in raws]
    for at in places.values():
        for d, i in at if len(at) > 1 else ():
            gone[d][i : i + length] = True
    out = []
    for (i, _), raw, g in zip(rows, raws, gone, strict=True):
        runs = int(np.sum(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        out.append((i, len(raw), int(g.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~g])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdé", "abcdefghijklmnopqrstuvwxyz "])
def test_suffix_array_against_sorting(letters):
    rng = random.Random(8)
    for n in (0, 1, 2, 30, 400):
        raw = "".join(rng.choice(letters) for _ in range(n)).encode()
        order = sd.suffix_array(np.frombuffer(raw, np.uint8), 10_000).tolist()
        assert order == sorted(range(len(raw)), key=lambda i: raw[i:])
        prefixes = sd.common_prefixes(np.frombuffer(raw + b"\xff" * 5, np.uint8), np.array(order, int), 5)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :] + b"\xff" * 5, raw[order[k] :] + b"\xff" * 5
            assert prefixes[k] == next((i for i in range(5) if a[i] != b[i]), 5)


@pytest.mark.parametrize("chunk", [64, 256, 1 << 20])
def test_equal_strings_choose_equal_anchors(monkeypatch, chunk):
    """Texts of several chunks too."""
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rng = random.Random(9)
    part = "".join(rng.choice("abc") for _ in range(300))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(150))) + part + "x" * rng.randrange(50) for _ in range(4)]
    seen = []
    for t in texts:
        h, first, last = sd.anchors(t.encode(), 40, 8)
        assert first[0] == 0 and last[-1] == len(t) - 40 and (first[1:] == last[:-1] + 1).all()
        owner = np.repeat(h, last - first + 1)
        seen.append(owner[t.index(part) : t.index(part) + 261].tolist())
    assert all(s == seen[0] for s in seen)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 40)), rng.choice(shared), "a" * rng.randint(0, 90)]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    whole = text(60)
    rows += [(100, None), (101, ""), (102, whole), (103, whole), (104, whole + "x"), (105, whole), (7, whole), (106, "z" * 3000), (109, "ab c " * 400), (110, "ab c " * 300 + "d" + "ab c " * 90), (None, text(50)), (107, "é" * 500), (107, "é" * 500), (107, text(60)), (108, rows[0][1])]
    return rows


@pytest.mark.parametrize("hot", [4, 4096])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = fixture(hot)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)
    for length in (60,):
        got = sorted((tuple(r) for r in sd.digest_kept(docs, length).collect()), key=str)
        assert got == brute(rows, length)
    assert sd.digest_kept(docs.limit(0), 60).count() == 0


def test_a_line_that_stands_often_in_one_text(spark, monkeypatch):
    """Places count, not texts: the anchor is hot though a single text has it, and columns may be named like the operator's own."""
    monkeypatch.setattr(sd, "HOT", 20)
    rng = random.Random(3)
    line = "the line that stands everywhere, again and again and again. "
    rows = [(1, "".join(line + "".join(rng.choices("abcdef ", k=30)) for _ in range(50))), (2, line + "once more")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, row int, spans int, hash int, content string")
    assert sorted((tuple(r) for r in sd.digest_kept(docs, 60).collect()), key=str) == brute(rows, 60)
    assert sd.without_repeats(docs, 60, spans_col="cut").columns == [*docs.columns, "cut"]


def test_equal_fragments_and_blocks(monkeypatch):
    """Equal fragments fold, and blocks end between groups."""
    monkeypatch.setattr(sd, "BLOCK", 50)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab", k=rng.randrange(20, 60)))) for i in range(40)]
    sent = []
    for i, t in rows:
        h, first, last = sd.anchors(t.encode(), 20, 8)
        sent += [(k, i, a, b, t.encode()[a : b + 20]) for k, a, b in zip(h.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)]
    sent.sort(key=lambda x: x[0])
    batch = sd.pa.RecordBatch.from_arrays([sd.pa.array(c) for c in zip(*sent, strict=True)], ["hash", "row", "first", "last", "fragment"])
    gone = {(r["row"], s) for out in sd._compare(20)(iter([batch])) for r in out.to_pylist() for s in range(r["first"], r["last"] + 1)}
    where = defaultdict(set)
    for i, t in rows:
        for s in range(len(t) - 19):
            where[t[s : s + 20]].add((i, s))
    assert gone == {p for at in where.values() if len(at) > 1 for p in at}


def test_texts_without_their_repeats(spark):
    shared = "x y z " * 40
    docs = spark.createDataFrame([(1, "é" + shared + "end"), (2, "other" + shared), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.without_repeats(docs).collect()}
    assert got == {1: "éend", 2: "other", 3: None}


def test_hashes_tell_grams_apart():
    raw = bytes(np.random.default_rng(1).integers(97, 123, 50_000, dtype=np.uint8))
    assert len(np.unique(sd.gram_hashes(np.frombuffer(raw, np.uint8), 32))) == 50_000 - 31
    h, first, last = sd.anchors(raw)
    assert len(np.unique(h)) == len(h) < 50_000 / 60


def test_many_spans_in_one_text_take_linear_time():
    n = 400_000
    first = np.arange(n) * 500
    began = time.time()
    start, end = sd.joined(first, first + 10, 200)
    assert time.time() - began < 2 and len(start) == n and (end - start == 210).all()
    start, end = sd.joined(np.array([0, 5, 300, 500, 900]), np.array([200, 6, 310, 600, 900]), 200)
    assert list(zip(start.tolist(), end.tolist())) == [(0, 800), (900, 1100)]


def test_columns_of_any_name(spark):
    text = "abc defg " * 60
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, text + "tail", 8, "y"), (3, None, 9, "z")], "doc_id long, text string, row long, __row string")
    got = {r.doc_id: (r.text, r.row, r["__row"]) for r in sd.without_repeats(docs, spans_col="cut").collect()}
    assert got[3] == (None, 9, "z") and got[2][1:] == (8, "y") and got[1][1:] == (7, "x")
    with pytest.raises(ValueError):
        sd.without_repeats(docs, spans_col="row")
