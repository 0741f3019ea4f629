import random
import time
import zlib
from collections import Counter
from itertools import product

import pytest

from tidemark.llm import language_id as li
from tidemark.llm import toxicity as tx
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_grams(text, most):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " "
    n = {}
    for k, s in product((1, 2, 3), range(len(padded))):
        g = padded[s : s + k]
        if len(g) == k and not (k == 1 and g == " ") and not (k == 3 and g[1] == " "):
            n[g] = n.get(g, 0) + 1
    return n


def test_ranks_against_a_plain_count():
    text = "The cat, the hat. Été à l'été 12 x"
    alphabet = li.letters_of([text])
    letter = {int(alphabet[ord(c)]): c for c in text.lower() if c.isalpha()} | {0: " "}
    _, gram, rank = li.ranked_grams([text], alphabet, 10_000)
    n = plain_grams(text, 0)
    spelt = ["".join(letter[(g >> 8 * k) & 255] for k in reversed(range(g >> 24))) for g in gram.tolist()]
    assert sorted(spelt) == sorted(n) and rank.tolist() == list(range(len(n)))
    assert [n[g] for g in spelt] == sorted(n.values(), reverse=True)


def test_prediction_is_the_smallest_distance():
    samples = {"a": ["the hat that sat"], "b": ["der hut der war"]}
    profiles = li.fit_profiles(samples)
    texts = ["that hat", "der hut", "", "12 !", "ж", "x" * 100_000]
    langs, score = li.predict(texts, profiles)
    assert langs[:4] == ["a", "b", "und", "und"] and langs[4] in ("a", "b") and score[4] == 0 and all(0 <= s <= 1 for s in score)
    batch = [li.predict([t], profiles)[0][0] for t in texts]
    assert batch == langs


def plain_prediction(text, samples):
    """Out-of-place distances written out; profiles and documents as lists of grams in the order of their ranks."""
    letter = {c: k for k, (_, c) in enumerate(sorted((-n, c) for c, n in Counter(c for t in sum(samples.values(), []) for c in t.lower() if c.isalpha()).items()))}
    code = lambda g: (len(g), [letter.get(c, 250) + 1 if c != " " else 0 for c in g])
    ranked = lambda t, most: [g for g, _ in sorted(plain_grams(t, 0).items(), key=lambda x: (-x[1], code(x[0])))][:most]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0
    own, best = ranked(text, li.DOC_GRAMS), None
    for lang in sorted(samples):
        profile = ranked(" ".join(samples[lang]), li.PROFILE_GRAMS)
        away = sum(abs(profile.index(g) - k) if g in profile else li.PROFILE_GRAMS for k, g in enumerate(own))
        best = min(best or (away, lang), (away, lang))
    return best[1], 1 - best[0] / (li.PROFILE_GRAMS * len(own))


def test_language_query_against_a_plain_one(spark):
    """The query's own profiles, learnt from all rows that are not held out, by plain counting; more languages than few."""
    rng = random.Random(2)
    names = [f"l{k:03d}" for k in range(230)]
    words = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rng.randint(2, 6))) for _ in range(8)] for lang in names}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(0, 9))), lang) for i, lang in enumerate(rng.choices(names, k=700))]
    rows += [(900, None, "l000"), (901, "", "l001"), (902, "12 !", None), (903, "\U00030001", None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    samples = {}
    for i, t, lang in sorted(set(rows[:701]), key=str):
        if lang and t is not None and not held(i):
            samples.setdefault(lang, []).append(t)
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in li.identify(docs).collect())
    want = sorted((i, held(i), *((p, round(s, 9)) for p, s in [plain_prediction(t, samples)]).__next__()) for i, t, _ in rows)
    assert len(samples) > 200 and [g for g in got if g[0] < 900] == [w for w in want if w[0] < 900]
    assert {g[0]: g[2] for g in got if g[0] >= 900 and g[0] < 903} == {900: "und", 901: "und", 902: "und"} and [g[2] for g in got if g[0] == 903] != ["und"]


def test_language_query(spark):
    docs = table(spark, SF, "documents")
    got = li.query(spark, SF).join(docs, "doc_id")
    held = got.filter("held_out and lang is not null and n_chars > 30")
    assert got.count() == docs.count() and held.filter("lang_pred = lang").count() >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None, None), (None, "abc", "en"), (2, "", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.lang_pred) for r in li.identify(odd).collect()) == [("1", "und"), ("2", "und"), ("2", "und"), ("None", "en")]
    assert li.identify(odd.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_edit_distance():
    terms = ["moron", "scum", "morons", "idiot"]
    automaton = tx.Automaton([(t, False) for t in terms] + [("lowei", True)])
    words = ["moron", "maron", "morn", "moroon", "scum", "scun", "idioot", "idot", "xmoron", "loweihr", "lowe", "loweix", "", "moronss", "diot", "mor"]
    for w in words:
        want = {k: edits(w, t) for k, t in enumerate(terms) if edits(w, t) <= (1 if len(t) >= tx.EDIT_LETTERS else 0)}
        want |= {4: 0} if w.startswith("lowei") else {}
        assert dict(automaton.match(w)) == want, w


def test_quotation_and_misspelling():
    rows = [(f"you are a moron scum number {chr(97 + i % 26)}{chr(97 + i // 26)}", 1) for i in range(30)] + [(f"you are a nice number {chr(97 + i % 26)}{chr(97 + i // 26)}", 0) for i in range(300)]
    scorer = tx.Scorer(tx.fit(rows))
    abuse, quoted, spelt, clean = (scorer.score(t) for t in ("what a moron", 'she said "moron" aloud', "what a m0ron", "nice day"))
    near = scorer.score("what a maron")
    assert clean < near < scorer.score("what a maron and morons") < abuse
    assert abuse >= tx.THRESHOLD > quoted > clean == 0 and spelt >= tx.THRESHOLD


def test_misspelt_markers_decide_alone():
    """The one marker of a toxic text is misspelt; a form that clean texts have counts nothing, and others of its entry do."""
    tail = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(f"you are a moron idiot number {tail(i)}", 1) for i in range(30)] + [(f"you are a nice {'oron' if i % 2 else 'day'} number {tail(i)}", 0) for i in range(300)]
    scorer = tx.Scorer(tx.fit(rows))
    for toxic in ("what a maron", "what a mroon", "what an idoit", "what an idioot", "such a m0rn", "diiot"):
        assert scorer.score(toxic) >= tx.THRESHOLD, toxic
    for clean in ("a nice oron", "oron number", "a nice day", "it is mornoo", "such a doiit"):
        assert scorer.score(clean) == 0, clean
    swapped = tx.Automaton([("moron", False)])
    assert [swapped.match(w) for w in ("omron", "mroon", "moorn", "morno")] == [((0, 1),)] * 4 and swapped.match("mornox") == ()


def test_toxicity_query(spark):
    big = SF.replace("0.01", "0.1")
    got = tx.query(spark, big).join(table(spark, big, "labels"), "doc_id")
    n = {(r.held_out, r.toxic, r.predicted): r["count"] for r in got.groupBy("held_out", "toxic", "predicted").count().collect()}
    caught, toxic, flagged = (sum(v for (h, y, p), v in n.items() if h and f(y, p)) for f in (lambda y, p: y and p, lambda y, p: y, lambda y, p: p))
    assert caught >= 0.8 * toxic and caught >= 0.9 * flagged, (caught, toxic, flagged)
    none = tx.toxicity(spark.createDataFrame([(1, None), (None, ""), (1, "x" * 50_000)], "doc_id long, text string"), tx.fit([]))
    assert [r.score for r in none.collect()] == [0, 0, 0]


def test_sample_is_bounded_and_odd_rows_do_not_matter(spark, monkeypatch):
    """Repeated ids and rows, contradicting labels, clashing columns; a bound on characters that leaves one row of each label."""
    texts = [(i, f"you are a moron scum {chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 4 == 0 else f"a fine day {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    docs = spark.createDataFrame([(*r, 0.5, 1, "z") for r in [*texts, texts[0], (0, "other text"), (None, "moron"), (7, None)]], "doc_id long, text string, score double, y int, hash string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    assert {t for t, _ in model.entries} & {"moron", "scum"}
    scored = tx.toxicity(docs, model).collect()
    assert len(scored) == 204 and all(0 <= r.score <= 1 for r in scored) and tx.toxicity(docs.limit(0), model).count() == 0
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 1)
    seen = []
    monkeypatch.setattr(tx, "fit", seen.append)
    tx.learn(docs, labels)
    assert sorted(y for _, y in seen[0]) == [0, 1]


@pytest.mark.parametrize("rows", [[], [("only clean", 0)], [("only toxic", 1)]])
def test_fits_on_little(rows):
    assert tx.Scorer(tx.fit(rows)).score("only clean") >= 0


def test_thousands_of_quoted_hits_take_linear_time():
    scorer = tx.Scorer(tx.Model([("maroon", False)], {(0, 0): 1e-5, (0, 1): 0.0}, frozenset()))
    text = ' '.join(['"maroon"'] * 40_000)
    began = time.time()
    assert 0 < scorer.score(text) < scorer.score(text.replace('"', "")) and time.time() - began < 20
