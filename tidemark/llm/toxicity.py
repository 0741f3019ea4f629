"""Toxicity from a lexicon that is learnt, spelling included.

The lexicon is a trie. Its Levenshtein automaton of MOST_EDITS edits is intersected with it and made deterministic as words
come: a state is a set of (trie node, edits so far), and a letter leads from one state to the next. An edit is a letter put
in, left out or replaced, or two neighbours swapped; a member of a state that is amid a swap names the letter it waits for.
A word whose state is empty matches nothing, which for most words shows after two or three letters. An entry is a whole word
or a stem, which matches any word that begins with it exactly; stems and words under EDIT_LETTERS letters take no edits.

Learning, from a bounded sample of labelled rows (TOXIC_ROWS rows of label 1 and CLEAN_ROWS of label 0, in the order of a
hash of their id; whole texts, of SAMPLE_CHARS characters a label at most but for the first): entries are words and word beginnings that stand in at least LEAST documents of label 1
and hardly ever in others, taken one by one as they explain documents that earlier ones do not. The weight of an entry
is the share of toxic documents among those that have it, at equal numbers of both labels. Misspellings are judged one by
one: a form weighs MISSPELT of its entry, enough to decide alone for a strong entry, or nothing if a clean document of the
sample has that form.

Scoring: a hit counts its weight, QUOTED of it where its context window shows quotation (inside quotation marks, or after a
word of reporting within CONTEXT words). Score is 1 - exp(-SLOPE * sum over distinct entries of the entry's best hit and a
quarter of its others). Null and empty texts score 0. Texts are scored whole. Repeated rows and ids are scored one by one; of labels that contradict each
other 1 counts. An empty table gives an empty result, and without labels all scores are 0. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, settle, table

SAMPLE_CHARS = 20_000_000
TOXIC_ROWS, CLEAN_ROWS, LEAST, IMPURE, DECAY, MOST_EDITS = 2_000, 6_000, 3, 0.02, 0.25, 1
STEM_LETTERS, STEM_SUFFIXES, EDIT_LETTERS, STATES = (4, 5, 6, 7, 8), 3, 5, 50_000
QUOTED, MISSPELT, CONTEXT, SLOPE, THRESHOLD = 0.2, 0.5, 4, 1.2, 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Letters that stand for others in disguised spellings, and words that report another's speech.
DISGUISE = str.maketrans("013457@$", "oieastas")
DISGUISING, TOKEN = re.compile("[013457@$]"), re.compile(r"[\w@$]+")
REPORTING = frozenset("said says called quote quoted wrote writes term word slur dijo llamó palabra sagte nannte wort zitat dit appelé mot terme".split())
OPENING = re.compile("[\"“”„«»]")


@dataclass
class Automaton:
    """The lexicon's trie and its Levenshtein automaton, determinised lazily. Matches: (entry, edits)."""

    entries: list[tuple[str, bool]]
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, (term, _) in enumerate(self.entries):
            at = 0
            for c in term:
                at = self.nodes[at].setdefault(c, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append({})
            self.ends.setdefault(at, []).append(k)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states, self.edges, self.stems, self.words = [], [], [], []
        self.state(frozenset())
        self.first = self.state(self._closed({(0, "", 0)}))

    def state(self, members: frozenset) -> int:
        """Number of a state; with it are kept the stems that end there and the words that do, with their edits."""
        if (k := self.number.get(members)) is None:
            k = self.number[members] = len(self.states)
            ended = [(e, edits) for (node, wait), edits in members if not wait for e in self.ends.get(node, ())]
            self.states.append(members)
            self.edges.append({})
            self.stems.append([e for e, edits in ended if self.entries[e][1] and not edits])
            self.words.append([(e, edits) for e, edits in ended if not self.entries[e][1] and (not edits or len(self.entries[e][0]) >= EDIT_LETTERS)])
        return k

    def _closed(self, members: set[tuple[int, str, int]]) -> frozenset:
        """With letters of the entry left out; of equal places the fewest edits stay."""
        best: dict[tuple[int, str], int] = {}
        todo = list(members)
        while todo:
            node, wait, edits = todo.pop()
            if best.get((node, wait), MOST_EDITS + 1) <= edits:
                continue
            best[node, wait] = edits
            if edits < MOST_EDITS and not wait:
                todo += [(child, "", edits + 1) for child in self.nodes[node].values()]
        return frozenset(best.items())

    def step(self, state: int, letter: str) -> int:
        after: set[tuple[int, str, int]] = set()
        for (node, wait), edits in self.states[state]:
            if wait:
                if wait == letter:
                    after.add((node, "", edits))
                continue
            for c, child in self.nodes[node].items():
                if c == letter:
                    after.add((child, "", edits))
                elif edits < MOST_EDITS:
                    after.add((child, "", edits + 1))
                    if (beyond := self.nodes[child].get(letter)) is not None:
                        after.add((beyond, c, edits + 1))
            if edits < MOST_EDITS:
                after.add((node, "", edits + 1))
        to = self.edges[state][letter] = self.state(self._closed(after))
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """Entries near the word with their edits: whole words up to MOST_EDITS, short ones and stems only exactly."""
        if len(self.states) > STATES:
            self._forget()
        state, edges, stems, found = self.first, self.edges, self.stems, {}
        for c in word:
            to = edges[state].get(c)
            state = self.step(state, c) if to is None else to
            if not state:
                break
            for k in stems[state]:
                found[k] = 0
        for k, edits in self.words[state]:
            found[k] = min(edits, found.get(k, edits))
        return tuple(sorted(found.items()))


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    weights: dict[tuple[int, int], float]
    #: (entry, misspelt form) of the clean sample; as many at most as its words near an entry.
    innocent: frozenset[tuple[int, str]] = frozenset()


def words_of(text: str) -> Counter:
    """Lower-case words, and what disguised ones read as."""
    lowered = text.lower()
    words = Counter(WORD.findall(lowered))
    if DISGUISING.search(lowered):
        for w in TOKEN.findall(lowered):
            if not w.isalpha() and not w.isdigit() and (plain := w.translate(DISGUISE)).isalpha():
                words[plain] += 1
    return words


def learn_lexicon(rows: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Entries in the order in which they explain toxic documents.

    The weight of a toxic document falls by DECAY with each entry found in it, so words that merely stand beside known ones,
    as in near copies, explain nothing. An entry is taken while a word that has nothing to do with toxicity would hardly
    reach its explained weight by chance, over all words tried; of entries that explain as much, the longest is taken.
    """
    docs = [(set(words_of(t)), y) for t, y in dict.fromkeys(rows)]
    n_clean = sum(1 for _, y in docs if not y)
    where: dict[tuple[str, bool], list[int]] = {}
    spelt: dict[str, set] = {}
    toxic = [words for words, y in docs if y]
    for i, words in enumerate(toxic):
        for f in _features(words):
            where.setdefault(f, []).append(i)
        for w in words:
            for k in STEM_LETTERS:
                if len(w) > k:
                    spelt.setdefault(w[:k], set()).add(w)
    where = {f: at for f, at in where.items() if len(at) >= LEAST and not (f[1] and len(spelt.get(f[0], ())) < STEM_SUFFIXES)}
    clean = Counter(f for words, y in docs if not y for f in _features(words) if f in where)
    hopeful = {f: at for f, at in where.items() if clean[f] <= IMPURE * n_clean * len(at) / len(toxic)}
    left, taken = [1.0] * len(toxic), []
    explained = lambda f: sum(left[i] for i in hopeful[f])
    score = {f: explained(f) for f in hopeful}
    while score:
        f = max(score, key=lambda f: (score[f], f))
        rest = sum(left)
        if score[f] * math.log((rest + n_clean + 1) / rest) < math.log(10 * len(where)):
            break
        alike = [g for g in hopeful if g in score and g[0].startswith(f[0][:4]) and score[g] >= 0.97 * score[f] and not set(hopeful[g]) - set(hopeful[f])]
        f = max([f, *alike], key=lambda g: (not g[1], len(g[0]), g))
        taken.append(f)
        changed = set(hopeful[f])
        for i in changed:
            left[i] *= DECAY
        del score[f]
        score = {g: explained(g) if changed.intersection(hopeful[g]) else x for g, x in score.items() if not (f[1] and g[0].startswith(f[0]))}
    return taken


def _features(words: set[str]) -> set[tuple[str, bool]]:
    return {(w, False) for w in words if len(w) >= 4} | {(w[:k], True) for w in words for k in STEM_LETTERS if len(w) >= k}


def fit(rows: list[tuple[str, int]]) -> Model:
    entries = learn_lexicon(rows) if any(y for _, y in rows) else []
    automaton, seen = Automaton(entries), {0: Counter(), 1: Counter()}
    n_toxic, n_clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    innocent = set()
    for text, y in rows:
        found = {(w, m) for w in words_of(text) for m in automaton.match(w)}
        seen[y].update({m for _, m in found})
        innocent.update((k, w) for w, (k, edits) in found if edits and not y)
    weights = {}
    for k in range(len(entries)):
        a, b = seen[1][k, 0] / max(1, n_toxic), seen[0][k, 0] / max(1, n_clean)
        weight = (a + 1 / max(1, n_toxic)) / (a + b + 1 / max(1, n_toxic))
        weights[k, 0] = weight if weight >= 0.5 else 0.0
        for edits in range(1, MOST_EDITS + 1):
            weights[k, edits] = MISSPELT * weights[k, 0]
    return Model(entries, weights, frozenset(innocent))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.automaton, self.known = model, Automaton(model.entries), {}

    def hit(self, word: str) -> tuple[tuple[int, float], ...]:
        if (out := self.known.get(word)) is None:
            out = tuple((k, w) for k, edits in self.automaton.match(word) if (w := self.model.weights[k, edits]) > 0 and (k, word) not in self.model.innocent)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = out
        return out

    def score(self, text: str) -> float:
        words = words_of(text)
        hits = {w: h for w in words if (h := self.hit(w))}
        if not hits:
            return 0.0
        lowered, best, total = text.lower(), {}, {}
        marks = [m.start() for m in OPENING.finditer(lowered)]
        spans = [(m.start(), m[0]) for m in WORD.finditer(lowered)]
        plain = Counter(w for _, w in spans if w in hits)
        places = [(i, at, w) for i, (at, w) in enumerate(spans) if w in hits] + [(None, 0, w) for w in hits for _ in range(words[w] - plain[w])]
        for i, at, w in places:
            quoted = False
            if i is not None:
                quoted = bisect_left(marks, at) % 2 == 1 and marks[-1] > at if marks else False
                quoted = quoted or any(x in REPORTING for _, x in spans[max(0, i - CONTEXT) : i])
            for k, weight in hits[w]:
                value = weight * (QUOTED if quoted else 1)
                best[k], total[k] = max(best.get(k, 0), value), total.get(k, 0) + value
        return 1 - math.exp(-SLOPE * sum(best[k] + (total[k] - best[k]) / 4 for k in best))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Labels of rows that are not held out; a row with contradicting labels counts as toxic, one without text is left out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = [marked.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = settle(some[0].union(some[1]))  # TOXIC_ROWS + CLEAN_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("hash", F.xxhash64("text"))
    #: Of a repeated id each text counts once; whole texts are taken until SAMPLE_CHARS are reached, one of each label at least.
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("y", "doc_id", "hash").agg(F.max(F.length("text")).alias("chars"))
    first = sizes.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(*order, "hash"))).filter(F.col("k") <= TOXIC_ROWS + CLEAN_ROWS)
    run = F.sum("chars").over(Window.partitionBy("y").orderBy("k"))
    keys = settle(first.withColumn("run", run).filter((F.col("run") <= SAMPLE_CHARS) | (F.col("k") == 1)).select("doc_id", "hash", "y"))
    sample = texts.join(F.broadcast(keys), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "y", "doc_id").orderBy("doc_id", "text")
    return fit([(r.text, r.y) for r in sample.toLocalIterator()])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fewer entries than the sample has words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t) if t else 0.0 for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op10_toxicity over the whole of documents. A learnt lexicon is not expressible in SQL; tests measure held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
