"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, word ends included) in order. A
document's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum, over the
document's n-grams, of how far the rank in the profile is from the rank in the document, and the profile's length for an
n-gram that it lacks. The smallest distance wins, ties go to the smaller name; score is 1 minus that distance over the
largest possible one.

Profiles are fitted on a bounded sample of the rows to learn from: at most PER_LANG documents of each language, in the order
of a hash of their id, and CHARS characters in all of them but for the first. Every language is learnt, however many there
are: n-grams are counted on the executors, and only PROFILE_GRAMS of each language come to the driver. Whole texts are read,
both in fitting and in prediction. A null or empty text, or one without a letter, is `und` with score 0. Repeated rows
and ids are predicted one by one. An empty table gives an empty result, and one without labelled rows predicts `und` only.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out, pieces, settle, table

PER_LANG, CHARS, BROADCAST_ROWS = 300, 2_000_000, 100_000
DOC_GRAMS, PROFILE_GRAMS, ALPHABET = 300, 400, 250
UNKNOWN = "und"
_SHIFT = 26


@dataclass
class Profiles:
    """alphabet: code of each code point, 0 for what is no letter. grams: sorted; ranks: of each gram in each language."""

    langs: list[str]
    alphabet: np.ndarray
    grams: np.ndarray
    ranks: np.ndarray


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code point, how often) of the letters of lower-cased texts."""
    points, n = np.unique(np.frombuffer("".join(texts).lower().encode("utf-32-le"), np.uint32), return_counts=True)
    letters = np.array([chr(p).isalpha() for p in points], bool)
    return points[letters], n[letters]


def alphabet_of(points: list[int]) -> np.ndarray:
    """Codes 1.. for these letters, the most frequent first, ALPHABET + 1 for other letters, 0 for all else."""
    codes = np.zeros(0x110000, np.uint8)
    codes[[p for p in range(0x110000) if chr(p).isalpha()]] = ALPHABET + 1
    codes[points[:ALPHABET]] = np.arange(1, min(ALPHABET, len(points)) + 1)
    return codes


def letters_of(texts: list[str]) -> np.ndarray:
    points, n = letter_counts(texts)
    return alphabet_of(points[np.lexsort((points, -n))].tolist())


def counted_grams(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, how often) of all grams of each text."""
    lowered = [t.lower() + " " for t in texts]
    points = np.frombuffer(("".join([" ", *lowered])).encode("utf-32-le"), np.uint32)
    codes = alphabet[points].astype(np.int64)
    owner = np.repeat(np.arange(-1, len(texts)), [1, *map(len, lowered)])
    owner[0] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    codes, owner = codes[keep], owner[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    whole = b > 0
    one = codes > 0
    parts = [
        (owner[one], (1 << 24) | codes[one]),
        (owner[1:], (2 << 24) | (codes[:-1] << 8) | codes[1:]),
        (owner[2:][whole], (3 << 24) | (a[whole] << 16) | (b[whole] << 8) | c[whole]),
    ]
    keys = np.concatenate([(o << _SHIFT) | g for o, g in parts])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    return keys[first] >> _SHIFT, keys[first] & ((1 << _SHIFT) - 1), n


def ranked_grams(texts: list[str], alphabet: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, rank) of the `most` most frequent grams of each text; ties go to the smaller gram."""
    text, gram, n = counted_grams(texts, alphabet)
    order = np.lexsort((gram, -n, text))
    text, gram = text[order], gram[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    few = rank < most
    return text[few], gram[few], rank[few]


def fit_profiles(samples: dict[str, list[str]]) -> Profiles:
    """From texts at hand."""
    alphabet = letters_of([t for texts in samples.values() for t in texts])
    return profiles_of(alphabet, {lang: ranked_grams([" ".join(texts)], alphabet, PROFILE_GRAMS)[1] for lang, texts in samples.items()})


def profiles_of(alphabet: np.ndarray, lists: dict[str, np.ndarray]) -> Profiles:
    """lists: of each language its grams in the order of their ranks."""
    langs = sorted(lists)
    grams = np.unique(np.concatenate([lists[x] for x in langs])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, max(1, len(langs))), PROFILE_GRAMS, np.int32)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(grams, lists[lang]), k] = np.arange(len(lists[lang]))
    return Profiles(langs, alphabet, grams, ranks)


def predict(texts: list[str], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    langs, score = np.full(len(texts), -1), np.zeros(len(texts))
    text, gram, rank = ranked_grams(texts, profiles.alphabet, DOC_GRAMS)
    letters = (gram >> 24) == 1
    lettered = np.bincount(text[letters], minlength=len(texts)) > 0
    if len(profiles.grams) and len(text):
        at = np.searchsorted(profiles.grams, gram)
        at[(at == len(profiles.grams)) | (profiles.grams[np.minimum(at, len(profiles.grams) - 1)] != gram)] = len(profiles.grams)
        ranks = profiles.ranks[at]
        away = np.where(ranks < PROFILE_GRAMS, np.abs(ranks - rank[:, None]), PROFILE_GRAMS)
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        total, n = np.add.reduceat(away, starts), np.diff(np.append(starts, len(text)))
        best = total.argmin(axis=1)
        langs[text[starts]] = best
        score[text[starts]] = 1 - total[np.arange(len(best)), best] / (PROFILE_GRAMS * n)
    langs[~lettered], score[~lettered] = -1, 0
    return [profiles.langs[k] if k >= 0 else UNKNOWN for k in langs], score


def learn(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Profiles:
    """Profiles of all languages. Only ids and lengths are ranked, and PER_LANG and CHARS bound the texts of a language."""
    rows = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "chars", "hash")
    first = rows.select("id", "lang", F.length("text").alias("chars"), F.xxhash64("text").alias("hash")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PER_LANG)
    run = F.sum("chars").over(Window.partitionBy("lang").orderBy("k"))
    keys = settle(first.withColumn("run", run).filter((F.col("run") <= CHARS) | (F.col("k") == 1)).select("id", "lang", "hash").distinct())
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")
    texts = rows.withColumn("hash", F.xxhash64("text")).join(small, ["id", "lang", "hash"], "left_semi").dropDuplicates(["id", "lang", "hash"])
    sample = settle(texts.select("lang", "text"))
    letters = sample.mapInArrow(_letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(ALPHABET)
    alphabet = alphabet_of([r.point for r in letters.collect()])
    sent = docs.sparkSession.sparkContext.broadcast(alphabet)  # 1.1 MB of codes
    grams = sample.mapInArrow(_grams(sent), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[int]] = {}
    for r in grams.withColumn("k", rank).filter(F.col("k") <= PROFILE_GRAMS).select("lang", "gram", "k").orderBy("lang", "k").collect():  # PROFILE_GRAMS a language
        lists.setdefault(r.lang, []).append(r.gram)
    return profiles_of(alphabet, {lang: np.array(x, np.int64) for lang, x in lists.items()})


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text", 1_000_000):
            points, n = letter_counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n.astype(np.int64))], ["point", "n"])


def _grams(alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1_000_000):
                text, gram, n = counted_grams(b.column("text").to_pylist(), alphabet.value)
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(text)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def language_id(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns of docs with the prediction and its score; docs must not have columns of these two names."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # 1.1 MB of codes, and PROFILE_GRAMS grams a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text_col, 1_000_000):
                langs, score = predict([t or "" for t in b.column(text_col).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, pred_col, score_col])

    schema = StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of a table of documents."""
    profiles = learn(docs, ~held_out(F.col("doc_id")))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return language_id(narrow, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3_language_id over the whole of documents. Fitted ranks are not expressible in SQL; tests measure held-out accuracy."""
    return identify(table(spark, sf_dir, "documents"))
