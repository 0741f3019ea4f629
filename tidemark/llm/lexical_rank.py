"""Ranked lexical search as a blocked sparse matrix product.

The items are a sparse matrix of term multiplicities, the documents one of integer impacts (terms x documents), and the
scores are their product. One pass over the texts makes the rows of documents: how many terms each has, and the number and
count of those terms that some item has. From these come the statistics, over all documents: N, L and df, added up by task
and then by term. Then every task takes its documents in blocks, sorts their impacts by term, and for each item merges the
rows of its terms (Gustavson) in one dense accumulator over the block's documents. It keeps the best of each item, which meet in
two levels of ranking, by item and share of the tasks and then by item.

Items are a stated set that meets all documents in blocks of ITEM_PAIRS pairs of item and term at most (one item at least):
the terms of one block are sent to all tasks, and every block is one pass over the texts.

Terms are the maximal runs of digits, letters and characters beyond ASCII, of which only A-Z are lower-cased; that is done on
the bytes of the UTF-8 form, where all bytes of characters beyond ASCII are parts of terms.

Rows: null and empty texts have no terms, and count neither in N nor as an answer; an item without terms has no answers. Texts of
any length are taken whole. Rows of documents and items are judged each by itself, whether or not others have their id: a
repeated item is ranked once for each row. Equal scores go to the smaller id, null ids last. Without documents the result is
empty. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

NEAREST, ITEM_PAIRS, BLOCK_DOCS, BLOCK_PAIRS, SHARES = 50, 250_000, 16_384, 2_000_000, 16
#: Bytes that end a term become spaces; A-Z become a-z.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POSTINGS = "id long, n long, terms binary, counts binary"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


@dataclass
class Items:
    """A block of items: their ids and places, and the rows of the item-term matrix as offsets, terms and multiplicities."""

    places: list[int]
    ids: list[int | None]
    offsets: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    names: dict[bytes, int]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [sorted(Counter(words(t)).items()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("id"), pa.array([[w for w, _ in r] for r in rows], pa.list_(pa.binary())), pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))], ["place", "id", "terms", "counts"])


def _item_blocks(items: DataFrame, once: bool) -> Iterator[Items]:
    """Blocks of items, read one partition at a time."""
    held, pairs = [], 0

    def made() -> Items:
        names: dict[bytes, int] = {}
        terms = [names.setdefault(bytes(w), len(names)) for r in held for w in r.terms]
        counts = [1 if once else n for r in held for n in r.counts]
        return Items([r.place for r in held], [r.id for r in held], np.cumsum([0, *(len(r.terms) for r in held)]), np.array(terms, np.int64), np.array(counts, np.int64), names)

    for row in settle(items.mapInArrow(_item_rows, "place long, id long, terms array<binary>, counts array<long>").filter("size(terms) > 0")).toLocalIterator():
        if held and pairs + len(row.terms) > ITEM_PAIRS:
            yield made()
            held, pairs = [], 0
        held.append(row)
        pairs += len(row.terms)
    if held:
        yield made()


def _postings(names):
    """The rows of the term-document matrix, document by document, for the terms that the broadcast `names` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for b in batches:
            size, terms, counts = [], [], []
            for text in b.column("text"):
                found = words(text.as_py())
                seen = Counter(known[w] for w in found if w in known)
                size.append(len(found))
                terms.append(np.fromiter(seen.keys(), np.int32, len(seen)).tobytes())
                counts.append(np.fromiter(seen.values(), np.int32, len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["id", "n", "terms", "counts"])

    return run


def _seen(n_terms: int):
    """How many documents of a task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(_numbers(b.column("terms")), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["term", "df"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norm(n_terms: int, n_docs: int, all_terms: int) -> int:
    return 100 - 50 + (50 * n_terms * n_docs) // all_terms


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task in blocks of BLOCK_DOCS rows and about BLOCK_PAIRS pairs of document and term."""
    held, docs, pairs = [], 0, 0
    for batch in batches:
        for s in range(0, batch.num_rows, 1024):
            b = batch.slice(s, 1024)
            size = sum(len(t) for t in b.column("terms").to_pylist()) // 4
            if held and (docs + b.num_rows > BLOCK_DOCS or pairs + size > BLOCK_PAIRS):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, docs, pairs = [], 0, 0
            held.append(b)
            docs, pairs = docs + b.num_rows, pairs + size
    if docs:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best_of(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores in order; equal ones by id, null ids last."""
    places = np.arange(len(scores))
    if len(scores) > most:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return places[np.lexsort((ids[places], nulls[places], -scores[places]))][:most]


def _product(block, n_docs: int, all_terms: int, most: int):
    """The best documents of a task for each item of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, weights = block.value
        none = np.zeros(0, np.int64)
        best = [(none, none, np.zeros(0, bool)) for _ in items.ids]
        for b in _blocks(batches):
            nulls = b.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = b.column("id").fill_null(0).to_numpy()
            long = np.array([length_norm(n, n_docs, all_terms) for n in b.column("n").to_pylist()], np.int64)
            size = np.array([len(t) // 4 for t in b.column("terms").to_pylist()], np.int64)
            docs, terms, tf = np.repeat(np.arange(b.num_rows), size), _numbers(b.column("terms")), _numbers(b.column("counts")).astype(np.int64)
            order = np.argsort(terms, kind="stable")
            docs, impact = docs[order], ((1_000_000_000 * tf) // (1000 * tf + 20 * long[docs]))[order]
            starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
            scores = np.zeros(b.num_rows, np.int64)
            for i in range(len(items.ids)):
                of = items.terms[items.offsets[i] : items.offsets[i + 1]]
                factor = weights[of] * items.counts[items.offsets[i] : items.offsets[i + 1]]
                for t, f in zip(of.tolist(), factor.tolist(), strict=True):
                    at = slice(starts[t], starts[t + 1])
                    scores[docs[at]] += f * impact[at]  # a term has a document once
                met = np.flatnonzero(scores > 0)
                if len(met):
                    s, d, z = best[i]
                    if len(s) == most:
                        met = met[scores[met] >= s[-1]]
                    joined = np.concatenate([s, scores[met]]), np.concatenate([d, ids[met]]), np.concatenate([z, nulls[met]])
                    top = best_of(*joined, most)
                    best[i] = tuple(x[top] for x in joined)
                scores[:] = 0
        size = [len(s) for s, _, _ in best]
        if any(size):
            task = TaskContext.get().partitionId()
            score, ids, nulls = (np.concatenate([x[k] for x in best]) for k in range(3))
            which = np.repeat(np.arange(len(best)), size)
            columns = [pa.array(np.array(items.places)[which]), pa.array([items.ids[i] for i in which], pa.int64()), pa.array(ids, pa.int64(), mask=nulls), pa.array(score), pa.array(np.full(len(which), task % SHARES, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "item", "id", "score", "share"])

    return run


def ranked(items: DataFrame, docs: DataFrame, most: int = NEAREST, once: bool = True, item_col: str = "item_id", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc, score of the `most` highest-scoring documents of each item; once: a term of an item counts once."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = settle(items.select(F.monotonically_increasing_id().alias("place"), F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    found = []
    for block in _item_blocks(asked, once):
        rows = settle(texts.mapInArrow(_postings(spark.sparkContext.broadcast(block.names)), POSTINGS).filter("n > 0"))
        whole = rows.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        weights = np.zeros(len(block.names), np.int64)
        for r in rows.select("terms").mapInArrow(_seen(len(weights)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            weights[r.term] = weight(whole.n, r.df)
        sent = spark.sparkContext.broadcast((block, weights))
        found.append(rows.mapInArrow(_product(sent, whole.n, whole.terms or 1, most), "place long, item long, id long, score long, share int"))
    if not found:
        return spark.createDataFrame([], f"{item_col} long, rank int, {doc_col} long, score long")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    of_share = F.row_number().over(Window.partitionBy("place", "share").orderBy(*order))
    of_item = F.row_number().over(Window.partitionBy("place").orderBy(*order))
    some = reduce(DataFrame.unionByName, found).withColumn("rank", of_share).filter(F.col("rank") <= most)
    return some.withColumn("rank", of_item).filter(F.col("rank") <= most).select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_lexical_rank: all documents for each item of benchmark."""
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), whole AS (SELECT count(*)::BIGINT AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, whole GROUP BY term, n),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(words) * n) // l))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (r), whole GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50
"""
