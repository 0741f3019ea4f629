"""Exact deduplication by Grace hashing.

Texts are equal when they are identical without the characters of `[\\x20\\x09-\\x0D]`. A map task first folds its own
copies, so a text with any number of copies leaves it once (and once more each time the bounded table is emptied). The
folded records are dealt by digest; each task spreads what does not fit its memory over spill files, recursively, until a
file fits an open-addressing table, which compares complete contents. A text that is hot within a map task is dealt with a
salt, so that no task receives the records of a hot text from all map tasks; what the salts found then meets in a plain
aggregation by digest.

Rows: null text counts as empty; all texts of white space are equal to the empty one; among equal texts the one with most
code points stays, then the smallest id (null ids last), then any one of those alike in both, so one row of a class is kept
whether or not ids repeat. Texts of any length are compared whole: a table holds one
row at least, however large. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, give_back, row_key, settle

SPACE = b" \t\n\v\f\r"
MAP_BYTES, TABLE_BYTES, FAN_OUT, HOT_ROWS, SALTS = 24 << 20, 48 << 20, 16, 64, 64
FOLDED = "digest binary, salt int, content binary, n long, points long, id long"
GROUPS = "digest binary, n long, points long, id long"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def _better(points: int, id_: int | None, than_points: int, than_id: int | None) -> bool:
    if points != than_points:
        return points > than_points
    return id_ is not None and (than_id is None or id_ < than_id)


class OpenTable:
    """Open addressing with linear probing; the slots hold indexes of `rows`, and equal means equal contents."""

    def __init__(self) -> None:
        self.slots, self.rows, self.bytes = [-1] * 1024, [], 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (i := self.slots[at]) >= 0 and not (self.rows[i][0] == digest and self.rows[i][1] == content):
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, n: int, points: int, id_: int | None) -> None:
        at = self._slot(digest, content)
        if (i := self.slots[at]) >= 0:
            row = self.rows[i]
            row[2] += n
            if _better(points, id_, row[3], row[4]):
                row[3:5] = points, id_
            return
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, n, points, id_])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for i, row in enumerate(self.rows):
                self.slots[self._slot(row[0], row[1])] = i


def grace(records: Iterable[tuple], most: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """Rows [digest, content, n, points, id], one for each content; `most` bounds the bytes held in memory.

    Once the table is full, its rows and all later records are spread over files by a byte of the digest, and each file is
    taken on alone. Copies fold before they are spread, so a file shrinks even where all of its records are equal; a table
    of one content is never spread.
    """
    table = OpenTable()
    source = iter(records)
    for record in source:
        table.add(*record)
        if table.bytes > most and len(table.rows) > 1 and level < 32:
            break
    else:
        yield from table.rows
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, f"{k:02x}") for k in range(FAN_OUT)]
        files = [open(p, "wb") for p in paths]  # noqa: SIM115
        try:
            place = lambda row: pickle.dump(tuple(row), files[hashlib.blake2b(row[0], digest_size=2, salt=level.to_bytes(2, "little")).digest()[0] % FAN_OUT], 4)
            for row in table.rows:
                place(row)
            del table
            for record in source:
                place(record)
        finally:
            for f in files:
                f.close()
        for path in paths:
            yield from grace(_spilled(path), most, level + 1)
            os.remove(path)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most_bytes:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a map task: one record for each content, as far as the bounded table reaches back."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task = context.partitionId() if context else 0

    def rows() -> Iterator[tuple]:
        table = OpenTable()
        leave = lambda: [(d, 1 + task % SALTS if n >= HOT_ROWS else 0, c, n, p, i) for d, c, n, p, i in table.rows]
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = normalised(text)
                table.add(hashlib.sha256(content).digest(), content, 1, len(text or ""), id_)
                if table.bytes > MAP_BYTES:
                    yield from leave()
                    table = OpenTable()
        yield from leave()
        del table
        give_back()

    yield from _batches(rows(), ["digest", "salt", "content", "n", "points", "id"], [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records = ((r["digest"], r["content"], r["n"], r["points"], r["id"]) for b in batches for s in range(0, b.num_rows, 256) for r in b.slice(s, 256).to_pylist())
    yield from _batches(((d, n, p, i) for d, _, n, p, i in grace(records)), ["digest", "n", "points", "id"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, which comes last, becomes its digest."""
    for b in batches:
        digests = pa.array([hashlib.sha256(normalised(t)).digest() for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], digests], [*b.schema.names[:-1], "digest"])
        give_back()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keep_id, group_size) of every class of equal texts."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    met = narrow.mapInArrow(_fold, FOLDED).repartition("digest", "salt").select("digest", "content", "n", "points", "id").mapInArrow(_meet, GROUPS)
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id")).alias("best")
    return met.groupBy("digest").agg(F.sum("n").alias("group_size"), best).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Only classes of two rows or more are joined back, on their digest; where one digest holds many rows, the join is one
    that adaptive execution splits, as the other side has a single row for it.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = narrow.select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), "text").mapInArrow(_digests, "id long, points long, digest binary")
    judged = settle(_judged(measured, exact_groups(docs, id_col, text_col), "points", "keep_points").withColumn("row", F.monotonically_increasing_id()))
    #: Rows that have the length and the id that stay; of each class the first of them does.
    fit = judged.filter("group_size > 1 and kept and points = keep_points").groupBy("text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    kept = (F.col("group_size") == 1) | F.coalesce("first", F.lit(False))
    return judged.join(fit.hint("merge"), "row", "left").select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _judged(members: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    #: A second key that no aggregation has: so adaptive execution may split the rows of a hot digest.
    lead = F.crc32("digest").alias("lead")
    return members.select("*", lead).join(groups.filter("group_size > 1").select("*", lead), ["digest", "lead"], "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *more,
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one physical row of every class of equal texts: most code points, then the smallest id, then one by a hash.

    Several rows of a class can have the id that is kept. Of these the class keeps one row_key(), and of rows alike in id and
    text one; copies of a row leave a map task once.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("points"), F.col(text_col).cast("string").alias("text"))
    members = narrow.mapInArrow(_digests, "id long, row long, points long, digest binary")
    kept = _judged(members, exact_groups(docs, id_col, text_col), "row", "points").filter("kept")
    row = free_name(docs, "row")
    n = free_name(docs, "copy", row)
    stays = kept.groupBy("text_sha256").agg(F.max(F.struct("points", "row")).alias("best")).select(F.col("best.row").alias(row))
    copy = F.row_number().over(Window.partitionBy(row).orderBy(F.xxhash64(*docs.columns)))
    once = docs.withColumn(row, row_key(id_col, text_col)).withColumn(n, copy).filter(F.col(n) == 1)
    return once.join(stays.hint("merge"), row, "left_semi").select(*docs.columns)
