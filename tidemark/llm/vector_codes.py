"""Vector code compression: a product codebook learnt by Lloyd rounds with Hamerly's bounds.

Components become the integers floor(SCALE * x), and a vector is cut into PARTS equal consecutive parts, each with a codebook
of its own. A row keeps, for each part, its entry, one upper bound on the distance to it and one lower bound on the distance
to the second nearest entry. After the entries have moved, both bounds are widened by the moves; a part is scanned in full
only where the upper bound is not strictly below the lower one (or below half the way to the entry's nearest neighbour),
first with the bound as it stands and then with the exact distance in its place. Bounds are rounded outwards and distances
are exact integers, so a part keeps its entry only where no other is as near, and ties go to the lower index as in a full scan.

Each round is one pass over the rows, which are settled with their bounds, and one aggregation of sums that every task has
already added up by part and entry. The driver holds the codebooks alone: ENTRIES vectors for each dimension of the table.

Rows: a vector that is null, empty, or holds null or non-finite components is dropped, as is one whose length is no multiple
of PARTS. Vectors of several dimensions have codebooks of their own. A codebook starts with the rows of the smallest ids
(null ids last, equal ids by their vectors), and has fewer entries where there are fewer rows. Rows are coded each by itself,
whether or not others have their id. Components up to 10**30 are coded exactly, larger ones end the query with an overflow; an
error beyond 64 bits is given as the largest long. Null labels are one label. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, settle, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Sums over labels are broadcast up to this many labels and joined by a salted sort beyond.
MOST_LABELS, SALTS = 10_000, 32
LARGEST = 2**63 - 1
Books = dict[int, np.ndarray]


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as doubles where all squared distances stay exact in them, else as Python's integers."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    most = float(np.abs(x).max(initial=0))
    if most > 1e30:
        raise OverflowError(f"a component of {most / SCALE:g} is too large to be coded")
    return x if most < 2**23 else np.array([int(y) for y in x.ravel()], object).reshape(x.shape)


def _exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if their squared distances are exact in them."""
    if x.dtype == object or c.dtype == object or 16 * x.shape[-1] * max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 >= 2**53:
        return x.astype(object) if x.dtype == object else _whole(x), c.astype(object) if c.dtype == object else _whole(c)
    return x, c


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(y) for y in x.ravel()], object).reshape(x.shape)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots in single precision, rounded outwards."""
    wide = np.sqrt(squares.astype(np.float64))
    away = np.float32(np.inf if up else -np.inf)
    return np.nextafter(np.nextafter(wide.astype(np.float32), away), away)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lowest index of a tie), its upper bound, and the lower bound of the second nearest."""
    x, c = _exact(x, c)
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    at, rows = square.argmin(axis=1), np.arange(len(x))
    best = square[rows, at].copy()
    if len(c) == 1:
        return at, _root(best, True), np.full(len(x), np.inf, np.float32)
    square[rows, at] = square.max() + 1
    return at, _root(best, True), _root(square.min(axis=1), False)


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of a part: how far it moved, the largest move of any other, half the way to its nearest neighbour."""
    a, b = _exact(new, old)
    away = _root(((a - b) ** 2).sum(axis=1), True)
    others = np.array([max((m for j, m in enumerate(away) if j != i), default=0) for i in range(len(away))], np.float32)
    between = ((a[:, None] - a[None]) ** 2).sum(axis=2).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    return away, others, np.nextafter(_root(between.min(axis=1), False) / 2, np.float32(-np.inf))


def reassign(x: np.ndarray, c: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """Update entries and bounds of one part in place after its codebook has moved; how many rows were scanned in full."""
    away, others, half = moves
    upper[:] = np.nextafter(upper + away[at], np.float32(np.inf))
    lower[:] = np.nextafter(lower - others[at], np.float32(-np.inf))
    floor = np.maximum(lower, half[at])
    unsure = np.flatnonzero(~(upper < floor))
    if len(unsure):
        near, entry = _exact(x[unsure], c)
        upper[unsure] = _root(((near - entry[at[unsure]]) ** 2).sum(axis=1), True)
        unsure = unsure[~(upper[unsure] < floor[unsure])]
    if len(unsure):
        at[unsure], upper[unsure], lower[unsure] = scan(x[unsure], c)
    return len(unsure)


def _state(held: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(held.to_pylist()), kind).reshape(n, PARTS).copy()


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = batch.column("d").to_numpy()
    for d in np.unique(sizes).tolist():
        b = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
        yield d, b, integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, PARTS, d // PARTS))


def _assign(books: Books, before: Books | None, last: bool):
    """Entries and bounds of all rows for `books`; `before` has those that the bounds are for. At last, codes and errors."""
    moves = {d: [moved(before[d][p], books[d][p]) for p in range(PARTS)] for d in books} if before else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b, x in _by_dimension(batch):
                if before:
                    at, upper, lower = _state(b.column("at"), np.uint8, len(x)).astype(np.int64), _state(b.column("upper"), np.float32, len(x)), _state(b.column("lower"), np.float32, len(x))
                    for p in range(PARTS):
                        mine = at[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                        reassign(x[:, p], books[d][p], *mine, moves[d][p])
                        at[:, p], upper[:, p], lower[:, p] = mine
                else:
                    at, upper, lower = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), np.float32), np.zeros((len(x), PARTS), np.float32)
                    for p in range(PARTS):
                        at[:, p], upper[:, p], lower[:, p] = scan(x[:, p], books[d][p])
                codes = at.astype(np.uint8)
                if last:
                    error = np.zeros(len(x), np.int64)
                    for p in range(PARTS):
                        near, entry = _exact(x[:, p], books[d][p])
                        square = ((near - entry[at[:, p]]) ** 2).sum(axis=1)
                        error = error + (square if square.dtype == object else square.astype(np.int64))
                    found = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(e, LARGEST) for e in error.tolist()], pa.int64())]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("d"), *found], ["id", "label", "d", "code", "error"])
                else:
                    held = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, upper, lower)]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("d"), b.column("v"), *held], ["id", "label", "d", "v", "at", "upper", "lower"])

    return run


def _sums(shape: dict[int, tuple[int, int, int]]):
    """What a task's rows add up to, by part, entry and position within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, b, x in _by_dimension(batch):
                parts, entries, width = shape[d]
                counts, sums = held.setdefault(d, (np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)))
                cell = (_state(b.column("at"), np.uint8, len(x)).astype(np.int64) + np.arange(parts) * entries).ravel()
                counts += np.bincount(cell, minlength=len(counts))
                flat = x.reshape(-1, width)
                if x.dtype == object:
                    np.add.at(sums, cell, flat)
                else:
                    for i in range(width):
                        part = np.zeros(len(counts), np.int64)
                        np.add.at(part, cell, flat[:, i].astype(np.int64))
                        sums[:, i] += part.astype(object)
        for d, (counts, sums) in held.items():
            _, entries, width = shape[d]
            used = np.flatnonzero(counts)
            n = len(used) * width
            cells = np.repeat(used, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, d, np.int32)), pa.array(cells // entries), pa.array(cells % entries), pa.array(np.tile(np.arange(width), len(used))), pa.array(np.repeat(counts[used], width)), pa.array([Decimal(int(s)) for s in sums[used].ravel()], pa.decimal128(38, 0))],
                ["d", "part", "entry", "place", "n", "total"],
            )

    return run


def _replaced(books: Books, state: DataFrame) -> Books:
    """Each used entry by the floored mean of its parts; unused ones stay. Counts and sums are PARTS * ENTRIES * width numbers."""
    added = state.select("d", "v", "at").mapInArrow(_sums({d: b.shape for d, b in books.items()}), "d int, part long, entry long, place long, n long, total decimal(38,0)")
    out = {d: b.astype(object) for d, b in books.items()}
    for r in added.groupBy("d", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toLocalIterator():
        out[r.d][r.part, r.entry, r.place] = int(r.total) // r.n
    return {d: _narrow(b) for d, b in out.items()}


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.float64) if all(abs(y) < 2**50 for y in book.ravel()) else book


def encode(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, Books]:
    """(id, label, d, code, error) of every sound vector, settled, and the codebooks by dimension: (part, entry, position)."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.size(vector_col).alias("d"), F.col(vector_col).cast(kind).alias("v")).filter(f"v is not null and d > 0 and d % {PARTS} = 0")
    rows = given.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = F.row_number().over(Window.partitionBy("d").orderBy(F.asc_nulls_last("id"), "v"))
    starts = rows.select("d", "id", "v").withColumn("n", first).filter(F.col("n") <= ENTRIES)
    chosen: dict[int, list] = {}
    for r in starts.select("d", "n", "v").collect():
        chosen.setdefault(r.d, []).append((r.n, r.v))
    books = {d: _narrow(integers(np.array([v for _, v in sorted(c, key=lambda r: r[0])], np.float64)).reshape(len(c), PARTS, -1).transpose(1, 0, 2)) for d, c in chosen.items()}
    kept = f"id long, label {rows.schema['label'].dataType.simpleString()}, d int"
    state, before = rows, None
    for _ in range(rounds):
        state = settle(state.mapInArrow(_assign(books, before, last=False), f"{kept}, v {kind}, at binary, upper binary, lower binary"))
        release(vectors.sparkSession)
        before, books = books, _replaced(books, state)
    coded = settle(state.mapInArrow(_assign(books, before, last=True), f"{kept}, code string, error long"))
    return coded, books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(y)) for y in book.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The errors summed over equal labels, nulls together. Few labels are broadcast; a hot label of many is salted."""
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error"))
    keys = F.col("label").eqNullSafe(F.col("same"))
    named = total.withColumnRenamed("label", "same")
    if named.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        return coded.join(F.broadcast(named), keys, "left").drop("same")
    spread = named.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, keys & (F.col("salt") == F.col("salted")), "left").drop("same", "salt", "salted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_vector_codes over the whole of embeddings."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digests = spark.createDataFrame([(d, digest(b)) for d, b in books.items()], "d int, codebooks_sha256 string")
    return with_label_error(coded).join(F.broadcast(digests), "d").select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Assignments and means as CTEs, one of each for a round."""
    near = "arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN b{r} b USING (part))")
        steps.append(f"a{r} AS (SELECT vec_id, part, {near} FROM d{r} GROUP BY vec_id, part)")
        if r < ROUNDS:
            mean = f"SELECT part, entry, i, floor(sum(p.x[i])::DECIMAL(38,0) / count(*))::BIGINT AS y FROM a{r} JOIN p USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY part, entry, i"
            steps.append(f"m{r} AS (SELECT part, entry, list(y ORDER BY i) AS x FROM ({mean}) GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k),
b0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id) WHERE entry < {ENTRIES}),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), s
"""


ORACLE_SQL = _oracle()
