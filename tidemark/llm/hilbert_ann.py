"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are grouped by their dimension and by bands of norms, each about twice as wide as the last. Inside a group each of
CURVES orderings projects the directions of the vectors on AXES random directions, shifts them, and takes the place of the
cell on a Hilbert curve of that many axes as the key. Spark sorts each ordering by range into BLOCKS windows of keys. The
largest inner product is asked for, which long vectors at a wide angle may have as well as short ones nearby; so a query is
sent to every band of its dimension, to the windows that lie within REACH of the place that its direction has there, and is
compared with every vector of them in double precision. The best of all bands, windows and orderings are merged.

Windows are shares of a group, not numbers of rows: vectors without structure, such as independent directions in 64
dimensions, have neighbours that no projection tells from others, and a fixed recall then costs a fixed share of all
comparisons. With REACH lowered the work falls, and recall with it. Bands do not add comparisons, but copies of the queries,
which are shuffled once for each. A window is compared in tiles of about TILE_VECTORS vectors and TILE_QUERIES queries, so
no task grows with the table.

Of equal vectors only as many can be answers as are asked for, those of the smallest ids, and one more for the query itself;
the rest need not be compared, so copies of a hot vector take no room. Keys that many vectors share otherwise are told apart
by the row, in each ordering differently, so windows stay even. Queries are all rows whose id is divisible by QUERY_EVERY. Null, zero or non-finite vectors take no part, nor do rows
without an id; vectors of several dimensions are searched each among their own. Rows are judged each by itself, whether or
not others have their id: a repeated row is a candidate for its twin, and each row that asks has its own ranks. Ties go to
the smaller id. Products that overflow are infinite and rank first or last. Empty tables give an empty result. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table

CURVES, AXES, BITS, BLOCKS, REACH, NEAREST, QUERY_EVERY, SEED = 4, 6, 8, 24, 6, 20, 20, 11
ROWS, TILE_VECTORS, TILE_QUERIES = 2_000, 50_000, 4_000
#: Groups of one dimension and band are listed in a broadcast table up to this many, and joined by sorting beyond.
MOST_GROUPS = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (axes of 0 .. 2**bits - 1), by Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[axes - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _keys(curves: int, seed: int):
    """Each row once for every ordering, with its key there."""
    planes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def drawn(dimension: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if dimension not in planes:
            rng = np.random.Generator(np.random.PCG64([seed, dimension]))
            axes = min(AXES, dimension)
            planes[dimension] = [(np.linalg.qr(rng.normal(size=(dimension, axes)))[0], rng.uniform(0, 1, axes)) for _ in range(curves)]
        return planes[dimension]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in batches:
            sizes = mixed.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                b = mixed if (sizes == d).all() else mixed.filter(pa.array(sizes == d))
                v = _matrix(b.column("v"))
                v = v / np.abs(v).max(axis=1)[:, None]
                v /= np.sqrt((v * v).sum(axis=1))[:, None]
                for c, (plane, shift) in enumerate(drawn(d)):
                    #: Projections of directions lie within 1; with a shift of up to a fifth of the range they stay inside the cells.
                    scaled = ((v @ plane) / 1.5 + 1) / 2 * 0.8 + 0.2 * shift
                    cells = np.clip((scaled * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), c, np.int32)), pa.array(hilbert_keys(cells, BITS))], [*b.schema.names, "curve", "key"])

    return run


def compare(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """The best of one tile for each of its queries; queries come first, vectors then in blocks of ROWS.

    Products are summed in one fixed order, so equal vectors have equal scores wherever they stand. Places without an
    answer bear no row; infinite products are answers like others, and one that overflows to both sides counts as -inf.
    """
    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q_rows = best = None
    none = np.iinfo(np.int64).max
    for b in batches:
        asks, rows, ids, v = b.column("asks").to_numpy(zero_copy_only=False), b.column("row").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("v"))
        if asks.any():
            asked.append((rows[asks], ids[asks], v[asks]))
        rows, ids, v = rows[~asks], ids[~asks], v[~asks]
        if not asked or not len(ids):
            continue
        if q_rows is None:
            q_rows, q_ids, q = (np.concatenate(x) for x in zip(*asked, strict=True))
            shape = len(q_rows), nearest
            best = np.full(shape, -np.inf), np.full(shape, none), np.full(shape, none)
        for s in range(0, len(ids), ROWS):
            part = rows[s : s + ROWS], ids[s : s + ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.einsum("qd,vd->qv", q, v[s : s + ROWS])
            own = q_rows[:, None] == part[0][None, :]
            scores[own | np.isnan(scores)] = -np.inf
            all_scores = np.concatenate([best[0], scores], axis=1)
            all_ids = np.concatenate([best[1], np.broadcast_to(part[1], scores.shape)], axis=1)
            all_rows = np.concatenate([best[2], np.where(own, none, part[0][None, :])], axis=1)
            #: Only what reaches the score of the last place can enter; ties with it go by id.
            last = -np.partition(-all_scores, nearest - 1, axis=1)[:, nearest - 1]
            y, x = np.nonzero(all_scores >= last[:, None])
            order = np.lexsort((all_rows[y, x], all_ids[y, x], all_rows[y, x] == none, -all_scores[y, x], y))
            y, x = y[order], x[order]
            place = np.arange(len(y)) - np.searchsorted(y, y)
            y, x, place = (n[place < nearest] for n in (y, x, place))
            kept = all_scores[y, x], all_ids[y, x], all_rows[y, x]
            for old, new in zip(best, kept, strict=True):
                old[y, place] = new
    if best is not None:
        real = best[2] != none
        count = real.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q_rows, count), np.repeat(q_ids, count), best[2][real], best[1][real], best[0][real])], FOUND)


FOUND = ["q_row", "query_id", "v_row", "vec_id", "near"]


def nearest(vectors: DataFrame, queries, nearest: int = NEAREST, curves: int = CURVES, blocks: int = BLOCKS, reach: int = REACH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found; `queries` says of an id column which rows ask."""
    value = F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    sound = given.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    #: Norms by their logarithm, from components divided by the largest: squares of tiny and huge ones stay in range.
    scaled = sound.withColumn("big", F.array_max(F.transform("v", F.abs)))
    norm = F.log2("big") + F.log2(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("big")) * (x / F.col("big")))) / 2
    rows = settle(scaled.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("d"), F.floor(norm + 0.5).cast("int").alias("band"), F.coalesce(queries(F.col("id")), F.lit(False)).alias("asks")))
    keyed = lambda some: some.mapInArrow(_keys(curves, SEED), f"{_ddl(some)}, curve int, key long")
    alike = F.row_number().over(Window.partitionBy("d", "v").orderBy("id", "row"))
    judged = settle(rows.withColumn("n", alike).filter(F.col("n") <= nearest + 1).drop("n"))
    asked = rows.filter("asks").groupBy("d").agg(F.count("*").alias("asked"))
    groups = settle(_groups(keyed(judged), asked, blocks, reach, nearest))
    listed = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    placed = keyed(judged).join(listed, ["d", "band", "curve"]).withColumn("block", _block())
    all_ = placed.withColumn("v_tile", dealt("v_tiles")).withColumn("q_tile", every("q_tiles")).withColumn("asks", F.lit(False))
    met = keyed(rows.filter("asks")).drop("band").join(listed, ["d", "curve"]).withColumn("block", _block())
    near = F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.col("blocks") - 1))
    asking = met.withColumn("block", F.explode(near)).withColumn("q_tile", dealt("q_tiles")).withColumn("v_tile", every("v_tiles"))
    tile = F.concat_ws("/", "d", "band", "curve", "block", "v_tile", "q_tile").alias("tile")
    both = asking.select(tile, "asks", "row", "id", "v").unionByName(all_.select(tile, "asks", "row", "id", "v"))
    found = both.repartition("tile").sortWithinPartitions("tile", F.desc("asks")).mapInArrow(_by_tile(nearest), "q_row long, query_id long, v_row long, vec_id long, near double")
    unique = found.groupBy(FOUND[:-1]).agg(F.max("near").alias("near"))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("near"), "vec_id", "v_row"))
    return unique.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _groups(keyed: DataFrame, asked: DataFrame, blocks: int, reach: int, nearest: int) -> DataFrame:
    """One row for each dimension, band and ordering: bounds of windows, how many there are, and tiles of a window.

    Groups of few rows have few windows; those of fewer rows than two answers only one, for which one ordering is enough.
    """
    shares = [k / blocks for k in range(1, blocks)] or [0.5]
    seen = keyed.groupBy("d", "band", "curve").agg(F.percentile_approx("key", shares, 10_000).alias("bounds"), F.count("*").alias("n"))
    up = lambda x, y: F.greatest(F.ceil(x / y), F.lit(1)).cast("int")
    windows = F.greatest(F.least(F.lit(blocks), F.floor(F.col("n") / nearest)), F.lit(1)).cast("int")
    sized = seen.join(asked, "d").withColumn("blocks", windows).filter("blocks > 1 or curve = 0")
    met = F.least(F.col("blocks"), F.lit(2 * reach + 1))
    return sized.select("d", "band", "curve", "bounds", "blocks", F.lit(max(blocks, 2)).alias("cuts"), up(F.col("n"), F.col("blocks") * TILE_VECTORS).alias("v_tiles"), up(F.col("asked") * met, F.col("blocks") * TILE_QUERIES).alias("q_tiles"))


def _block():
    """The window of a row among those of about equal size of a group in one ordering.

    Bounds are quantiles of the keys; rows of one key are spread over the windows between its first and last by the row
    and the ordering, so a key that many copies share fills several windows evenly, and copies that are out of each other's
    reach in one ordering are within it in others.
    """
    below = F.size(F.filter("bounds", lambda b: b < F.col("key")))
    same = F.size(F.filter("bounds", lambda b: b == F.col("key")))
    cut = below + F.pmod(F.xxhash64("row", "curve"), same + 1)
    return F.floor(cut * F.col("blocks") / F.col("cuts")).cast("int")


def _by_tile(nearest: int):
    """Tiles come one after the other in a sorted partition; the queries of each come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[str, pa.RecordBatch]]:
            for b in batches:
                names = np.array(b.column("tile").to_pylist(), object)
                if len(names):
                    cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                    yield from ((names[a], b.slice(a, e - a)) for a, e in zip(cut[:-1], cut[1:], strict=True))

        for _, group in groupby(parts(), key=lambda x: x[0]):
            yield from compare((b for _, b in group), nearest)

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op1_hilbert_ann over the whole of embeddings. Approximate, so without SQL; tests measure recall against brute force."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0)
