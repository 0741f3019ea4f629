"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative per group.

Centroids come from a sample of SAMPLE vectors, those of the smallest hashes: seeds are its densest vectors, at least as far
from each other as the linking angle, so a hot group has one cell; a few rounds of spherical k-means follow. They only say
where work is done. No link is lost at a cell's border: if two linked vectors have different cells, each lies within the linking
angle of the great circle between the two centroids, so a vector also visits every cell of lower number that it may have a
link in. As many cells are used as keep visits to VISITS a vector on the sample, since vectors without structure are near to all
borders; these few cells then mean about as many products as comparing all pairs once.

Vectors within half the linking angle of their centroid, the core, are linked with each other by the triangle inequality.
They are counted instead of compared and are one node of the graph, so groups of any number of near copies cost no pairs.
Others meet their cell in tiles. A cell's vectors are cut by their angle to the centroid into blocks of about HOME rows, and
a visitor, or a member outside the core, is sent only to blocks with angles within the linking angle of its own; those that meet
a block are dealt over tiles of about PROBES rows. A tile gives counts and a spanning forest, never pairs. Products are
single-precision matrix products; what they leave within a margin of the threshold is decided in double precision.

Rows: null, zero and non-finite vectors, empty ones, and ones holding nulls link with nothing: they are their own component. Vectors of
several dimensions link only among their own. Rows are judged each by itself, whether or not others have their id; a
component's id is its smallest one (null only if it has no other). An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, release, settle, table

COSINE, SAMPLE, CELLS, LLOYD, VISITS, HOME, PROBES = 0.95, 8_192, 256, 4, 1.5, 16_384, 65_536
#: Angles and products are compared with this to spare; single-precision products need more, by dimension.
SPARE, STEP = 1e-7, 1_024


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, from components divided by the largest, so that squares stay in range."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def borders(x: np.ndarray, home: np.ndarray, centroids: np.ndarray, theta: float) -> np.ndarray:
    """Rows by cells: whether a row may have a link in that cell, of lower number than its own."""
    near = x @ centroids.T
    own = near[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    reach = math.sin(theta) * apart[home] + SPARE
    return (own[:, None] - near <= reach) & (np.arange(len(centroids))[None] < home[:, None])


def fit_cells(sample: np.ndarray, theta: float) -> np.ndarray:
    """Centroids from unit vectors; as many, by halves, as keep visits within VISITS."""
    near = np.concatenate([(sample[s : s + STEP] @ sample.T >= math.cos(theta / 2)).sum(axis=1) for s in range(0, len(sample), STEP)])
    seeds: list[int] = []
    for i in np.argsort(-near, kind="stable").tolist():
        if not seeds or (sample[seeds] @ sample[i]).max() < math.cos(theta):
            seeds.append(i)
        if len(seeds) == CELLS:
            break
    k = len(seeds)
    while True:
        centroids = sample[seeds[:k]].copy()
        for _ in range(LLOYD):
            home = (sample @ centroids.T).argmax(axis=1)
            total = np.zeros_like(centroids)
            np.add.at(total, home, sample)
            size = np.sqrt((total * total).sum(axis=1))
            centroids = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centroids)
        home = (sample @ centroids.T).argmax(axis=1)
        if k == 1 or borders(sample, home, centroids, theta).sum() <= VISITS * len(sample):
            return centroids
        k = (k + 1) // 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _place(cells: dict[int, np.ndarray], theta: float):
    """Each row's cell, its angle to the centroid, whether it is of the core, and the lower cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                b = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
                x, centroids = unit(_matrix(b.column("v"))), cells[d]
                near = x @ centroids.T
                home = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), home], -1, 1))
                who, cell = np.nonzero(borders(x, home, centroids, theta))
                core = angle <= theta / 2 - SPARE
                #: The cells that a row asks, each with its angle there: its own, unless it is of the core, and those it visits.
                asks = np.concatenate([np.flatnonzero(~core), who]), np.concatenate([home[~core], cell]), np.concatenate([angle[~core], np.arccos(np.clip(near[who, cell], -1, 1))])
                order = np.argsort(asks[0], kind="stable")
                offsets = pa.array(np.searchsorted(asks[0][order], np.arange(len(x) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (asks[1][order].astype(np.int32), asks[2][order])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(angle), pa.array(core), *lists], [*b.schema.names, "home", "angle", "core", "asked", "at"])

    return run


def _compare(cosine: float):
    """Tiles come one after the other in a sorted partition, the home rows of each first. Rows (row, node, other, n): n links
    found for a row, or a link between two nodes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for b in batches:
            names = np.array(b.column("tile").to_pylist(), object)
            if len(names):
                cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                yield from ((names[a], b.slice(a, e - a)) for a, e in zip(cut[:-1], cut[1:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(parts(batches), key=lambda x: x[0]):
            yield from tile((b for _, b in group), cosine)

    return run


def _links(p: np.ndarray, h: np.ndarray, p_narrow: np.ndarray, h_narrow: np.ndarray, cosine: float) -> np.ndarray:
    margin = max(1e-4, p.shape[1] * 2e-7)
    s = p_narrow @ h_narrow.T
    linked = s >= cosine + margin
    y, x = np.nonzero((s >= cosine - margin) & ~linked)
    for a in range(0, len(y), 65_536):
        some = slice(a, a + 65_536)
        linked[y[some], x[some]] = np.einsum("ij,ij->i", p[y[some]], h[x[some]]) >= cosine
    return linked


def tile(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    names = ["row", "node", "core", "kind"]
    homes: list[tuple] = []
    h = None
    for b in batches:
        row, node, core, kind = (b.column(n).to_numpy(zero_copy_only=False) for n in names)
        v = unit(_matrix(b.column("v")))
        at_home = kind == 0
        if at_home.any():
            homes.append((row[at_home], node[at_home], core[at_home], v[at_home]))
        row, node, kind, v = (x[~at_home] for x in (row, node, kind, v))
        if not len(row) or not homes:
            continue
        if h is None:
            h_row, h_node, h_core, h = (np.concatenate(x) for x in zip(*homes, strict=True))
            h_narrow, h_count, group = h.astype(np.float32), np.zeros(len(h), np.int64), np.arange(len(h))
        for s in range(0, len(row), STEP):
            some = slice(s, s + STEP)
            p_row, p_node, p_kind, p = row[some], node[some], kind[some], v[some]
            linked = _links(p, h, p.astype(np.float32), h_narrow, cosine)
            if (p_kind == 1).any():
                linked &= p_row[:, None] != h_row[None, :]
            found = linked.sum(axis=1)
            met = np.flatnonzero(found)
            if not len(met):
                continue
            yield _counts(p_row[met], found[met])
            #: Members outside the core that share the block ask for themselves (kind 1); all others count for both sides.
            both = linked[p_kind > 1].sum(axis=0) + np.where(h_core, linked[p_kind == 1].sum(axis=0), 0)
            h_count += both
            first = linked[met].argmax(axis=1)
            yield _edges(p_node[met], h_node[first])
            for r in met.tolist():
                seen = np.unique(group[linked[r]])
                if len(seen) > 1:
                    group[np.isin(group, seen)] = seen[0]
    if h is not None:
        met = np.flatnonzero(h_count)
        yield _counts(h_row[met], h_count[met])
        tied = np.flatnonzero(group != np.arange(len(group)))
        yield _edges(h_node[tied], h_node[group[tied]])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
    none = pa.nulls(pairs.shape[1], pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(pairs[0]), pa.array(pairs[1]), none], ["row", "a", "b", "n"])


def _counts(row: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row), none, none, pa.array(n.astype(np.int64))], ["row", "a", "b", "n"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (its id is that of its component), representative (one row of each)."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and 1 at most")
    spark, theta = vectors.sparkSession, math.acos(cosine)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    given = settle(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")))
    sound = given.filter("v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).select("row", F.size("v").alias("d"), "v")
    placed = settle(sound.mapInArrow(_place(_cells(sound, theta), theta), f"row long, d int, v {kind}, home int, angle double, core boolean, asked array<int>, at array<double>"))
    ids = settle(given.select("row", "id"))
    del given, sound  # their vectors stand in placed
    release(spark)
    groups = settle(_groups(placed))
    leaders = F.broadcast(groups.filter("core_size > 0").select("d", F.col("cell").alias("home"), "leader", "core_size"))
    found = settle(_tiles(placed, groups, theta).mapInArrow(_compare(cosine), "row long, a long, b long, n long"))
    members = placed.join(leaders, ["d", "home"], "left").select("row", F.when(F.col("core"), F.col("leader")).otherwise(F.col("row")).alias("node"), F.when(F.col("core"), F.col("core_size") - 1).otherwise(0).alias("sure"))
    nodes = connected_components(found.filter("a is not null").select("a", "b"))
    release(spark)
    counts = found.filter("n is not null").groupBy("row").agg(F.sum("n").alias("n"))
    lead = lambda c: F.crc32(F.col(c).cast("string").cast("binary")).alias("lead")  # noqa: E731  lets adaptive execution split a hot node
    named = members.select("*", lead("node")).join(nodes.select("node", lead("node"), "component"), ["node", "lead"], "left").select("row", "sure", F.coalesce("component", "node").alias("component"))
    judged = settle(ids.join(named, "row", "left").join(counts, "row", "left").select("row", "id", F.coalesce("component", "row").alias("component"), (F.coalesce("sure", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links")))
    #: Aggregates of longs stay in hash tables with map-side sums; the row of a component's smallest id comes in a second one.
    least = judged.groupBy("component").agg(F.min("id").alias("component_id"))
    ids = judged.select("*", lead("component")).join(least.select("component", lead("component"), "component_id"), ["component", "lead"])
    first = ids.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("stays"))
    shown = ids.join(first.select(F.col("stays").alias("row"), F.lit(True).alias("stays")), "row", "left")
    return shown.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("stays", F.lit(False)).alias("representative"))


def _cells(sound: DataFrame, theta: float) -> dict[int, np.ndarray]:
    """Centroids by dimension, from SAMPLE rows of each at most. Only about twice as many leave the tasks that read them."""
    sizes = F.broadcast(sound.groupBy("d").agg(F.count("*").alias("of")))  # a row for each dimension
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    some = sound.join(sizes, "d").filter(share * F.col("of") <= 2 * SAMPLE).select("d", "row", "v")
    order = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("row"), "row"))
    chosen: dict[int, list] = {}
    for r in some.withColumn("n", order).filter(F.col("n") <= SAMPLE).select("d", "v").toLocalIterator():
        chosen.setdefault(r.d, []).append(np.array(r.v, np.float64))
    return {d: fit_cells(unit(np.stack(x)), theta) for d, x in chosen.items()}


def _groups(placed: DataFrame) -> DataFrame:
    """One row for each cell: rows, core, bounds between blocks of about HOME rows by angle, and tiles of about PROBES rows."""
    cuts = 256
    homes = placed.groupBy("d", F.col("home").alias("cell")).agg(
        F.count("*").alias("n"), F.count_if("core").alias("core_size"), F.min(F.when(F.col("core"), F.col("row"))).alias("leader"),
        F.percentile_approx("angle", [k / cuts for k in range(1, cuts)], 10_000).alias("bounds"))
    asks = placed.select("d", F.explode("asked").alias("cell")).groupBy("d", "cell").agg(F.count("*").alias("asked"))
    up = lambda x, y: F.greatest(F.ceil(F.coalesce(x, F.lit(0)) / y), F.lit(1)).cast("int")
    return homes.join(asks, ["d", "cell"], "left").withColumn("blocks", up("n", HOME)).withColumn("tiles", up("asked", PROBES)).withColumn("cuts", F.lit(cuts))


def _tiles(placed: DataFrame, groups: DataFrame, theta: float) -> DataFrame:
    """Home rows once for each tile of their block, and the rows that ask once for each block with angles within theta."""
    listed = F.broadcast(groups.drop("leader", "core_size"))
    place = lambda cut: F.floor(cut * F.col("blocks") / F.col("cuts")).cast("int")
    below = lambda a: F.size(F.filter("bounds", lambda b: b < a))
    upto = lambda a: F.size(F.filter("bounds", lambda b: b <= a))
    angle, reach = F.col("angle"), theta + SPARE
    #: Rows of one angle are dealt by their hash over the blocks between its first and its last place.
    own = place(below(angle) + F.pmod(F.xxhash64("row"), upto(angle) - below(angle) + 1))
    node = F.when(F.col("core"), F.col("leader")).otherwise(F.col("row")).alias("node")
    leaders = F.broadcast(groups.select("d", F.col("cell").alias("home"), "leader"))
    rows = placed.join(leaders, ["d", "home"], "left").select("d", "home", "row", node, "core", "angle", "asked", "at", "v")
    homes = rows.withColumn("cell", F.col("home")).join(listed, ["d", "cell"]).withColumn("block", own).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("kind", F.lit(0))
    asks = rows.withColumn("ask", F.explode(F.arrays_zip("asked", "at"))).drop("asked").withColumn("cell", F.col("ask.asked")).withColumn("there", F.col("ask.at"))
    probes = asks.join(listed, ["d", "cell"]).withColumn("own", F.when(F.col("cell") == F.col("home"), own))
    #: A member asks the blocks up to its own, where the others of that block ask it as well.
    last = F.coalesce("own", place(upto(F.col("there") + reach)))
    asking = probes.withColumn("block", F.explode(F.sequence(place(below(F.col("there") - reach)), last))).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    asking = asking.withColumn("kind", F.when(F.col("block") == F.col("own"), 1).otherwise(2))
    picked = ["row", "node", "core", "kind", "v"]
    name = F.concat_ws("/", "d", "cell", "block", "tile").alias("tile")
    both = homes.select(name, *picked).unionByName(asking.select(name, *picked))
    return both.repartition("tile").sortWithinPartitions("tile", "kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_embedding_cells over the whole of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

