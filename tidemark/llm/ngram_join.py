"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its shingles: runs of SHINGLE words, of the text with A-Z lower-cased. Two sets link when
100 * intersection >= percent * union. The answer is the component of each document under these links.

Signatures: sizes are cut into bands, each WIDTH times as long as the one before (at least 100 / percent, so that partners
are in the same band or the next). A set takes part in its own band's instance, and in the next band's if a partner can be
there. Two partners of an instance whose largest size is r differ in at most k = floor(2 r (100 - percent) / (100 +
percent)) shingles. The domain of shingles is cut by their hash into n1 > k / 2 parts, and each of these into SECOND = 3.
Some part of the first level then holds one difference of two partners at most, so that they agree on two of its three
parts. Signatures enumerate those subsets: for each part of the first level and each two of its three parts, a hash of the
set's shingles there. Sets that are equal are one class from the start, and only classes are compared, so no pair of copies
is ever formed. A task hands each class on once, as far as it remembers; a signature that many of its classes have, beyond
the first HOT in SLICE of them, bears a salt, as it is shared for certain, so no task gets all rows of a hot signature.

Candidates: a bucket of a signature is never expanded into its pairs. In each of PIVOT_ROUNDS rounds a bucket offers one of
its classes as a pivot, each other class is compared with the pivot that it shares most signatures with, and linked classes
are contracted to components. What then still meets across components in a bucket is compared in full. Before that, a
sketch of 1024 parity bits, which gives a lower bound of the difference, drops most pairs that cannot link; a pair is
compared once. So every link either is tested or joins classes that are in one component already, and components are exact
(but for collisions of 64-bit hashes of shingles and of sets).

Rows: null texts and texts without words have no shingles and link with nothing: their component is their own id. A text
of fewer than SHINGLE words has one shingle, its whole sequence. Rows of equal ids share the smallest id like any others.
Long texts are read whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, give_back, release, row_key, settle, table

SHINGLE, PERCENT, WIDTH, PIVOT_ROUNDS, SKETCH_LONGS, KNOWN = 5, 80, 2.0, 2, 16, 100_000
SECOND, SLICE, HOT, SALTS, FIRST_SIGS = 3, 500, 32, 1009, 16
_MIX, _MIX2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are `[^\\x20\\x09-\\x0D]+`."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out + h[j : j + len(out)])
    return np.unique(out)


def set_hash(shingles: np.ndarray) -> int:
    """The class of equal sets, as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 1)))) if len(shingles) else 0


@dataclass(frozen=True)
class Bands:
    percent: int
    width: float

    def band(self, size: int) -> tuple[int, int, int]:
        """(number, smallest, largest size) of the band of a size."""
        number, low = 0, 1
        while True:
            high = max(low, int(low * max(self.width, 100 / self.percent)))
            if size <= high:
                return number, low, high
            number, low = number + 1, high + 1

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(number, k, most) of the instances of a set of this size; most: differences of this set from any partner there.

        With k = 0 only equal sets link, which are one class.
        """
        number, _, high = self.band(size)
        tops = [(number, high)]
        if size * 100 >= (high + 1) * self.percent:
            tops.append((number + 1, self.band(high + 1)[2]))
        share = lambda sizes: sizes * (100 - self.percent) // (100 + self.percent)
        return [(i, k, share(size + min(top, size * 100 // self.percent))) for i, top in tops if (k := share(2 * top))]


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """One for each two of the three parts of each part of the first level, but those with the fewest shingles.

    A difference spoils two of three signatures of its part, or the third too if another one is beside it, so partners agree
    on `agreed` signatures at least. A set may leave out one fewer than that, and leaves out those with fewer shingles than
    some number: of the signatures that partners agree on, the largest is left out by neither. A few parts more than are
    needed make room for this, so that empty signatures, on which sets agree by chance, hardly ever remain.
    """
    found = [np.zeros(0, np.uint64)]
    mixed = mix(shingles + np.uint64(77))
    for number, k, most in bands.instances(len(shingles)):
        firsts = (k + 2) // 2 + 1 + (k + 1) // 16
        parts = firsts * SECOND
        part = (mixed >> np.uint64(24)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)])
        held, own = np.diff(bounds).reshape(firsts, SECOND), (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(firsts, SECOND)
        held = (held.sum(axis=1, keepdims=True) - held).ravel()
        own = (own.sum(axis=1, keepdims=True, dtype=np.uint64) - own).ravel()
        agreed = 3 * firsts - 2 * most if most <= firsts else 2 * firsts - most
        keep = np.flatnonzero(held >= np.partition(held, agreed - 1)[agreed - 1])
        instance = np.full(len(keep), number + 1, np.uint64) * _MIX
        found.append(mix(own[keep] + keep.astype(np.uint64) * _MIX2 + instance))
    return np.concatenate(found)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH_LONGS bins."""
    bins = np.bincount((mix(shingles) & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS)
    return np.packbits((bins & 1).astype(np.uint8)).view(np.int64)


def _lists(columns: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *columns]).view(np.int64)))


def _salts(found: np.ndarray) -> np.ndarray:
    """0 for the first HOT places of each signature among some classes, a salt for those beyond."""
    order = np.argsort(found, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], found[order][1:] != found[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    beyond = order[np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) >= HOT]
    salts = np.zeros(len(found), np.int32)
    salts[beyond] = 1 + beyond % SALTS
    return salts


def _classes(size: int):
    """(id, row, n, node) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                b = whole.slice(s, SLICE)
                sets = [shingle_set(t, size) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64())], ["id", "row", "n", "node"])
            give_back()

    return run


def _signed(size: int, bands: Bands):
    """(sig, salt, node) of the classes that the task has not met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                if len(known) > KNOWN:
                    known.clear()
                nodes, found = [], []
                for t in whole.slice(s, SLICE).column("text").to_pylist():
                    x = shingle_set(t, size)
                    if len(x) and (h := set_hash(x)) not in known:
                        known.add(h)
                        nodes.append(h)
                        found.append(signatures(x, bands))
                if found:
                    sigs = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(_salts(sigs)), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in found]))], ["sig", "salt", "node"])
            give_back()

    return run


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                sets = [shingle_set(t, size) for t in whole.slice(s, SLICE).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _lists([sketch(x).view(np.uint64) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "sketch", "set"])
            give_back()

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
            give_back()

    return run


def _may_link(percent: int) -> Column:
    """The parity bits that differ are a lower bound of the difference, which for links is at most a share of both sizes."""
    bits = sum((F.bit_count(F.col("xs")[i].bitwiseXOR(F.col("ys")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    return (bits * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)) & (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, width: float = WIDTH, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links lead to, its own included).

    Texts are read for their classes, for signatures, and once more where a class shares one. Disk: the one exchange of
    signatures is the most that stands at a time; it is released before texts move.

    Ids may be of any type that has an order, such as a struct that tells rows of a repeated id apart.
    """
    spark = docs.sparkSession
    bands = Bands(percent, width)
    named = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").alias("text"))
    given = named.withColumn("row", row_key("id"))
    rows = settle(given.mapInArrow(_classes(shingle), f"id {id_type}, row long, n long, node long"))
    release(spark)  # what came before this join, such as the exchange of whole texts, would stand beside the signatures
    buckets = _buckets(given, shingle, bands)
    release(spark)
    nodes = _nodes(given, rows, buckets, shingle)
    release(spark)
    components = _contract(buckets, nodes, percent)
    rows = rows.select("id", "n", "node")
    named = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    labelled = named.join(components, "node").groupBy("component").agg(F.min("least").alias("least"))
    members = components.join(labelled, "component").select("node", F.col("least").alias("linked"))
    own = settle(named.join(members, "node", "left").select("node", F.coalesce("linked", "least").alias("component_id"), _led("node")))
    keyed = rows.withColumn("lead", _led("node"))
    return keyed.join(own, ["node", "lead"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _led(key: str) -> Column:
    """Part of a join key that no aggregation before or after the join has, so that adaptive execution may split a hot key."""
    return F.pmod(F.col(key), F.lit(1009)).alias("lead")


def _buckets(given: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """(sig, node) of the signatures that two classes or more have; what bears a salt is shared for certain."""
    signed = given.select("text").mapInArrow(_signed(shingle, bands), "sig long, salt int, node long")
    alike = Window.partitionBy("sig", "salt")
    low, high = F.min("node").over(alike).alias("low"), F.max("node").over(alike).alias("high")
    return settle(signed.select("sig", "salt", "node", low, high).filter("salt > 0 or low <> high").select("sig", "node"))


def _nodes(given: DataFrame, rows: DataFrame, buckets: DataFrame, shingle: int) -> DataFrame:
    """(node, n, sketch, set) of the classes in buckets, each from one row of its class."""
    met = buckets.select("node").distinct()
    chosen = rows.filter("node is not null").groupBy("node").agg(F.min("row").alias("row")).join(met.hint("merge"), "node", "left_semi").select("row")
    texts = given.select("row", "text").join(chosen.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    return settle(texts.mapInArrow(_described(shingle), "node long, n long, sketch array<long>, set binary"))


def _contract(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes in buckets."""
    light = nodes.select("node", "n", "sketch")
    components = nodes.select("node", F.col("node").alias("component"))
    tested = None
    for turn in range(PIVOT_ROUNDS + 1):
        at = buckets.join(components.hint("merge"), "node")
        mixed = at.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("pivot"), F.col("component").alias("held"))).alias("p")).filter("low <> high").select("sig", "p.pivot", "p.held")
        if turn < PIVOT_ROUNDS:
            met = at.withColumn("lead", _led("sig")).join(mixed.withColumn("lead", _led("sig")).hint("merge"), ["sig", "lead"]).filter("component <> held").groupBy(F.col("node").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("shared"))
            met = _described_pairs(met, light, percent)
            met = met.join(_either(tested).hint("merge"), ["x", "y"], "left_anti") if tested else met
            best = met.groupBy("x").agg(F.max(F.struct("shared", "y")).alias("best")).select("x", "best.y")
            pairs = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            pairs = _across(at.join(mixed.select("sig").hint("merge"), "sig", "left_semi"), light, percent)
            pairs = pairs.join(tested.select("a", "b").hint("merge"), ["a", "b"], "left_anti") if tested else pairs
        compared = settle(_compared(pairs, nodes, percent))
        tested = tested.union(compared) if tested else compared
        #: Links between components; the graph of the next round is that of components.
        ends = [components.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")).hint("merge") for k in "ab"]
        links = compared.filter("linked").join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(links).select(F.col("node").alias("was"), F.col("component").alias("now"))
        components = settle(components.join(merged.hint("merge"), F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")))
        release(buckets.sparkSession)
    return components


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def _described_pairs(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, shared) that the sketches do not rule out."""
    x, y = (light.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("sketch").alias(f"{k}s")) for k in "xy")
    return pairs.join(x.hint("merge"), "x").join(y.hint("merge"), "y").filter(_may_link(percent)).select("x", "y", "shared")


def _across(at: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) in a bucket but in different components, as far as the sketches do not rule them out."""
    return _meetings(at, light, percent).distinct()


def _meetings(at: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The same with a row for each bucket that offers the pair.

    One side has only the classes outside the component that most of the bucket is in, so a bucket that is in one
    component but for few classes costs few comparisons. Two classes that are both outside it meet once, not once from
    either side. Of signatures that the very same classes share (told by their number and two hashes of them) one is kept, as the
    others would only offer the same pairs again. A class knows its FIRST_SIGS smallest signatures: two classes that have one of
    them in common meet in the smallest such bucket only, so that a pair is made about once, however many signatures it shares.
    """
    at = at.select("sig", "node", "component").distinct()
    mark = lambda k: F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}")
    marks = at.groupBy("sig").agg(F.count("*").alias("n"), mark(1), mark(2)).groupBy("n", "mark1", "mark2").agg(F.min("sig").alias("sig"))
    at = settle(at.join(marks.select("sig").hint("merge"), "sig", "left_semi"))
    most = at.groupBy("sig", "component").count().groupBy("sig").agg(F.max(F.struct("count", "component")).alias("m")).select("sig", F.col("m.component").alias("main"))
    small = at.select("node", "sig", F.row_number().over(Window.partitionBy("node").orderBy("sig")).alias("k")).filter(F.col("k") <= FIRST_SIGS)
    firsts = small.groupBy("node").agg(F.collect_list("sig").alias("firsts"))
    full = at.join(light.hint("merge"), "node").join(firsts.hint("merge"), "node")
    both = full.join(most.hint("merge"), "sig").withColumn("out", F.col("component") != F.col("main"))
    rest = both.filter("out").select("sig", F.col("node").alias("x"), F.col("component").alias("xc"), F.col("n").alias("xn"), F.col("sketch").alias("xs"), F.col("firsts").alias("xf"))
    all_ = both.select("sig", "out", F.col("node").alias("y"), F.col("component").alias("yc"), F.col("n").alias("yn"), F.col("sketch").alias("ys"), F.col("firsts").alias("yf"))
    here = F.coalesce(F.array_min(F.array_intersect("xf", "yf")) == rest.sig, F.lit(True))
    met = rest.join(all_.hint("merge"), (rest.sig == all_.sig) & (F.col("xc") != F.col("yc")) & (~F.col("out") | (F.col("x") < F.col("y"))) & _may_link(percent) & here)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) from the whole sets of both."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")).hint("merge") for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long, linked boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op4_ngram_join over the whole of documents: 3-word shingles, 90 per cent. Too slow as SQL on whole tables; tests compare with brute force."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)
