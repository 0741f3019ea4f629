"""Removal of repeated passages by suffix arrays.

A string of LENGTH bytes is repeated when it starts at two places at least, of one document or of several. All places
count, the first one too, and are judged on the input; what repeated strings cover is removed.

The work is dealt by content. In every string of LENGTH bytes one anchor is chosen, the GRAM bytes with the smallest hash
(the rightmost of equals), so equal strings have the same anchor at the same place. An anchor owns the strings that chose
it, which start next to each other: a fragment holds them all. Anchors that were seen at one place only, which are most,
are dropped before any text moves. Fragments that are equal as a whole, by their anchor and a 64-bit hash, are repeats and
count once from there on; the different fragments of an anchor meet. In blocks of these, suffix arrays are built by two-stage sorting: a suffix that is smaller than its successor is sorted directly, all others are induced by one
scan over the buckets of first bytes; adjacent common prefixes of LENGTH or more then show what repeats. Comparing the
first LENGTH bytes is enough for that, and separators that no UTF-8 text holds end each fragment.

Skew: rows of equal texts take part once (a text of LENGTH bytes or more with a copy is repeated as a whole), and an anchor
with HOT different fragments or more is not gathered: each of their strings is aggregated by a 128-bit hash of the string
itself. So no group holds more than HOT fragments of less than 2 * LENGTH bytes.

Rows: null text counts as empty; a row is known by a 64-bit hash of its id and text, so repeated ids are kept apart and
repeated rows are copies of each other. Texts shorter than LENGTH never lose anything; long ones are read whole, CHUNK bytes
at a time. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, pieces, release, row_key, settle, table

LENGTH, GRAM, HOT = 200, 32, 4096
CHUNK, BLOCK = 1 << 18, 1 << 18
SEPARATOR = 0xFF


@lru_cache(maxsize=1)
def _constants(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and `most` powers of an odd base and of its inverse modulo 2**64."""
    letters = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(most, b, np.uint64)]))
    return letters, powers(base), powers(inverse)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes of at most CHUNK bytes, which depends on these bytes alone."""
    letters, up, down = _constants(CHUNK)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): each anchor with the first and last start of the strings that it owns."""
    gram = min(gram, length)
    width = length - gram + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(text) - length + 1, CHUNK - length + 1):
        data = np.frombuffer(text, np.uint8)[at : at + CHUNK]
        h = gram_hashes(data, gram)
        n = len(data) - length + 1
        #: Smallest hash first; of equals the one furthest right.
        keys = (h >> np.uint64(20) << np.uint64(20)) | (np.uint64(CHUNK - 1) - np.arange(len(h), dtype=np.uint64))
        padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = keys
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (CHUNK - 1) - (least[first] & np.uint64(CHUNK - 1)).astype(np.int64)
        found.append((h[place], first + at, np.append(first[1:], n) - 1 + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, exact for the first `depth` bytes at least. Two-stage sorting."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    #: A suffix is smaller than its successor if the next byte that differs is larger; the end is smaller than anything.
    change = np.flatnonzero(data[1:] != data[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    rising = np.zeros(n, bool)
    inner = nearest < len(change)
    at = change[nearest[inner]]
    rising[inner] = data[at] < data[at + 1]
    raw = data.tobytes()
    direct = np.array(sorted(np.flatnonzero(rising).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    heads = data[direct]
    parts: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(order: np.ndarray) -> np.ndarray:
        """Predecessors that are larger go to their buckets, in order; those of the bucket at hand come back."""
        before = order[order > 0] - 1
        before = before[~rising[before]]
        first = data[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        same = before[:0]
        if not len(before):
            return same
        cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
            if first[a] == letter:
                same = before[a:b]
            else:
                parts[first[a]].append(before[a:b])
        return same

    letter = -1
    induce(np.array([n]))
    for letter in range(256):
        wave = np.concatenate(parts[letter]) if parts[letter] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave)
        own = direct[np.searchsorted(heads, letter) : np.searchsorted(heads, letter, "right")]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix and the one before it in order, up to depth; data is padded by depth bytes."""
    out = np.zeros(len(order), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(data, depth)
    for a in range(1, len(order), 16_384):
        same = views[order[a : a + 16_384]] == views[order[a - 1 : a - 1 + len(order[a : a + 16_384])]]
        out[a : a + 16_384] = np.where(same.all(axis=1), depth, same.argmin(axis=1))
    return out


def repeated_starts(fragments: list[bytes], rows: list[int], starts: list[int], length: int) -> list[tuple[int, int, int]]:
    """(row, first, last): runs of starts of strings that also start elsewhere, of fragments of `length` bytes or more."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    data = np.frombuffer(b"".join(f + bytes([SEPARATOR]) for f in fragments), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    inside = np.arange(len(data)) - begin[owner]
    order = suffix_array(data, length)
    order = order[(inside[order] + length <= sizes[owner[order]])]
    #: Left out were suffixes whose first bytes hold a separator, which stand between no two equal strings.
    prefixes = common_prefixes(np.concatenate([data, np.full(length, SEPARATOR, np.uint8)]), order, length)
    known: dict[int, int] = {}
    number = np.array([known.setdefault(r, len(known)) for r in rows], np.int64)
    place = (number[owner[order]] << 40) | (np.array(starts, np.int64)[owner[order]] + inside[order])
    runs = np.flatnonzero(prefixes < length)
    least, most = np.minimum.reduceat(place, runs), np.maximum.reduceat(place, runs)
    hit = np.sort(place[np.repeat(least != most, np.diff(np.append(runs, len(order))))])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
    names = list(known)
    return [(names[a >> 40], a & ((1 << 40) - 1), b & ((1 << 40) - 1)) for a, b in zip(hit[cut].tolist(), hit[np.append(cut[1:], len(hit)) - 1].tolist(), strict=True)]


def _anchored(length: int):
    """(row, content, and of each anchor hash, hash of its fragment, first and last as lists) of the texts of `length` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=1_000_000):
                batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column("text")), length))
                if not batch.num_rows:
                    continue
                found = []
                for t in batch.column("text"):
                    raw = t.as_buffer().to_pybytes()
                    h, first, last = anchors(raw, length)
                    frag = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(h))
                    found.append((h, frag, first, last))
                bounds = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).view(np.int64)).cast(t)) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("content"), *lists], ["row", "content", "hash", "frag", "first", "last"])

    return run


def _wanted(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text, hash, first, last of its anchors of one kind) of each row of a batch."""
    column = batch.column("anchors")
    all_, bounds = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    names = ("hash", "first", "last", "hot")
    hashes, first, last, kind = (all_.field(n).to_numpy(zero_copy_only=False) for n in names)
    for i, (a, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        of = a + np.flatnonzero(kind[a:e] == hot)
        if len(of):
            yield batch.column("row")[i].as_py(), batch.column("text")[i].as_buffer().to_pybytes(), hashes[of], first[of].astype(np.int64), last[of].astype(np.int64)


def _strings(length: int):
    """One row for each string of the hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, raw, _, first, last in _wanted(whole, True):
                for a in range(0, len(first), 500):
                    starts = [s for x, y in zip(first[a : a + 500].tolist(), last[a : a + 500].tolist(), strict=True) for s in range(x, y + 1)]
                    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s : s + length]) for s in starts), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([row] * len(starts), pa.int64()), pa.array(starts, pa.int64())], ["k1", "k2", "row", "first"])

    return _gathered(run)


def _fragments(length: int):
    """One row for each fragment of the anchors that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, raw, hashes, first, last in _wanted(whole, False):
                cut = [raw[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(cut), row, np.int64)), pa.array(first), pa.array(last), pa.array(cut, pa.binary())], ["hash", "row", "first", "last", "fragment"])

    return _gathered(run)


def _gathered(run, least: int = 2_000):
    """Small batches together: one row's worth each is too little for Arrow."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if sum(x.num_rows for x in held[-1:]) + len(held) * 8 > least:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def _compare(length: int):
    """Fragments that come sorted by anchor, in blocks of whole anchors, through suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[int, int, int]] = []
        block: list[tuple[bytes, int, int]] = []
        group: dict[bytes, list[tuple[int, int, int]]] = {}
        at, size = None, 0

        def close() -> None:
            """The group at hand ends. Of equal fragments, which are repeats, one goes on, and only to be compared with others."""
            nonlocal size
            for places in group.values():
                if len(places) > 1:
                    known.extend(places)
            if len(group) > 1:
                block.extend((f, p[0][0], p[0][1]) for f, p in group.items())
                size += sum(map(len, group))
            group.clear()

        def found() -> Iterator[pa.RecordBatch]:
            """What is known by now, and the repeats of the block at hand."""
            nonlocal size
            out = known + (repeated_starts(*map(list, zip(*block, strict=True)), length) if block else [])
            known.clear(), block.clear()
            size = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "first", "last"])

        for b in batches:
            for hash_, *place, fragment in zip(*(b.column(c).to_pylist() for c in ("hash", "row", "first", "last", "fragment")), strict=True):
                if hash_ != at:
                    close()
                    at = hash_
                    if size > BLOCK or len(known) > 50_000:
                        yield from found()
                group.setdefault(fragment, []).append(tuple(place))
        close()
        yield from found()

    return run


def _led(key: str) -> Column:
    """Part of a join key that no aggregation before the join had, so that adaptive execution may split a hot key."""
    return F.pmod(F.col(key), F.lit(1009)).alias("lead")


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): for rows that lose something, the byte ranges [start, end) to remove, sorted and apart. row is row_key()."""
    return _repeats(*_keyed(docs, id_col, text_col), length, hot)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id, text), and the same dealt by row, for all joins with texts."""
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows, rows.repartition("row")


def _repeats(rows: DataFrame, parted: DataFrame, length: int, hot: int) -> DataFrame:
    content = rows.select("row", F.octet_length("text").alias("n"), F.xxhash64("text").alias("c1"), F.crc32(F.col("text").cast("binary")).alias("c2")).filter(F.col("n") >= length)
    copies = content.groupBy("c1", "c2", "n").agg(F.count("*").alias("copies"), F.min("row").alias("stands")).filter("copies > 1").withColumn("lead", F.col("c2") % 1000)
    copied = settle(content.withColumn("lead", F.col("c2") % 1000).join(copies, ["c1", "c2", "n", "lead"]).select("row", F.col("n").cast("long").alias("n"), "stands"))
    texts = rows.select("row", F.xxhash64("text").alias("content"), "text")
    #: One pass over the texts finds all anchors; they are kept as lists, without the texts.
    listed = settle(texts.mapInArrow(_anchored(length), "row long, content long, hash array<long>, frag array<long>, first array<int>, last array<int>"))
    place = F.xxhash64("content", "a.first").alias("place")
    every = listed.select("row", "content", F.explode(F.arrays_zip("hash", "frag", "first", "last")).alias("a"))
    seen = every.groupBy(F.col("a.hash").alias("hash")).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    shared = settle(seen.filter("low <> high").select("hash", _led("hash")))
    del seen
    release(rows.sparkSession)
    places = settle(every.select("row", "a.hash", "a.frag", "a.first", "a.last", place, _led("a.hash")).join(shared, ["hash", "lead"]).drop("lead"))
    del listed, every, shared
    release(rows.sparkSession)
    classes = places.groupBy("hash", "frag").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min(F.struct("row", "first", "last")).alias("one"))
    classes = settle(classes.select("hash", "frag", (F.col("low") != F.col("high")).alias("twice"), "one.*"))
    same = places.withColumn("lead", _led("frag")).join(classes.filter("twice").select("hash", "frag", _led("frag")), ["hash", "frag", "lead"])
    same = same.select("row", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    many = classes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash", (F.col("n") >= hot).alias("hot"), _led("hash"))
    wanted = classes.withColumn("lead", _led("hash")).join(many, ["hash", "lead"])
    wanted = settle(wanted.groupBy("row").agg(F.collect_set(F.struct("hash", "hot", "first", "last")).alias("anchors")))
    of = lambda hot: parted.join(wanted.filter(F.exists("anchors", lambda a: a["hot"] == hot)), "row").dropDuplicates(["row"])
    near = of(False).mapInArrow(_fragments(length), "hash long, row long, first long, last long, fragment binary").repartition("hash").sortWithinPartitions("hash").mapInArrow(_compare(length), "row long, first long, last long")
    strings = of(True).mapInArrow(_strings(length), "k1 long, k2 long, row long, first long")
    place = F.xxhash64("row", "first")
    twice = strings.groupBy("k1", "k2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("k1", "k2", _led("k1"))
    far = strings.withColumn("lead", _led("k1")).join(twice, ["k1", "k2", "lead"]).select("row", "first", F.col("first").alias("last"))
    whole = copied.select("row", F.lit(0).cast("long").alias("first"), (F.col("n") - length).alias("last"))
    runs = near.union(far).union(same).join(copied.select("row"), "row", "left_anti").union(whole.distinct())
    gathered = runs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))
    return gathered.mapInArrow(_joined(length), "row long, spans array<struct<start:bigint,end:bigint>>")


def joined(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts, sorted by their first, to the starts and ends of ranges of bytes that do not touch."""
    end = np.maximum.accumulate(last + length)
    opens = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return first[opens], end[np.append(opens[1:], len(end)) - 1]


def _joined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, flat = b.column("runs"), b.column("runs").flatten()
            at = np.cumsum([0, *pc.list_value_length(rows).to_pylist()])
            first, last = (flat.field(k).to_numpy() for k in (0, 1))
            found = [joined(first[x:y], last[x:y], length) for x, y in zip(at[:-1], at[1:], strict=True)]
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])) for k in (0, 1)], ["start", "end"])
            offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(offsets, spans)], ["row", "spans"])

    return run


def kept(raw: bytes, spans: list) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]])


def digest_kept(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, parted = _keyed(docs, "doc_id", "text")
    spans = _repeats(rows, parted, length, HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x or "", s or []) for x, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            raws = [x.encode() for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([sum(y["end"] - y["start"] for y in s) for _, s in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([hashlib.sha256(kept(r, s)).hexdigest() for r, (_, s) in zip(raws, found, strict=True)], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    met = parted.join(spans, "row", "left")
    return met.select("id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with repeated passages cut out of the text, and spans; characters of which a byte goes go whole.

    docs may have columns of any names but spans_col, which is refused.
    """
    if spans_col in docs.columns:
        raise ValueError(f"docs has a column {spans_col}; choose another name for the spans")
    row = free_name(docs, "row", spans_col)
    #: Settled, so that the exchanges that found the spans are gone before texts are dealt once more.
    spans = settle(repeats(docs, length, id_col=id_col, text_col=text_col).select(F.col("row").alias(row), F.col("spans").alias(spans_col)))
    release(docs.sparkSession)
    met = docs.withColumn(row, row_key(id_col, text_col)).join(spans, row, "left").drop(row).withColumn(text_col, F.col(text_col).cast("string"))
    at = met.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [t if not s or t is None else kept(t.encode(), s).decode(errors="ignore") for t, s in zip(b.column(at).to_pylist(), b.column(spans_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return met.mapInArrow(run, met.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2_repeated_passages over the whole of documents. Too slow as SQL on whole tables; tests compare with brute force."""
    return digest_kept(table(spark, sf_dir, "documents"))
