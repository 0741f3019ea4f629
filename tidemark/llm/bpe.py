"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged across: it marks a certain
cut. Each pre-token is cut at all such pairs, the fragments are merged on their own by the ranks of the merges, and their
ids are concatenated. Fragments repeat far more often than words, so each worker keeps a bounded cache of both, and one of
whole chunks (below), in which what later batches have in common with earlier ones is found at once.

Normalisation is the vocabulary's own: NFC, runs of white space to one space, lower case. No token holds white space and no
step reaches across a space, so a batch of texts is cut at its spaces and each distinct chunk is coded once. Chunks with
code points whose class may differ between Unicode versions are normalised and split by the library; merging and decoding
are always done here. Special strings are taken out of the raw chunk first, as the library does.

Null text counts as empty, and an empty one has no ids. Texts of any length are coded whole; batches are bounded by bytes,
caches by entries. Repeated rows and ids are coded one by one. An empty table gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .token_counts import BATCH_BYTES, UNSURE, byte_letters, coded, library

CACHE_SIZE, CHUNKS, MAX_KEY = 300_000, 150_000, 48
SPACES = regex.compile(r"\p{White_Space}+")
#: Fixed value: the vocabulary's split.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for ASCII texts in lower case.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
ID_BITS, NEVER = 20, 1 << 62


class Vocabulary:
    """Ids, byte pairs and merges of a BPE file whose words end in a suffix; a merge is known by the ids of its two sides."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        sides = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: Rank and result in one number, so that the smallest one names the merge to make.
        self.pairs = {self.ids[a] << ID_BITS | self.ids[b]: rank << ID_BITS | self.ids[a + b] for rank, (a, b) in enumerate(sides)}
        bare = lambda t: t.removesuffix(self.end) if self.end else t
        self.inside = {t[i : i + 2] for t in map(bare, self.ids) for i in range(len(t) - 1)}
        #: Rank and result of the pairs of single bytes, by their stand-ins.
        self.twos = {t: x for t in self.inside if (x := self.pairs.get(self.ids[t[0]] << ID_BITS | self.ids[t[1]])) is not None}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.fragments: dict[str, list[int]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        #: Two generations: what is not asked for while the newer one fills is forgotten.
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.letters = byte_letters()

    def cuts(self, piece: str) -> list[str]:
        """The fragments of a piece between its certain cuts."""
        inside = self.inside
        if inside.issuperset(map(add, piece, piece[1:])):
            return [piece]
        at = [i for i, pair in enumerate(map(add, piece, piece[1:]), 1) if pair not in inside]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def merge(self, fragment: str, last: bool) -> list[int]:
        key = fragment + self.end if last else fragment
        if (known := self.fragments.get(key)) is not None:
            return known
        symbols = list(map(self.ids.__getitem__, fragment))
        if last:
            symbols[-1] = self.ids[fragment[-1] + self.end]
        if len(symbols) > MAX_KEY:
            ids = merged_long(symbols, self.pairs)
        else:
            found = list(map(self.twos.get, map(add, fragment, fragment[1:]), repeat(NEVER)))
            if last and found:
                found[-1] = self.pairs.get(symbols[-2] << ID_BITS | symbols[-1], NEVER)
            ids = merged(symbols, self.pairs, found)
        if len(fragment) <= MAX_KEY:
            if len(self.fragments) > CACHE_SIZE:
                self.fragments.clear()
            self.fragments[key] = ids
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, which is written in the stand-ins of its bytes."""
        *parts, last = self.cuts(piece)
        return [*(i for part in parts for i in self.merge(part, False)), *self.merge(last, True)] if parts else self.merge(last, True)

    def word(self, piece: str, spelt: bool = False) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of a pre-token. spelt: it is written in stand-ins already."""
        if not spelt and (known := self.words.get(piece)) is not None:
            return known
        plain = spelt or piece.isascii() and piece.isprintable()
        ids = self.encode_piece(piece if plain else "".join(map(self.letters.__getitem__, piece.encode())))
        out = (packed(ids), " ".join(map(self.tokens.__getitem__, ids)))
        if len(piece) <= MAX_KEY and not spelt:
            if len(self.words) > CACHE_SIZE:
                self.words.clear()
            self.words[piece] = out
        return out


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if array("H", [1]).tobytes() != b"\1\0":
        out.byteswap()
    return out.tobytes()


def merged(symbols: list[int], pairs: dict[int, int], found: list[int] | None = None) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left. found: what each pair is in pairs, else NEVER."""
    find = pairs.get
    if found is None:
        found = [find(a << ID_BITS | b, NEVER) for a, b in pairwise(symbols)]
    while found and (least := min(found)) != NEVER:
        i = found.index(least)
        new = symbols[i] = least & (1 << ID_BITS) - 1
        del symbols[i + 1], found[i]
        if i:
            found[i - 1] = find(symbols[i - 1] << ID_BITS | new, NEVER)
        if i < len(found):
            found[i] = find(new << ID_BITS | symbols[i + 1], NEVER)
    return symbols


def merged_long(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The same with a heap of pairs and linked neighbours, near-linear in the length."""
    n, gone = len(symbols), -1
    after, before = [*range(1, n), gone], [gone, *range(n - 1)]
    heap = [(x, i, a, b) for i, (a, b) in enumerate(pairwise(symbols)) if (x := pairs.get(a << ID_BITS | b)) is not None]
    heapq.heapify(heap)
    while heap:
        x, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = x & (1 << ID_BITS) - 1, gone
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for u, v in ((before[i], i), (i, k)):
            if u >= 0 and v >= 0 and (x := pairs.get(symbols[u] << ID_BITS | symbols[v])) is not None:
                heapq.heappush(heap, (x, u, symbols[u], symbols[v]))
    return [s for s in symbols if s != gone]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: str, path: str) -> list[tuple[bytes, str]]:
    """What each pre-token and special string of a text encodes to."""
    words = vocabulary(path)
    if "<" not in text:
        return _words(text, words, path)
    whole, special = library(path)
    out: list[tuple[bytes, str]] = []
    at = 0
    for m in special.finditer(text):
        out += _words(text[at : m.start()], words, path)
        out.append((packed([whole.token_to_id(m[0])]), m[0]))
        at = m.end()
    return out + _words(text[at:], words, path)


def _words(text: str, words: Vocabulary, path: str) -> list[tuple[bytes, str]]:
    """Of a text without special strings."""
    if text.isascii():
        return list(map(words.word, PLAIN.findall(text.lower())))
    if not UNSURE.search(text):
        return list(map(words.word, SPLIT.findall(SPACES.sub(" ", unicodedata.normalize("NFC", text)).lower())))
    whole = library(path)[0]
    return [words.word(p, True) for p, _ in whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(text))]


def chunk_codes(chunks: list[str], path: str) -> list[tuple[bytes, bytes]]:
    """(ids as little-endian 32-bit integers, decoded text in UTF-8 with a space before each token) of each chunk."""
    words, out = vocabulary(path), []
    for c in chunks:
        got = words.chunks.get(c)
        if got is None:
            got = words.older.get(c)
            if got is None:
                parts = words_of(c, path)
                got = (b"".join([w[0] for w in parts]), "".join([" " + w[1] for w in parts]).encode())
            if len(c) <= MAX_KEY:
                if len(words.chunks) >= CHUNKS:
                    words.older, words.chunks = words.chunks, {}
                words.chunks[c] = got
        out.append(got)
    return out


def encode(text: str, path: str) -> list[int]:
    out = array("I", b"".join(w[0] for w in words_of(text, path)))
    if array("H", [1]).tobytes() != b"\1\0":
        out.byteswap()
    return out.tolist()


def decode(ids: list[int], path: str) -> str:
    """As the library decodes a vocabulary without a decoder: tokens with a space between them, special ones kept."""
    tokens, special = vocabulary(path).tokens, library(path)[0]
    return " ".join(t for i in ids if (t := tokens.get(i) or special.id_to_token(i)) is not None)


def batch_codes(texts: pa.Array, path: str) -> list[tuple[memoryview, memoryview]]:
    """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
    chunks, at, first = coded(texts)
    codes = chunk_codes(chunks.to_pylist(), path)
    raw = pa.array([c[0] for c in codes], pa.large_binary()).take(pa.array(at))
    back = pa.array([c[1] for c in codes], pa.large_binary()).take(pa.array(at))

    def texts_of(parts: pa.Array, skipped: int) -> list[memoryview]:
        """The parts of each text as one; the space before its first token is skipped."""
        ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
        bounds = ends[np.append(first, len(at))].tolist()
        data = memoryview(parts.buffers()[2] or b"")
        return [data[a + skipped * (a < b) : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    return list(zip(texts_of(raw, 0), texts_of(back, 1), strict=True))


def bpe_codes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; with full also ids and decoded themselves."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", BATCH_BYTES):
                codes = batch_codes(b.column(1), path)
                sha = lambda k: pa.array([hashlib.sha256(x[k]).hexdigest() for x in codes], pa.string())  # noqa: B023, E731
                out, names = [b.column(0), pa.array([len(raw) // 4 for raw, _ in codes], pa.int64()), sha(0), sha(1)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    ids = pa.array([np.frombuffer(raw, "<u4").astype(np.int64) for raw, _ in codes], pa.list_(pa.int64()))
                    out, names = [*out, ids, pa.array([bytes(back).decode() for _, back in codes], pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * full
    return narrow.mapInArrow(code, schema).withColumnRenamed("id", id_col)
