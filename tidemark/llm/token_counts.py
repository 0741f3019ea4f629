"""Token counts of byte-level BPE by a two-tier lookup on the map side.

First tier: a compact table of the lengths of the corpus' most frequent pre-tokens, TABLE_SIZE entries at most, each of
MAX_KEY characters at most, which is what bounds the broadcast. Its counts come from all texts: every task keeps a
bounded summary of its own pre-tokens. Second tier: a bounded cache in each worker, which encodes what the table lacks with
the library. No row for a pre-token is ever shuffled but those of the bounded summaries.

A batch of texts is cut into chunks at its single spaces, which begin a pre-token wherever no other white space stands beside
them, and each distinct chunk of the batch is split and looked up once. Chunks with code points whose class may differ
between Unicode versions go to the library, whole texts only where white space stands beside white space.

Special strings inside texts count as the library's default has them: one token each. Null and empty texts have no tokens.
Texts of any length are read whole; batches are bounded by bytes. Repeated rows and repeated ids are counted one by one. An
empty table gives an empty result. Of extra columns only those named in `keep` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

TABLE_SIZE, SUMMARY_SIZE, SUMMARY_MOST, MAX_KEY, CACHE_SIZE = 32_768, 20_000, 250_000, 48, 200_000
#: The split of byte-level BPE, with white space as the Unicode property.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Code points outside these blocks may have another class in the library's version of Unicode; such texts go to the library whole.
UNSURE = regex.compile("[^\u0000-ɏͰ-ͷΆ-ΡΤ-҂Ҋ-ԧ -⁯₠-₵℀-⅏←-⏳　-〩ぁ-ゖァ-ヿ一-龥]")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 as itself, the rest from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer, and the strings that it takes out first."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]
    return whole, regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))


@lru_cache(maxsize=2)
def encoder(path: str):
    """The number of tokens of one pre-token, by the library's model."""
    model, letter = library(path)[0].model, byte_letters().__getitem__
    return lambda piece: len(model.tokenize("".join(map(letter, piece.encode()))))


#: The same split where it may be written with the classes of `re`, which is faster: texts without the characters of UNLIKE.
PLAIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNLIKE = re.compile("['\x1c-\x1f\u00aa\u00b2\u00b3\u00b9\u00ba\u00bc-\u00be\u02b0-\uffff]")


def split(text: str) -> list[str]:
    return SPLIT.findall(text) if UNLIKE.search(text) else PLAIN.findall(text)


class Lengths(dict):
    """Length of each pre-token: the frequent ones that were sent along, then those that this worker has met.

    The cache has two generations of CACHE_SIZE entries; what is not asked for while the newer one fills is forgotten.
    """

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        super().__init__(frequent)
        self.frequent, self.older, self.encode = frequent, {}, encoder(path)

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece) or self.encode(piece)
        if len(piece) <= MAX_KEY:
            if len(self) > len(self.frequent) + CACHE_SIZE:
                self.older = {k: v for k, v in self.items() if k not in self.frequent}
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def count_tokens(text: str, lengths: Lengths, path: str) -> int:
    whole, special = library(path)
    if not text:
        return 0
    if not text.isascii() and UNSURE.search(text):
        return len(whole.encode(text, add_special_tokens=False).ids)
    if "<" not in text or not special.search(text):
        return sum(map(lengths.__getitem__, split(text)))
    parts = special.split(text)
    return len(parts) - 1 + sum(sum(map(lengths.__getitem__, split(p))) for p in parts)


#: Two code points side by side that are white space in any version of Unicode.
BESIDE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
BATCH_BYTES = 4_000_000


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks between spaces, the number of the chunk at each place, and the place of each text's first chunk.

    Every text, an empty one too, has a chunk at least.
    """
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    chunks = lists.flatten().dictionary_encode()
    return chunks.dictionary, chunks.indices.to_numpy(), lists.offsets.to_numpy()[:-1]


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def spaced_counts(chunks: pa.Array, lengths: Lengths, path: str) -> np.ndarray:
    """Tokens of each chunk with a space before it. 

    Chunks without white space at their ends are split all at once: there a piece begins with a space only where a chunk does.
    """
    out = np.zeros(len(chunks), np.int64)
    odd, unlike = _has(chunks, "^$|^[\\s\\p{Z}]|[\\s\\p{Z}]$|[<\\x0b\\x1c-\\x1f\\x{85}\\x{180e}]|" + UNSURE.pattern), _has(chunks, UNLIKE.pattern)
    for mask, pattern in ((~odd & ~unlike, PLAIN), (~odd & unlike, SPLIT)):
        if mask.any():
            found = pattern.findall(" " + " ".join(chunks.filter(pa.array(mask)).to_pylist()))
            n = np.fromiter(map(lengths.__getitem__, found), np.int64, len(found))
            out[mask] = np.add.reduceat(n, np.flatnonzero(np.fromiter((p[0] == " " for p in found), bool, len(found))))
    out[odd] = [count_tokens(" " + c, lengths, path) for c in chunks.filter(pa.array(odd)).to_pylist()]
    return out


def batch_counts(texts: pa.Array, lengths: Lengths, path: str) -> np.ndarray:
    """Tokens of each text. All chunks but a text's first one stand after a space."""
    chunks, at, first = coded(texts)
    if not len(first):
        return np.zeros(0, np.int64)
    spaced = spaced_counts(chunks, lengths, path)
    counts = np.add.reduceat(spaced[at], first) - spaced[at[first]]
    counts += np.array([count_tokens(c, lengths, path) for c in chunks.take(pa.array(at[first])).to_pylist()], np.int64)
    for i in np.flatnonzero(_has(texts, BESIDE)):
        counts[i] = count_tokens(texts[i].as_py(), lengths, path)
    return counts


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lossy counting: what was rare so far goes whenever the summary is full."""
    seen: Counter = Counter()
    for whole in batches:
        for batch in pieces(whole, "text", BATCH_BYTES):
            chunks, at, _ = coded(batch.column(0))
            for chunk, n in zip(chunks.to_pylist(), np.bincount(at, minlength=len(chunks)).tolist(), strict=True):
                for piece in split(" " + chunk):
                    seen[piece] += n
            if len(seen) > SUMMARY_MOST:
                seen = Counter(dict(seen.most_common(SUMMARY_MOST // 3)))
    top = [(t, n) for t, n in seen.most_common(SUMMARY_SIZE) if len(t) <= MAX_KEY and n > 1]
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> dict[str, int]:
    summaries = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_summary, "piece string, n long")
    top = summaries.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).collect()
    return {r.piece: encoder(path)(r.piece) for r in top}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, keep: tuple[str, ...] = (), table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, and the columns named in keep. With table_size 0 only the caches count."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, table_size) if table_size else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(frequent.value, path)
        for whole in batches:
            for batch in pieces(whole, "text", BATCH_BYTES):
                texts = batch.column(1)
                out = [batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(batch_counts(texts, lengths, path))]
                yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], ["id", "n_bytes", "n_tokens", *keep])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    counted = narrow.mapInArrow(count, f"id long, n_bytes long, n_tokens long{kept}")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *keep)
