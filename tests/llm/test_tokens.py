import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts as tc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world's  best", "a<|endoftext|> b<|endoftext|>", "<|startoftext|>Éa ΣΑΣ ﬁ İx", "x" * 5000, "ab" * 3000, "中文 text １２３ ½",
    "\x1c\x1d a\x85b\xa0c d​e", "''s 'S don't we'LL", "!!!??? --- ...", "\U0001f600 emoji \U0001f468‍\U0001f469", "é ö", "   trailing   ", "ñandú über ça", "𞤀𞤁 ꟸ ა Ა", "\x00\x01",
]


def same_count(text):
    t = Tokenizer.from_file(BYTE)
    return tc.count_tokens(text, tc.Lengths({}, BYTE), BYTE) == len(t.encode(text, add_special_tokens=False).ids)


def same_codes(text):
    t = Tokenizer.from_file(WORD)
    ids = t.encode(text, add_special_tokens=False).ids
    return bpe.encode(text, WORD) == ids and bpe.decode(ids, WORD) == t.decode(ids, skip_special_tokens=False) == " ".join(w[1] for w in bpe.words_of(text, WORD))


@pytest.mark.parametrize("text", TEXTS[1:])
def test_as_the_library(text):
    assert same_count(text) and same_codes(text)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sEéß<|>endoftext12")), max_size=80))
def test_as_the_library_anywhere(text):
    assert same_count(text) and same_codes(text)


def test_certain_cuts_hold():
    words = bpe.vocabulary(WORD)
    for token in random.Random(1).sample(sorted(words.ids), 500):
        assert words.cuts(token.removesuffix(words.end)) == [token.removesuffix(words.end)]


def test_merges_with_and_without_heap_agree():
    words, rng = bpe.vocabulary(WORD), random.Random(4)
    for n in (1, 2, 3, 30, 300):
        symbols = [words.ids[c] for c in rng.choices("aeiorstln", k=n)]
        assert bpe.merged(symbols[:], words.pairs) == bpe.merged_long(symbols[:], words.pairs)


SPACED = ["", " ", "  ", " a", "a ", "a  b", "a\n\n  b", "a \n b", "a\xa0 b", "x <|endoftext|> y", "　a b", "한국 어 😀 and שלום", "ΑΣ ΟΔΟΣ", "e \u0301a", "\x1c \x1d", "word " * 20_000, *TEXTS[1:]]


def test_batches_are_coded_as_their_texts():
    """Chunks between spaces, first chunks, white space beside white space, texts beyond 6,000 characters."""
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    texts = pa.array([*SPACED, None, *SPACED])
    counts, codes = tc.batch_counts(texts, tc.Lengths({}, BYTE), BYTE), bpe.batch_codes(texts, WORD)
    for t, n, (raw, back) in zip(texts.to_pylist(), counts, codes, strict=True):
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert n == len(byte.encode(t or "", add_special_tokens=False).ids) and bytes(raw) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(back).decode() == word.decode(ids, skip_special_tokens=False)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("   \n\t\xa0'sEéß<|>endoftext12")), max_size=40), max_size=4))
def test_batches_anywhere(texts):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    column = pa.array(texts, pa.string())
    ids = [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert tc.batch_counts(column, tc.Lengths({}, BYTE), BYTE).tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [(bytes(a), bytes(b).decode()) for a, b in bpe.batch_codes(column, WORD)] == [(struct.pack(f"<{len(i)}I", *i), word.decode(i, skip_special_tokens=False)) for i in ids]


@pytest.mark.parametrize("most", [3, 1000])
def test_chunks_of_earlier_batches_are_not_coded_again(monkeypatch, most):
    words, split, seen = bpe.vocabulary(WORD), bpe.words_of, []
    monkeypatch.setattr(bpe, "CHUNKS", most)
    monkeypatch.setattr(words, "chunks", {})
    monkeypatch.setattr(words, "older", {})
    monkeypatch.setattr(bpe, "words_of", lambda text, path: seen.append(text) or split(text, path))
    codes = [[(bytes(a), bytes(b)) for a, b in bpe.batch_codes(pa.array(["one two Three", "four's " + "x" * 60, None, "one"]), WORD)] for _ in range(3)]
    assert codes[0] == codes[1] == codes[2] and len(words.chunks) <= most
    if most > 3:
        assert sorted(seen) == sorted(["one", "two", "Three", "four's", "", *["x" * 60] * 3])


def test_queries(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, n_tokens int")
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    texts = [t or "" for t in [*TEXTS, *TEXTS]]
    got = {r.doc_id: r for r in tc.token_counts(docs, BYTE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(byte.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 1024)
    for r in bpe.bpe_codes(docs, WORD).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    none = docs.limit(0)
    assert tc.token_counts(none, BYTE).count() == 0 and bpe.bpe_codes(none, WORD).count() == 0
