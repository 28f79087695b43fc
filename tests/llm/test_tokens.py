"""Byte-level BPE and token counts against the libraries."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers

import __spark_entry__ as entry
from tidewatch.llm import byte_bpe, token_counts

ALPHABET = [
    "a", "Z", " ", "  ", "\n", "\t", "'s", "'ll", "9", "12", "é", "ß", "<|endoftext|>", "!!", "$", "　", "日本", "𝔘",
    "՘", "\x1c", "\x85", "\xa0", "'", "word", " the",
]


def noise(n, most, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(byte_bpe.MULTI, public_tokenizers.PATTERN)


def test_op5_query_equals_tiktoken(spark, small, texts, enc):
    rows = entry.queries()["op5_byte_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(20, 8), (12, 2), (40, 30)])
def test_stitched_chunks_encode_as_the_whole(enc, chunk, overlap):
    pattern, step = regex.compile(public_tokenizers.PATTERN), chunk - overlap
    for text in noise(1500, 60):
        cuts = range(0, max(1, len(text) - overlap), step)
        chunks = [(i, text[c : c + chunk], byte_bpe.starts_of(pattern, text[c : c + chunk]).astype("<i4").tobytes()) for i, c in enumerate(cuts)]
        pieces = list(byte_bpe.stitch(chunks, step))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_and_odd_rows_go_round(odd, enc):
    coded = byte_bpe.decode(byte_bpe.encode(odd, chunk=1000, overlap=50))
    assert coded.count() == odd.count()
    for r in coded.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert (r.score, r.n_tokens) == ("s", len(r.ids) // 4)


def test_bpe_of_an_empty_table(empty):
    assert byte_bpe.decode(byte_bpe.encode(empty)).collect() == []


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        byte_bpe.encode(None, chunk=10, overlap=10)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_counts.BYTE_BPE)


def test_op8_query_equals_the_library(spark, small, texts, library):
    rows = entry.queries()["op8_token_counts"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_counts_of_noise(library):
    texts = noise(4000, 25, seed=2)
    assert token_counts.counter(token_counts.BYTE_BPE).count(texts) == [
        len(library.encode(t, add_special_tokens=False).ids) for t in texts
    ]


def test_recent_counts_are_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "RECENT", 5)
    own = token_counts.counter(token_counts.BYTE_BPE)
    texts = [f"qzxv{i} jjkw{i}x" for i in range(40)]
    got = [n for t in texts for n in own.count([t])]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_proven_strings_are_single_tokens(library):
    for t in token_counts.whole_tokens(library)[::97]:
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_engines_agree_on_proven_characters(library):
    """Every character that the shortcut accepts is classified alike by both engines."""
    pattern = re.compile(token_counts.PROVEN.pattern.removesuffix("*+"))
    own = regex.compile(public_tokenizers.PATTERN)
    for c in (c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and pattern.match(c)):
        s = f"a{c}1{c}! {c}"
        assert [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)] == own.findall(s), hex(ord(c))


def test_counts_of_odd_rows(odd, empty, library):
    for r in token_counts.count_tokens(odd).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode())
    assert token_counts.count_tokens(empty).collect() == []
