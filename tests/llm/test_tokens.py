import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meritlens.llm import bpe, packing
from tests.llm.samples import awkward, frame, prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE.from_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def chunked():
    return packing.ChunkEncoder(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "a", "  a  b ", "it's we'll", "x" * 5000, "ab" * 4000, "\n\n x \t y", "<|endoftext|> </s>", "漢字 かな 😀", prose(3, 500), "z" * 129]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_matches_library(own, reference, text):
    ids = own.encode_texts([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeé漢 \n\t'1!ß😀 s")), max_size=60), max_size=5))
def test_encoders_match_libraries(own, reference, chunked, tokenizer, texts):
    assert [x.tolist() for x in own.encode_texts(texts)] == [reference.encode_ordinary(t) for t in texts]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in chunked.encode([t.encode() for t in texts])] == expected


def test_long_and_short_pieces_agree(own, monkeypatch):
    pieces = [prose(i, 5).replace(" ", "").encode() for i in range(50)]
    short = [x.tolist() for x in own.encode_pieces(pieces)]
    monkeypatch.setattr(bpe, "LONG", 1)
    assert [x.tolist() for x in own.encode_pieces(pieces)] == short


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "aab" * 999, prose(3, 4000).replace(" ", ""), "漢字" * 700, "=-" * 2048, "a" * 129])
def test_pieces_of_any_length(own, reference, text):
    assert own.encode_texts([text])[0].tolist() == reference.encode_ordinary(text)


def test_single_merges(own, monkeypatch):
    """One merge a round gives what all occurrences at once give."""
    assert 0 < own.fickle.sum() < len(own.fickle) // 2
    pieces = [prose(i, 60).replace(" ", "").encode() for i in range(5)] + [b"a" * 300]
    several = [x.tolist() for x in own.encode_pieces(pieces)]
    monkeypatch.setattr(own, "fickle", np.ones_like(own.fickle))
    assert [x.tolist() for x in own.encode_pieces(pieces)] == several


def random_letters(n, letters="abcdefghijklmnopqrstuvwxyz", seed=1):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "acgt", "ab", "0123456789abcdef", "etaoin漢é"])
def test_long_random_pieces(own, reference, letters):
    for n in (129, 1000, 20_000):
        text = random_letters(n, letters, n)
        assert own.encode_texts([text])[0].tolist() == reference.encode_ordinary(text)


def test_long_pieces_cost_what_they_merge(own, reference):
    """Ten times the bytes take at most about twelve times the time, and ids equal the library's."""
    took = {}
    for n in (100_000, 1_000_000):
        text = random_letters(n)
        began = time.process_time()
        ids = own._merge_long(text.encode())
        took[n] = time.process_time() - began
        if n == 100_000:  # the library itself is quadratic here
            assert ids.tolist() == reference.encode_ordinary(text)
    assert took[1_000_000] < 15 * took[100_000] + 1


def test_forgetting(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for i in range(4):
        assert own.encode_texts([prose(i)])[0].tolist() == reference.encode_ordinary(prose(i))


def test_chunk_table_fills_and_restarts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLOTS", 64)
    monkeypatch.setattr(packing, "WINDOW", 200)
    encoder = packing.ChunkEncoder(VOCABULARY)
    for i in range(6):
        text = prose(i, 20) + " é\n" + prose(i + 50, 12)
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_op5_awkward(spark, reference):
    got = bpe.op5(frame(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(awkward())
    texts = {i: t or "" for i, t, *_ in awkward()}
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.op5(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_then_decode(spark):
    rows = bpe.decode(bpe.encode(frame(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    texts = {i: t or "" for i, t, *_ in awkward()}
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in rows)


def test_packing(spark, tokenizer):
    rows = packing.pack(spark, frame(spark).repartition(3), VOCABULARY, with_ids=True).collect()
    texts = {i: t or "" for i, t, *_ in awkward()}
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    total = sum(r.length for r in rows)
    for s, own in by_sequence.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        held = sum(r.length for r in own)
        assert held == (1024 if s < max(by_sequence) else total - 1024 * max(by_sequence))
        assert {r.padded_length for r in own} == {held if held & (held - 1) == 0 else 1024}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, own in by_doc.items():
        expected = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        times = sum(r.start == 0 for r in own)  # repeated rows
        assert times == sum(i == doc_id for i, *_ in awkward())
        assert {r.doc_tokens for r in own} == {len(expected)}
        assert sum(r.length for r in own) == times * len(expected)
        for r in own:
            assert np.frombuffer(r.ids, dtype="<u4").tolist() == expected[r.start : r.start + r.length]


def test_packing_nothing(spark):
    assert packing.pack(spark, frame(spark, []), VOCABULARY).count() == 0


def thue_morse(length, first):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(length))


@pytest.mark.parametrize("length", [256, 512, 1024, 2048, 4096])
@pytest.mark.parametrize("first", [0, 1])
def test_texts_whose_polynomial_hashes_collide(tokenizer, length, first):
    """Thue-Morse texts collide modulo 2**64 whatever the base; each keeps its own ids."""
    encoder = packing.ChunkEncoder(VOCABULARY)
    for text in (thue_morse(length, first), thue_morse(length, 1 - first), "x " + thue_morse(length, first) + " y"):
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_all_hashes_collide(tokenizer, monkeypatch):
    """Ids do not depend on the hashes at all, within a call and between calls."""
    monkeypatch.setattr(packing.ChunkHasher, "hash", lambda self, data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    encoder = packing.ChunkEncoder(VOCABULARY)
    for i in range(3):
        texts = [prose(i, 20), prose(i + 50, 12), prose(i, 20)]
        got = encoder.encode([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_forgets_by_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 100)
    encoder = packing.ChunkEncoder(VOCABULARY)
    for i in range(4):
        text = prose(i, 40)
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.text_bounds[encoder.table.size] < 1000
