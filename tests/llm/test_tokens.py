"""BPE encoding, decoding and packing against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import bpe, packing, tokens
from wordloom.llm import kernels as K

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return bpe.library(PATH)


def encoded(texts, merge):
    data, offsets = K.text_buffers(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for _, _, _, ids, at in bpe.encode([(None, data, offsets)], merge, slice_bytes=64) for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stredvlmSD 1２ \n\t 　é日🙂.-!"), max_size=24), min_size=1, max_size=5))
def test_both_ways_equal_the_library(texts):
    library = bpe.library(PATH)
    want = [library.plain.encode_ordinary(t) for t in texts]
    assert encoded(texts, library) == want
    assert encoded(texts, lambda d, s, n: bpe.replay(d, s, n, library.vocab)) == want


def test_overlapping_pairs(library):
    words = ["a" * n for n in range(1, 40)] + ["ababab" * 7, "=" * 33]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    length = np.array([len(w) for w in words])
    ids, count = bpe.replay(data, np.cumsum(length) - length, length, library.vocab)
    ends = np.cumsum(count)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, count, strict=True)] == [library.plain._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_operator(odd, none, library):
    got = {(r.doc_id, bytes(r.decoded)): np.frombuffer(r.ids, "<u4").tolist() for r in tokens.encode_decode(odd, PATH).collect()}
    for r in odd.collect():
        text = r.text or ""
        assert got[r.doc_id, text.encode()] == library.plain.encode_ordinary(text)
    assert tokens.encode_decode(none, PATH).count() == 0


def check_packing(rows, texts, library, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = [*library.plain.encode_ordinary(texts[doc] or ""), 0], 0
        for r in sorted(parts, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(parts) == 1 or len(ids) > capacity)
        assert all(r.length == capacity for r in parts if r.piece)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing(odd, none, odd_ids, library):
    named = odd.where("doc_id IS NOT NULL")
    for capacity in (64, 2048):
        rows = packing.pack(named, PATH, capacity=capacity).collect()
        check_packing(rows, odd_ids, library, capacity)
    assert len(packing.pack(odd, PATH).select("sequence_id", "offset").distinct().collect()) == packing.pack(odd, PATH).count()
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_fills_use_every_length_once(sizes):
    counts = np.bincount(sizes, minlength=65)
    fills = packing.best_two_fit(counts, 64)
    used = np.zeros(65, int)
    for fill, times in fills:
        assert sum(fill) <= 64 and times >= 1
        np.add.at(used, fill, times)
    assert used.tolist() == counts.tolist()
    total = sum(t for _, t in fills)
    assert total <= 1.7 * (-(-sum(sizes) // 64)) + 1


def test_smallest_gives_way_to_two_that_fit_more_tightly():
    fills = packing.best_two_fit(np.bincount([60, 30, 27, 14], minlength=101), 100)
    assert fills[0] == ([60, 30], 1) or sum(fills[0][0]) > 90
    counts = np.bincount([50, 40, 29, 20], minlength=101)  # 50 + 40 leaves 10; 29 + 20 fits the place of 40
    assert packing.best_two_fit(counts, 100)[0] == ([50, 29, 20], 1)


JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_ids_are_the_tokenizers_own():
    """Added tokens in plain text are matched first, white space of any kind and odd letters included."""
    import random

    from tokenizers import Tokenizer

    whole, library = Tokenizer.from_file(JSON), bpe.library(JSON)
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\t", "'s", "'ll", "hello", " World", "12", "½", "é", "日本", "\u00a0", "\u2003", "\u3000", "\u0085", "\u200b", "😀", "\u0301", "\x1c", "\x00", "!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", ""]
    data, offsets = K.text_buffers(pa.array(texts))
    got = [ids[a:b].tolist() for _, _, _, ids, at in bpe.encode([(None, data, offsets)], library, slice_bytes=3000, added=library.vocab.added) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_texts_that_are_not_utf8_are_refused():
    with pytest.raises(ValueError, match="UTF-8"):
        bpe.pretokens(np.array([0x61, 0xFF, 0x62], np.uint8), np.array([0, 3]))
