"""Byte-level BPE over buffers: pretokens by array operations, merges once per distinct pretoken."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex

from . import kernels as K

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The suffixes that the public pattern keeps with their apostrophe (fixed values).
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties of the ``regex`` library."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            table[a:b] = kind
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and length of each match of the public pattern, and the first match of each row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    try:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError as e:
        raise ValueError("a text is not UTF-8: decode binary columns with their character set before they are cast to string") from e
    if len(cp) == len(data):
        byte_at, doc_at = None, offsets
    else:
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        doc_at = np.searchsorted(byte_at, offsets)
    kind = char_classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[doc_at] = True
    cut = first[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # the last white space before a visible run stands alone, or leads the run if it is U+0020
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    cut[after - 1] = True
    cut[after[cp[after - 1] == 0x20]] = False
    # an apostrophe that starts a match keeps a listed suffix
    quote = np.flatnonzero((cp[:-1] == 0x27) & cut[:-1] & ~first[1:n] & (kind[1:] == LETTER))
    for suffix in SUFFIXES:
        k, q = len(suffix), quote
        for j, c in enumerate(suffix, 1):
            q = q[q + j < n]
            q = q[(cp[q + j] == ord(c)) & ~first[q + j]]
        cut[q + 1] = False
        q = q[q + k + 1 < n]
        cut[q + k + 1] = True
    at = np.flatnonzero(cut)
    row = np.searchsorted(at, doc_at)
    start = at if byte_at is None else byte_at[at]
    return start, np.diff(start, append=len(data)), row


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as its visible Latin-1 character, the others as U+0100 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ranks of a ``.tiktoken`` or ``.json`` file with the tables that merging and decoding need.

    added: tokens of a ``.json`` file that are matched in plain text before it is split, and their ids.
    """

    def __init__(self, path: str):
        self.added: dict[bytes, int] = {}
        with open(path, "rb") as f:
            if path.endswith(".json"):
                held, letters = json.load(f), byte_letters()
                plain = all(not t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
                if not plain or held["model"]["type"] != "BPE" or held["normalizer"] is not None or held["pre_tokenizer"].get("add_prefix_space"):
                    raise ValueError(f"{path} is not a plain byte-level BPE")
                self.added = {t["content"].encode(): t["id"] for t in held["added_tokens"]}
                self.ranks = {bytes(letters[c] for c in w): i for w, i in held["model"]["vocab"].items() if w.encode() not in self.added}
            else:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        words += [b""] * (max(self.added.values(), default=0) + 1 - size)
        for w, r in (self.ranks | self.added).items():
            words[r] = w
        self.byte_len = np.array([len(w) for w in words], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for w, r in self.ranks.items():
            for i in range(1, len(w)):
                left, right = self.ranks.get(w[:i]), self.ranks.get(w[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = r
        self.pair_keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(self.pair_keys)
        self.pair_keys = self.pair_keys[order]
        self.pair_rank = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return K.gather(self.bytes, self.byte_at[ids], self.byte_len[ids])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the vocabulary has no such merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(data: np.ndarray, start: np.ndarray, length: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge replay over a list of words: ids one after another, and the number of ids of each word.

    ``index`` maps a merge's rank to the positions whose pair has it. The lowest rank in the index
    is applied everywhere at once; only the pairs that touch a merged place are looked up again and
    entered under their new rank, so a merge costs what it changes.
    """
    sym = vocab.single[K.gather(data, start, length)]
    n = len(sym)
    if not n:
        return sym, np.zeros(len(length), np.int64)
    begin = np.cumsum(length) - length
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[np.cumsum(length) - 1] = -1
    prv[begin] = -1
    rank = np.full(n, -1, np.int64)
    has = np.flatnonzero(nxt >= 0)
    rank[has] = vocab.rank_of(sym[has], sym[has + 1])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(pos: np.ndarray) -> None:
        r = rank[pos]
        keep = r >= 0
        pos, r = pos[keep], r[keep]
        if not len(pos):
            return
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        bounds = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            x = int(r[a])
            if x in index:
                index[x].append(pos[a:b])
            else:
                index[x] = [pos[a:b]]
                heapq.heappush(heap, x)

    enter(has)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        pos = found[0] if len(found) == 1 else np.concatenate(found)
        pos = pos[alive[pos] & (rank[pos] == r)]
        if len(pos) > 1:
            pos = np.unique(pos)
            linked = nxt[pos[:-1]] == pos[1:]
            if linked.any():  # overlapping pairs: the leftmost of each chain, then every second one
                chain_at = np.concatenate(([0], np.flatnonzero(~linked) + 1))
                depth = np.arange(len(pos)) - np.repeat(chain_at, np.diff(chain_at, append=len(pos)))
                pos = pos[depth % 2 == 0]
        elif not len(pos):
            continue
        gone = nxt[pos]
        sym[pos] = r
        alive[gone] = False
        follow = nxt[gone]
        nxt[pos] = follow
        ok = follow >= 0
        prv[follow[ok]] = pos[ok]
        rank[pos] = -1
        right = pos[ok]
        before = prv[pos]
        left = before[before >= 0]
        touched = np.concatenate((right, left))
        if len(touched):
            rank[touched] = vocab.rank_of(sym[touched], sym[nxt[touched]])
            enter(touched)
    word = np.repeat(np.arange(len(length)), length)
    return sym[alive], np.bincount(word[alive], minlength=len(length))


class Library:
    """Ids of distinct pretokens by the tiktoken library, in one call for all of them.

    The pretokens stand between line feeds. The pattern keeps a line feed apart from any pretoken
    without white space but a leading U+0020, so the line feed's id separates the results; the few
    other pretokens go one by one.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.vocab = vocabulary(path)
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.vocab.ranks, special_tokens={})
        self.feed = self.vocab.ranks[b"\n"]

    def __call__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        last = data[start + length - 1]
        head = data[start]
        odd = (last <= 0x20) | ((head <= 0x20) & (head != 0x20)) | (last >= 0xC2) | (head == 0x27)
        # ends in white space outside ASCII, or nearly: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000
        back = [data[np.maximum(start + length - k, start)] for k in (1, 2, 3)]
        odd |= (back[1] == 0xC2) & ((back[0] == 0x85) | (back[0] == 0xA0))
        odd |= (back[2] == 0xE1) & (back[1] == 0x9A) | (back[2] == 0xE3) & (back[1] == 0x80) | (back[2] == 0xE2) & ((back[1] == 0x81) | (back[1] == 0x80) & ((back[0] < 0x8B) | (back[0] >= 0xA8)))
        odd |= np.isin(length, [len(t) for t in self.vocab.added])  # a pretoken can be such a token whole, and nothing else is
        even = np.flatnonzero(~odd)
        total = int(length[even].sum()) + len(even)
        text = np.full(total, 0x0A, np.uint8)
        end = np.cumsum(length[even] + 1)
        keep = np.ones(total, bool)
        keep[end - 1] = False
        text[keep] = K.gather(data, start[even], length[even])
        ids = np.frombuffer(self.plain.encode_to_numpy(text.tobytes().decode(), disallowed_special=()), np.uint32) if total else np.zeros(0, np.uint32)
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(even):
            raise RuntimeError("the pattern joined two pretokens")
        count = np.zeros(len(start), np.int64)
        count[even] = np.diff(feeds, prepend=-1) - 1
        raw, added, merged = data.tobytes(), self.vocab.added, self.plain._core_bpe.encode_single_piece
        one = lambda w: [added[w]] if w in added else merged(w)
        rest = {i: one(raw[a : a + n]) for i, a, n in zip(np.flatnonzero(odd).tolist(), start[odd].tolist(), length[odd].tolist(), strict=True)}
        for i, x in rest.items():
            count[i] = len(x)
        flat = np.empty(int(count.sum()), np.uint32)
        owner_odd = np.repeat(odd, count)
        flat[~owner_odd] = ids[ids != self.feed]
        flat[owner_odd] = np.fromiter(chain.from_iterable(rest[i] for i in sorted(rest)), np.uint32)
        return flat, count


@lru_cache(2)
def library(path: str) -> Library:
    return Library(path)


def spread(flat: np.ndarray, count: np.ndarray, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From ids by distinct pretoken to ids by row."""
    many = count[code]
    ids = K.gather(flat, (np.cumsum(count) - count)[code], many)
    return ids, np.concatenate(([0], np.cumsum(many)))[row]


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each key, and the place where each code is first seen."""
    code, distinct = pd.factorize(keys)
    sample = np.empty(len(distinct), np.int64)
    sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, sample


def with_added(data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``pretokens``, where each added token in the text is one match and what stands around it is split apart."""
    raw, spans = data.tobytes(), []
    if added and any(t in raw for t in added):
        pattern = regex.compile(b"|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spans += [(a + m.start(), a + m.end()) for m in pattern.finditer(raw[a:b])]
    if not spans:
        return pretokens(data, offsets)
    at = np.array(spans, np.int64)
    cuts = np.unique(np.concatenate((offsets, at.ravel())))
    start, length, _ = pretokens(data, cuts)
    inside = np.searchsorted(at[:, 0], start, "right") - 1
    within = (inside >= 0) & (start > at[inside, 0]) & (start < at[inside, 1])
    start, length = start[~within], length[~within]
    length[np.searchsorted(start, at[:, 0])] = at[:, 1] - at[:, 0]
    return start, length, np.searchsorted(start, offsets)


def encode(parts: Iterable[tuple[object, np.ndarray, np.ndarray]], merge: Callable, slice_bytes: int = 4 << 20, most: int = 3_000_000, added: dict[bytes, int] | None = None) -> Iterator[tuple[object, int, int, np.ndarray, np.ndarray]]:
    """Encodes texts, each distinct pretoken once per about ``most`` pretokens.

    parts: ``(payload, data, offsets)``. merge: from distinct pretokens ``(data, start, length)`` to
    their ids and counts; added: tokens that are matched in plain text first. Yields ``(payload, lo, hi, ids, at)`` for the rows lo to hi of a part, in order.
    """
    held: list = []
    pieces = 0

    def flush():
        keys = np.concatenate([x[4] for x in held])
        length = np.concatenate([x[6] for x in held])
        data = np.concatenate([x[5] for x in held])
        check = np.concatenate([x[7] for x in held])
        code, sample = first_of(keys)
        if not np.array_equal(check[sample][code], check):  # two pretokens have one hash
            code, sample = first_of(keys ^ K.mix(check))
        flat, count = merge(data, (np.cumsum(length) - length)[sample], length[sample])
        at = 0
        for payload, lo, hi, local, kinds_here, _, _, _, row in held:
            mine = code[at : at + len(kinds_here)]
            at += len(kinds_here)
            yield payload, lo, hi, *spread(flat, count, mine[local] if len(local) else mine[:0], row)

    for payload, data, offsets in parts:
        for lo, hi in K.slices(offsets, slice_bytes):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            start, length, row = with_added(d, o, added or {})
            h = K.span_hash(d, start, length)
            local, sample = first_of(h)
            s, n = start[sample], length[sample]
            held.append((payload, lo, hi, local.astype(np.int32), h[sample], K.gather(d, s, n), n, K.span_hash(d, s, n, 1), row))
            pieces += len(local) + 4 * len(sample)
            if pieces > most:
                yield from flush()
                held.clear()
                pieces = 0
    if held:
        yield from flush()
