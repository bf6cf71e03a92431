"""Token ids and counts by the public tokenizers, with a bounded cache of stretches.

A text is cut only at places where the tokenizer's own rules cut it too, so
that the ids of the stretches, laid end to end, are the ids of the text. Texts
for which that can't be told cheaply go to the library whole. ``WordIds.batch``
encodes many texts together; the merges of their words are made side by side.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import byte_alphabet

#: Stretches in one generation of a worker's cache; there are two.
ENTRIES = 300_000
#: Longer stretches aren't kept.
LONGEST = 64
#: A stretch that ends in ASCII marks other than the apostrophe, after a Latin
#: letter or a digit: every tokenizer here cuts between the two (not after I
#: with a dot, whose lower case ends in a combining mark).
MARKED = re.compile(rb"(.*(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf]))([!-&(-/:-@\[-`{-~]+)\Z")

#: Stretches that are one piece of letters and don't change in normalisation.
LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
LETTERS = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def load(name: str):
    """The library's tokenizer for a vocabulary file of the given name."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version(name: str) -> str:
    """sha256 of the vocabulary file: the tokenizer-version digest."""
    import hashlib

    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Kept(dict):
    """What ``make`` gives for a stretch. When a generation is full it becomes the
    old one; what is asked for again moves over, so frequent stretches stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def worker_wide(key: tuple, make):
    """One object for all tasks of a Python worker: their caches stay warm."""
    home = sys.modules.setdefault("_corpusmill_worker", types.ModuleType("_corpusmill_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


class Merges:
    """Byte-pair merges of many words at once, for a vocabulary of merges alone (no dropout, no prefix, no fallback).

    All words of a block take their next merge together: of the pairs that have a
    rank the lowest, the leftmost of equals, which is the order of the library.
    """

    #: Words of one block; its arrays stay in a core's cache.
    WORDS = 16_384
    #: Words of a block are padded to the next of these lengths. A place takes six bits.
    WIDTHS = (4, 8, 12, 16, 24, 32, LONGEST)
    NEVER = np.int32(2**31 - 1)

    def __init__(self, name: str):
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        ranks = {}
        for k, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            ranks[vocab[left] << 32 | vocab[right]] = k, vocab[left + right]
        self.made = np.zeros(len(model["merges"]), np.int32)
        keys = np.array(list(ranks), np.int64)
        rank, made = np.array(list(ranks.values()), np.int32).reshape(-1, 2).T
        self.made[rank] = made
        # Open addressing; at most a quarter of the slots are taken.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NEVER >> 6, np.int32)
        at = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.ranks[at[free]] = keys[free], rank[free]
            stays = np.ones(len(keys), bool)
            stays[free] = False
            keys, rank, at = keys[stays], rank[stays], (at[stays] + 1) & (len(self.keys) - 1)
        self.inner, self.last = (np.array([vocab[c + x] for _, c in sorted(byte_alphabet().items())], np.int32) for x in ("", end))
        # Ranks of two bytes inside a word and at its end.
        self.two = [self.rank(np.repeat(self.inner, 256), np.tile(x, 256)) for x in (self.inner, self.last)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of ids; NEVER >> 6 where they don't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slots(keys)
        held = self.keys[at]
        out = self.ranks[at]
        further = np.flatnonzero((held != keys) & (held != -1))
        while len(further):
            at[further] = (at[further] + 1) & (len(self.keys) - 1)
            held = self.keys[at[further]]
            out[further] = self.ranks[at[further]]
            further = further[(held != keys[further]) & (held != -1)]
        return out

    def block(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of 1 to ``width`` bytes that start at these places of ``data``, laid end to end, and how many each has."""
        n = len(start)
        row = np.arange(width + 1, dtype=np.int32)[:, None]
        chars = data[np.minimum(start + row, len(data) - 1)]
        # The last row is the outside: id -1, which merges with nothing.
        ids = np.where(row < size - 1, self.inner[chars], np.where(row == size - 1, self.last[chars], -1)).astype(np.int32)
        ids[width] = -1
        pair = chars[:-1].astype(np.int32) << 8 | chars[1:]
        rank = np.where(row[:-1] < size - 2, self.two[0][pair], np.where(row[:-1] == size - 2, self.two[1][pair], self.NEVER >> 6))
        # Rank and row of the pair that begins in a place; neighbours as places.
        order = np.full((width + 1, n), self.NEVER, np.int32)
        order[:-1] = np.where(rank < self.NEVER >> 6, rank << 6 | row[:-1], self.NEVER)
        place = np.arange((width + 1) * n, dtype=np.int32).reshape(width + 1, n)
        after, before = np.empty_like(place), np.empty_like(place)
        after[:-1], after[-1], before[1:], before[0] = place[1:], place[-1], place[:-1], place[-1]
        ids, order, after, before = (x.reshape(-1) for x in (ids, order, after, before))
        grid = order.reshape(width + 1, n)[:-1]
        while True:
            best = grid.min(axis=0)
            word = np.flatnonzero(best != self.NEVER)
            if not len(word):
                break
            best = best[word]
            at = (best & 63) * np.int32(n) + word
            gone = after[at]
            right, left = after[gone], before[at]
            new = self.made[best >> 6]
            ids[at], ids[gone], order[gone] = new, -1, self.NEVER
            after[at], before[right] = right, at
            found = self.rank(new, ids[right])
            order[at] = np.where(found < self.NEVER >> 6, found << 6 | best & 63, self.NEVER)
            found = self.rank(ids[left], new)
            order[left] = np.where(found < self.NEVER >> 6, found << 6 | left // np.int32(n), self.NEVER)
        ids = ids.reshape(width + 1, n).T
        stays = ids >= 0
        return ids[stays].astype("<u4"), stays.sum(axis=1)

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of words, their ids end to end, how many each has) for words of 1 to LONGEST bytes."""
        group = np.searchsorted(self.WIDTHS, size)
        for k, width in enumerate(self.WIDTHS):
            own = np.flatnonzero(group == k)
            for at in range(0, len(own), self.WORDS):
                part = own[at : at + self.WORDS]
                yield part, *self.block(data, start[part], size[part], width)


def _flags(size: int, where) -> np.ndarray:
    out = np.zeros(size, bool)
    out[list(where)] = True
    return out


def _binary(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large binary array without nulls that begins at its buffers' start."""
    return np.frombuffer(a.buffers()[1], np.int64, len(a) + 1), np.frombuffer(a.buffers()[2] or b"", np.uint8)


class WordIds:
    """Ids by a word-piece BPE whose pieces never hold white space (its normaliser drops it) and have no ASCII capitals."""

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.model, self.table = self.tokenizer.model, byte_alphabet()
        self.merges = Merges(name)
        # The classes of MARKED and LOWER by byte, or by two bytes.
        self.mark = _flags(256, (b for b in range(256) if MARKED.match(b"a" + bytes([b]))))
        self.latin = _flags(1 << 16, (b for b in range(1 << 16) if MARKED.match(b.to_bytes(2) + b".")))
        self.small = _flags(256, (b for b in range(256) if LOWER.fullmatch(bytes([b]))))
        self.small_two = _flags(1 << 16, (b for b in range(1 << 16) if not self.small[b >> 8] and LOWER.fullmatch(b.to_bytes(2))))
        self.parts = _Kept(self.encoded)
        self.kept = _Kept(self.split)

    def encoded(self, w: bytes) -> bytes:
        if LOWER.fullmatch(w):
            return np.array([t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.table))], "<u4").tobytes()
        return np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def split(self, w: bytes) -> bytes:
        m = None if b"<|" in w else MARKED.match(w)
        return self.parts[m[1]] + self.parts[m[2]] if m else self.parts[w]

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        # Folding capitals first makes equal stretches meet; it could make a special token.
        return b"".join(map(self.kept.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of every text (null: none). Each distinct stretch is split once and each distinct part encoded once."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, None, texts)))
        flat = words.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0))])
        offsets, data = _bytes_of(self.stretches(flat.dictionary.cast(pa.large_binary())).take(flat.indices))
        data = memoryview(data)
        out = [bytes(data[a:b]) for a, b in itertools.pairwise(offsets[ends].tolist())]
        for i in np.flatnonzero(special):
            out[i] = self.ids(texts[int(i)].cast(pa.binary()).as_py())
        return out

    def stretches(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of stretches without white space, capitals or special tokens: ``split`` of each."""
        offsets, data = _bytes_of(words)
        # The last byte that is no mark, if it lies in the stretch and not at its end, and ends a letter or digit.
        solid = np.maximum.accumulate(np.where(self.mark[data], -1, np.arange(len(data))))
        last = solid[offsets[1:] - 1] if len(data) else offsets[1:] - 1
        marked = np.flatnonzero((last >= offsets[:-1]) & (last < offsets[1:] - 1))
        last = last[marked]
        before = np.where(last > offsets[:-1][marked], data[last - 1], 0).astype(np.int32)
        ends = self.latin[before << 8 | data[last]]
        marked, last = marked[ends], last[ends]
        pieces = np.ones(len(words), np.int64)
        pieces[marked] = 2
        parts = _binary(np.sort(np.concatenate([offsets, last + 1])), data).dictionary_encode()
        laid = self.encode(parts.dictionary).take(parts.indices)
        offsets, data = _bytes_of(laid)
        return _binary(offsets[np.concatenate([[0], np.cumsum(pieces)])], data)

    def encode(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """``encoded`` of each."""
        offsets, data = _bytes_of(parts)
        start, size = offsets[:-1], np.diff(offsets)
        # Bytes that are no small Latin letter by themselves or with the one beside them in the same part.
        inside = np.ones(len(data) + 1, bool)
        inside[offsets] = False
        two = np.zeros(len(data) + 1, bool)
        two[1:-1] = self.small_two[data[:-1].astype(np.int32) << 8 | data[1:]] & inside[1:-1] if len(data) else False
        other = np.concatenate([[0], np.cumsum(~(self.small[data] | two[:-1] | two[1:]))])
        plain = (other[offsets[1:]] == other[start]) & (size > 0) & (size <= LONGEST)
        counts = np.zeros(len(parts), np.int64)
        done = []
        small = np.flatnonzero(plain)
        for own, ids, n in self.merges.ids(data, start[small], size[small]):
            done.append((small[own], ids, n))
        rest = np.flatnonzero(~plain)
        ids = [self.parts[w] for w in parts.take(pa.array(rest)).to_pylist()]
        done.append((rest, np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)))
        for own, _, n in done:
            counts[own] = n
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], "<u4")
        for own, ids, n in done:
            out[np.repeat(offsets[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return _binary(4 * offsets, out)


class ByteCounts:
    """Number of ids by a byte-level BPE whose pieces start with at most one blank.

    Cutting before a single blank is exact. Texts with runs of white space, rare
    white space, or what may be a special token are counted whole.
    """

    HARD = re.compile(rb"[ \t-\r]{2}|[\x1c-\x1f]|<\||\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8-\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf")

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.model, self.table = self.tokenizer.model, byte_alphabet()
        self.parts = _Kept(self.piece)
        self.kept = _Kept(self.split)

    def piece(self, w: bytes) -> int:
        if LETTERS.fullmatch(w):
            return len(self.model.tokenize(w.decode("latin-1").translate(self.table)))
        return self.whole(w)

    def split(self, w: bytes) -> int:
        m = MARKED.match(w)
        return self.parts[b" " + m[1]] + self.parts[m[2]] if m else self.parts[b" " + w]

    def whole(self, text: bytes) -> int:
        return len(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def count(self, text: bytes) -> int:
        if self.HARD.search(text):
            return self.whole(text)
        first, *rest = text.split(b" ")
        return (self.whole(first) if first else 0) + sum(map(self.kept.__getitem__, rest))
