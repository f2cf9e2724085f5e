"""Texts as chunks that recur: whole columns are cut at white space, and each different chunk is worked on once.

A chunk is a run of characters other than white space with the white space before it. What is worked out of a chunk
(token ids, word classes) may depend on nothing outside it. Chunks are found and numbered in numpy and Arrow, so
Python sees each different chunk of a batch once, however often it comes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is kept of chunks, in bytes as reckoned in _COST; a batch's own chunks may be more.
MOST_BYTES = 24 << 20
_COST = 200
_AT_ONCE = 4 << 20
_GROUP = 1 << 19
#: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The last two bytes of wider white space: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = np.zeros((256, 256), bool)
for _lead, _tails in ((0xC2, (0x85, 0xA0)), (0x9A, (0x80,)), (0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, (0x9F,))):
    _WIDE[_lead, list(_tails)] = True


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, without a copy, and where each value begins, the end last; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8), offsets - first


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and at ASCII white space behind anything but white space."""
    cut = np.zeros(len(data), bool)
    for a in range(2, len(data), _AT_ONCE):
        part = data[a - 2 : a + _AT_ONCE]
        space = _SPACE[part]
        cut[a : a + _AT_ONCE] = space[2:] & ~space[1:-1]
    cut[1:2] = _SPACE[data[1:2]] & ~_SPACE[data[:1]][: len(data) - 1]
    at = np.flatnonzero(cut)
    at = at[data[at - 1] >= 0x80]
    cut[at[_WIDE[data[at - 2], data[at - 1]]]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def gather(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + n[i]] for all i, in a row."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(first - (ends - n), n)]


class Chunks:
    """Numbers for the chunks of texts. learn takes different chunks and gives their numbers in a row, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most_bytes: int = MOST_BYTES):
        self.learn, self.most = learn, most_bytes
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.values, self.first, self.n, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _places(self, keys: list[bytes], often: np.ndarray) -> np.ndarray:
        """Where the numbers of different chunks are. Only chunks that come often are kept for later calls."""
        out = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(out < 0)
        if not len(fresh):
            return out
        kept = fresh[often[fresh]]
        cost = sum(map(len, map(keys.__getitem__, kept.tolist()))) + _COST * len(kept)
        if len(kept) and self.held + cost > self.most:
            self.clear()
            fresh, kept = np.arange(len(keys)), np.flatnonzero(often)
            cost = sum(map(len, map(keys.__getitem__, kept.tolist()))) + _COST * len(kept)
        order = np.concatenate((kept, fresh[~often[fresh]]))
        values, n = self.learn([keys[i] for i in order.tolist()])
        at = len(self.place)
        out[order] = np.arange(at, at + len(order))
        self.place.update(zip(map(keys.__getitem__, kept.tolist()), range(at, at + len(kept)), strict=True))
        self.first = np.concatenate((self.first, len(self.values) + np.cumsum(n) - n))
        self.n, self.values, self.held = np.concatenate((self.n, n)), np.concatenate((self.values, values)), self.held + cost
        return out

    def _forget(self) -> None:
        """Drop the numbers of chunks that aren't kept; they stand last."""
        n = len(self.place)
        if n < len(self.n):
            self.values = self.values[: self.first[n]].copy()
            self.first, self.n = self.first[:n].copy(), self.n[:n].copy()

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts in a row, and where each text's begin, the end last."""
        data, offsets = flat_bytes(texts)
        at = starts(data, offsets)
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(at) + 1, np.int64)
        for k in range(0, len(at), _GROUP):
            edges = at[k : k + _GROUP + 1] if k + _GROUP < len(at) else np.append(at[k:], len(data))
            n = len(edges) - 1
            # large offsets, for one text may pass 2 GB
            chunks = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(edges - edges[0])), pa.py_buffer(data[edges[0] : edges[-1]])]).dictionary_encode()
            at_entry = chunks.indices.to_numpy()
            place = self._places(chunks.dictionary.to_pylist(), np.bincount(at_entry, minlength=len(chunks.dictionary)) > 1)[at_entry]
            each = self.n[place]
            counts[k + 1 : k + 1 + n] = each
            out.append(gather(self.values, self.first[place], each))
            self._forget()
        return np.concatenate(out), np.cumsum(counts)[np.searchsorted(at, offsets)]
