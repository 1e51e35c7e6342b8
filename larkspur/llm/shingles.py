"""Vectorised hashing of words and shingles over Arrow string buffers.

Nothing here makes a Python object per word: the UTF-8 bytes of a column are
one numpy buffer, and words are found with a byte table. A span is hashed by
its blocks of eight bytes: each is mixed with a key of its place by a bijection
of 64-bit values, and the mixed blocks are summed. (A polynomial in the bytes
would be cheaper for long spans, but modulo 2**64 it has short collisions.)

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D`` with A-Z
lower-cased. A shingle is five consecutive words; a shorter, non-empty
sequence is one shingle of its own. Shingles are compared by 64-bit hashes
within a pair of documents. Where equal hashes merge rows of a whole corpus,
callers take ``both()``: two hashes of independent keys, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
SLICE_BYTES = 1 << 18  # text bytes hashed at once; one longer text is a slice of its own


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the first k bytes of a block


class Spans:
    """Hashes of arbitrary spans of a byte buffer."""

    def __init__(self, data: np.ndarray, lower: bool = True):
        own = np.empty(len(data) + 8, dtype=np.uint8)
        own[: len(data)], own[len(data) :] = _FOLD[data] if lower else data, 0
        self.blocks = np.ndarray((len(data) + 1,), "<u8", own, strides=(1,)).copy()  # the eight bytes from each place

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hash(*self._parts(start, end), 0)

    def of_eight(self, start: np.ndarray) -> np.ndarray:
        """Of the eight bytes from each place on: the same as self(start, start + 8)."""
        return mix(self.blocks[start] ^ _U(8 * _ODD[0] % (1 << 64)))

    def both(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each span."""
        parts = self._parts(start, end)
        return self._hash(*parts, 1), self._hash(*parts, 2)

    def _parts(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sizes, first blocks, which spans have more, where those of each begin, and the others' blocks and places."""
        size = end - start
        head = self.blocks[start] & _HEAD[np.minimum(size, 8)]
        long = np.flatnonzero(size > 8)
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        rest = self.blocks[np.repeat(start[long], more) + 8 * place] & _HEAD[np.minimum(np.repeat(size[long], more) - 8 * place, 8)]
        return size, head, long, first, rest, place

    @staticmethod
    def _hash(size: np.ndarray, head: np.ndarray, long: np.ndarray, first: np.ndarray, rest: np.ndarray, place: np.ndarray, key: int) -> np.ndarray:
        key = key * 0x9E3779B97F4A7C15 % (1 << 64)
        h = mix(head ^ (size.astype(np.uint64) * _U(_ODD[0]) + _U(key)))
        if len(long):
            h[long] = mix(h[long] + np.add.reduceat(mix(rest ^ mix(place.astype(np.uint64) * _U(_ODD[1]) + _U(key))), first))
        return h


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()).fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the place of each text's first word (one more entry than texts)."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of all texts in order, and each text's first place."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    places = np.concatenate(([0], np.cumsum(sizes)))
    if places[-1] == 0:
        return np.empty(0, dtype=np.uint64), places
    text = np.repeat(np.arange(len(counts)), sizes)
    at = first[text] + (np.arange(places[-1]) - places[text])
    left = np.minimum(counts[text], k)  # words in each shingle
    padded = np.concatenate((words, np.zeros(k, dtype=np.uint64)))
    h = left.astype(np.uint64)
    for i in range(k):
        h = h + np.where(i < left, mix(padded[at + i] + _U(i * _ODD[1] % (1 << 64))), _U(0)) if i >= 1 else h + mix(padded[at])
        h *= _U(_ODD[2])
    return mix(h), places


def distinct_sorted(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words or text."""
    for _, _, data, offsets in text_slices(column):
        starts, ends, first = words_of(data, offsets)
        hashes, places = word_shingles(Spans(data)(starts, ends), first, k)
        for a, b in zip(places[:-1], places[1:]):
            yield distinct_sorted(hashes[a:b])


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def parity_sketch(h: np.ndarray, bits: int = 2048) -> np.ndarray:
    """Each value flips one bit; two sketches differ in at most as many bits as the sets differ in values."""
    odd = np.bincount((h >> _U(23)) % _U(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))
