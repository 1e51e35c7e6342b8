"""The order of md5 over many short texts, by numpy: what hash_order() sorts by, without a row for each text and seed."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

PIECE = 16_384  # texts that are hashed at once
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Texts:
    """Texts in an order, as byte matrices of equal length (and the places of their rows)."""

    def __init__(self):
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data, sizes = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.diff(offsets)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), PIECE):
                some = at[i : i + PIECE]
                self.pieces.append(((some + self.n).astype(np.int64), data[offsets[some][:, None] + np.arange(size)]))
        self.n += len(texts)

    def heads(self, prefix: bytes) -> np.ndarray:
        """The first eight bytes of md5(prefix + text), as numbers."""
        out = np.empty(self.n, np.uint64)
        for at, texts in self.pieces:
            out[at] = _heads(prefix, texts)
        return out

    def drawn(self, prefix: bytes, codes: np.ndarray) -> np.ndarray:
        """codes (0 to 3) in that order. Each is sorted with its hash, whose last two bits it takes."""
        keys = self.heads(prefix)
        keys &= ~np.uint64(3)
        keys |= codes.astype(np.uint64)
        keys.sort()
        out = (keys & np.uint64(3)).astype(np.int8)
        keys >>= np.uint64(2)
        return codes[self.order(prefix)] if (keys[1:] == keys[:-1]).any() else out

    def order(self, prefix: bytes) -> np.ndarray:
        """Places by md5(prefix + text), then place."""
        heads = self.heads(prefix)
        order = np.argsort(heads)
        ranked = heads[order]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        if len(same):  # whole digests tell these apart
            where = np.unique(np.concatenate((same, same + 1)))
            asked, digests = np.sort(order[where]), {}
            for at, texts in self.pieces:
                for i in np.flatnonzero(np.isin(at, asked)):
                    digests[int(at[i])] = hashlib.md5(prefix + texts[i].tobytes()).digest()
            order[where] = sorted(order[where].tolist(), key=lambda i: (digests[i], i))
        return order


def _heads(prefix: bytes, texts: np.ndarray) -> np.ndarray:
    n, size = texts.shape
    length = len(prefix) + size
    if length > 55:  # more than one block
        return np.array([int.from_bytes(hashlib.md5(prefix + t.tobytes()).digest()[:8]) for t in texts], np.uint64)
    message = np.zeros((n, 64), np.uint8)
    message[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    message[:, len(prefix) : length] = texts
    message[:, length] = 0x80
    used = length // 4 + 1
    words = np.ascontiguousarray(message.view("<u4").T[:used])
    words = [words[i] if i < used else np.uint32(8 * length if i == 14 else 0) for i in range(16)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    spare = np.empty(n, np.uint32)
    for i in range(64):
        f = np.empty(n, np.uint32)
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + int(words[g])) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=spare)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=f)
        np.bitwise_or(f, spare, out=f)
        f += b
        a, d, c, b = d, c, b, f
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap().astype(np.uint64)
