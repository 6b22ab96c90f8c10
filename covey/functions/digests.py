"""MD5 of many short texts at once, as numpy arrays: its first 32 bits, which is what draws are ordered by."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are hashed at once.
HASHED = 16384
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]


def first_bits(words: list) -> np.ndarray:
    """Of blocks of 16 words, each one number for all or an array (one at least), the first 32 bits of their MD5 (draw_int() of it)."""
    n = max(np.size(w) for w in words)
    words = [w.astype(np.uint32) if isinstance(w, np.ndarray) else np.uint32(w) for w in words]
    start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(61):  # what the first word ends as is there after 61 of 64 steps
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                g = 7 * i % 16
            f += a
            if isinstance(words[g], np.ndarray):
                f += words[g]
                f += np.uint32(_SINES[i])
            else:
                f += words[g] + np.uint32(_SINES[i])
            np.left_shift(f, np.uint32(_TURNS[i]), out=t)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
            f |= t
            f += b
            a, d, c, b, f = d, c, b, f, a
        return (b + start[0]).byteswap()


class Texts:
    """Values as Spark casts them to a string: rows of bytes, and their lengths. Whole numbers and strings."""

    def __init__(self, values: pa.Array):
        texts = values.cast(pa.string()).cast(pa.binary())
        self.lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = np.zeros((len(texts), int(self.lengths.max(initial=0))), np.uint8)
        if self.bytes.size:
            begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
            self.bytes[np.arange(self.bytes.shape[1]) < self.lengths[:, None]] = np.frombuffer(texts.buffers()[2], np.uint8)[begin : begin + self.lengths.sum()]


def draws_of(seed: int, a: Texts, at_a: np.ndarray, b: Texts, at_b: np.ndarray) -> np.ndarray:
    """draw_int(draw_key(seed, a, b)) of the pairs of the at_a-th of a and the at_b-th of b."""
    head, out = np.frombuffer(f"{seed}|".encode(), np.uint8), np.empty(len(at_a), np.uint32)
    lengths = a.lengths[at_a]
    for n in np.unique(lengths).tolist():
        rows, begin = np.flatnonzero(lengths == n), len(head) + n + 1
        for low in range(0, len(rows), HASHED):
            own = rows[low : low + HASHED]
            i, j = at_a[own], at_b[own]
            if begin + b.bytes.shape[1] > 55:  # more than a block
                texts = (head.tobytes() + a.bytes[x, :n].tobytes() + b"|" + b.bytes[y, : b.lengths[y]].tobytes() for x, y in zip(i, j, strict=True))
                out[own] = [int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in texts]
                continue
            block = np.zeros((len(own), 64), np.uint8)
            block[:, : len(head)], block[:, len(head) : begin - 1], block[:, begin - 1] = head, a.bytes[i, :n], ord("|")
            block[:, begin : begin + b.bytes.shape[1]] = b.bytes[j]
            end = begin + b.lengths[j]
            block[np.arange(len(own)), end] = 128
            used = (begin + b.bytes.shape[1]) // 4 + 1
            words = list(np.ascontiguousarray(block.view("<u4")[:, :used].T)) + [0] * (16 - used)
            words[14] = 8 * end
            out[own] = first_bits(words)
    return out
