"""MD5 of many short texts at once: the first seven hex digits, as `relational.seeded` has them."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(64).tolist()
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts of up to so many bytes are one block of the hash.
SHORT = 55


def blocks_of(ends: list[bytes], offset: int) -> np.ndarray:
    """Sixteen words of a block for each of these ends of texts of one length, behind `offset` bytes that are left zero."""
    n = len(ends[0])
    rows = np.zeros((len(ends), 64), np.uint8)
    rows[:, offset : offset + n] = np.frombuffer(b"".join(ends), np.uint8).reshape(len(ends), n)
    rows[:, offset + n] = 0x80
    rows[:, 56:58] = np.array([8 * (offset + n)], "<u2").view(np.uint8)
    return np.ascontiguousarray(rows.view("<u4").T)


def first_digits(begin: bytes, blocks: np.ndarray) -> np.ndarray:
    """The number of the first seven hex digits of the MD5 of `begin` and each end in `blocks_of(ends, len(begin))`."""
    own = np.frombuffer(begin + bytes(-len(begin) % 4), "<u4")
    words: list = [None] * 16
    for i in range(16):
        x = int(own[i]) if i < len(own) else 0
        same = i * 4 + 4 <= len(begin) or not blocks[i].any() or i >= 14
        words[i] = x | int(blocks[i, 0]) if same else blocks[i] | np.uint32(x)
    shape = blocks.shape[1]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not change the first word
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[k]
        if isinstance(w, int):
            np.add(a, np.uint32((SINES[i] + w) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, w, out=a)
            np.add(a, np.uint32(SINES[i]), out=a)
        np.add(f, a, out=f)
        np.left_shift(f, np.uint32(SHIFTS[i]), out=g)
        np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    # after step 61 the new word stands in b, and is the first of the sum
    b = b + np.uint32(START[0])
    return b.byteswap() >> np.uint32(4)


def digits_of(begin: bytes, end: bytes) -> int:
    """The same for one text of any length."""
    return int(hashlib.md5(begin + end).hexdigest()[:7], 16)
