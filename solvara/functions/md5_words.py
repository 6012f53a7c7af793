"""``md5_int`` of many short strings at once: each is a whole number followed by one of a few endings."""

from __future__ import annotations

from hashlib import md5

import numpy as np

#: Strings that are worked on at once, and bytes of an ending up to which number and ending fit one block of md5.
_SLICE, _LONGEST = 8192, 45
_ADD = [np.uint32(int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURN = [s for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in turns]


def md5_int_of(text: bytes) -> int:
    """First 32 bits of md5, as ``expressions.md5_int`` gives them."""
    return int.from_bytes(md5(text).digest()[:4], "big")


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """First 32 bits of md5 of padded 64-byte blocks, one a row."""
    x = np.ascontiguousarray(blocks.view("<u4").T)
    start = np.full(x.shape[1], 0x67452301, dtype="u4")
    a, b, c, d = (start, *(np.full(x.shape[1], v, dtype="u4") for v in (0xEFCDAB89, 0x98BADCFE, 0x10325476)))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _ADD[i]
        f += x[g]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURN[i])) | (f >> np.uint32(32 - _TURN[i])))
    return (a + start).astype("<u4").view(">u4").astype("i8")


def md5_ints(number: np.ndarray, endings: list[bytes], which: np.ndarray) -> np.ndarray:
    """``md5_int`` of the decimal digits of ``number[i]`` (0 to 2^32 - 1) and ``endings[which[i]]``.

    A number of -1 stands for NULL: the string is the ending without its first byte, the separator.
    """
    out = np.zeros(len(number), dtype="i8")
    size = np.array([len(e) for e in endings], dtype="i8")
    by_block = (number >= 0) & (size[which] <= _LONGEST)
    for i in np.flatnonzero(~by_block).tolist():
        end = endings[which[i]]
        out[i] = md5_int_of(b"%d%b" % (number[i], end) if number[i] >= 0 else end[1:])
    width = int(size[size <= _LONGEST].max(initial=0)) + 1
    padded = np.array([list((e + b"\x80").ljust(width, b"\0")) if len(e) <= _LONGEST else [0] * width for e in endings], dtype="u1").reshape(-1, width)
    places = np.flatnonzero(by_block)
    for at in range(0, len(places), _SLICE):
        some = places[at:at + _SLICE]
        n, end = number[some], which[some]
        digits = 1 + sum((n >= 10**k).astype("i8") for k in range(1, 10))
        blocks = np.zeros((len(some), 64), dtype="u1")
        for k in np.unique(digits).tolist():
            rows = np.flatnonzero(digits == k)
            for j in range(k):
                blocks[rows, j] = 48 + n[rows] // 10 ** (k - 1 - j) % 10
            blocks[rows, k:k + width] = padded[end[rows]]
        blocks[:, 56:58] = ((digits + size[end]) * 8).astype("<u2").view("u1").reshape(-1, 2)
        out[some] = _first_words(blocks)
    return out
