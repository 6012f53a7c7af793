"""Bit positions of the q-grams of whole texts, for an Arrow batch at a time.

The texts of a slice lie end to end as code points; every gram becomes one number, Arrow numbers the distinct ones, and only
those are hashed, once per worker as long as a bounded table remembers them.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are worked on at once, and grams whose bits a worker remembers.
WINDOW, CACHE_GRAMS = 1 << 20, 200_000
_KNOWN: dict[tuple[int, int], dict[str, int]] = {}


def _numbers(points: np.ndarray, starts: np.ndarray, q: int) -> np.ndarray:
    """One number per gram, equal for equal grams: the code points as digits, renumbered where 63 bits would not do."""
    code, bound = np.zeros(len(starts), dtype="i8"), 1
    for k in range(q):
        point = points[starts + k].astype("i8")
        top = int(point.max()) + 1
        if bound * top >= 1 << 63:
            code = pa.array(code).dictionary_encode().indices.to_numpy().astype("i8")
            bound = int(code.max()) + 1
        code, bound = code * top + point, bound * top
    return code


def _slice_bits(texts: list[str], q: int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bits per text, their sorted numbers)`` of a few texts."""
    known = _KNOWN.setdefault((q, n_bits), {})
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) for t in texts])
    marks = np.zeros((len(texts), n_bits), dtype=bool)
    for a in range(0, len(whole), WINDOW):
        place = np.arange(a, min(a + WINDOW, len(whole)))
        row = np.searchsorted(ends, place, side="right")
        inside = place + q <= ends[row]
        place, row = place[inside], row[inside]
        if not len(place):
            continue
        number = pa.array(_numbers(points, place, q)).dictionary_encode().indices.to_numpy()
        first = np.zeros(int(number.max()) + 1, dtype="i8")
        first[number[::-1]] = place[::-1]
        if len(known) > CACHE_GRAMS:
            known.clear()
        bits = np.zeros(len(first), dtype="i8")
        for i, at in enumerate(first.tolist()):
            gram = whole[at:at + q]
            bit = known.get(gram)
            if bit is None:
                bit = known[gram] = int.from_bytes(md5(gram.encode("utf-8", "surrogatepass")).digest()[:4], "big") % n_bits
            bits[i] = bit
        marks[row, bits[number]] = True
    return marks.sum(axis=1), np.nonzero(marks)[1]


def text_bits(texts: pa.Array, q: int, n_bits: int) -> pa.Array:
    """Sorted distinct bits of every text (UTF-8 bytes; null: none)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    piece = (np.cumsum(size) - size) // WINDOW  # texts are taken together up to the window's length
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
    sizes, values = [np.zeros(1, dtype="i8")], []
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            some = [b"" if t is None else t for t in texts.slice(a, z - a).to_pylist()]
            n, v = _slice_bits([t.decode("utf-8", "replace") for t in some], q, n_bits)
            sizes.append(n)
            values.append(v)
    offsets = np.cumsum(np.concatenate(sizes)).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values or [[]]).astype("i4")))
