"""Vectorised words and n-grams of Arrow text columns.

A word is a maximal run of ASCII letters, ASCII digits and characters outside ASCII. Words are hashed all at once:
a running sum of byte codes times powers of an odd base, whose differences are the hashes of the words up to a
power of the base, which its inverse takes out. Arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; arrays of 8 bytes for each stay in the processor's cache.
CHUNK = 1 << 17

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = []

WORD = np.zeros(256, bool)
WORD[0x80:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    WORD[ord(_a) : ord(_b) + 1] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, CHUNK + (1 << 17))
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside, and for each text the number of runs before it."""
    n = len(data)
    m = np.zeros(n + 1, bool)
    m[:n] = inside[data]
    start = m.copy()
    start[1:] &= ~m[:-1]
    end = np.zeros(n + 1, bool)
    end[1:] = m[:-1] & ~m[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[m[cut] & m[cut - 1]]
    start[both] = True
    end[both] = True
    s, e = np.flatnonzero(start[:n]), np.flatnonzero(end)
    return s, e, np.searchsorted(s, offsets)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e]; equal bytes have equal hashes, wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def hash_word(text: str) -> int:
    """The hash that hash_spans gives to one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text, the hashes of its word n-grams, with repeats; all its words are one gram where there are fewer."""
    k = len(words)
    odd = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(n)]
    full = words * odd[0]
    m = max(0, k - n + 1)
    g = full[:m].copy()
    for i in range(1, n):
        g += words[i : i + m] * odd[i]
    g = mix(g)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield g[a : b - n + 1]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(b - a):
                h += words[a + i : a + i + 1] * odd[i]
            yield mix(h)
        else:
            yield g[:0]
