"""Vectorised kernels over the UTF-8 bytes of Arrow string columns (no Python object for a text or word)."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd base of the polynomial word hash, and the constants of the 64-bit mixing function.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at once (a longer text is handled alone).
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of about PIECE bytes; a null is an empty text."""
    a = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("")
    wide = pa.types.is_large_string(a.type)
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        j = min(j, len(a))
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    p = np.full(n + 1, pow(BASE, -1, 1 << 64) if inverse else BASE, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, inverse: bool) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), inverse)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of ``inside``; no run crosses two texts."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    b = off[:-1][off[:-1] < n]
    begin[b] = inside[b]
    e = off[1:][off[1:] > 0] - 1
    end[e] = inside[e]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def is_word(data: np.ndarray) -> np.ndarray:
    """Bytes that are not white space (blank, tab to carriage return)."""
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum of a polynomial with an odd, so invertible, base."""
    n = len(data)
    p = np.empty(n + 1, U)
    p[0] = 0
    np.cumsum((data.astype(U) + U(1)) * powers(n, False)[:n], out=p[1:])
    return mix((p[ends] - p[starts]) * powers(n, True)[starts])


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every white-space separated word."""
    d = lower_ascii(data) if lower else data
    s, e, row = spans(is_word(d), off)
    return span_hashes(d, s, e), row


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words inside one text."""
    if len(h) < k:
        return h[:0], row[:0]
    n = len(h) - k + 1
    out = np.zeros(n, U)
    for i in range(k):
        out = mix(out * U(3) + h[i : i + n] + U(i))
    ok = row[:n] == row[k - 1 :]
    return out[ok], row[:n][ok]
