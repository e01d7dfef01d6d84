"""Vectorised word tables of whole texts: numpy over UTF-8 bytes inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values).
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES * 2), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats the hash table of np.unique on short arrays."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of values[s:e] for every span; equal content gives equal hashes."""
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(BASE, len(values)), dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(U64))


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """[start, end) runs of texts of about limit bytes; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(start, end, UTF-8 texts) runs of a text column of about limit bytes, so a batch is never held twice."""
    column = column.cast(pa.large_binary())
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


class Words:
    """Words of a run of texts: ``begin``/``end`` byte spans in ``data``, 64-bit ``hash``, and
    ``bound[i]:bound[i+1]`` the words of text i. Null and empty texts have none.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; with ``letters`` they are maximal runs of
    ASCII letters, digits and non-ASCII bytes. ``lower`` folds A-Z.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, letters: bool = False):
        self.data = b"\n".join([t or b"" for t in texts]) + b"\n"
        b = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        if letters:
            inside = (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)) | ((b >= 48) & (b <= 57))
        else:
            inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.bytes = b
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.bound = np.searchsorted(self.begin, self.offset)
        self.hash = spans_hash(b.astype(U64) + U64(1), self.begin, self.end)

    def text_of(self) -> np.ndarray:
        """Index of the text that each word stands in."""
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``size`` words; a text with fewer words gives its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    first = np.arange(n)
    counts = np.diff(words.bound)
    last = np.repeat(words.bound[1:], counts)
    whole = (first + size <= last)
    short = (first == np.repeat(words.bound[:-1], counts)) & (np.repeat(counts, counts) < size)
    begin = first[whole | short]
    return spans_hash(h, begin, np.minimum(begin + size, last[whole | short])), words.text_of()[whole | short]
