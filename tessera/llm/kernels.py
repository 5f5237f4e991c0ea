"""Vectorised text kernels over Arrow buffers: words, word hashes, shingles.

A batch of texts is one byte buffer with row offsets.  Hashes of substrings
come from a running sum of ``T[byte] * B**i`` modulo 2**64, so any substring
costs one subtraction and one product; no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are hashed at once; only a single word may be longer.
SPAN = 1 << 18
#: ASCII white space: 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits separate terms.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; kept, and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SPAN + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(texts, limit: int = 4 * SPAN) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row slices of at most ``limit`` bytes (or one row), their bytes and offsets from 0."""
    data, offs = buffer(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield slice(i, j), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a longest run of non-separators in a row."""
    word = ~separator[data]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[cut] = word[cut]
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each substring; starts and ends both ascend.  Each salt is another hash."""
    out, table = np.empty(len(start), U), mix(_BYTE ^ U(salt)) if salt else _BYTE
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + SPAN, "right")))
        part = data[at : int(end[j - 1])]
        run = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * powers(_BASE, len(part)), out=run[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (run[e] - run[s]) * powers(_INVERSE, len(part) + 1)[s]
        out[i:j] += (e - s).astype(U)
        i = j
    return mix(out)


def shingles(word: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words, their rows, and the words of each row.

    A row of fewer words has its whole sequence as its one shingle; a row
    without words has none.  Order is by position for rows of ``k`` or more.
    """
    count = np.bincount(row, minlength=n_rows)
    value = np.zeros(max(0, len(word) - k + 1), U)
    for j in range(k):
        value = value * U(0xD1342543DE82EF95) + word[j : j + len(value)]
    good = row[: len(value)] == row[k - 1 :][: len(value)] if len(value) else np.zeros(0, bool)
    out, of = [mix(value[good])], [row[: len(value)][good]]
    first = np.cumsum(count) - count
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        value = np.full(len(short), m, U)
        for j in range(m):
            value = value * U(0xD1342543DE82EF95) + word[first[short] + j]
        out.append(mix(value))
        of.append(short)
    return np.concatenate(out), np.concatenate(of), count


def phrases(word: np.ndarray, row: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``m`` words and their rows, equal to what ``shingles`` gives for a row of just those words."""
    value = np.full(max(0, len(word) - m + 1), m, U)
    for j in range(m):
        value = value * U(0xD1342543DE82EF95) + word[j : j + len(value)]
    good = row[: len(value)] == row[m - 1 :][: len(value)] if len(value) else np.zeros(0, bool)
    return mix(value[good]), row[: len(value)][good]


def distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, by row and value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def deletions(line: np.ndarray, first: int, last: int) -> np.ndarray:
    """What ``hashes`` gives for a line without its character ``t``, for ``t`` from ``first`` to before ``last``."""
    n = len(line)
    run = np.zeros(n + 1, U)
    np.cumsum(_BYTE[line] * powers(_BASE, n), out=run[1:])
    at = np.r_[np.flatnonzero((line & 0xC0) != 0x80), n]
    p, q = at[first:last], at[first + 1 : last + 1]
    return mix(run[p] + (run[n] - run[q]) * powers(_INVERSE, 8)[q - p] + (n - (q - p)).astype(U))


def places(value: np.ndarray, probe: int) -> np.ndarray:
    """Where the bits of a hash are looked for, before the cut to a bitmap's size; a hash has ``PROBES`` of them."""
    return mix(value + U(probe * 0x9E3779B97F4A7C15 % (1 << 64))) if probe else value


PROBES = 3


class Bitmap:
    """A set of 64-bit hashes in a fixed number of bits; it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, U(len(words) * 64 - 1)

    def __contains__(self, value) -> bool:
        return bool(self.has(np.array([value], U))[0])

    def has(self, value: np.ndarray) -> np.ndarray:
        out = np.ones(len(value), bool)
        for probe in range(PROBES):
            some = np.flatnonzero(out)
            at = places(value[some], probe) & self.mask
            out[some] = self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1) != 0
        return out
