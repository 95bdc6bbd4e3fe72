"""Words and shingles of Arrow text columns as 64-bit hashes, computed column-wise in numpy.

Words are runs of bytes other than space and the ASCII controls 9 to 13; A-Z count as a-z.  A word's hash is
a polynomial over random 64-bit byte values, finished by a mixing step, so that two different words or
shingles that are compared share a hash with a probability near 2^-64.  Work arrays are bounded by
`SLICE_BYTES`, except that one word is always whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    _VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x2545F4914F6CDD1D  # odd, so that its powers have inverses modulo 2^64
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, U(_BASE)), np.full(size, U(pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def _hash_words(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes and the positions where they start; rows cut words as spaces do."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[row_starts[row_starts < n]] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, first[1:] | ~inside[1:]
    ends = np.flatnonzero(last & inside)
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_VALUES[data] * up)
        before = np.where(starts > 0, sums[starts - 1], U(0))
        return mix((sums[ends] - before) * down[starts] + (ends - starts + 1).astype(U)), starts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def word_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words before each row, byte position of each word in its row)."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    i = 0
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + slice_bytes, "right")) - 1
        if j > i:
            begin, end = int(offsets[i]), int(offsets[j])
            hashes, starts = _hash_words(data[begin:end], offsets[i:j] - begin)
            bounds = np.searchsorted(starts, offsets[i : j + 1] - begin)
            row = np.repeat(np.arange(j - i), np.diff(bounds))
            yield i, j, hashes, bounds, starts - (offsets[i:j] - begin)[row]
            i = j
            continue
        begin, end = int(offsets[i]), int(offsets[i + 1])  # one long text: cut it between words
        parts, places, at = [], [], begin
        while at < end:
            stop = min(at + slice_bytes, end)
            if stop < end:
                space = np.flatnonzero(_SPACE[data[at:stop]])
                if len(space):
                    stop = at + int(space[-1]) + 1
                else:
                    while stop < end and not _SPACE[data[stop]]:
                        stop += 1
            hashes, starts = _hash_words(data[at:stop], np.zeros(1, np.int64))
            parts.append(hashes)
            places.append(starts + (at - begin))
            at = stop
        hashes = np.concatenate(parts)
        yield i, i + 1, hashes, np.array([0, len(hashes)]), np.concatenate(places)
        i += 1


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text in order; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    size = min(n, k)
    with np.errstate(over="ignore"):
        total = np.full(n - size + 1, U(size))
        for j in range(size):
            total = total * U(0x9FB21C651E98DF25) + (words[j : n - size + 1 + j] ^ (words[j : n - size + 1 + j] >> U(29)))
        return mix(total)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row in turn."""
    for i, j, words, bounds, _ in word_slices(column):
        for r in range(j - i):
            yield np.unique(shingles(words[bounds[r] : bounds[r + 1]], k))
