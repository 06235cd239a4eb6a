"""Cutting and hashing the text of whole Arrow batches in numpy.

Words and byte windows are hashed by a polynomial over random byte values modulo 2**64, taken
from running sums, so that a batch needs a fixed number of array passes and no loop over rows.
Work is done in blocks of about one megabyte of text, which bounds the size of its arrays.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, U), np.ones(1, U)]

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(n, salt):
    """``n`` pseudo-random odd numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD6E8FEB86659FD93) + U(salt)) | U(1)


_VALUES = salted(256, 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PLACES = salted(64, 2)


def byte_set(members, inverted=False):
    """A table that tells for each byte value whether it belongs to a set."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return ~table if inverted else table


def _powers(n):
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1]


def blocks(column, size=BLOCK):
    """Runs of rows with about ``size`` bytes of text; null counts as empty text.

    Yields the first row, the bytes of the run and the offset of each row in them.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def cut(data, offsets, is_word):
    """Start and end of each word, and the first word of each row (one more for the end).

    A word is a maximal run of bytes of the set ``is_word`` inside a row.
    """
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, starts, ends, fold=True):
    """A 64-bit hash of each word; with ``fold`` A-Z count as a-z."""
    values = _VALUES[_FOLD] if fold else _VALUES
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
        j = max(j, i + 1)
        low = starts[i]
        sums = prefix_sums(data[low : ends[j - 1]], values)
        out[i:j] = range_hashes(sums, starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def prefix_sums(data, values=_VALUES):
    powers, _ = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums, starts, ends):
    """Hashes of byte ranges from running sums; equal bytes give equal hashes anywhere."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def ngrams(hashes, first, n):
    """Hashes of each row's runs of ``n`` words, and the row of each.

    A row with fewer words, but not none, has one run of all its words.
    """
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(hashes))
    starts = starts[starts + n <= first[1:][row]]
    runs = np.zeros(len(starts), U)
    for j in range(n):
        runs += hashes[starts + j] * _PLACES[j]
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.zeros(len(short), U)
    for j in range(n - 1):
        has = counts[short] > j
        whole[has] += hashes[first[:-1][short[has]] + j] * _PLACES[j]
    whole += counts[short].astype(U) * _PLACES[n]
    return mix(np.concatenate([runs, whole])), np.concatenate([row[starts], short])
