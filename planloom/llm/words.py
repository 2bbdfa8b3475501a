"""Words and hashes of texts, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than space and the control characters 9 to 13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Rows worked on, and returned, together.
PART_ROWS = 512

# Random odd constants of the hashes; any others would do.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers = {BASE: np.ones(1, dtype=np.uint64), INVERSE: np.ones(1, dtype=np.uint64)}


def powers(base: int, count: int) -> np.ndarray:
    """The first `count` powers of `base` modulo 2**64, kept between calls."""
    known = _powers[base]
    if len(known) < count:
        known = np.full(max(count, 2 * len(known)), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of the input."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal for equal bytes, wherever they are."""
    inverse = powers(INVERSE, len(prefixes))
    return mixed((prefixes[ends] - prefixes[starts]) * inverse[starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    starts, ends = word_spans(data)
    return span_hashes(prefix_hashes(data), starts, ends)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of `width` words; of the whole where there are fewer."""
    if len(words) == 0:
        return words
    size = min(width, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for place in range(size):
        total *= np.uint64(BASE)
        total += words[place : place + count]
    return np.unique(mixed(total))


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of them, and sent back, is small as well."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value of a string or binary column; no bytes for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    empty = np.zeros(0, dtype=np.uint8)
    if len(column) == 0:
        return
    bounds = np.frombuffer(bounds, dtype=np.int64 if wide else np.int32)[column.offset :][: len(column) + 1]
    data = empty if data is None else np.frombuffer(data, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for row in range(len(column)):
        yield data[bounds[row] : bounds[row + 1]] if valid[row] else empty
