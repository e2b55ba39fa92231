"""Words, spans and rolling hashes of whole Arrow string columns, as array operations.

All functions work on the bytes of a column at once: no loop over words, and memory in proportion to the
column. A word is a maximal run of bytes other than space and 09-0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rowloom.functions.spans import column_bytes, word_spans

SEGMENT_BYTES = 2**20
KEPT_POWERS = 2**20      # longer tables of powers are made for one text and not kept
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class _Powers:
    """Powers of the two bases and of their inverses modulo 2^64, grown on demand and kept up to a bound."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.uint64) for _ in range(4)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, min(2 * len(self.tables[0]), KEPT_POWERS))
            made = []
            for base in (*_BASES, *map(_inverse, _BASES)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64, out=steps))
            if size > KEPT_POWERS:
                return made
            self.tables = made
        return [t[:n] for t in self.tables]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    a, b, ia, ib = _powers.upto(len(raw) + 1)
    values = raw.astype(np.uint64) + np.uint64(1)
    found = []
    for power, inverse in ((a, ia), (b, ib)):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=sums[1:])
        found.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return found


def gram_hashes(words: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Two hashes of the `size` words that start at each word (the last ones, which lack words, are left out)."""
    count = max(0, len(words[0]) - size + 1)
    a, b, ia, ib = _powers.upto(len(words[0]) + 1)
    found = []
    for values, power, inverse in ((words[0], a, ia), (words[1], b, ib)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=sums[1:])
        found.append(mix((sums[size:size + count] - sums[:count]) * inverse[:count]))
    return found


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each `size` consecutive values."""
    width, low = 1, values
    while 2 * width <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def segments(batch: pa.RecordBatch, text: str, max_bytes: int = SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts have about `max_bytes` together; a longer text is a range of its own."""
    lengths = batch.column(text).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
