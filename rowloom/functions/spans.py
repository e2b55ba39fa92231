"""Bytes and words of whole Arrow string columns, as array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the number of each text's first word (one more at the end)."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~gap
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    cut = edges[~gap[edges] & ~gap[edges - 1]]  # a word that runs into the next text
    begins[cut] = True
    ends[cut - 1] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)
