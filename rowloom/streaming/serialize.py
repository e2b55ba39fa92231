"""Row text on a stream.

The projection to canonical samples is stateless, so tables that arrive as a stream are serialised by
the same expressions as batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.sources.tables import DatasetSpec, project_samples, with_row_id


def stream_samples(stream: DataFrame, spec: DatasetSpec, max_chars: int, precision: int = 2) -> DataFrame:
    """Canonical samples of a streaming table with a declared key."""
    if not spec.id_columns:
        raise ValueError("a streaming table needs id_columns")
    rows = project_samples(with_row_id(stream, spec.id_columns), spec, 0, precision)
    return rows.filter(F.length("text") <= max_chars)
