"""Arrow batches in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available

#: Bytes of text that a Python operator turns into Python strings at once (a longer text is a step of its own).
STEP_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's texts are at most so many bytes in each, or one row."""
    for batch in batches:
        total = start = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows:
            yield batch.slice(start)
