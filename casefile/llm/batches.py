"""Arrow batches in bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_slices(texts: pa.StringArray, most: int = 32 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about ``most`` bytes of text; one long text is a run of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(total):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield lo, hi
        lo = hi


def sliced(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` rows, so that few texts at once are Python strings."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            yield batch.slice(lo, most)


def whole(docs: DataFrame) -> Column:
    """A row's columns as the struct ``doc``, which Python passes on as it is: no name in it can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def text_in(column: pa.Array, at: int | None) -> list[str | None]:
    """The texts of a column, or of its field ``at`` where it holds whole rows."""
    return (column if at is None else column.field(at).cast(pa.string())).to_pylist()


def freed() -> None:
    """Give what this process no longer uses back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` for ``mapInArrow``, with memory given back at the end of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            freed()

    return run
