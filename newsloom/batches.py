"""Arrow batches of bounded size for Python stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.session import ship

#: Rows and bytes of an Arrow batch handed to Python: a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def cut_frames(frames: Iterator, rows: int, size: int) -> Iterator:
    """Pieces of pandas frames or Arrow batches of at most `rows` rows and about `size` bytes of texts."""
    for f in frames:
        if isinstance(f, pa.RecordBatch):
            yield from sliced([f], rows, size)
            continue
        weights = np.zeros(len(f))
        for c in f.columns:
            if f[c].dtype == object:
                weights += np.fromiter((len(x) if hasattr(x, "__len__") else 0 for x in f[c]), np.int64, len(f))
        if len(f) <= rows and weights.sum() <= size:
            yield f
            continue
        number = np.maximum(np.arange(len(f)) // rows, 0) + (np.cumsum(weights) // size).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(f)]
        for i, j in zip(cuts, cuts[1:]):
            yield f.iloc[i:j].reset_index(drop=True)


def released(batches: Callable[[Iterator], Iterator], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Callable[[Iterator], Iterator]:
    """batches over pieces of bounded size, which gives its freed memory back to the system at its end: idle Python workers stay beside
    those of other stages."""

    def run(frames: Iterator) -> Iterator:
        yield from batches(cut_frames(frames, rows, size))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none
        if trim:
            trim(0)

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows and `size` bytes; a longer row is a piece of its own. The session's own
    settings bound what one batch brings (10,000 rows and 64 MB unless they say otherwise) and stay as they are."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            rest = [batch.slice(first, rows)]
            while rest:
                piece = rest.pop()
                if piece.num_rows > 1 and piece.nbytes > size:
                    half = piece.num_rows // 2
                    rest += [piece.slice(half), piece.slice(0, half)]
                else:
                    yield piece


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow(work, schema), where work gets pieces of bounded size."""
    ship(df.sparkSession)
    return df.mapInArrow(released(work, rows, size), schema)
