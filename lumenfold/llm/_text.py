"""Arrow and numpy helpers that several text operators share.

All of them work on one slice of one Arrow batch at a time (`slices`), so a task's memory is bounded by
`SLICE_BYTES` or by its longest single text, whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of `batch`, in order, with at most `most` bytes of `column` each (or one row)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_texts(column: pa.Array) -> pa.Array:
    """Null texts become empty ones; 64-bit offsets, so that a slice may pass 2 GB; an array of its own, as some string kernels misread slices."""
    own = column.take(pa.array(np.arange(len(column)))) if column.offset else column
    return pc.fill_null(own.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and its offsets into them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def lists(split: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array and the offsets of its rows, starting at 0."""
    ends = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return split.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: a code for each word, the rows' offsets, and the words that the codes stand for."""
    found, ends = lists(pc.ascii_split_whitespace(texts))
    real = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        found = found.filter(pa.array(real))
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, coded.dictionary


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `values` in each row."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[ends])
