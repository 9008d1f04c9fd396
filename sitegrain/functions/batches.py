"""Python functions of long texts over Arrow batches of many rows, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of values that are Python objects at one time (one value is never split).
CHUNK = 1 << 20


def slices(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """The columns' rows in runs of about CHUNK bytes."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), np.int64) for c in columns)
    ends = np.cumsum(sizes) // CHUNK
    at = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(sizes)]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield [c.slice(a, b - a) for c in columns]


def mapped(f: Callable, kind: pa.DataType, batches: Iterator) -> Iterator[pa.Array]:
    """f of every row of batches (an array, or a tuple of arrays of strings or bytes), as arrays of one run each."""
    for batch in batches:
        for run in slices(list(batch) if isinstance(batch, tuple) else [batch]):
            yield pa.array([f(*row) for row in zip(*[c.to_pylist() for c in run], strict=True)], kind)
