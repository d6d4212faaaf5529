"""Arrow batches in slices, so that what a worker makes of a batch is made of a slice at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text whose Python strings a worker holds at once.
SLICE_BYTES = 1 << 20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """A batch of texts in runs of rows with about ``most`` bytes of text (a longer text is a run of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def list_slices(lists: pa.Array, most: int):
    """(start, stop) of runs of rows that hold about ``most`` elements padded to the longest of the run."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lengths):
        widest = np.maximum.accumulate(lengths[at:])
        fits = widest * np.arange(1, len(widest) + 1) <= most
        stop = at + (max(1, int(np.argmin(fits))) if not fits.all() else len(widest))
        yield at, stop
        at = stop
