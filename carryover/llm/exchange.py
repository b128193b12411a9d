"""Rows that carry packed arrays between chunks of a corpus and hash ranges of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with the same values in ``columns``."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in columns)
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row)
    if held:
        yield key, held


def rows(values: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), schema)], schema=schema)


def range_edges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` even ranges of ``bits``-bit keys begins in sorted ``keys``."""
    inner = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.float64) * (2.0 ** bits / ranges)).astype(np.uint64))
    return np.concatenate(([0], inner, [len(keys)]))
