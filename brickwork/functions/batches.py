"""Chains of Arrow-batch steps.

A step takes an iterator of record batches and yields record batches. Steps that follow each
other run in one Python task, so packed voxels pass between them without going back to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def chain(df: DataFrame, schema, *steps: Step) -> DataFrame:
    """Run ``steps`` one after the other over the batches of ``df``."""
    return df.mapInArrow(lambda batches: reduce(lambda flow, step: step(flow), steps, batches), schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values.cast(batch.schema.field(at).type))


def unpack(batch: pa.RecordBatch, name: str = "payload") -> tuple[np.ndarray, np.ndarray]:
    """Intensities of all rows as one array, without a copy, and where each row starts in it."""
    packed = column(batch, name)
    wide = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    _, offset_buffer, data = packed.buffers()
    offsets = np.frombuffer(offset_buffer, wide)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, "<u2"), (offsets - offsets[0]) // 2


def pack(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary rows from one array of intensities, without a copy."""
    values = np.ascontiguousarray(values, "<u2")
    small = starts[-1] * 2 < 2**31
    kind, width = (pa.binary(), np.int32) if small else (pa.large_binary(), np.int64)
    offsets = pa.py_buffer((starts * 2).astype(width))
    return pa.Array.from_buffers(kind, len(starts) - 1, [None, offsets, pa.py_buffer(values)])
