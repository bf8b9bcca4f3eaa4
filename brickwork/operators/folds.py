"""Reduction with a merge given by the user, as a tree.

Every task folds its rows into states, one key at a time. Rounds then merge the states of each key, ``fan_in`` of them at
a time, until one is left: no task takes the states of all others, and each holds one state and the one it adds.
States travel as bytes and are stored between rounds, so a lost executor costs one round's share. They are dealt out to
partitions of some megabytes, as whole partitions may come to Python in one batch; the last round finishes them as well.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork.session import materialize

#: States that one task merges into one.
FAN_IN = 64
#: States, in bytes, that a partition of a round has on average, and how many are taken from a batch at a time.
ROUND_BYTES, TAKEN = 8 << 20, 64
PART, STATE = "_part", "_state"


def fold(
    rows: DataFrame,
    zero: Callable[[], Any],
    add: Callable[[Any, pa.RecordBatch], Any],
    merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], dict[str, Any]],
    schema: T.StructType | str,
    by: Sequence[str] = (),
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per key, ``(…by, …schema)``, with the values that ``finish`` makes of the key's state.

    ``add`` takes a state and rows of one key, ``merge`` two states, the earlier one first: it must be associative, but
    need not be commutative. Without ``by`` there is one row, also for an empty table. Runs at once.
    """
    if fan_in < 2:
        raise ValueError("a merge takes at least two states")
    keys = list(by)
    own = [rows.schema[k] for k in keys]
    states = T.StructType([*own, T.StructField(PART, T.LongType()), T.StructField(STATE, T.BinaryType())])
    arrow = to_arrow_schema(states)

    def packed(key: tuple, part: int, state: Any) -> pa.RecordBatch:
        row = dict(zip(keys, key)) | {PART: part, STATE: pickle.dumps(state, protocol=5)}
        return pa.RecordBatch.from_pylist([row], schema=arrow)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, state = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for key, piece in _runs(batch, keys):
                if key != held:
                    if held is not None:
                        yield packed(held, part, state)
                    held, state = key, zero()
                state = add(state, piece)
        if held is not None:
            yield packed(held, part, state)

    wanted = T.StructType([*own, *(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields])
    result = to_arrow_schema(wanted)

    def finished(key: tuple, part: int, state: Any) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(keys, key)) | finish(state)], schema=result)

    def merged(span: int, out: Callable[[tuple, int, Any], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, state = None, None
            for row in _rows(batches):
                place = (*[row[k] for k in keys], row[PART] // span)
                value = pickle.loads(row[STATE])
                if place == held:
                    state = merge(state, value)
                else:
                    if held is not None:
                        yield out(held[:-1], held[-1] * span, state)
                    held, state = place, value
            if held is not None:
                yield out(held[:-1], held[-1] * span, state)

        return run

    found = materialize((rows.sortWithinPartitions(*keys) if keys else rows).mapInArrow(first, states), "states")
    if not keys and found.isEmpty():
        return rows.sparkSession.createDataFrame([finish(zero())], wanted)
    last, size = found.agg(F.max(PART), F.sum(F.length(STATE))).first()
    parts, span = (last or 0) + 1, fan_in
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // ROUND_BYTES)

    def dealt() -> DataFrame:
        slot = F.floor(F.col(PART) / F.lit(span))
        return found.withColumn("_slot", slot).repartition(n, *keys, "_slot").sortWithinPartitions(*keys, "_slot", PART).drop("_slot")

    while span < parts:
        found = materialize(dealt().mapInArrow(merged(span, packed), states), "states")
        span *= fan_in
    return dealt().mapInArrow(merged(span, finished), wanted)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """All rows, some at a time: states are not copied a batch at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TAKEN):
            yield from batch.slice(at, TAKEN).to_pylist()


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys."""
    if not keys:
        if batch.num_rows:
            yield (), batch
        return
    values = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]))
    begin = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[begin]:
            yield values[begin], batch.slice(begin, i - begin)
            begin = i
