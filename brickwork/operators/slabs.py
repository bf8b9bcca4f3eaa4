"""Operators on slab rows, whose voxels stay packed in binary columns.

A step works on Arrow batches of planes with NumPy and either maps them to new planes or reduces
them to partial counts, which Spark then aggregates. Voxels never become rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork import schemas
from brickwork.functions.batches import Step, chain, column, pack, replaced, unpack
from brickwork.functions.intensity import BINS, LEVELS
from brickwork.session import materialize
from brickwork.sources import nifti
from brickwork.sources.nifti import call


def change_step(func: str, change: Callable, origin: float | None = None) -> Step:
    """Apply an elementwise ``change`` to all planes; with ``origin``, log one call per image and batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            began = time.time()
            values, starts = unpack(batch)
            out = replaced(batch, "payload", pack(change(values), starts))
            if origin is not None and len(batch):
                calls = [c or [] for c in column(batch, "calls").to_pylist()]
                paths = column(batch, "path").to_pylist()
                for i, path in enumerate(paths):
                    if i == 0 or path != paths[i - 1]:
                        calls[i] = [*calls[i], call(func, path, began, origin)]
                out = replaced(out, "calls", pa.array(calls, column(batch, "calls").type))
            yield out

    return run


def increment_step(amount: int = 1, origin: float | None = None) -> Step:
    """Add a constant to every voxel, wrapping at 2^16."""
    step = np.uint16(amount % LEVELS)
    return change_step("increment", lambda v: v + step, origin)


def classify_step(centroids: Sequence[float], origin: float | None = None) -> Step:
    """Replace every voxel by the index of its nearest centroid, through a table of all intensities."""
    levels = np.arange(LEVELS, dtype=np.float64)
    table = np.argmin(np.square(np.subtract.outer(levels, np.asarray(centroids, float))), axis=1).astype("<u2")
    return change_step("classify_block", lambda v: table[v], origin)


def _logged(batch: pa.RecordBatch, began: float, origin: float, *funcs: tuple[str, Callable[[str], str]]) -> list[dict]:
    """Calls that a batch brings, and one of each function for every image in it, named by its path."""
    calls = [c for row in column(batch, "calls").to_pylist() for c in row or ()]
    paths = column(batch, "path").to_pylist()
    for i, path in enumerate(paths):
        if i == 0 or path != paths[i - 1]:
            calls += [call(func, name(path), began, origin) for func, name in funcs]
    return calls


def _own_name(path: str) -> str:
    return path


def count_step(origin: float | None = None) -> Step:
    """Number of voxels per intensity; a task keeps one counter each and yields at most 65,536 rows.

    With ``origin``, rows without intensity carry the calls.
    """
    arrow = to_arrow_schema(COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            began = time.time()
            values = unpack(batch)[0]
            flat = time.time()
            total += np.bincount(values, minlength=LEVELS)
            if origin is not None and len(batch):
                calls = _logged(batch, began, origin, ("flatten", _own_name), ("calculate_histogram", _own_name))
                for c in calls:  # one ends where the other begins
                    if c["func"] in ("flatten", "calculate_histogram"):
                        c["end_us" if c["func"] == "flatten" else "start_us"] = round((flat - origin) * 1e6)
                yield pa.RecordBatch.from_pylist([{"v": None, "n": 0, "calls": calls}], schema=arrow)
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), arrow.field("calls").type)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen]), none], schema=arrow)

    return run


def volume_step(threshold: int, origin: float | None = None) -> Step:
    """Foreground voxels per plane, and whether its bytes contradict its dimensions.

    With ``origin``, rows without block carry the calls, which name the participant.
    """
    arrow = to_arrow_schema(VOLUMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            began = time.time()
            values, starts = unpack(batch)
            above = np.concatenate([[0], np.cumsum(values > threshold)])
            sizes = [d[0] * d[1] for d in column(batch, "dims").to_pylist()]
            bad = (np.diff(starts) != sizes).astype(np.int64)
            volume = above[starts[1:]] - above[starts[:-1]]
            none = pa.nulls(len(batch), arrow.field("calls").type)
            yield pa.RecordBatch.from_arrays([column(batch, "block_id"), pa.array(volume, pa.int64()), pa.array(bad), none], schema=arrow)
            if origin is not None and len(batch):
                calls = _logged(batch, began, origin, ("run_participant", subject_in))
                yield pa.RecordBatch.from_pylist([{"block_id": None, "volume": 0, "bad": 0, "calls": calls}], schema=arrow)

    return run


def subject_in(path: str) -> str:
    """Participant that an image path names: what follows the last hyphen of its ``sub-`` folder."""
    folders = [f for f in path.split("/")[:-1] if f.startswith("sub-")]
    return folders[0].split("-")[-1] if folders else path


_CALLS = T.StructField("calls", T.ArrayType(schemas.CALL))
#: What reducing steps yield. Rows with null in the first column carry calls and nothing else.
COUNTS = T.StructType([T.StructField("v", T.LongType()), T.StructField("n", T.LongType()), _CALLS])
VOLUMES = T.StructType([*[T.StructField(c, T.LongType()) for c in ("block_id", "volume", "bad")], _CALLS])


def traced(partials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial results and calls of a reducing step, from one stored table.

    A task that is repeated adds to the table once, so its calls are logged once.
    """
    stored = materialize(partials, "partials")
    return stored.where(F.col(stored.columns[0]).isNotNull()), stored.where(F.col("calls").isNotNull())


def increment_slabs(slabs: DataFrame, amount: int = 1) -> DataFrame:
    """Add a constant to every voxel, wrapping at 2^16."""
    return chain(slabs, slabs.schema, increment_step(amount))


def classify_slabs(slabs: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """Replace every voxel by the index of its nearest centroid."""
    return chain(slabs, slabs.schema, classify_step(centroids))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Sum the counts of all tasks per intensity."""
    return counts.groupBy("v").agg(F.sum("n").alias("n"))


def slab_frequency(slabs: DataFrame) -> DataFrame:
    """Number of voxels per intensity ``(v, n)`` of slab rows."""
    return merge_counts(chain(slabs.where(F.col("error").isNull()).select("payload"), COUNTS, count_step()))


def range_counts(ranges: DataFrame, origin: float | None = None) -> DataFrame:
    """Partial counts of image ranges, and with ``origin`` the calls; voxels are counted where they are read."""
    return chain(ranges, COUNTS, nifti.read_step(origin), count_step(origin))


def range_frequency(ranges: DataFrame) -> DataFrame:
    """Number of voxels per intensity of image ranges."""
    return merge_counts(range_counts(ranges))


def bin_frequency(frequency: DataFrame) -> DataFrame:
    """Histogram bins ``(bin, n)`` of an intensity table."""
    return frequency.select(F.least("v", F.lit(BINS - 1).cast("bigint")).alias("bin"), "n")


def merge_volumes(counted: DataFrame) -> DataFrame:
    """Foreground voxels per block, from partial volumes."""
    totals = counted.groupBy("block_id").agg(F.sum("volume").alias("volume"), F.sum("bad").alias("bad"))
    fits = F.col("bad") == 0
    return totals.select(
        "block_id",
        F.when(fits, F.col("volume")).alias("volume"),
        F.when(~fits, F.concat("bad", F.lit(" planes do not fit the dimensions"))).alias("error"),
    )


def slab_volume(slabs: DataFrame, threshold: int) -> DataFrame:
    """Foreground voxels per block ``(block_id, volume, error)`` of slab rows.

    A plane whose bytes do not fit its dimensions gives an error instead of a count.
    """
    return merge_volumes(chain(slabs.select("block_id", "payload", "dims"), VOLUMES, volume_step(threshold)))


def range_volume(ranges: DataFrame, threshold: int) -> DataFrame:
    """As :func:`slab_volume`, for image ranges."""
    return merge_volumes(range_volumes(ranges, threshold))


def range_volumes(ranges: DataFrame, threshold: int, origin: float | None = None) -> DataFrame:
    """Partial volumes of image ranges, and with ``origin`` the calls."""
    return chain(ranges, VOLUMES, nifti.read_step(origin), volume_step(threshold, origin))


def slab_nearest_rows(slabs: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """For each (block, x, z, centroid): the y of least distance, the lowest y on ties.

    A plane holds complete y lines, so no plane needs another one.
    """
    targets = np.asarray(centroids, float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim_x, dim_y = r["dims"][:2]
                plane = np.frombuffer(r["payload"], "<u2").reshape(dim_y, dim_x).astype(float)
                best = np.stack([np.argmin(np.square(plane - c), axis=0) for c in targets], axis=1)
                x, k = np.divmod(np.arange(best.size), len(targets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(best.size, r["block_id"])), pa.array(x), pa.array(np.full(best.size, r["slab"])),
                     pa.array(k), pa.array(best.ravel())],
                    names=["block_id", "x", "z", "k", "y"],
                )

    return slabs.select("block_id", "slab", "dims", "payload").mapInArrow(
        search, "block_id bigint, x bigint, z bigint, k bigint, y bigint"
    )


def flatten_slabs(slabs: DataFrame) -> DataFrame:
    """One row per voxel, with coordinates and row-major position; meant for small selections."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim_x, dim_y, dim_z = r["dims"]
                v = np.frombuffer(r["payload"], "<u2").astype(np.int64)
                y, x = np.divmod(np.arange(v.size, dtype=np.int64), dim_x)
                z = np.full(v.size, r["slab"], np.int64)
                columns = [np.full(v.size, r["block_id"], np.int64), (x * dim_y + y) * dim_z + z, x, y, z, v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["block_id", "pos", "x", "y", "z", "v"]
                )

    return slabs.select("block_id", "slab", "dims", "payload").mapInArrow(
        rows, "block_id bigint, pos bigint, x bigint, y bigint, z bigint, v bigint"
    )


def call_rows(written: DataFrame) -> DataFrame:
    """Trace rows collected while slabs were read, changed and written."""
    names = [f.name for f in schemas.CALL.fields]
    return written.where(F.size("calls") > 0).select(F.inline("calls").alias(*names))
