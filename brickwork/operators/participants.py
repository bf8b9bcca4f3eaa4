"""User functions per participant and per site of a cohort.

A participant's images are read in the task that runs the function, a few planes at a time and only as far as the
function asks for them: neither voxels nor whole images are shuffled or held. A site's function gets the results of its
participants one after the other. What a function raises becomes the ``error`` of its row, and the others go on; a fault
of the storage fails the task, which Spark then repeats.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork import schemas
from brickwork.session import spread
from brickwork.sources import nifti, stores
from brickwork.sources.nifti import call


class StorageFault(OSError):
    """A file that could not be read: no result of the function."""


@dataclass
class Image:
    """One image of a participant; its voxels are read when asked for."""

    path: str
    dims: list[int]
    affine: list[list[float]]
    offset: int
    header: bytes

    def planes(self, some: int | None = None) -> Iterator[np.ndarray]:
        """Voxels as uint16 arrays ``(planes, y, x)`` of up to ``some`` planes, by default a few megabytes."""
        x, y, depth = self.dims
        step = some or max(1, nifti.BATCH_BYTES // (2 * x * y))
        about = {"header": self.header, "dims": self.dims, "offset": self.offset}
        try:
            file = nifti.open_file(self.path)
        except OSError as problem:
            raise StorageFault(str(problem)) from problem
        with file:
            for first in range(0, depth, step):
                count = min(step, depth - first)
                try:
                    values = nifti.read_planes(about, file, first, count)
                except OSError as problem:
                    raise StorageFault(str(problem)) from problem
                yield values.reshape(count, y, x)


@dataclass
class Participant:
    site: str
    subject: str
    images: list[Image]


#: Takes a participant, or a site and an iterator over its participants' rows; returns the values of one result row.
Function = Callable[[Participant], dict[str, Any]]
GroupFunction = Callable[[str, Iterator[dict[str, Any]]], dict[str, Any]]


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _result(keys: Sequence[str], schema: T.StructType | str) -> T.StructType:
    own = [T.StructField(k, T.StringType()) for k in keys]
    log = [T.StructField("error", T.StringType()), T.StructField("calls", T.ArrayType(schemas.CALL))]
    if taken := {*keys, "error", "calls"} & set(_struct(schema).names):
        raise ValueError(f"the result uses the column(s) {', '.join(sorted(taken))}")
    return T.StructType([*own, *_struct(schema).fields, *log])


def _attempt(function: Callable[..., dict], *arguments: Any) -> dict[str, Any]:
    try:
        return {**function(*arguments), "error": None}
    except StorageFault:
        raise
    except Exception as problem:  # whatever a user function raises is its result
        return {"error": f"{type(problem).__name__}: {problem}"}


def per_participant(images: DataFrame, function: Function, schema: T.StructType | str, origin: float | None = None) -> DataFrame:
    """``(site, subject, …schema, error, calls)`` from ``images(site, subject, path, dims, affine, offset, header, error)``.

    A participant with an image that can't be read gets that image's error, and the function is not run.
    """
    result = _result(["site", "subject"], schema)
    arrow, known = to_arrow_schema(result), stores.registered()
    columns = ["site", "subject", "path", "dims", "affine", "offset", "header", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        for (site, subject), rows in _groups(batches, ["site", "subject"]):
            own, began = list(rows), time.time()  # metadata of one participant's images
            bad = next((r for r in own if r["error"] is not None), None)
            if bad is not None:
                row = {"error": f"{bad['path']}: {bad['error']}"}
            else:
                parts = [Image(*(r[c] for c in ("path", "dims", "affine", "offset", "header"))) for r in own]
                row = _attempt(function, Participant(site, subject, parts))
            calls = [] if origin is None else [call("run_participant", subject, began, origin)]
            yield pa.RecordBatch.from_pylist([{"site": site, "subject": subject, **row, "calls": calls}], schema=arrow)

    rows = spread(images.select(*columns), "site", "subject").sortWithinPartitions("site", "subject", "path")
    return rows.mapInArrow(run, result)


def per_site(participants: DataFrame, function: GroupFunction, schema: T.StructType | str, origin: float | None = None) -> DataFrame:
    """``(site, …schema, error, calls)`` from the rows that :func:`per_participant` gave."""
    result = _result(["site"], schema)
    arrow = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (site,), rows in _groups(batches, ["site"]):
            began = time.time()
            row = _attempt(function, site, rows)
            for _ in rows:  # what the function left
                pass
            calls = [] if origin is None else [call("run_group", "all_file", began, origin)]
            yield pa.RecordBatch.from_pylist([{"site": site, **row, "calls": calls}], schema=arrow)

    return spread(participants, "site").sortWithinPartitions("site", "subject").mapInArrow(run, result)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys, each as an iterator that must be used up before the next."""
    rows = (r for batch in batches for r in batch.to_pylist())
    held = next(rows, None)
    while held is not None:
        key = tuple(held[k] for k in by)

        def own() -> Iterator[dict]:
            nonlocal held
            while held is not None and tuple(held[k] for k in by) == key:  # noqa: B023
                row, held = held, next(rows, None)
                yield row

        yield key, own()
