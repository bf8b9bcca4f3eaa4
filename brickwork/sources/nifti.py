"""Uncompressed NIfTI-1 files as tables of z-planes.

A scan is planned on file metadata. Headers are read in parallel, every file is cut into
ranges of whole planes, and the small range rows are spread over the cluster; each task then
reads only its own byte ranges. One file may thus be far larger than a task, and no image data
is shuffled.

Writing is the mirror image, in two steps. Tasks first write to a staging folder inside the target. On mounted
folders each plane goes to its own byte range of the staged file; ranges do not overlap and a repeated write stores the
same bytes, so retried and speculative tasks are harmless. Other stores take parts: runs of planes, each a file of its
own. When all tasks are through, the images are published, in parallel: a staged file, or an image of one part, is
moved to its place, several parts are put together. A job that fails publishes nothing and leaves nothing.
"""

from __future__ import annotations

import math
import os
import socket
import struct
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork import schemas
from brickwork.functions.batches import Step, chain, pack, unpack
from brickwork.session import materialize, spread
from brickwork.sources import stores
from brickwork.sources.listing import block_ordinal, list_blocks
from brickwork.sources.stores import local_path, mounted

HEADER_BYTES = 348
DATA_OFFSET = 352
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Planes that are held at a time where the planes of many images are read together.
GROUP_BYTES = 256 << 20
LEAST_RANGE_BYTES = 1 << 20
#: Planes that one task writes of an image, where a store takes parts; larger images come from several tasks.
PART_BYTES = 1 << 30

# Voxel type codes of the public NIfTI-1 layout.
VOXEL_TYPES = {
    2: "u1",
    4: "i2",
    8: "i4",
    16: "f4",
    64: "f8",
    256: "i1",
    512: "u2",
    768: "u4",
    1024: "i8",
    1280: "u8",
}

# Byte positions in the public NIfTI-1 header.
DIM_AT, TYPE_AT, BITS_AT, PIXDIM_AT, OFFSET_AT, SLOPE_AT, QFORM_AT, SFORM_AT = 40, 70, 72, 76, 108, 112, 252, 254
QUATERN_AT, SROW_AT, MAGIC_AT = 256, 280, 344


# --------------------------------------------------------------------- header


def byte_order(header: bytes) -> str:
    """``<`` or ``>``, from the header's own length field."""
    for order in "<>":
        if struct.unpack_from(order + "i", header)[0] == HEADER_BYTES:
            return order
    raise ValueError("not a NIfTI-1 header")


def _values(header: bytes, code: str, count: int, at: int) -> tuple:
    return struct.unpack_from(f"{byte_order(header)}{count}{code}", header, at)


def dims_of(header: bytes) -> list[int]:
    """Three dimensions; further ones are folded into the third, as planes lie one after the other in the file."""
    rank, *sizes = _values(header, "h", 8, DIM_AT)
    if not 1 <= rank <= 7 or any(s < 1 for s in sizes[:rank]):
        raise ValueError("an image has one to seven dimensions of at least 1")
    sizes = [*sizes[:rank], 1, 1]
    return [*sizes[:2], math.prod(sizes[2:])]


def voxel_type(header: bytes) -> np.dtype:
    code = _values(header, "h", 1, TYPE_AT)[0]
    if code not in VOXEL_TYPES:
        raise ValueError(f"unsupported voxel type {code}")
    return np.dtype(byte_order(header) + VOXEL_TYPES[code])


def affine_of(header: bytes) -> list[list[float]]:
    """Voxel-to-space matrix: the explicit one, else the rotation, else the voxel sizes."""
    pixdim = _values(header, "f", 8, PIXDIM_AT)
    out = np.eye(4)
    if _values(header, "h", 1, SFORM_AT)[0] > 0:
        out[:3] = np.reshape(_values(header, "f", 12, SROW_AT), (3, 4))
    elif _values(header, "h", 1, QFORM_AT)[0] > 0:
        b, c, d, *origin = _values(header, "f", 6, QUATERN_AT)
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        turn = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        out[:3, :3] = turn * (pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0))
        out[:3, 3] = origin
    else:
        steps = np.array(pixdim[1:4]) * (-1, 1, 1)
        out[:3, :3] = np.diag(steps)
        out[:3, 3] = -steps * (np.array(dims_of(header)) - 1) / 2
    return out.tolist()


def scaling_of(header: bytes) -> tuple[float, float] | None:
    """Slope and intercept, or nothing when the stored numbers are the values."""
    slope, intercept = _values(header, "f", 2, SLOPE_AT)
    if not np.isfinite(slope) or slope == 0:
        return None
    if not np.isfinite(intercept):
        raise ValueError("the slope is valid but the intercept is not")
    if (slope, intercept) == (1, 0):
        return None
    return slope, intercept


def new_header(dims: list[int], affine: list[list[float]] | None = None) -> bytes:
    """Header of a uint16 image."""
    out = bytearray(HEADER_BYTES)
    struct.pack_into("<i", out, 0, HEADER_BYTES)
    struct.pack_into("<8f", out, PIXDIM_AT, 1, 1, 1, 1, 1, 1, 1, 1)
    matrix = np.eye(4) if affine is None else np.asarray(affine, float)
    struct.pack_into("<h", out, SFORM_AT, 1)
    struct.pack_into("<12f", out, SROW_AT, *matrix[:3].ravel())
    struct.pack_into("<4s", out, MAGIC_AT, b"n+1\0")
    return output_header(bytes(out), dims)


def data_offset(header: bytes) -> int:
    """Where the planes of a rewritten image begin: behind the header's extensions, if it says that it has any."""
    if len(header) < DATA_OFFSET or header[HEADER_BYTES] == 0:
        return DATA_OFFSET
    return max(DATA_OFFSET, int(_values(header, "f", 1, OFFSET_AT)[0]))


def output_header(header: bytes, dims: list[int]) -> bytes:
    """The given header, changed only where the output differs: uint16, unscaled, data behind the extensions."""
    out, order = bytearray(header[:HEADER_BYTES]), byte_order(header)
    rank, *sizes = _values(header, "h", 8, DIM_AT)
    # More than three dimensions stay as they are: the planes keep their order.
    if rank <= 3 or [*sizes[:2], math.prod(sizes[2:rank])] != list(dims):
        struct.pack_into(order + "8h", out, DIM_AT, 3, *dims, 1, 1, 1, 1)
    struct.pack_into(order + "2h", out, TYPE_AT, 512, 16)
    struct.pack_into(order + "3f", out, OFFSET_AT, data_offset(header), 1, 0)
    struct.pack_into("<4s", out, MAGIC_AT, b"n+1\0")
    return bytes(out)


def file_head(header: bytes, dims: list[int]) -> bytes:
    """All bytes ahead of the planes: the header and, where ``header`` brings them, its extensions as they were."""
    head = output_header(header, dims) + header[HEADER_BYTES : data_offset(header)]
    return head + bytes(data_offset(header) - len(head))


# ----------------------------------------------------------------------- scan


def open_file(path: str):
    """Open a file of any file system for reading at positions."""
    return stores.open_input(path)


def _read_header(path: str, length: int, f=None) -> dict:
    """Row of :data:`schemas.BLOCK` for one file. Of extensions, only the flag that there are any."""
    row = {"path": path, "length": length, "dims": None, "offset": None, "header": None, "affine": None, "error": None}
    # A fault of the storage is no property of the file: it fails the task, which Spark then repeats.
    with ExitStack() as opened:
        header = (f or opened.enter_context(open_file(path))).read_at(min(length, DATA_OFFSET), 0)
    try:
        if len(header) < HEADER_BYTES:
            raise ValueError("the file is shorter than a header")
        dims, kind, _ = dims_of(header), voxel_type(header), scaling_of(header)
        offset = int(_values(header, "f", 1, OFFSET_AT)[0]) or DATA_OFFSET
        if length < offset + int(np.prod(dims)) * kind.itemsize:
            raise ValueError("the file is shorter than its dimensions say")
        row |= {"dims": dims, "offset": offset, "header": header, "affine": affine_of(header)}
    except (ValueError, struct.error) as problem:
        row["error"] = str(problem)
    return row


def read_headers(files: DataFrame) -> DataFrame:
    """One row per file with dimensions, data offset, header and matrix, or with ``error``."""
    arrow, known = to_arrow_schema(schemas.BLOCK), stores.registered()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        for batch in batches:
            rows = [_read_header(r["path"], r["length"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    few = files.coalesce(4 * files.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(parse, schemas.BLOCK)


def block_table(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Headers of all images of a folder, numbered by path; numbering stores them, so files are read once."""
    return block_ordinal(read_headers(list_blocks(spark, folder, recursive)))


def plane_ranges(blocks: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cut every readable block into ranges of whole planes ``(…, first, count)``, spread evenly.

    The rows are a few bytes each, so the partition count must not be left to size-based
    coalescing: it comes from the number of data bytes.
    """
    x, y, z = (F.get("dims", F.lit(i)) for i in range(3))
    per_range = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(split_bytes) / (x * y * F.lit(2))))
    good = blocks.where(F.col("error").isNull())
    ranges = good.withColumn("_step", per_range).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), z - 1, F.col("_step")))
    )
    planned = good.agg(F.sum(x * y * z * 2)).first()[0] or 0
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, cores, planned // split_bytes)
    return ranges.withColumn("count", F.least("_step", z - F.col("first"))).drop("_step").repartition(tasks)


def call(func: str, path: str, began: float, origin: float) -> dict:
    """Trace entry of one call; times count from ``origin``."""
    ended = time.time()
    return {
        "func": func,
        "start_us": round((began - origin) * 1e6),
        "end_us": round((ended - origin) * 1e6),
        "filename": os.path.basename(path),
        "worker": socket.gethostname(),
        "thread": threading.get_ident(),
        "process": os.getpid(),
    }


def read_step(origin: float | None = None) -> Step:
    """Turn ranges into slab rows, a few planes per batch. With ``origin`` reads are logged."""
    arrow, known = to_arrow_schema(schemas.SLAB), stores.registered()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        for batch in batches:
            for r in batch.to_pylist():
                yield from range_batches(r, origin, arrow)

    return read


def range_batches(r: dict, origin: float | None, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Slab rows of one range, a few planes per batch; the file is opened once."""
    step = max(1, BATCH_BYTES // (2 * r["dims"][0] * r["dims"][1]))
    end = r["first"] + r["count"]
    with open_file(r["path"]) as file:
        for first in range(r["first"], end, step):
            count, began = min(step, end - first), time.time()
            planes = read_planes(r, file, first, count)
            calls = [] if origin is None else [call("load", r["path"], began, origin)]
            yield slab_batch(r, file, planes, first, count, calls, arrow)


def slab_batch(r: dict, file, planes: np.ndarray, first: int, count: int, calls: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """Rows of neighbouring planes of one image."""
    same = {c: [r[c]] * count for c in ("block_id", "path", "dims", "header", "affine")}
    if first == 0 and data_offset(r["header"]) > DATA_OFFSET:  # the extensions travel with the first plane
        same["header"] = [file.read_at(data_offset(r["header"]), 0), *same["header"][1:]]
    rows = same | {
        "slab": list(range(first, first + count)),
        "payload": pack(planes, np.arange(count + 1) * (planes.size // count)),
        "calls": [calls] + [[]] * (count - 1),
        "error": [None] * count,
    }
    return pa.RecordBatch.from_pydict({c: rows[c] for c in arrow.names}, schema=arrow)


def shared_ranges(blocks: DataFrame, group_bytes: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cut blocks of one shape into ranges, and deal them out so that a task has the same planes of many blocks.

    Adds ``first``, ``count`` and ``group``: the rows of one (first, group) are neighbours in a task, and their planes
    take at most ``group_bytes``, or are one plane of one block.
    """
    group_bytes = group_bytes or GROUP_BYTES
    about = blocks.agg(F.count(F.lit(1)).alias("n"), F.first("dims").alias("dims")).first()
    if not about.n:
        return blocks.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("first", "count", "group")])
    plane, depth = 2 * about.dims[0] * about.dims[1], about.dims[2]
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    spread_out = max(depth // (2 * cores), LEAST_RANGE_BYTES // plane)  # enough ranges for all cores, unless they get small
    step = max(1, min(group_bytes // (plane * about.n), split_bytes // plane, spread_out))
    together = max(1, group_bytes // (plane * step))
    firsts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(depth - 1).cast("bigint"), F.lit(step).cast("bigint")))
    ranges = blocks.withColumn("first", firsts).withColumn("count", F.least(F.lit(step), F.lit(depth) - F.col("first")))
    ranges = ranges.withColumn("group", F.floor(F.col("block_id") / F.lit(together)))
    cells = -(-depth // step) * -(-about.n // together)
    return ranges.repartition(max(cores, cells), "first", "group").sortWithinPartitions("first", "group", "block_id")


def shared_step(origin: float | None = None) -> Step:
    """Turn ranges with ``donors``, a list of ``(path, its)``, into slab rows: every donor's planes are added once for
    each iteration in ``its``, wrapping at 2^16.

    Neighbouring ranges of equal ``first`` and ``group`` are read together, and each of their donors is read once for all
    of them; equal draws are one addition by a factor.
    """
    arrow, known = to_arrow_schema(schemas.SLAB), stores.registered()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["first"], r["group"]) != (held[0]["first"], held[0]["group"]):
                    yield from _shared_batches(held, origin, arrow)
                    held = []
                held.append(r)
        if held:
            yield from _shared_batches(held, origin, arrow)

    return read


def _shared_batches(rows: list[dict], origin: float | None, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    planes, calls, wanted = [], [], {}
    for k, r in enumerate(rows):
        began = time.time()
        with open_file(r["path"]) as file:
            planes.append(read_planes(r, file, r["first"], r["count"]).copy())
        calls.append([] if origin is None else [call("load", r["path"], began, origin)])
        for d in r["donors"] or ():
            wanted.setdefault(d["path"], []).append((k, d["its"]))
    for path in sorted(wanted):
        with open_file(path) as file:
            donor = _read_header(path, file.size(), file)
            if donor["error"] is not None:
                raise ValueError(f"unreadable image {path}: {donor['error']}")
            given = read_planes(donor, file, rows[0]["first"], rows[0]["count"])
        for k, its in wanted[path]:
            began = time.time()
            planes[k] += given * np.uint16(len(its) % 65_536)
            if origin is not None:
                calls[k] += [call("increment", f"{rows[k]['path']}:{path}", began, origin) for _ in its]
    for r, own, logged in zip(rows, planes, calls):
        with ExitStack() as opened:
            file = opened.enter_context(open_file(r["path"])) if r["first"] == 0 and data_offset(r["header"]) > DATA_OFFSET else None
            yield slab_batch(r, file, own, r["first"], r["count"], logged, arrow)


def read_planes(r: dict, file, first: int, count: int) -> np.ndarray:
    """Planes of one image as uint16; scaled values are truncated."""
    kind, scaling = voxel_type(r["header"]), scaling_of(r["header"])
    plane = r["dims"][0] * r["dims"][1] * kind.itemsize
    raw = np.frombuffer(file.read_at(count * plane, r["offset"] + first * plane), kind)
    values = raw if scaling is None else raw * float(scaling[0]) + float(scaling[1])
    return values.astype("<u2", copy=False)


def scan_ranges(ranges: DataFrame, origin: float | None = None) -> DataFrame:
    """Read ranges into slab rows."""
    return chain(ranges, schemas.SLAB, read_step(origin))


def complete(blocks: DataFrame, unreadable: str = "raise") -> DataFrame:
    """The blocks, after a check that all of them can be read; with ``"skip"``, those that can."""
    if unreadable == "skip":
        return blocks.where(F.col("error").isNull())
    bad = blocks.where(F.col("error").isNotNull()).select("path", "error").limit(5).collect()
    if bad:
        raise ValueError("unreadable images: " + "; ".join(f"{r['path']}: {r['error']}" for r in bad))
    return blocks


def scan_blocks(
    spark: SparkSession, folder: str, recursive: bool = False, origin: float | None = None, unreadable: str = "raise"
) -> DataFrame:
    """All images of a folder as slab rows; one that can't be read is an error, unless ``unreadable`` is ``"skip"``."""
    return scan_ranges(plane_ranges(complete(block_table(spark, folder, recursive), unreadable)), origin)


# ---------------------------------------------------------------------- write

#: What a task has written: ``part`` is the staged file, whose bytes belong at ``at`` of an image of ``size`` bytes.
WRITTEN = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("planes", T.LongType()),
        T.StructField("needed", T.LongType()),
        T.StructField("calls", T.ArrayType(schemas.CALL)),
    ]
)


def output_path(path: str, folder: str, prefix: str, below: str | None) -> str:
    """Where the image read from ``path`` is written; with ``below``, folders under that root are kept."""
    inner, name = os.path.split(path if below is None else os.path.relpath(local_path(path), local_path(below)))
    name = prefix + (name if prefix else name[:-3] + "nii")
    return os.path.join(folder, name) if below is None else os.path.join(folder, inner, name)


class Target:
    """Folder that images are written to, and how their names are made."""

    def __init__(self, folder: str, prefix: str = "", below: str | None = None, in_place: bool = True):
        """``folder`` is a full address; ``in_place`` says that it is mounted and that all tasks see the same files there."""
        self.folder = local_path(folder) if mounted(folder) else folder.rstrip("/")
        self.prefix, self.below, self.in_place = prefix, below, in_place
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"
        self.known = stores.registered()

    def place(self, path: str) -> str:
        return output_path(path, self.folder, self.prefix, self.below)

    def staged(self, path: str) -> str:
        return output_path(path, self.staging, self.prefix, self.below)

    def write_step(self, origin: float | None = None) -> Step:
        return write_step(self, origin) if self.in_place else part_step(self, origin)

    def open_staging(self) -> None:
        """Make the staging folder. Tasks make none, so one that is late can't bring back what was given up."""
        stores.make_folder(self.staging)

    def drop_staging(self) -> None:
        stores.delete_folder(self.staging)


def target_of(
    spark: SparkSession, folder: str, prefix: str = "", below: str | None = None, in_place: bool | None = None
) -> Target:
    """Resolve a folder as Spark does. On a cluster, a mounted folder must be the shared one, or said to be shared by
    ``in_place=True``: else each executor would write to a disk of its own."""
    folder = stores.qualified(spark, folder)
    if in_place is None:
        in_place = mounted(folder)
        if in_place and not stores.in_place_allowed(spark, folder):
            raise ValueError(f"{folder} is on the executors' own disks unless it is a shared mount; if it is, pass in_place=True")
    return Target(folder, prefix, below, in_place)


def write_step(target: Target, origin: float | None = None) -> Step:
    """Store the planes of slab rows in place, in any order; yields rows of :data:`WRITTEN`."""
    arrow = to_arrow_schema(WRITTEN)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts = unpack(batch)
            rows = batch.select([n for n in batch.schema.names if n != "payload"]).to_pylist()
            done = []
            for first, last in _runs(rows):
                began, r = time.time(), rows[first]
                staged = target.staged(r["path"])
                stores.make_below(target.staging, os.path.dirname(staged))
                _write_run(staged, r, values[starts[first] : starts[last]])
                done.append(_done(target, r, rows[first:last], staged, 0, began, origin))
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return write


def _done(target: Target, r: dict, rows: list[dict], part: str, at: int, began: float, origin: float | None) -> dict:
    calls = [c for row in rows for c in row["calls"] or ()]
    if origin is not None:
        calls.append(call("dump", r["path"], began, origin))
    size = data_offset(r["header"]) + 2 * r["dims"][0] * r["dims"][1] * r["dims"][2]
    return {"path": target.place(r["path"]), "part": part, "at": at, "size": size, "planes": len(rows), "needed": r["dims"][2], "calls": calls}


def _runs(rows: list[dict]) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring planes of one image."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["path"] != rows[i - 1]["path"] or rows[i]["slab"] != rows[i - 1]["slab"] + 1:
            yield first, i
            first = i


def _write_run(out: str, r: dict, values: np.ndarray) -> None:
    """Write neighbouring planes at their place; the first plane brings header and file size."""
    plane, offset = 2 * r["dims"][0] * r["dims"][1], data_offset(r["header"])
    data = memoryview(values.astype(byte_order(r["header"]) + "u2", copy=False)).cast("B")
    at = offset + plane * r["slab"]
    handle = os.open(out, os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        if r["slab"] == 0:
            os.ftruncate(handle, offset + plane * r["dims"][2])
            os.pwrite(handle, file_head(r["header"], r["dims"]), 0)
        while data:
            sent = os.pwrite(handle, data, at)
            data, at = data[sent:], at + sent
    finally:
        os.close(handle)


def part_step(target: Target, origin: float | None = None) -> Step:
    """As :func:`write_step` for stores that take whole files only: each run of neighbouring planes becomes a part.

    Planes are passed on as they come, so a part may be larger than memory. The part of the first plane has the header.
    """
    arrow = to_arrow_schema(WRITTEN)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(target.known)
        following, sink, part, at = None, None, "", 0
        for batch in batches:
            values, starts = unpack(batch)
            rows = batch.select([n for n in batch.schema.names if n != "payload"]).to_pylist()
            done = []
            for first, last in _runs(rows):
                began, r = time.time(), rows[first]
                if (r["path"], r["slab"]) != following:
                    if sink is not None:
                        sink.close()
                    plane, offset = 2 * r["dims"][0] * r["dims"][1], data_offset(r["header"])
                    at = 0 if r["slab"] == 0 else offset + plane * r["slab"]
                    # Attempts of a task have parts of their own: a late one can't disturb what the other has closed.
                    part = f"{target.staged(r['path'])}.{at}.{uuid.uuid4().hex}"
                    if not stores.exists(target.staging):
                        raise RuntimeError(f"the write to {target.folder} was given up")
                    sink = stores.create(part)
                    if at == 0:
                        sink.write(file_head(r["header"], r["dims"]))
                sink.write(values[starts[first] : starts[last]].astype(byte_order(r["header"]) + "u2", copy=False).tobytes())
                following = (r["path"], r["slab"] + last - first)
                done.append(_done(target, r, rows[first:last], part, at, began, origin))
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if sink is not None:
            sink.close()

    return write


def publish_image(path: str, parts: list[dict], in_place: bool) -> None:
    """Put an image in its place, from its staged file or its parts, ``{at, part, size, planes, needed}`` in order of ``at``.

    Planes that are missing leave zeros. A repeated call finds the image in its place and is done.
    """
    head = parts[0]
    if in_place or (len(parts) == 1 and head["at"] == 0 and head["planes"] == head["needed"]):
        stores.move(head["part"], path)
        return
    whole, position = f"{head['part']}.whole", 0
    if not all(stores.exists(p["part"]) for p in parts) and stores.exists(path):
        return
    with stores.create(whole) as sink:
        for p in parts:
            position += _zeros(sink, p["at"] - position)
            with stores.open_input(p["part"]) as source:
                source.seek(position - p["at"])
                while data := source.read(BATCH_BYTES):
                    sink.write(data)
                    position += len(data)
        _zeros(sink, head["size"] - position)
    stores.move(whole, path)


def _zeros(sink, count: int) -> int:
    for k in range(0, max(count, 0), BATCH_BYTES):
        sink.write(bytes(min(BATCH_BYTES, count - k)))
    return max(count, 0)


def publish(written: DataFrame, target: Target) -> DataFrame:
    """Move all staged images to their places, one image per row; returns what was written, then without staging folder."""
    known, in_place = target.known, target.in_place
    if in_place:  # one staged file each
        one = F.struct(F.min("part").alias("part"))
        files = written.groupBy("path").agg(F.array(one).alias("parts"))
    else:
        own = F.struct("at", "part", "size", "needed", F.col("_planes").alias("planes"))
        parts = written.groupBy("path", "part", "at", "size", "needed").agg(F.sum("planes").alias("_planes"))
        files = spread(parts.groupBy("path").agg(F.sort_array(F.collect_list(own)).alias("parts")), "path")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        for batch in batches:
            for r in batch.to_pylist():
                publish_image(r["path"], r["parts"], in_place)
            yield batch.select(["path"])

    files.mapInArrow(move, "path string").write.format("noop").mode("overwrite").save()
    target.drop_staging()
    return written


def _committed(target: Target, rows: DataFrame, *steps: Step) -> DataFrame:
    """Run the steps, the last of which writes, and publish; a failure takes the staging folder with it."""
    target.open_staging()
    try:
        return publish(materialize(chain(rows, WRITTEN, *steps), "written"), target)
    except BaseException:
        target.drop_staging()
        raise


def _parts(planes: str) -> list:
    """Keys by which planes, or ranges, of a large image go to several tasks."""
    bytes_before = F.col(planes) * F.get("dims", F.lit(0)) * F.get("dims", F.lit(1)) * 2
    return [F.col("path"), F.floor(bytes_before / PART_BYTES)]


def write_planes(
    slabs: DataFrame,
    folder: str,
    prefix: str = "",
    origin: float | None = None,
    below: str | None = None,
    in_place: bool | None = None,
) -> DataFrame:
    """Write slab rows to image files in ``folder``; runs at once.

    On mounted folders every task writes its planes in place, so nothing is shuffled or gathered.
    Other stores take an image in parts, which brings the planes of each to one task, in order.
    """
    target = target_of(slabs.sparkSession, folder, prefix, below, in_place)
    good = slabs.where(F.col("error").isNull())
    if not target.in_place:
        n = int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        good = good.repartition(n, *_parts("slab")).sortWithinPartitions("path", "slab")
    return _committed(target, good, target.write_step(origin))


def rewrite_ranges(
    ranges: DataFrame,
    folder: str,
    *changes: Step,
    prefix: str = "",
    origin: float | None = None,
    in_place: bool | None = None,
    read: Step | None = None,
) -> DataFrame:
    """Read ranges, change their planes and write them, all in one task; runs at once. ``read`` replaces the plain reading.

    Where files cannot be written in place, the ranges of a part go to one task; only these
    few-byte rows move, never voxels.
    """
    target = target_of(ranges.sparkSession, folder, prefix, None, in_place)
    if not target.in_place:
        planned = ranges.agg(F.sum(F.col("count") * F.get("dims", F.lit(0)) * F.get("dims", F.lit(1)) * 2)).first()[0] or 0
        n = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), planned // PART_BYTES)
        ranges = ranges.repartition(n, *_parts("first")).sortWithinPartitions("path", "first")
    return _committed(target, ranges, read or read_step(origin), *changes, target.write_step(origin))


def write_status(written: DataFrame) -> DataFrame:
    """``(path, status)`` per file: SUCCESS when all of its planes were written."""
    totals = written.groupBy("path").agg(F.sum("planes").alias("planes"), F.max("needed").alias("needed"))
    status = F.when(F.col("planes") == F.col("needed"), "SUCCESS").otherwise("INCOMPLETE")
    return totals.select("path", status.alias("status"))


def write_blocks(slabs: DataFrame, folder: str, prefix: str = "", below: str | None = None) -> DataFrame:
    """Write images and return their status."""
    return write_status(write_planes(slabs, folder, prefix, below=below))


def write_classified(slabs: DataFrame, folder: str) -> DataFrame:
    """Write label images as ``classified-<name>`` and return their status."""
    return write_blocks(slabs, folder, "classified-")
