"""The ``nifti`` data source: ``spark.read.format("nifti")`` and ``df.write.format("nifti")``.

Reading is planned on the listing alone. Large files are cut into shares by their length, ``splitBytes`` each, small ones are
put together; a task opens its files, reads their headers, and then its share of the planes. Filters on ``path`` and ``block_id`` drop files before
any is opened; filters on ``slab`` cut the planes that are read. A schema without ``payload`` reads headers only.

Columns are those of :data:`brickwork.schemas.SLAB`. ``block_id`` numbers the files by path, whatever the filters.

Options for reading: ``recursive`` (``false``), ``splitBytes``, ``unreadable`` (``raise``, ``skip``, or ``keep``: one row
with ``error`` set). For writing: ``prefix`` and ``below``, as in :func:`brickwork.sources.nifti.write_planes`, and
``shared`` (``true`` where all tasks see the same files in a mounted folder).

A write stages its files inside the target; the commit moves them to their places, an abort removes them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork import schemas
from brickwork.session import ship_package
from brickwork.sources import nifti, stores
from brickwork.sources.listing import SUFFIX

SPLIT_BYTES = 128 << 20
#: What opening a file counts for where small files are put together.
OPEN_BYTES = 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the ``nifti`` format known to a session. Filters reach it if the session's setting ``PUSHDOWN`` is on, which this does."""
    ship_package(spark)
    spark.conf.set(PUSHDOWN, "true")
    home = stores.qualified(spark, "/")
    local = spark.sparkContext.master.startswith("local")
    # Sources are planned in a process of their own, without a session: what is known here goes with the class.
    known = pickle.dumps(stores.registered())
    spark.dataSource.register(type("Nifti", (Nifti,), {"home": home, "local": local, "known": known, "cores": spark.sparkContext.defaultParallelism}))


def read(spark: SparkSession, folder: str, schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Images of a folder as slab rows."""
    register(spark)
    reader = spark.read.format("nifti").options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(folder)


def write(slabs: DataFrame, folder: str, **options: object) -> None:
    """Write slab rows to image files, all of them or none. Planes of an image may be spread over tasks on mounted folders."""
    register(slabs.sparkSession)
    slabs.write.format("nifti").mode("append").options(**options).save(folder)


class Nifti(ds.DataSource):
    home, local, known, cores = "file:/", True, pickle.dumps({}), 1

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> T.StructType:
        return schemas.SLAB

    def folder(self) -> str:
        """The folder's full address: one without scheme belongs to the session's default file system."""
        path = self.options["path"]
        if ":" in path.split("/")[0]:
            return path
        if not path.startswith("/"):
            raise ValueError(f"{path} is neither an address nor an absolute path")
        return self.home.rstrip("/") + path

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return Reader(self.folder(), schema, self.options, self.known, self.cores)

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("images are replaced one by one: use mode append")
        needed = [f.name for f in schemas.SLAB if f.name in ("path", "slab", "dims", "payload", "header")]
        if missing := [n for n in needed if n not in schema.names]:
            raise ValueError(f"the table lacks the column(s) {', '.join(missing)}")
        folder = self.folder()
        shared = str(self.options.get("shared", self.local)).lower() == "true"
        if stores.mounted(folder) and not shared:
            raise ValueError(f"{folder} is on the executors' own disks unless it is a shared mount; if it is, set the option shared")
        stores.use(pickle.loads(self.known))
        target = nifti.Target(folder, self.options.get("prefix", ""), self.options.get("below"), stores.mounted(folder))
        target.open_staging()
        return Writer(target)


# ----------------------------------------------------------------------- read


@dataclass
class Share:
    """A share of one file's planes: the ``index``-th of ``count`` equal ones."""

    block_id: int
    path: str
    length: int
    index: int
    count: int


@dataclass
class Shares(ds.InputPartition):
    """What one task reads: a share of a large file, or several small files."""

    shares: list[Share]


class Reader(ds.DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType, options, known: bytes, cores: int = 1):
        self.folder, self.wanted, self.known, self.cores = folder, schema, known, max(cores, 1)
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.unreadable = options.get("unreadable", "raise")
        if self.unreadable not in ("raise", "skip", "keep"):
            raise ValueError(f"unreadable is {self.unreadable!r}, not raise, skip or keep")
        self.files: list[ds.Filter] = []
        self.planes: list[ds.Filter] = []

    def pushFilters(self, filters):
        """Take filters on the file and on the plane; the others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("path",), ("block_id",)) and isinstance(f, tuple(_TESTS)):
                self.files.append(f)
            elif column == ("slab",) and isinstance(f, tuple(_TESTS)) and self.unreadable != "keep":
                self.planes.append(f)
            else:
                yield f

    def partitions(self) -> list[Shares]:
        stores.use(pickle.loads(self.known))
        shares: list[Share] = []
        for number, (path, length) in enumerate(stores.list_files(self.folder, SUFFIX, self.recursive)):
            if all(_holds(f, number if f.attribute == ("block_id",) else path) for f in self.files):
                count = max(1, -(-length // self.split_bytes)) if "payload" in self.wanted.names else 1
                shares += [Share(number, path, length, k, count) for k in range(count)]
        sizes = [s.length // s.count + OPEN_BYTES for s in shares]
        most = min(self.split_bytes, max(OPEN_BYTES, sum(sizes) // self.cores))
        tasks, held = [], most + 1
        for share, size in zip(shares, sizes):
            if held + size > most:
                tasks.append(Shares([]))
                held = 0
            tasks[-1].shares.append(share)
            held += size
        return tasks or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        stores.use(pickle.loads(self.known))
        for share in partition.shares:
            yield from self._share(share)

    def _share(self, share: Share) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.wanted)
        with ExitStack() as opened:
            file = opened.enter_context(nifti.open_file(share.path))
            row = nifti._read_header(share.path, share.length, file) | {"block_id": share.block_id}
            if row["error"] is not None:
                if self.unreadable == "raise":
                    raise ValueError(f"unreadable image {share.path}: {row['error']}")
                if self.unreadable == "keep" and share.index == 0:
                    yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in arrow.names}], schema=arrow)
                return
            depth = row["dims"][2]
            first, end = (depth * k // share.count for k in (share.index, share.index + 1))
            for a, b in _stretches([z for z in range(first, end) if all(_holds(f, z) for f in self.planes)]):
                yield from self._planes(row, file, a, b - a, arrow)

    def _planes(self, row: dict, file, first: int, count: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        if "payload" in arrow.names:
            full = to_arrow_schema(schemas.SLAB)
            step = max(1, nifti.BATCH_BYTES // (2 * row["dims"][0] * row["dims"][1]))
            for at in range(first, first + count, step):
                some = min(step, first + count - at)
                batch = nifti.slab_batch(row, file, nifti.read_planes(row, file, at, some), at, some, [], full)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in arrow.names], schema=arrow)
        else:
            same = {n: [row.get(n)] * count for n in arrow.names}
            same |= {n: v for n, v in (("slab", list(range(first, first + count))), ("calls", [[]] * count)) if n in same}
            yield pa.RecordBatch.from_pydict(same, schema=arrow)


def _stretches(planes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring numbers, end exclusive."""
    first = 0
    for i in range(1, len(planes) + 1):
        if i == len(planes) or planes[i] != planes[i - 1] + 1:
            yield planes[first], planes[i - 1] + 1
            first = i


#: A null never passes: path, number and plane are never null, and comparisons with null hold for nothing.
_TESTS = {
    ds.EqualTo: lambda f, v: f.value is not None and v == f.value,
    ds.EqualNullSafe: lambda f, v: v == f.value,
    ds.In: lambda f, v: v in f.value,
    ds.GreaterThan: lambda f, v: f.value is not None and v > f.value,
    ds.GreaterThanOrEqual: lambda f, v: f.value is not None and v >= f.value,
    ds.LessThan: lambda f, v: f.value is not None and v < f.value,
    ds.LessThanOrEqual: lambda f, v: f.value is not None and v <= f.value,
    ds.StringStartsWith: lambda f, v: v.startswith(f.value),
    ds.StringEndsWith: lambda f, v: v.endswith(f.value),
    ds.StringContains: lambda f, v: f.value in v,
    ds.IsNotNull: lambda f, v: True,
}


def _holds(f: ds.Filter, value) -> bool:
    return _TESTS[type(f)](f, value)


# ---------------------------------------------------------------------- write


@dataclass
class Staged(ds.WriterCommitMessage):
    """What one task staged: ``(path, part, at, size, planes, needed)`` of each run of planes."""

    runs: list[tuple]


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, target: nifti.Target):
        self.target = target

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        stores.use(self.target.known)
        full = (_with_calls(b.filter(b.column(b.schema.get_field_index("payload")).is_valid())) for b in iterator)
        total: dict[tuple, int] = {}
        for batch in self.target.write_step()(full):
            for r in batch.to_pylist():
                key = (r["path"], r["part"], r["at"], r["size"], r["needed"])
                total[key] = total.get(key, 0) + r["planes"]
        return Staged([(*key, n) for key, n in total.items()])

    def commit(self, messages: list[Staged | None]) -> None:
        """Publish every image. Only names and numbers come to the driver, and only renames happen there."""
        stores.use(self.target.known)
        images: dict[str, dict[tuple, int]] = {}
        for path, part, at, size, needed, planes in (r for m in messages if m is not None for r in m.runs):
            parts = images.setdefault(path, {})
            parts[at, part, size, needed] = parts.get((at, part, size, needed), 0) + planes
        if not self.target.in_place and (several := [p for p, parts in images.items() if len(parts) > 1]):
            self.target.drop_staging()
            raise ValueError(f"planes of {several[0]} came from several tasks: repartition by path, or use write_planes")
        for path, parts in images.items():
            rows = [dict(zip(("at", "part", "size", "needed"), key)) | {"planes": n} for key, n in sorted(parts.items())]
            nifti.publish_image(path, rows, self.target.in_place)
        self.target.drop_staging()

    def abort(self, messages: list[Staged | None]) -> None:
        stores.use(self.target.known)
        self.target.drop_staging()


def _with_calls(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with a column ``calls``, which the writing step passes on."""
    if "calls" in batch.schema.names:
        return batch
    return batch.append_column("calls", pa.nulls(len(batch), pa.null()))
