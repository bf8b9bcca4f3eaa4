"""File lists, and what folder names tell."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.functions import labels as fl
from brickwork.operators.ordinals import with_row_number
from brickwork.session import materialize
from brickwork.sources import stores
from brickwork.sources.stores import qualified  # noqa: F401  (part of this module's interface)

SUFFIX = ".nii"
#: Folders that a task lists, and files that it hands on.
FOLDERS, FILES = 256, 32
_FOUND = "path string, length bigint, folder boolean"


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """Files below ``folder`` as ``(path, length)``. File contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "length")


def list_blocks(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Image files of a folder, or of the whole tree below it. A tree is listed by tasks: its names stay off the driver."""
    if recursive and (roots := _roots(spark, folder)):
        return _tree(spark, roots, SUFFIX)
    return list_files(spark, folder, "*" + SUFFIX, recursive)


def _roots(spark: SparkSession, folder: str) -> list[str]:
    """The folders that a path, or a pattern of paths, stands for; none where only Spark's reader can tell or list them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = system.globStatus(path) or []
    if not all(f.isDirectory() for f in found):
        return []
    roots = [qualified(spark, f.getPath().toString()) for f in found]
    return roots if all(stores.reachable(r) for r in roots) else []


def _shown(name: str, folder: bool) -> bool:
    """Whether Spark's readers take a file, or go into a folder, of this name."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return True
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _tree(spark: SparkSession, roots: list[str], suffix: str) -> DataFrame:
    """Files ``(path, length)`` below ``roots`` as Spark's readers see them: neither hidden nor empty ones.

    One round per level of the tree. A task lists some folders and stores what it finds, so that only the number of
    folders of each level comes to the driver.
    """
    known = stores.registered()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.use(known)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [
                    (path, size, below) for path, name, size, below in stores.list_folder(folder)
                    if _shown(name, below) and (below or (name.endswith(suffix) and size > 0))
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "length", "folder"])

    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, folders, count = [], spark.createDataFrame([(r,) for r in roots], "path string"), len(roots)
    while count:
        dealt = folders.repartition(min(most, -(-count // FOLDERS)))
        levels.append(materialize(dealt.mapInArrow(inside, _FOUND), "listed"))
        folders = levels[-1].where("folder").select("path")
        count = folders.count()
    files = reduce(DataFrame.unionByName, levels).where("not folder").select("path", "length")
    return files.repartition(min(most, -(-files.count() // FILES) or 1))


def suffix_filter(files: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """Files whose name ends with ``suffix``."""
    return files.where(F.col("path").endswith(suffix))


def block_ordinal(files: DataFrame) -> DataFrame:
    """Number files from 0 in path order, as ``block_id``."""
    numbered = with_row_number(files, "_no", ["path"])
    return numbered.withColumn("block_id", F.col("_no").cast("bigint") - 1).drop("_no")


_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _cohort_parts(paths: DataFrame, root: str | None) -> DataFrame:
    """Site and subject folder: the two below ``root``, or without one the first pair that looks so."""
    if root is None:
        below, inside = F.col("path"), "/([^/]+)/(sub-[^/]*)/"
    else:
        top = re.sub(_STORE, "", root).rstrip("/") + "/"
        whole = F.regexp_replace("path", _STORE, "")
        below = F.when(whole.startswith(top), F.substr(whole, F.lit(len(top) + 1)))
        inside = "^([^/]+)/(sub-[^/]*)/"
    return paths.select(
        "path",
        F.regexp_extract(below, inside, 1).alias("site"),
        F.regexp_extract(below, inside, 2).alias("_folder"),
    ).where(F.col("_folder") != "")


def site_list(paths: DataFrame, root: str | None = None) -> DataFrame:
    """Sites of a cohort tree ``<root>/<site>/sub-<id>/…``."""
    return _cohort_parts(paths, root).select("site").distinct()


def subject_list(paths: DataFrame, root: str | None = None) -> DataFrame:
    """Distinct ``(site, subject)`` of a cohort tree."""
    return _cohort_parts(paths, root).select("site", fl.subject_of(F.col("_folder")).alias("subject")).distinct()


def subject_images(paths: DataFrame, root: str | None = None) -> DataFrame:
    """Site and subject of every image path of a cohort tree."""
    return _cohort_parts(paths, root).select("path", "site", fl.subject_of(F.col("_folder")).alias("subject"))
