"""Trace files: writing, scanning, compacting, and the catalogue of runs."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork import schemas
from brickwork.functions import labels as fl
from brickwork.operators.trace import SECOND, seconds
from brickwork.session import broadcast_if_small, materialize, spread
from brickwork.sources import stores
from brickwork.sources.listing import list_files

_FILE_COLUMNS = [f.name for f in schemas.TRACE_FILE.fields]


def write_trace(calls: DataFrame, folder: str, mode: str = "append") -> None:
    """Append calls with ``label`` and ``run_id`` to headerless CSV logs, one folder per run."""
    times = [seconds(F.col("start_us")).alias("start"), seconds(F.col("end_us")).alias("end")]
    rows = calls.select("func", *times, "filename", "worker", "thread", "process", "label", "run_id")
    rows.write.mode(mode).partitionBy("label", "run_id").csv(folder)


def _with_us(df: DataFrame) -> DataFrame:
    for name in ("start", "end"):
        df = df.withColumn(f"{name}_us", F.round(F.col(name) * SECOND).cast("bigint"))
    return df


def _with_seq(df: DataFrame) -> DataFrame:
    """Input order: file, then byte range, then line."""
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")
    )
    return df.select("*", place.alias("seq"))


def scan_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Read logs written by :func:`write_trace`; ``label`` and ``run_id`` prune folders."""
    schema = schemas.T.StructType([*schemas.TRACE_FILE.fields])
    schema = schema.add("label", "string").add("run_id", "string")
    return _with_us(_with_seq(spark.read.schema(schema).csv(folder)))


def scan_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Read ``<folder>/<label>/summary-<run>.csv`` files, as other tools lay them out."""
    reader = spark.read.schema(schemas.TRACE_FILE).option("recursiveFileLookup", "true")
    rows = _with_seq(reader.option("pathGlobFilter", "summary-*.csv").csv(folder))
    path = F.url_decode("seq.file_path")
    return _with_us(rows.withColumn("label", fl.parent_name(path)).withColumn("run_id", run_of(path)))


def run_of(path):
    """Run id in a summary file name."""
    return F.regexp_extract(fl.basename(path), r"summary-(.*)\.csv$", 1)


def merge_traces(spark: SparkSession, logs: str, summaries: str) -> None:
    """Compact the many small logs of every run into few summary files; the logs stay.

    A run that was merged before is replaced, so merging again, or after a failure, doubles nothing.

    Rebalancing puts a run's rows together and splits a run that is too large for one file.
    """
    rows = scan_traces(spark, logs).select(*_FILE_COLUMNS, "label", "run_id")
    compact = rows.hint("rebalance", "label", "run_id")
    compact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "run_id").csv(summaries)


# Folders of raw logs: ``<folder>/<label>/<run>/<name>.log``, one or more per worker, which workers go on appending to.

LOG_SUFFIX = ".log"
#: Bytes of log text that a merged file is made from.
MERGED_BYTES = 128 << 20


def write_logs(calls: DataFrame, folder: str) -> None:
    """Write calls with ``label`` and ``run_id`` as raw logs, one file per run and worker."""
    seconds_of = [F.format_string("%.6f", seconds(F.col(c))) for c in ("start_us", "end_us")]
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("filename", "worker", "thread", "process")]
    lines = calls.select(
        F.concat_ws("/", "label", "run_id", F.concat(F.coalesce("worker", F.lit("none")), F.lit(LOG_SUFFIX))).alias("name"),
        F.concat_ws(",", "func", *seconds_of, *rest).alias("line"),
    )
    base, known = stores.qualified(calls.sparkSession, folder).rstrip("/"), stores.registered()

    def write(batches):
        stores.use(known)
        name, sink = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if sink is not None:
                        sink.close()
                    name, sink = row["name"], stores.create(f"{base}/{row['name']}")
                sink.write((row["line"] + "\n").encode())
            yield batch.select(["name"])
        if sink is not None:
            sink.close()

    sorted_lines = spread(lines, "name").sortWithinPartitions("name")
    sorted_lines.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def _source(path):
    """Label, run and file name of a raw log, as one string."""
    return F.substring_index(path, "/", -3)


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw logs ``(source, length, folder)`` below a folder; empty ones are left out."""
    files = list_files(spark, folder, "*" + LOG_SUFFIX, recursive=True).where("length > 0")
    return files.select(_source(F.col("path")).alias("source"), "length", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


def _manifest(spark: SparkSession, target: str) -> DataFrame:
    """Merged logs ``(source, length, batch, made)``; of one that grew, all lengths it was merged at."""
    schema = "source string, length bigint, batch string, made bigint"
    path = f"{target.rstrip('/')}/_manifest"
    if not stores.exists(stores.qualified(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _current(manifest: DataFrame) -> DataFrame:
    """The batch that holds each log: the last one it was merged in."""
    last = F.max_by(F.struct("batch", "length"), F.struct("made", "batch")).alias("last")
    return manifest.groupBy("source").agg(last).select("source", "last.*")


def merge_logs(spark: SparkSession, folder: str, target: str, file_bytes: int = MERGED_BYTES) -> int:
    """Merge the raw logs that are new, or longer than when they were merged; returns how many. The logs stay.

    A merge writes a batch of Parquet files, of about ``file_bytes`` of log text each, and then names what it holds in
    the manifest. A batch that the manifest doesn't name, say of a merge that failed, is never read, so merging may be
    repeated at any time. A log that grew is merged again as a whole, and its rows in earlier batches are no longer read.
    """
    logs = materialize(list_logs(spark, folder), "logs")
    known = _current(_manifest(spark, target)).select("source", F.col("length").alias("_merged"))
    todo = logs.join(known, "source", "left").where(F.col("_merged").isNull() | (F.col("_merged") != F.col("length"))).drop("_merged")
    todo = materialize(todo, "todo")
    count, size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not count:
        return 0
    # Folders of runs with new logs: only these are read, unless a name would be taken for a pattern.
    folders = [r.folder for r in todo.select("folder").distinct().collect()]
    if any(re.search(r"[\\*?\[\]{}]", f) for f in folders):
        folders = [folder]
    reader = spark.read.schema(schemas.TRACE_FILE).option("pathGlobFilter", "*" + LOG_SUFFIX).option("recursiveFileLookup", "true")
    rows = _with_seq(reader.csv(folders))
    source = _source(F.url_decode("seq.file_path"))
    rows = rows.select(source.alias("source"), F.col("seq.file_block_start").alias("at"), F.col("seq.line").alias("line"), *_FILE_COLUMNS)
    chosen = rows.join(broadcast_if_small(todo.select("source")), "source", "left_semi")
    batch = uuid.uuid4().hex
    parts = max(1, -(-size // file_bytes))
    chosen.repartitionByRange(parts, "source", "at", "line").write.parquet(f"{target.rstrip('/')}/batch={batch}")
    made = F.lit(time.time_ns())
    named = todo.select("source", "length", F.lit(batch).alias("batch"), made.alias("made"))
    named.write.mode("append").parquet(f"{target.rstrip('/')}/_manifest")
    return count


def scan_merged(spark: SparkSession, target: str) -> DataFrame:
    """All merged calls, with ``label``, ``run_id`` and ``seq``, their order."""
    current = _current(_manifest(spark, target)).select("source", "batch")
    fields = [T.StructField("source", T.StringType()), T.StructField("at", T.LongType()), T.StructField("line", T.LongType())]
    schema = T.StructType([*fields, *schemas.TRACE_FILE.fields, T.StructField("batch", T.StringType())])
    batches = [r.batch for r in current.select("batch").distinct().collect()]  # one per merge
    if not batches:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).option("basePath", target).parquet(*[f"{target.rstrip('/')}/batch={b}" for b in batches])
    rows = rows.join(broadcast_if_small(current), ["source", "batch"], "left_semi")
    names = F.split("source", "/")
    found = rows.select(*_FILE_COLUMNS, F.get(names, F.lit(0)).alias("label"), F.get(names, F.lit(1)).alias("run_id"), F.struct("source", "at", "line").alias("seq"))
    return _with_us(found)


def run_catalog(files: DataFrame) -> DataFrame:
    """Runs behind trace file paths: ``(label, run_id, framework)``, for both folder layouts."""
    path = F.col("path")
    own = path.contains("/label=")
    label = F.when(own, F.url_decode(F.regexp_extract(path, "/label=([^/]*)/", 1))).otherwise(fl.parent_name(path))
    run = F.when(own, F.url_decode(F.regexp_extract(path, "/run_id=([^/]*)/", 1))).otherwise(run_of(path))
    runs = files.select(label.alias("label"), run.alias("run_id")).distinct()
    return runs.withColumn("framework", fl.label_framework(F.col("label")))


def list_trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all trace files below a folder."""
    return list_files(spark, folder, "*.csv", recursive=True)


def write_histogram(histogram: DataFrame, folder: str) -> None:
    """Write ``bin;count`` lines, ascending, in one file: 65,535 rows by definition."""
    one = histogram.select("bin", "n").repartition(1).sortWithinPartitions("bin")
    one.write.mode("overwrite").option("sep", ";").csv(f"{folder.rstrip('/')}/histogram.csv")
