"""Table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CALL = T.StructType(
    [
        T.StructField("func", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("worker", T.StringType()),
        T.StructField("thread", T.LongType()),
        T.StructField("process", T.LongType()),
    ]
)

#: One z-plane of one image. ``payload`` is little-endian uint16, x fastest.
SLAB = T.StructType(
    [
        T.StructField("block_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("slab", T.LongType()),
        T.StructField("dims", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("header", T.BinaryType()),
        T.StructField("affine", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("calls", T.ArrayType(CALL)),
        T.StructField("error", T.StringType()),
    ]
)

#: Header of one image file; one row per file.
BLOCK = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("dims", T.ArrayType(T.LongType())),
        T.StructField("offset", T.LongType()),
        T.StructField("header", T.BinaryType()),
        T.StructField("affine", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("error", T.StringType()),
    ]
)

#: Trace file: seven columns, no header line, times in seconds since the start of the run.
TRACE_FILE = T.StructType(
    [
        T.StructField("func", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("filename", T.StringType()),
        T.StructField("worker", T.StringType()),
        T.StructField("thread", T.LongType()),
        T.StructField("process", T.LongType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df``, or raise when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the column(s) {', '.join(missing)}")
    return df


def require_trace(df: DataFrame, lane: str, framework: str) -> DataFrame:
    """Check that a trace can be drawn as lanes: known framework, all columns present."""
    if framework.lower() not in ("dask", "spark"):
        raise ValueError(f"{framework} is not a supported framework")
    if framework.lower() == "spark":
        require_columns(df, "process")
    times = ("start", "end") if "start" in df.columns else ("start_us", "end_us")
    return require_columns(df, "func", *times, "filename", "thread", lane)
