"""Aggregates over run traces.

A trace has one row per function call: ``seq, func, start_us, end_us, filename, worker, thread,
process`` and, when several runs share a table, columns that name the run. Times are whole
microseconds, so sums are exact; seconds appear only in the last projection. ``by`` names the
columns that tell runs apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions import intensity as fi
from brickwork.functions import labels as fl
from brickwork.session import broadcast_if_small, materialize

SECOND = 1_000_000
SAMPLES = 100
#: A file name is hot from this share of a shuffle partition's rows on: a quarter.
HOT_SHARES = 4
#: Length of the stretches of time that calls are dealt out by when points are counted.
STRETCH_SECONDS = 300
#: Sample points that one task makes where they are told apart: they take some hundred bytes each.
TASK_POINTS = 1 << 19


def seconds(us: Column) -> Column:
    """Microseconds as seconds in a double."""
    return us.cast("double") / F.lit(float(SECOND))


def runtime_us() -> Column:
    return F.col("end_us") - F.col("start_us")


# ---------------------------------------------------------------- projections


def with_runtime(trace: DataFrame) -> DataFrame:
    """Add ``runtime`` in seconds."""
    return trace.withColumn("runtime", seconds(runtime_us()))


def with_effective_thread(trace: DataFrame) -> DataFrame:
    """Replace the thread by the process for runs of Spark."""
    return trace.withColumn("thread", fl.effective_thread(F.col("framework"), F.col("thread"), F.col("process")))


def with_shown_func(trace: DataFrame) -> DataFrame:
    """Replace function names by the names shown in reports."""
    return trace.withColumn("func", fl.shown_func(F.col("func")))


def _dealt(rows: DataFrame, calls: DataFrame, samples: int, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` ahead of making points: as :func:`spread`, or to more partitions if ``calls`` are many."""
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(few, calls.count() * samples // TASK_POINTS), *keys)


def active_points(trace: DataFrame, samples: int = SAMPLES, by: Sequence[str] = ()) -> DataFrame:
    """Evenly spaced sample points of every call, between its rounded start and end.

    ``point`` numbers the samples of a call from 0. Where points are then grouped by columns, these are named in ``by``:
    calls are dealt out by them, so that only calls are shuffled, never points.
    """
    if by:
        trace = _dealt(trace, trace, samples, *by)
    begin, end = (F.bround(seconds(F.col(c)), 0) for c in ("start_us", "end_us"))
    index = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    rows = trace.withColumn("_begin", begin).withColumn("_end", end).withColumn("point", index)
    active = fi.spaced(F.col("_begin"), F.col("_end"), F.col("point"), samples)
    return rows.withColumn("active", active).drop("_begin", "_end")


# -------------------------------------------------------------------- filters


def of_worker(trace: DataFrame, worker: str) -> DataFrame:
    """Calls of one worker."""
    return trace.where(F.col("worker") == worker)


def same_file_events(trace: DataFrame, selected: DataFrame) -> DataFrame:
    """All calls on a file that any selected call touched.

    Few names are broadcast. Of many, those that hold a large share of the calls are told apart by a count and broadcast
    by themselves (there are at most ``HOT_SHARES`` for each shuffle partition); the calls on all others are shuffled.
    """
    names = materialize(selected.select("filename").where(F.col("filename").isNotNull()).distinct(), "names")
    small = broadcast_if_small(names)
    if small is not names:
        return trace.join(small, "filename", "left_semi")
    counts = materialize(trace.where(F.col("filename").isNotNull()).groupBy("filename").agg(F.count(F.lit(1)).alias("_n")), "file_counts")
    least = counts.agg(F.sum("_n")).first()[0] or 0
    least /= HOT_SHARES * int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(counts.where(F.col("_n") > least).select("filename"), "hot_files")
    chosen = F.broadcast(hot.join(names, "filename", "left_semi"))
    rest = trace.join(F.broadcast(hot), "filename", "left_anti").join(names, "filename", "left_semi")
    return trace.join(chosen, "filename", "left_semi").unionByName(rest)


# --------------------------------------------------------------- per function


def avg_func_time(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean runtime per function, in seconds."""
    mean = F.sum(runtime_us()).cast("double") / F.count(F.lit(1)) / F.lit(float(SECOND))
    return trace.groupBy(*by, "func").agg(mean.alias("runtime"))


def func_count(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls with a file name, per function."""
    return trace.groupBy(*by, "func").agg(F.count("filename").alias("n"))


def func_total(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total runtime per function, in seconds."""
    return trace.groupBy(*by, "func").agg(seconds(F.sum(runtime_us())).alias("runtime"))


def sorted_functions(trace: DataFrame) -> DataFrame:
    """Function names in order."""
    return trace.select("func").distinct().orderBy("func")


def distinct_values(trace: DataFrame, columns: Sequence[str] = ("worker", "thread", "func")) -> DataFrame:
    """Distinct values of several columns as ``(kind, value)``, in one pass."""
    tagged = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return trace.select(F.inline(tagged).alias("kind", "value")).distinct()


# --------------------------------------------------------------- concurrency


def concurrency(
    trace: DataFrame, by: Sequence[str] = (), thread_key: Sequence[str] = ("thread",), samples: int = SAMPLES
) -> DataFrame:
    """Number of threads active at each sample point.

    Calls with equal rounded ends and equal thread give the same points, so they are reduced
    to one before points are made; a call that starts and ends in the same second gives one.

    Calls are dealt out by run and stretch of time, one row for each stretch that has points of the call. All points of a
    stretch are then made, told apart and counted in one task: only calls are shuffled, never points, and a run with
    most of the calls is spread over its stretches.
    """
    thread = list(thread_key)
    begin, end = (F.bround(seconds(F.col(c)), 0) for c in ("start_us", "end_us"))
    spans = trace.dropna(subset=thread).select(*by, *thread, begin.alias("_b"), end.alias("_e")).distinct()
    point = lambda i: fi.spaced(F.col("_b"), F.col("_e"), i, samples)
    stretch = lambda t: F.floor(t / F.lit(float(STRETCH_SECONDS)))
    index = F.sequence(F.lit(0), F.when(F.col("_b") == F.col("_e"), F.lit(0)).otherwise(F.lit(samples - 1)))
    one = stretch(F.col("_b")).eqNullSafe(stretch(F.col("_e")))
    touched = F.when(one, F.array(stretch(F.col("_b")))).otherwise(F.array_distinct(F.transform(index, lambda i: stretch(point(i)))))
    dealt = _dealt(spans.withColumn("_s", F.explode(touched)), trace, samples, *by, "_s")
    points = dealt.withColumn("_i", F.explode(index)).withColumn("active", point(F.col("_i")))
    inside = points.where(stretch(F.col("active")).eqNullSafe(F.col("_s")))
    unique = inside.select(*by, "_s", "active", *thread).distinct()
    return unique.groupBy(*by, "_s", "active").agg(F.count(F.lit(1)).alias("threads")).drop("_s")


def concurrency_summary(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of the thread counts.

    Equal counts are merged first, so the exact quartiles hold one entry per distinct count.
    """
    levels = points.groupBy(*by, F.col("threads").alias("t")).agg(F.count(F.lit(1)).alias("w"))
    weight, total, square = F.sum("w"), F.sum(F.col("t") * F.col("w")), F.sum(F.col("t").cast("double") * F.col("t") * F.col("w"))
    quartiles = F.percentile("t", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w"))
    one = levels.groupBy(*by).agg(
        weight.alias("_n"), total.alias("_s"), square.alias("_q"), F.min("t").alias("_lo"), F.max("t").alias("_hi"),
        quartiles.alias("_p"),
    )
    n, s, q = (F.col(c).cast("double") for c in ("_n", "_s", "_q"))
    spread = F.when(F.col("_n") > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    return one.select(
        *by, F.col("_n").alias("count"), (s / n).alias("mean"), spread.alias("std"), F.col("_lo").alias("min"),
        F.get("_p", F.lit(0)).alias("p25"), F.get("_p", F.lit(1)).alias("p50"), F.get("_p", F.lit(2)).alias("p75"),
        F.col("_hi").alias("max"),
    )


# ---------------------------------------------------------------- idle, waste


def thread_busy(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Busy time and last end of every (worker, thread), in microseconds; null keys left out."""
    return (
        trace.dropna(subset=["worker", "thread"])
        .groupBy(*by, "worker", "thread")
        .agg(F.sum(runtime_us()).alias("busy_us"), F.max("end_us").alias("last_us"))
    )


def cores_used(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct (worker, thread)."""
    return thread_busy(trace, by).groupBy(*by).agg(F.count(F.lit(1)).alias("cores"))


def wasted_time(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Makespan times cores minus the runtime of all calls, in seconds.

    Calls without worker or thread count for runtime and makespan, but are no core.
    """
    lanes = (
        trace.groupBy(*by, "worker", "thread")
        .agg(F.sum(runtime_us()).alias("_busy"), F.max("end_us").alias("_last"))
        .withColumn("_core", (F.col("worker").isNotNull() & F.col("thread").isNotNull()).cast("bigint"))
    )
    waste = F.max("_last") * F.sum("_core") - F.sum("_busy")
    return lanes.groupBy(*by).agg(seconds(waste).alias("wasted"))


def idle_time(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Time each thread spent before its own last end without running a call, summed, in seconds."""
    idle = F.sum(F.col("last_us") - F.col("busy_us"))
    return thread_busy(trace, by).groupBy(*by).agg(seconds(idle).alias("idle"))


def makespan(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last end, in seconds."""
    return trace.groupBy(*by).agg(seconds(F.max("end_us")).alias("makespan"))


def metric_rows(
    trace: DataFrame, by: Sequence[str], overhead: str | Callable[[DataFrame, Sequence[str]], DataFrame] = "idle"
) -> DataFrame:
    """Long form ``(…by, metric, us)``: the overhead and the total runtime of every function.

    ``overhead`` is ``idle``, ``wasted``, or a function of trace and ``by`` that gives rows ``(…by, us)``; its name is the metric's.
    One pass reduces the calls to (run, function, worker, thread) rows; both parts are built
    from that stored table.
    """
    small = materialize(
        trace.groupBy(*by, "func", "worker", "thread").agg(
            F.sum(runtime_us()).alias("_busy"), F.max("end_us").alias("_last")
        ),
        "metrics",
    )
    lanes = small.groupBy(*by, "worker", "thread").agg(F.sum("_busy").alias("_busy"), F.max("_last").alias("_last"))
    known = F.col("worker").isNotNull() & F.col("thread").isNotNull()
    per_func = small.groupBy(*by, F.col("func").alias("metric")).agg(F.sum("_busy").alias("us"))
    if callable(overhead):
        over = overhead(trace, by).select(*by, F.lit(overhead.__name__).alias("metric"), F.col("us").cast("bigint").alias("us"))
        return over.unionByName(per_func)
    if overhead == "idle":
        value = F.sum(F.when(known, F.col("_last") - F.col("_busy")))
    elif overhead == "wasted":
        value = F.max("_last") * F.sum(known.cast("bigint")) - F.sum("_busy")
    else:
        raise ValueError(f"unknown overhead {overhead!r}")
    over = lanes.groupBy(*by).agg(value.alias("us")).select(*by, F.lit(overhead).alias("metric"), "us")
    return over.unionByName(per_func)


def trace_extent(trace: DataFrame, lane: Sequence[str] = ("worker", "thread"), by: Sequence[str] = ()) -> DataFrame:
    """Default x limit (last end, in seconds) and number of lanes."""
    lanes = trace.groupBy(*by, *lane).agg(F.max("end_us").alias("_last"))
    return lanes.groupBy(*by).agg(seconds(F.max("_last")).alias("x_limit"), F.count(F.lit(1)).alias("lanes"))


def union_traces(*traces: DataFrame) -> DataFrame:
    """All rows of all traces; duplicates stay."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t)
    return out


def with_thread_number(trace: DataFrame, lanes: DataFrame, keys: Sequence[str] = ("worker", "thread")) -> DataFrame:
    """Look up the lane number of each call in ``lanes(…keys, thread_number)``."""
    table = lanes.select(*keys, "thread_number")
    return trace.join(broadcast_if_small(table), list(keys), "left")
