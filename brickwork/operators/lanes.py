"""Timeline lanes: short names and numbers for workers, threads and functions.

Numbers follow first appearance, which ``seq`` defines. Calls are first reduced to one row per
worker or thread; only those rows are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions import labels as fl
from brickwork.operators.ordinals import with_row_number
from brickwork.session import broadcast_if_small, materialize

COLORS = 8


def first_calls(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First ``seq`` per worker, thread and function, stored.

    All numbering below needs no more than these rows, so a trace is scanned once for it.
    """
    return materialize(trace.groupBy(*by, "worker", "thread", "func").agg(F.min("seq").alias("seq")), "first_calls")


def worker_ordinal(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Name workers ``worker01``, ``worker02``, … by first appearance."""
    first = trace.where(F.col("worker").isNotNull()).groupBy(*by, "worker").agg(F.min("seq").alias("first_seq"))
    numbered = with_row_number(first, "number", ["first_seq"], by)
    return numbered.withColumn("worker_name", F.format_string("worker%02d", "number"))


def thread_ordinal(trace: DataFrame, by: Sequence[str] = (), worker: str = "worker") -> DataFrame:
    """Number the threads of each worker by first appearance."""
    first = (
        trace.where(F.col(worker).isNotNull() & F.col("thread").isNotNull())
        .groupBy(*by, worker, "thread")
        .agg(F.min("seq").alias("first_seq"))
    )
    return with_row_number(first, "thread_number", ["first_seq"], [*by, worker])


def lane_table(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per lane with its worker name, thread number and label.

    Reads ``trace`` twice; hand in :func:`first_calls` of a large one.
    """
    threads = thread_ordinal(trace, by).drop("first_seq")
    workers = worker_ordinal(trace, by).select(*by, "worker", "worker_name")
    lanes = threads.join(broadcast_if_small(workers), [*by, "worker"])
    return lanes.withColumn("lane", fl.lane_label(F.col("worker_name"), F.col("thread_number")))


def lane_sort(lanes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Workers ascending, then thread numbers ascending."""
    return lanes.orderBy(*by, "worker_name", "thread_number")


def gantt_lanes(lanes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vertical place of each lane: 1.5 per lane plus 16 per worker, one unit high."""
    placed = with_row_number(lanes, "_lane_no", ["worker_name", "thread_number"], by)
    workers = with_row_number(lanes.select(*by, "worker_name").distinct(), "_worker_no", ["worker_name"], by)
    joined = placed.join(broadcast_if_small(workers), [*by, "worker_name"])
    bottom = (F.col("_lane_no") - 1) * F.lit(1.5) + (F.col("_worker_no") - 1) * F.lit(16.0)
    return joined.withColumn("bottom", bottom).withColumn("top", bottom + 1).drop("_lane_no", "_worker_no")


def flat_lane_table(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lanes under shortened host names; hosts with equal short names share one."""
    named = trace.withColumn("worker_name", fl.short_worker(F.col("worker")))
    threads = thread_ordinal(named, by, "worker_name").drop("first_seq")
    return threads.withColumn("lane", fl.lane_label(F.col("worker_name"), F.col("thread_number")))


def gantt_lanes_flat(lanes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vertical place without gaps: workers descending, threads ascending, centred on 0, 1, ….

    Counting from the other end turns the descending order into an ascending one: a lane comes
    after all lanes of greater worker names and after the lower threads of its own.
    """
    placed = with_row_number(lanes, "_up", ["worker_name", "thread_number"], by)
    stored = materialize(placed, "lanes")
    extent = stored.groupBy(*by, "worker_name").agg(F.min("_up").alias("_lo"), F.max("_up").alias("_hi"))
    last = stored.groupBy(*by).agg(F.max("_up").alias("_n"))
    if by:
        extent = extent.join(last, list(by))
    else:
        extent = extent.withColumn("_n", last.scalar())
    joined = stored.join(broadcast_if_small(extent), [*by, "worker_name"])
    index = (F.col("_n") - F.col("_hi")) + (F.col("_up") - F.col("_lo"))
    bottom = index - F.lit(0.5)
    return joined.withColumn("bottom", bottom).withColumn("top", bottom + 1).drop("_up", "_lo", "_hi", "_n")


def func_color_index(trace: DataFrame) -> DataFrame:
    """Colour number of each function: its rank by name, modulo the palette size."""
    names = trace.select("func").distinct()
    ranked = with_row_number(names, "_rank", ["func"])
    return ranked.select("func", F.pmod(F.col("_rank") - 1, F.lit(COLORS)).alias("color"))
