"""Comparison of runs: labels, repetitions, statistics, significance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwork.functions import labels as fl
from brickwork.functions.student import student_p
from brickwork.operators.ordinals import with_row_number
from brickwork.operators.trace import seconds
from brickwork.session import broadcast_if_small, materialize


def parse_run_label(df: DataFrame, params: Mapping[str, str], label: str = "label") -> DataFrame:
    """Split a run label into framework, app and one column per parameter ``{name: type}``."""
    source = F.col(label)
    columns = [fl.label_framework(source).alias("framework"), fl.label_app(source).alias("app")]
    columns += [fl.label_param(source, name).cast(kind).alias(name) for name, kind in params.items()]
    return df.select("*", *columns)


def free_parameter(parameters: Sequence[str], fixed: Mapping[str, object]) -> str:
    """The one parameter that is not fixed; anything else is an error."""
    free = [p for p in parameters if p not in fixed]
    if len(free) != 1:
        raise ValueError(f"exactly one parameter must be free, found {free}")
    return free[0]


def runs_one_free_param(
    runs: DataFrame, app: str, parameters: Sequence[str], fixed: Mapping[str, object], label: str = "label"
) -> DataFrame:
    """Runs of ``app`` with all parameters fixed except one, which becomes the number ``free``."""
    free = free_parameter(parameters, fixed)
    source = F.col(label)
    wanted = fl.label_app(source) == app
    for name, value in fixed.items():
        if name in parameters:
            wanted = wanted & fl.label_has(source, name, value)
    value = fl.label_param(source, free).cast("double")
    return runs.where(wanted & value.isNotNull()).withColumn("free", value)


def calls_one_free_param(
    calls: DataFrame, app: str, parameters: Sequence[str], fixed: Mapping[str, object], catalog: DataFrame | None = None
) -> DataFrame:
    """Calls of the runs that :func:`runs_one_free_param` keeps, with ``free`` and ``framework``.

    Labels are parsed once each, not once per call, and joined back. On logs stored by label the
    join also prunes the folders of all other runs. ``catalog`` saves the pass that finds the labels.
    """
    source = calls if catalog is None else catalog
    # Both tables are stored, else the optimizer moves the parsing below the distinct and, as a
    # condition inferred from the join, to the calls.
    labels = materialize(source.select("label").distinct(), "labels")
    chosen = runs_one_free_param(labels, app, parameters, fixed)
    if "framework" not in calls.columns:
        chosen = chosen.withColumn("framework", fl.label_framework(F.col("label")))
    # Spark prunes partitions by a join only when the small side has a comparison; this one is always true.
    stored = materialize(chosen, "chosen").where(F.col("label") > "")
    return calls.join(broadcast_if_small(stored), "label")


def lossless_int(values: DataFrame, column: str = "free") -> DataFrame:
    """Distinct values, with ``whole`` as integers only when every one of them is whole."""
    stored = values.select(column).distinct()
    all_whole = values.agg(F.bool_and(F.col(column) == F.floor(column)).alias("ok")).scalar()
    return stored.withColumn("whole", F.when(all_whole, F.col(column).cast("bigint")))


def run_ordinal_files(files: DataFrame) -> DataFrame:
    """Number the files of each label in path order: its repetitions."""
    return with_row_number(files, "rep", ["path"], ["label"])


def runs_by_free_param(runs: DataFrame) -> DataFrame:
    """Sort runs by the number of their free parameter."""
    return runs.orderBy("framework", "free", "label")


def mean_and_deviation(value: Column) -> tuple[Column, Column]:
    """Mean and population deviation in seconds of a microsecond column."""
    return seconds(F.avg(value)), seconds(F.stddev_pop(value))


def makespan_stats(makespans_us: DataFrame, by: Sequence[str] = ("framework", "free")) -> DataFrame:
    """Mean and population deviation of ``us`` over the repetitions."""
    mean, deviation = mean_and_deviation(F.col("us"))
    return makespans_us.groupBy(*by).agg(mean.alias("mean"), deviation.alias("std"))


def stacked_stats(metrics: DataFrame, by: Sequence[str] = ("framework", "free")) -> DataFrame:
    """Mean and population deviation of every metric over the repetitions.

    ``position`` puts the overhead first and the functions after it, by name.
    """
    mean, deviation = mean_and_deviation(F.col("us"))
    stats = metrics.groupBy(*by, "metric").agg(mean.alias("mean"), deviation.alias("std"))
    first = F.col("metric").isin("idle", "wasted")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(first, 0).otherwise(1), "metric")) - 1
    return stats.withColumn("position", place.cast("bigint"))


def stacked_totals(stats: DataFrame, by: Sequence[str] = ("framework", "free")) -> DataFrame:
    """Height of each stack: the sum of its means."""
    return stats.groupBy(*by).agg(F.sum("mean").alias("total"))


def run_totals(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total of all metrics per run, in seconds."""
    return metrics.groupBy(*by).agg(seconds(F.sum("us")).alias("total"))


def max_height(totals: DataFrame) -> DataFrame:
    """Largest total."""
    return totals.agg(F.max("total").alias("max_height"))


def welch_ttest(totals: DataFrame, by: Sequence[str] = ("free",)) -> DataFrame:
    """Two-sided Welch test of ``total`` between neighbouring frameworks, per free value.

    Works on one row per framework and free value, so the p-value function sees few rows.
    """
    stats = totals.groupBy(*by, "framework").agg(
        F.avg("total").alias("_m"), F.var_samp("total").alias("_v"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    order = Window.partitionBy(*by).orderBy("framework")
    nexts = [F.lead(c).over(order).alias(f"{c}2") for c in ("framework", "_m", "_v", "_n")]
    pairs = stats.select("*", *nexts).where(F.col("framework2").isNotNull())
    a, b = F.col("_v") / F.col("_n"), F.col("_v2") / F.col("_n2")
    defined = (F.col("_n") > 1) & (F.col("_n2") > 1) & (a + b > 0)
    t = F.when(defined, (F.col("_m") - F.col("_m2")) / F.sqrt(a + b))
    df = F.when(defined, (a + b) * (a + b) / (a * a / (F.col("_n") - 1) + b * b / (F.col("_n2") - 1)))
    tested = pairs.select(
        *by, F.col("framework").alias("left"), F.col("framework2").alias("right"), t.alias("t"), df.alias("df")
    )
    p = tested.withColumn("p", student_p("t", "df"))
    return p.withColumn("stars", fl.stars(F.col("p")))
