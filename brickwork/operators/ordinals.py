"""Row numbers that do not need one task to see a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickwork.session import materialize, same_keys

#: Up to this many rows an ordinary window is cheaper than counting per range.
WINDOW_ROWS = 200_000


def with_row_number(
    df: DataFrame,
    name: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    window_rows: int | None = None,
) -> DataFrame:
    """Number rows from 1 inside each ``partition_by`` group, in ``order_by`` order.

    ``order_by`` must be unique inside a group. Small tables use one window. Larger ones
    are range-partitioned by group and order, numbered inside each range, and shifted by the
    count of the ranges before; a group that holds most rows then spreads over many ranges.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    keys, order = list(partition_by), list(order_by)
    stored = materialize(df, "ordinal")
    rows = stored.count()
    if rows <= limit:
        return stored.withColumn(name, _row_number(keys, order).cast("bigint"))

    spark = df.sparkSession
    ranges = max(rows // max(limit, 1), spark.sparkContext.defaultParallelism)
    # Stored, because the range borders come from a sample and must not move on a retry.
    ranged = materialize(
        stored.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    numbered = ranged.withColumn("_local", _row_number([*keys, "_range"], order))
    joined = numbered.join(shifts, same_keys(numbered, shifts, [*keys, "_range"]))
    kept = [numbered[c] for c in df.columns]
    return joined.select(*kept, (F.col("_local") + F.col("_shift")).cast("bigint").alias(name))


def _row_number(keys: Sequence[str], order: Sequence[str]):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
