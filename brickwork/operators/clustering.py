"""One-dimensional k-means on intensities.

Labels depend on nothing but the intensity, of which there are at most 65,536. One pass turns
the voxels into counts per intensity; every iteration then runs on those few rows, and only the
``k`` new centroids come to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions import intensity as fi
from brickwork.session import materialize


def intensity_frequency(voxels: DataFrame) -> DataFrame:
    """Number of voxels per intensity."""
    return voxels.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def linspace_centroids(extent: DataFrame, count: int) -> DataFrame:
    """Evenly spaced start centroids ``(k, c)`` from a one-row ``(lo, hi)``."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))
    rows = extent.where(F.col("lo").isNotNull()).select("lo", "hi", F.explode(steps).alias("k"))
    return rows.select("k", fi.spaced(F.col("lo"), F.col("hi"), F.col("k"), count).alias("c"))


def centroid_values(centroids: DataFrame) -> list[float]:
    """Bring the ``k`` centroid rows to the driver, in order."""
    return [row.c for row in centroids.orderBy("k").collect()]


def cluster_stats(frequency: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """Sum and count per label ``(k, s, n)`` of the counted intensities ``(v, n)``."""
    label = fi.nearest_label(F.col("v"), centroids).alias("k")
    return frequency.groupBy(label).agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n"))


def update_centroids(stats: DataFrame, count: int) -> DataFrame:
    """New centroids ``(k, c)``; a cluster without voxels goes to 0."""
    nothing = F.lit(0).cast("bigint")
    zeros = stats.sparkSession.range(count).select(F.col("id").alias("k"), nothing.alias("s"), nothing.alias("n"))
    merged = stats.select("k", "s", "n").unionAll(zeros).groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    divisor = F.greatest(F.col("n"), F.lit(1).cast("bigint")).cast("double")
    return merged.select("k", (F.col("s").cast("double") / divisor).alias("c"))


def fit_frequency(
    frequency: DataFrame, count: int = 3, iterations: int = 3, log: Callable[[str, float], None] | None = None
) -> list[float]:
    """Lloyd iterations on a frequency table, without a convergence test; ``log`` gets name and begin of every call."""
    log = log or (lambda func, began: None)
    stored = materialize(frequency, "frequency")
    centroids = centroid_values(linspace_centroids(stored.agg(F.min("v").alias("lo"), F.max("v").alias("hi")), count))
    if not centroids:
        raise ValueError("there are no voxels to cluster")
    for _ in range(iterations):
        began = time.time()
        found = {row.k: row for row in cluster_stats(stored, centroids).collect()}
        log("get_labels", began)
        began = time.time()
        centroids = [float(found[k].s) / float(found[k].n) if k in found else 0.0 for k in range(count)]
        log("update_centroids", began)
    return centroids


def fit(voxels: DataFrame, count: int = 3, iterations: int = 3) -> list[float]:
    """Centroids of all voxels."""
    return fit_frequency(intensity_frequency(voxels), count, iterations)


def centroid_table(spark, centroids: Sequence[float]) -> DataFrame:
    """Centroids as a table ``(k, c)``."""
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(centroids)], "k bigint, c double")


def classify(voxels: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """Add the column ``label``: the nearest centroid of each voxel."""
    return voxels.withColumn("label", fi.nearest_label(F.col("v"), centroids))


def classify_by_table(voxels: DataFrame, centroids: DataFrame) -> DataFrame:
    """As :func:`classify`, with the centroids in a table ``(k, c)`` of k rows.

    The table becomes one array value, so each voxel compares its k distances in place instead
    of being multiplied by k rows and regrouped.
    """
    listed = centroids.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("all")).scalar()
    scored = F.transform(
        F.col("_all"), lambda p: F.struct(fi.squared_distance(F.col("v"), p["c"]).alias("d"), p["k"].alias("k"))
    )
    return voxels.withColumn("_all", listed).withColumn("label", F.array_min(scored)["k"]).drop("_all")


def nearest_row_per_centroid(blocks: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """For each (block, x, z, centroid): the y of least distance, the lowest y on ties.

    A row-major block holds the whole (x, z) line, so the search runs inside the row.
    """
    dim_x, dim_y, dim_z = (F.get("dims", F.lit(k)) for k in range(3))

    def along(length, cell):
        return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), length - 1), cell))

    def nearest(x, z, k: int, c: float):
        def scored(y):
            v = F.get("v", fi.c_order(x, y, z, dim_y, dim_z).cast("int"))
            return F.struct(fi.squared_distance(v, c).alias("d"), y.alias("y"))

        return F.struct(F.lit(k).cast("bigint").alias("k"), F.array_min(along(dim_y, scored))["y"].alias("y"))

    def line(x, z):
        best = F.array(*[nearest(x, z, k, c) for k, c in enumerate(centroids)])
        return F.struct(x.alias("x"), z.alias("z"), best.alias("_best"))

    # Only the answers of a block are exploded, not a copy of the block for each line.
    found = F.flatten(along(dim_x, lambda x: along(dim_z, lambda z: line(x, z))))
    return blocks.select("block_id", F.inline(found)).select("block_id", "x", "z", F.inline("_best"))
