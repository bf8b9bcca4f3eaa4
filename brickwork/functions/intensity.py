"""Expressions on 16-bit voxel intensities.

Spark has no unsigned type: intensities are integers in 0..65535 and every addition wraps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 65_536
#: The dense histogram has 65,535 bins; the last one is closed and takes both top intensities.
BINS = LEVELS - 1


def wrap(value: Column) -> Column:
    """Reduce a sum to 0..65535."""
    return F.pmod(value, F.lit(LEVELS).cast("bigint"))


def add_wrapped(value: Column, amount: int | Column) -> Column:
    """Add and wrap at 2^16."""
    amount = F.lit(amount).cast("bigint") if isinstance(amount, int) else amount
    return wrap(value + amount)


def intensity_bin(value: Column) -> Column:
    """Histogram bin of an intensity."""
    return F.least(value, F.lit(BINS - 1).cast("bigint"))


def squared_distance(value: Column, centroid: Column | float) -> Column:
    """Squared distance in doubles."""
    centroid = F.lit(float(centroid)) if not isinstance(centroid, Column) else centroid
    gap = value.cast("double") - centroid
    return gap * gap


def nearest_label(value: Column, centroids: Sequence[float]) -> Column:
    """Index of the nearest centroid; the lowest index wins ties.

    The centroids are inlined as literals, so this stays inside generated code: no join.
    """
    distances = [squared_distance(value, c) for c in centroids]
    if len(distances) == 1:
        return F.lit(0).cast("bigint")
    best = F.least(*distances)
    picks = [(d == best, F.lit(k).cast("bigint")) for k, d in enumerate(distances)]
    chain = reduce(lambda c, p: c.when(*p), picks[1:-1], F.when(*picks[0]))
    return chain.otherwise(picks[-1][1])


def spaced(low: Column, high: Column, index: Column, count: int) -> Column:
    """Point ``index`` of ``count`` evenly spaced points; the last one is exactly ``high``."""
    low, high = low.cast("double"), high.cast("double")
    if count == 1:
        return low
    inner = low + index.cast("double") * ((high - low) / F.lit(float(count - 1)))
    return F.when(index == F.lit(count - 1), high).otherwise(inner)


def c_order(x: Column, y: Column, z: Column, dim_y: Column, dim_z: Column) -> Column:
    """Position of a voxel in the row-major vector."""
    return (x * dim_y + y) * dim_z + z


def chunk_count(item_count: Column, item_bytes: int, chunk_bytes: int) -> Column:
    """Number of pieces of at most ``chunk_bytes``."""
    return F.ceil(item_count * F.lit(item_bytes) / F.lit(chunk_bytes)).cast("bigint")


def chunk_start(chunk: Column, item_count: Column, chunks: Column) -> Column:
    """First position of a piece when the first ``item_count % chunks`` pieces are one longer."""
    short = F.floor(item_count / chunks)
    return (chunk * short + F.least(chunk, F.pmod(item_count, chunks))).cast("bigint")
