"""Voxel and block operators.

Two shapes are used. *Blocks* carry one array per row, ``(block_id, dims, v)``, row-major.
*Voxels* carry one intensity per row, ``(block_id, pos, x, y, z, v)``. Operators that need
only one block stay on arrays, so no row fan-out and no shuffle takes place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions import intensity as fi
from brickwork.session import broadcast_if_small, materialize, spread

VOXEL_BYTES = 2
#: Blocks that one copy of a donor's planes is handed to.
FAN_OUT = 64


def _dim(axis: int, dims: str = "dims") -> Column:
    return F.get(F.col(dims), F.lit(axis))


# ---------------------------------------------------------------- projections


def increment(voxels: DataFrame, amount: int = 1, iterations: int = 1) -> DataFrame:
    """Add ``amount`` to every voxel ``iterations`` times, wrapping at 2^16.

    Wrapped additions of constants collapse into one.
    """
    return voxels.withColumn("v", fi.add_wrapped(F.col("v"), amount * iterations))


def flatten(blocks: DataFrame) -> DataFrame:
    """One row per voxel with its row-major position and its coordinates."""
    rows = blocks.select("block_id", "dims", F.posexplode("v").alias("i", "v"))
    pos = F.col("i").cast("bigint")
    plane, dim_z = _dim(1) * _dim(2), _dim(2)
    return rows.select(
        "block_id",
        pos.alias("pos"),
        F.floor(pos / plane).alias("x"),
        F.pmod(F.floor(pos / dim_z), _dim(1)).alias("y"),
        F.pmod(pos, dim_z).alias("z"),
        "v",
    )


def rechunk(blocks: DataFrame, chunk_bytes: int, item_bytes: int = VOXEL_BYTES) -> DataFrame:
    """Split every block into ``ceil(bytes / chunk_bytes)`` pieces of nearly equal length."""
    size = F.size("v").cast("bigint")
    counted = blocks.withColumn("_n", fi.chunk_count(size, item_bytes, chunk_bytes)).where("_n > 0")
    def piece(chunk):
        start, stop = fi.chunk_start(chunk, size, F.col("_n")), fi.chunk_start(chunk + 1, size, F.col("_n"))
        return F.struct(chunk.alias("chunk"), F.slice("v", (start + 1).cast("int"), (stop - start).cast("int")).alias("v"))

    # The pieces are cut inside the row: only they are exploded, not a copy of the block for each.
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), piece)
    return counted.select("block_id", F.inline(pieces))


def slab_split(blocks: DataFrame) -> DataFrame:
    """Split every block into one slab per index of its first axis."""
    return _planes(blocks).drop("dims")


def _planes(blocks: DataFrame) -> DataFrame:
    """Planes of the first axis, ``(block_id, dims, x, v)``."""
    length = _dim(1) * _dim(2)

    def plane(x):
        return F.struct(x.alias("x"), F.slice("v", (x * length + 1).cast("int"), length.cast("int")).alias("v"))

    return blocks.select("block_id", "dims", F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), _dim(0) - 1), plane)))


def add_blocks(blocks: DataFrame, donors: DataFrame, fan_out: int | None = None) -> DataFrame:
    """Add to each block the block named in ``donors(block_id, donor)``, voxel by voxel; one result per distinct pair.

    Planes are moved, not blocks; one of a donor that many blocks drew is copied, see :func:`_given`.
    """
    planes = _planes(blocks)
    picks = materialize(donors.select(F.col("block_id").alias("_to"), "donor").distinct().withColumn("_times", F.lit(1).cast("bigint")), "picks")
    drawn = picks.select(F.col("_to").alias("block_id"), "donor")
    own = planes.join(broadcast_if_small(drawn), "block_id").withColumn("_times", F.lit(1).cast("bigint")).withColumn("_own", F.lit(True))
    gifts = _given(planes, picks, fan_out).withColumn("dims", F.lit(None).cast("array<bigint>")).withColumn("_own", F.lit(False))
    return _summed(own.unionByName(gifts), ["block_id", "donor"], whole=True)


def squared_distances(voxels: DataFrame, centroids: Sequence[float]) -> DataFrame:
    """Squared distance of every voxel to every centroid."""
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(float(c)).alias("c")) for k, c in enumerate(centroids)])
    return voxels.select("block_id", "pos", "v", F.explode(pairs).alias("_p")).select(
        "block_id", "pos", F.col("_p.k").alias("k"), fi.squared_distance(F.col("v"), F.col("_p.c")).alias("d")
    )


def with_affine(blocks: DataFrame, affine: Sequence[Sequence[float]]) -> DataFrame:
    """Attach the same 4x4 matrix to every block."""
    matrix = F.array(*[F.array(*[F.lit(float(a)) for a in row]) for row in affine])
    return blocks.withColumn("affine", matrix)


# Fixed value: matrix given to converted images; it swaps the first and the third axis.
AXIS_REVERSAL = ((0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 1))


# ------------------------------------------------------------------ histogram


def block_histogram(voxels: DataFrame) -> DataFrame:
    """Counts per block and bin; bins without voxels are left out."""
    return voxels.groupBy("block_id", fi.intensity_bin(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(partials: DataFrame) -> DataFrame:
    """Sum partial histograms bin by bin."""
    return partials.groupBy("bin").agg(F.sum("n").alias("n"))


def dense_histogram(partials: DataFrame) -> DataFrame:
    """Merge partial histograms ``(bin, n)`` and give every bin a row.

    The empty bins join as zero rows of the same aggregation: one shuffle of at most 65,535
    partial rows per task, no join, and an empty input gives the all-zero histogram.
    """
    zeros = partials.sparkSession.range(fi.BINS).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    return merge_histograms(partials.select("bin", "n").unionAll(zeros))


def histogram(voxels: DataFrame) -> DataFrame:
    """Dense intensity histogram of all voxels."""
    ones = voxels.select(fi.intensity_bin(F.col("v")).alias("bin"), F.lit(1).cast("bigint").alias("n"))
    return dense_histogram(ones)


def extent(voxels: DataFrame) -> DataFrame:
    """Least and greatest intensity."""
    return voxels.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def chunk_total(chunks: DataFrame) -> DataFrame:
    """Number of chunks."""
    return chunks.agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- blocks


def lookup_block(voxels: DataFrame, block_id: int) -> DataFrame:
    """Voxels of one block."""
    return voxels.where(F.col("block_id") == block_id)


def sample_block(blocks: DataFrame) -> DataFrame:
    """First block by path; the path is found before any array moves."""
    return blocks.where(F.col("path") == blocks.select(F.min("path")).scalar()).limit(1)


def require_one_shape(blocks: DataFrame) -> DataFrame:
    """Raise unless all blocks have the same dimensions."""
    shapes = blocks.select("dims").distinct().limit(2).count()
    if shapes > 1:
        raise ValueError("the blocks differ in shape")
    return blocks


def stack_blocks(blocks: DataFrame, ordinal: str = "block_id") -> DataFrame:
    """Concatenate blocks of one shape, in ordinal order, into one vector ``(pos, v)``.

    Raises unless the ordinals are 0 .. n - 1, each once.
    """
    require_one_shape(blocks)
    n, distinct, low, high = blocks.agg(F.count(F.lit(1)), F.count_distinct(ordinal), F.min(ordinal), F.max(ordinal)).first()
    if n and (low, high, distinct) != (0, n - 1, n):
        raise ValueError(f"{n} blocks are not numbered 0 to {n - 1}, each once")
    rows = blocks.select(F.col(ordinal).alias("_o"), F.size("v").alias("_n"), F.posexplode("v").alias("i", "v"))
    return rows.select((F.col("_o") * F.col("_n") + F.col("i")).cast("bigint").alias("pos"), "v")


# ------------------------------------------------------------ multi-increment


def assign_donors(blocks: DataFrame, iterations: int, seed: int, policy: str = "per_block") -> DataFrame:
    """Pick donors for blocks numbered 0..n-1 by ``block_id``.

    ``per_block`` draws for every block and iteration and returns ``(block_id, it, donor)``;
    ``per_iteration`` draws once per iteration and returns ``(it, donor)``. The draw is a digest
    of seed, iteration and block, so it is the same on every run and needs no state.
    """
    n = blocks.count()
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))).alias("it")
    if policy == "per_block":
        rows = blocks.select("block_id", steps) if iterations > 0 else _no_steps(blocks.select("block_id"))
        return rows.withColumn("donor", _draw(n, F.lit(seed), F.col("it"), F.col("block_id")))
    if policy == "per_iteration":
        rows = blocks.sparkSession.range(iterations).select(F.col("id").alias("it"))
        return rows.withColumn("donor", _draw(n, F.lit(seed), F.col("it")))
    raise ValueError(f"unknown donor policy {policy!r}")


def _draw(n: int, *keys: Column) -> Column:
    """Number below ``n`` from 60 bits of a digest."""
    digest = F.md5(F.concat_ws("-", *[k.cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n).cast("bigint"))


def _no_steps(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.lit(False)).withColumn("it", F.lit(0).cast("bigint"))


def multi_increment_per_iteration(voxels: DataFrame, donors: DataFrame) -> DataFrame:
    """Add to every block the original voxels of each iteration's donor; ``donors(it, donor)``.

    The donors are few (one per iteration), so their sum is one block. Whether that block is
    broadcast or shuffled by position depends on its counted size.
    """
    picks = donors.groupBy("donor").agg(F.count(F.lit(1)).alias("_times"))
    chosen = voxels.join(broadcast_if_small(picks), F.col("block_id") == F.col("donor"))
    addend = materialize(chosen.groupBy("pos").agg(F.sum(F.col("v") * F.col("_times")).alias("_add")), "addend")
    joined = voxels.join(broadcast_if_small(addend), "pos", "left")
    return joined.select(
        "block_id", "pos", fi.wrap(F.col("v") + F.coalesce(F.col("_add"), F.lit(0).cast("bigint"))).alias("v")
    )


def multi_increment_per_block(voxels: DataFrame, donors: DataFrame, salts: int = 32) -> DataFrame:
    """Add to every block the original voxels of its own donors; ``donors(block_id, it, donor)``.

    Repeated draws of one donor are counted first. Contributions and own voxels then meet in
    one aggregation by (block, position), which needs no join back. When the assignment is too
    large to broadcast, the voxels are spread over ``salts`` pieces per block, so a block with
    a large share of all voxels does not end in one task.
    """
    picks = donors.groupBy("block_id", "donor").agg(F.count(F.lit(1)).alias("_times"))
    picks = materialize(picks.select(F.col("block_id").alias("_to"), "donor", "_times"), "picks")
    small = broadcast_if_small(picks)
    if small is not picks:
        given = voxels.join(small, F.col("block_id") == F.col("donor"))
    else:
        every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        salted = voxels.withColumn("_salt", F.pmod(F.col("pos"), F.lit(salts)))
        spread = picks.withColumn("_to_salt", every_salt)
        given = salted.join(spread, (F.col("block_id") == F.col("donor")) & (F.col("_salt") == F.col("_to_salt")))
    gifts = given.select(
        F.col("_to").alias("block_id"), "pos", (F.col("v") * F.col("_times")).alias("v"), F.lit(0).alias("_own")
    )
    own = voxels.select("block_id", "pos", "v", F.lit(1).alias("_own"))
    return (
        own.unionByName(gifts)
        .groupBy("block_id", "pos")
        .agg(F.sum("v").alias("_sum"), F.max("_own").alias("_own"))
        .where(F.col("_own") == 1)
        .select("block_id", "pos", fi.wrap(F.col("_sum")).alias("v"))
    )


def multi_increment_planes(planes: DataFrame, donors: DataFrame, fan_out: int | None = None) -> DataFrame:
    """Add to every plane ``(block_id, x, v)`` the same planes of the block's own donors; ``donors(block_id, it, donor)``.

    Repeated draws of one donor are counted first. No row holds more than a plane, and a task adds up one plane at a time.
    """
    return _multi_increment(planes.withColumn("dims", F.lit(None).cast("array<bigint>")), donors, fan_out, whole=False).drop("dims")


def multi_increment_blocks(blocks: DataFrame, donors: DataFrame, fan_out: int | None = None) -> DataFrame:
    """As :func:`multi_increment_planes` for blocks: they are cut into planes, which are put together again when added."""
    return _multi_increment(_planes(blocks), donors, fan_out, whole=True).select("block_id", "v")


def _multi_increment(planes: DataFrame, donors: DataFrame, fan_out: int | None, whole: bool) -> DataFrame:
    picks = donors.groupBy("block_id", "donor").agg(F.count(F.lit(1)).alias("_times"))
    picks = materialize(picks.select(F.col("block_id").alias("_to"), "donor", "_times"), "picks")
    own = planes.select("block_id", "dims", "x", "v").withColumn("_times", F.lit(1).cast("bigint")).withColumn("_own", F.lit(True))
    gifts = _given(planes, picks, fan_out).drop("donor").withColumn("dims", F.lit(None).cast("array<bigint>")).withColumn("_own", F.lit(False))
    return _summed(own.unionByName(gifts), ["block_id"], whole)


def _given(planes: DataFrame, picks: DataFrame, fan_out: int | None) -> DataFrame:
    """Planes of donors for the blocks that drew them, ``(block_id, donor, x, v, _times)``.

    Draws are counted per donor: one that many blocks drew is copied once for every ``fan_out`` of them, so its planes
    are handed out by many tasks.
    """
    copies = F.ceil(F.count(F.lit(1)) / F.lit(fan_out or FAN_OUT)).alias("_copies")
    counted = picks.groupBy("donor").agg(copies)
    dealt = picks.join(counted, "donor").withColumn("_copy", F.pmod(F.xxhash64("_to"), F.col("_copies"))).drop("_copies")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_copy")
    copied = planes.withColumnRenamed("block_id", "donor").join(broadcast_if_small(counted), "donor").select("donor", "x", "v", every)
    joined = copied.join(dealt, ["donor", "_copy"])
    return joined.select(F.col("_to").alias("block_id"), "donor", "x", "v", "_times")


def _summed(contributions: DataFrame, by: Sequence[str], whole: bool) -> DataFrame:
    """Sum of the planes ``(…by, dims, x, v, _times, _own)`` of each key and ``x``, wrapping; of keys that have one of their own.

    Rows come sorted to a task, which holds the sum of one plane, or with ``whole`` the planes of one block.
    """
    keys = [*by] if whole else [*by, "x"]
    rows = spread(contributions, *keys).sortWithinPartitions(*by, "x")
    kinds = {f.name: f.dataType.simpleString() for f in contributions.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "dims", "v"])
    return rows.mapInArrow(lambda batches: _fold_planes(batches, list(by), whole), schema)


def _fold_planes(batches: Iterator[pa.RecordBatch], by: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []  # of keys, dims and voxels
    place, total, dims, own = None, None, None, False

    def close() -> None:
        if place is None or not own:
            return
        if whole and done and done[-1][0] == place[:-1]:
            done[-1][2].append(total)
        else:
            done.append((place[:-1] if whole else place, dims, [total]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        voxels = [np.concatenate(v) if v else np.zeros(0, np.int64) for _, _, v in rows]
        starts = np.r_[0, np.cumsum([len(v) for v in voxels])]
        lists = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(np.concatenate(voxels)))
        keys = [pa.array(c, pa.int64()) for c in zip(*[k for k, _, _ in rows])]
        names = [*by, "dims", "v"] if whole else [*by, "x", "dims", "v"]
        return pa.RecordBatch.from_arrays([*keys, pa.array([d for _, d, _ in rows], pa.list_(pa.int64())), lists.cast(pa.list_(pa.int64()))], names=names)

    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        lists = column("v")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_pylist()
        at = 0
        keys = zip(*[column(c).to_pylist() for c in [*by, "x"]])
        for key, size, times, mine, shape in zip(keys, sizes, *[column(c).to_pylist() for c in ("_times", "_own", "dims")]):
            values, at = flat[at : at + size], at + size
            if key != place:
                close()
                place, total, dims, own = key, np.zeros(size, np.int64), None, False
            if size != len(total):
                raise ValueError("the blocks differ in shape")
            total = (total + values * times) % fi.LEVELS
            dims, own = shape or dims, own or mine
        if len(done) > 1:  # the last one may go on
            yield batch_of(done[:-1])
            del done[:-1]
    close()
    if done:
        yield batch_of(done)
