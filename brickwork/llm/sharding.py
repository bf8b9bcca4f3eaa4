"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows are stored once with their partition and place in it, which numbers them without a sort. Runs of ``LEAF_ROWS``
numbers are the *partitions* of the method, so that a large partition is many of them; shards of more than
``BLOCK_ROWS`` rows are cut into blocks of nearly equal size. Row p of the matrix says how many rows of run p go to each
block. In a uniform permutation of all rows, it is multivariate hypergeometric given the rows before it, and so it is
for every way to group the runs: the matrix is drawn by halving. A node of the tree over the runs splits what its blocks
get between its two halves, with random numbers of its own seed. A task draws only the path to its runs, so that no
matrix is stored, sent or gathered, and a repeated task draws the same numbers.

Each run is permuted in its task and cut by its row of the matrix; the path also tells how many rows come from earlier
runs, so every row knows its place among its block's arrivals. Rows are exchanged by block, and places are permuted
again within the block. The result is uniform over all arrangements, up to the quality of the random numbers.

Nulls are values like others: rows are moved whole, repeated rows each get a place of their own. An empty table gives an
empty table; with fewer rows than shards, some shards are empty. Columns named as the added ones are replaced.
The driver gets one number for each partition of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.session import materialize

#: Rows of one run: the partitions that the matrix has a row for.
LEAF_ROWS = 1 << 16
#: Most rows of a block, which one task permutes.
BLOCK_ROWS = 1 << 20
#: NumPy draws from populations below this.
_NUMPY_MOST = 10**9


def draw_one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good, for populations of any size.

    Inverts the distribution over 40 standard deviations on either side of its mode; what lies beyond is below the
    smallest number that a double can hold.
    """
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max(int((n + 1) * (good + 1) // (total + 2)), low), high)
    reach = int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    p = np.r_[0.0, np.cumsum(step)]
    p = np.cumsum(np.exp(p - p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def draw(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` rows drawn from ``cells``, how many come from each."""
    left = int(cells.sum())
    if left < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    out = np.zeros(len(cells), np.int64)
    for k, size in enumerate(cells.tolist()):
        left -= size
        out[k] = draw_one(rng, size, left, n)
        n -= int(out[k])
    return out


class Matrix:
    """Rows of the communication matrix, drawn on demand along the path from the root."""

    def __init__(self, rows: int, sizes: np.ndarray, seed: int, leaf_rows: int = LEAF_ROWS):
        self.rows, self.seed, self.leaf_rows = rows, seed, leaf_rows
        self.leaves = -(-rows // leaf_rows)
        self.path = [(0, self.leaves, sizes.astype(np.int64), np.zeros(len(sizes), np.int64))]

    def row(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that run ``leaf`` sends to each block, and those that all earlier runs send."""
        while not self.path[-1][0] <= leaf < self.path[-1][1]:
            self.path.pop()
        low, high, cells, before = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, 0, low, high])
            left = draw(rng, cells, (middle - low) * self.leaf_rows)
            if leaf < middle:
                high, cells = middle, left
            else:
                low, cells, before = middle, cells - left, before + left
            self.path.append((low, high, cells, before))
        return cells, before

    def place(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each row of a run, and its place among the block's arrivals."""
        cells, before = self.row(leaf)
        size = min(self.leaf_rows, self.rows - leaf * self.leaf_rows)
        rank = np.random.default_rng([self.seed, 1, leaf]).permutation(size)
        end = np.cumsum(cells)
        block = np.searchsorted(end, rank, side="right")
        return block, before[block] + rank - (end - cells)[block]


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, shard and first slot of every block. Shard sizes differ by one at most."""
    sizes, shard, first = [], [], []
    for k in range(shards):
        size = rows // shards + (k < rows % shards)
        parts = max(1, -(-size // block_rows))
        cut = [size * i // parts for i in range(parts + 1)]
        sizes += [b - a for a, b in zip(cut, cut[1:])]
        shard += [k] * parts
        first += cut[:-1]
    return np.array(sizes, np.int64), np.array(shard, np.int64), np.array(first, np.int64)


def shuffle(
    rows: DataFrame, shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot", leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the shard (0 .. ``shards`` - 1) and the slot within it (0 .. its size - 1) of every row."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in (shard, slot)]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")) if names else rows.select(F.struct(F.lit(0).alias("none")).alias("row"))
    number = F.monotonically_increasing_id()
    stored = materialize(packed.select(F.spark_partition_id().alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), "row"), "shuffled")
    size = dict(stored.groupBy("part").agg(F.count("*")).collect())
    before = np.zeros(max(size, default=0) + 2, np.int64)
    for part, count in size.items():
        before[part + 1] = count
    before = np.cumsum(before)
    total = int(before[-1])
    sizes, shard_of, first = block_sizes(total, shards, block_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, known, placed = Matrix(total, sizes, seed, leaf_rows), -1, None
        for batch in batches:
            at = before[batch.column("part").to_numpy(zero_copy_only=False)] + batch.column("n").to_numpy(zero_copy_only=False)
            leaf = at // leaf_rows
            block, arrival = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for one in np.unique(leaf).tolist():
                if one != known:
                    known, placed = one, matrix.place(one)
                own = np.flatnonzero(leaf == one)
                inside = at[own] - one * leaf_rows
                block[own], arrival[own] = placed[0][inside], placed[1][inside]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(block), pa.array(arrival)], names=["row", "block", "arrival"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = -1, None
        for batch in batches:
            block, arrival = batch.column("block").to_numpy(zero_copy_only=False), batch.column("arrival").to_numpy(zero_copy_only=False)
            slots = np.zeros(len(block), np.int64)
            for one in np.unique(block).tolist():
                if one != known:
                    known, order = one, np.random.default_rng([seed, 2, one]).permutation(int(sizes[one]))
                own = block == one
                slots[own] = first[one] + order[arrival[own]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shard_of[block].astype(np.int32)), pa.array(slots)], names=["row", "shard", "slot"])

    row = stored.schema["row"]
    sent = stored.mapInArrow(place, T.StructType([row, T.StructField("block", T.LongType()), T.StructField("arrival", T.LongType())]))
    dealt = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    out = dealt.mapInArrow(settle, T.StructType([row, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return out.select(*[F.col(f"row.`{c}`") for c in names], F.col("shard").alias(shard), F.col("slot").alias(slot))


def write(rows: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the shuffled rows as Parquet, a folder for each shard, each file in the order of its slots."""
    shuffle(rows, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
