"""Groups of any size, compared in blocks.

The members of a group are dealt out to blocks of about ``BLOCK`` members, and every two blocks of a group meet in one
place. A task sees two blocks at a time, however large the group is; only results per member leave it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def block_pairs(members: DataFrame, group: str, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Each member once for every other block of its group: adds ``i``, ``j`` (i <= j) and ``own``, the member's block."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = members.withColumn("_n", blocks).withColumn("own", F.pmod(F.hash(member, F.lit(7)), F.col("_n")))
    other = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return other.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_n", "_o")


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key in one partition, one after the other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a sorted stream of batches into the rows of one key each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(c[a] for c in columns)
            if last is not None and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)
