"""First step of the searches for repeated passages: which short windows occur more than once.

Every window of the wanted length holds one *anchor*: of the shorter windows in it, the one of least hash. Equal
windows have equal anchors, so a window can only be repeated if its anchor is. Anchors are few (about two for every
``span`` positions); they are dealt out by hash and counted. Within a slice of some megabytes, equal anchors are counted
before they travel, so a passage of which many documents hold a copy sends one entry per slice.

Only 48 bits of an anchor's hash travel: a chance match lets a window through to the exact step, no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.llm import kernels as K

_S16 = np.uint64(16)
#: Texts per slice, so that a text's number fits beside 48 bits of a hash in a signed number.
MOST_TEXTS = 1 << 15

Found = tuple[np.ndarray, np.ndarray]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``rid``, ``id`` and ``text``: the rows with an identity of their own, from key and text, whatever else they hold."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(key), value).alias("rid"), F.col(key).alias("id"), value.alias("text"))


def shards(df: DataFrame) -> tuple[int, np.ndarray]:
    """Number of shards, and for each the number that Spark's hash sends to a partition of its own."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(16 * n).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(n)).alias("p"))
    found = dict(tried.groupBy("p").agg(F.min("i")).collect())
    return n, np.array([found.get(p, p) for p in range(n)], np.int64)


def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batch):
        for at in range(0, part.num_rows, MOST_TEXTS):
            yield part.slice(at, MOST_TEXTS)


def anchor_positions(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of ``span`` consecutive hashes from every position on, and where the anchors are."""
    least = K.sliding_min(g, span)
    if len(least) == 0:
        return least, np.zeros(0, np.int64)
    # A position is an anchor if some window around it has its hash as least: if the greatest of the leasts is its own.
    pad = np.zeros(span - 1, np.uint64)
    greatest = ~K.sliding_min(~np.r_[pad, least, pad], span)
    return least, np.flatnonzero(greatest == g)


def runs(least: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of windows with one anchor, of the windows that lie ``inside`` one text."""
    if len(least) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    edge = np.flatnonzero(new | ~inside)
    first = np.flatnonzero(new & inside)
    after = np.r_[edge, len(least)][np.searchsorted(edge, first, side="right")]
    return first, after - first


def split_at(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal values in a sorted array, and all borders."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return first, np.r_[first, len(groups)]


def repeated(docs: DataFrame, find: Callable[[np.ndarray, np.ndarray], Found], across: bool) -> DataFrame:
    """``rid`` and ``v``: the anchors of each row that occur again, as 48-bit hashes.

    ``find`` gives hash and text number of all anchors of a slice. With ``across``, an anchor counts once per row.
    """
    n, sent_as = shards(docs)

    def count_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                rid = batch.column("rid").to_numpy(zero_copy_only=False)
                v, d = find(*K.flat(batch.column("text")))
                key = np.sort(v >> _S16 << _S16 | d.astype(np.uint64))
                if across:
                    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                v, d = key >> _S16, (key & np.uint64(0xFFFF)).astype(np.int64)
                first, border = split_at(v)
                many = np.diff(border) > 1
                again = np.repeat(many, np.diff(border))
                rows: list[tuple] = []
                # Known to be repeated: straight to the row.
                pair = np.unique(d[again] << 48 | v[again].astype(np.int64)) if again.any() else np.zeros(0, np.int64)
                at, border = split_at(pair >> 48)
                for a, b in zip(at.tolist(), border[1:].tolist()):
                    own = int(rid[pair[a] >> 48])
                    rows.append((int(sent_as[own % n]), own, (pair[a:b] & (2**48 - 1)).astype(np.int64).tobytes(), None, None))
                # One entry for each anchor of the slice; the row is left open where the slice has several.
                v, who = v[first], np.where(many, -1, d[first])
                shard = (v % np.uint64(n)).astype(np.int64)
                order = np.lexsort((who, shard))
                at, border = split_at(shard[order])
                for a, b in zip(at.tolist(), border[1:].tolist()):
                    take = order[a:b]
                    used, size = np.unique(who[take], return_counts=True)
                    names = np.where(used < 0, 0, rid[np.maximum(used, 0)])
                    low, high = (v[take] & np.uint64(2**32 - 1)).astype(np.uint32), (v[take] >> np.uint64(32)).astype(np.uint16)
                    head = np.int64(size[0] if used[0] < 0 else 0)  # entries that want no reply come first
                    rows.append((int(sent_as[shard[take[0]]]), None, low.tobytes() + high.tobytes(), head.tobytes() + size[used >= 0].astype(np.uint32).tobytes(), names[used >= 0].tobytes()))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["shard", "rid", "v", "who", "names"]
                    )

    def count_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owners = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            direct = batch.filter(batch.column("who").is_null())
            for row in direct.to_pylist():
                found = np.frombuffer(row["v"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["rid"])), pa.array(found)], names=["rid", "v"])
            for row in batch.filter(batch.column("who").is_valid()).to_pylist():
                head, names = int(np.frombuffer(row["who"], np.int64, 1)[0]), np.frombuffer(row["names"], np.int64)
                size = np.frombuffer(row["who"], np.uint32, len(names), 8).astype(np.int64)
                total = head + int(size.sum())
                low, high = np.frombuffer(row["v"], np.uint32, total), np.frombuffer(row["v"], np.uint16, total, 4 * total)
                values.append(high.astype(np.uint64) << np.uint64(32) | low)
                owners.append(np.c_[np.arange(total) >= head, np.r_[np.zeros(head, np.int64), np.repeat(names, size)]])
        v, own = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, own = v[order], own[order]
        first, border = split_at(v)
        size = np.diff(border)
        reply = np.repeat(size > 1, size) & (own[:, 0] == 1)
        v, rid = v[reply].astype(np.int64), own[reply, 1]
        order = np.argsort(rid, kind="stable")
        for k in range(0, len(order), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rid[order[k : k + 100_000]]), pa.array(v[order[k : k + 100_000]])], names=["rid", "v"])

    sent = docs.select("rid", "text").mapInArrow(count_slice, "shard int, rid long, v binary, who binary, names binary")
    return sent.repartition(n, "shard").mapInArrow(count_shard, "rid long, v long")


def collected(rows: DataFrame, *columns: str) -> DataFrame:
    """The values of each ``rid`` side by side. A row's own arrays are bounded by its text."""
    return rows.groupBy("rid").agg(*[F.collect_list(c).alias(c) for c in columns])


def surviving(least: np.ndarray, first: np.ndarray, doc: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which runs have an anchor that is in their row's list."""
    v, row = listed(column)
    known = np.sort(v.astype(np.uint64) << _S16 | row.astype(np.uint64))
    key = least[first] >> _S16 << _S16 | doc.astype(np.uint64)
    at = np.searchsorted(known, key)
    return (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == key) if len(known) else np.zeros(len(first), bool)


def position_runs(rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rid``, first position and length of the runs of positions."""
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    if len(rid) == 0:
        return rid, pos, pos
    keep = np.r_[True, (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])]
    rid, pos = rid[keep], pos[keep]
    new = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1] + 1)])
    return rid[new], pos[new].astype(np.int64), np.diff(np.r_[new, len(rid)]).astype(np.int64)


def packed_runs(rid: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """The same, with the runs of each ``rid`` packed in two arrays."""
    owner, first, length = position_runs(rid, pos)
    at, border = split_at(owner)
    return [(int(owner[a]), first[a:b].tobytes(), length[a:b].tobytes()) for a, b in zip(at.tolist(), border[1:].tolist())]


def flagged(rid: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of one row for each run."""
    for k in range(0, len(rid), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (rid, first, length)], names=["rid", "first", "length"])


def unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of packed runs as one row for each run."""
    for row in batch.to_pylist():
        first = np.frombuffer(row["first"], np.int64)
        yield from flagged(np.full(len(first), row["rid"]), first, np.frombuffer(row["length"], np.int64))


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a column of lists, and the row each belongs to."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))


def covered(first_column: pa.Array, length_column: pa.Array, starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which items (bytes, words) of a slice lie in a flagged window of ``width``; runs are given within each text."""
    a, row = listed(first_column)
    n, _ = listed(length_column)
    change = np.zeros(total + 1, np.int32)
    begin = starts[row] + a
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(begin + n - 1 + width, total), -1)
    return np.cumsum(change[:-1]) > 0
