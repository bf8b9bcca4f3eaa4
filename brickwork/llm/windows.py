"""Substring dedup by level-wise doubling over windows of words.

The first level looks at windows of half the wanted length (see :mod:`anchors`): those that occur once are done with.
Windows repeated at that length alone are extended to twice it, hashed, dealt out and counted again. Words in a window
that survives the last level are removed.

Windows of the last level are compared by the 64 bits of their hash among the windows dealt to the same task. Null and
empty texts have no words. Repeated rows repeat each other's windows. Texts shorter than a window stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brickwork.llm import anchors as A
from brickwork.llm import kernels as K

WINDOW = 35


def _levels(buf: np.ndarray, starts: np.ndarray, window: int):
    begin, end, before = K.words(buf, starts)
    h, doc = K.hash_words(buf, begin, end), K.owner(before)
    half = (window + 1) // 2
    g = K.doubled_hash(h, half)
    return h, doc, before, g, half


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid`` and runs of word positions at which a repeated window begins; ``docs`` has rid, id and text."""
    n, sent_as = A.shards(docs)

    def anchors_of(buf: np.ndarray, starts: np.ndarray) -> A.Found:
        _, doc, _, g, half = _levels(buf, starts, window)
        _, at = A.anchor_positions(_apart(g, doc, half), window - half + 1)
        at = at[doc[at] == doc[at + half - 1]] if len(at) else at
        return g[at], doc[at]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                rid = batch.column("rid").to_numpy(zero_copy_only=False)
                h, doc, before, g, half = _levels(*K.flat(batch.column("text")), window)
                least, _ = A.anchor_positions(_apart(g, doc, half), window - half + 1)
                inside = doc[: len(least)] == doc[window - 1 : window - 1 + len(least)]
                first, count = A.runs(least, inside)
                if len(first) == 0:
                    continue
                live = A.surviving(least, first, doc[first], batch.column("v"))
                first, count = first[live], count[live]
                if len(first) == 0:
                    continue
                at = K.ranges(first, count)
                w = K.doubled_hash(h, window)[at]
                shard = ((np.repeat(least[first], count) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
                _, one, back, many = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
                own, pos = rid[doc[at]], at - before[doc[at]]
                again = many[back] > 1
                rows: list[tuple] = [(int(sent_as[r[0] % n]), r[0], None, None, None, r[1], r[2]) for r in A.packed_runs(own[again], pos[again])]
                one = np.sort(one)  # one entry for each window of the slice, in text order
                order = one[np.argsort(shard[one], kind="stable")]
                begin, border = A.split_at(shard[order])
                for a, b in zip(begin.tolist(), border[1:].tolist()):
                    take = order[a:b]
                    used, told = np.unique(doc[at[take]], return_inverse=True)
                    told = np.where(again[take], 0, told + 1).astype(np.uint32)
                    step = np.diff(np.r_[0, pos[take]]).astype(np.int32)
                    rows.append((int(sent_as[shard[take[0]]]), None, w[take].tobytes(), told.tobytes() + step.tobytes(), rid[used].tobytes(), None, None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                    names=["shard", "rid", "w", "at", "names", "first", "length"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        names, known = [np.zeros(0, np.int64)], 0
        for batch in batches:
            direct = batch.filter(batch.column("w").is_null())
            yield from A.unpacked(direct.select(["rid", "first", "length"]))
            for row in batch.filter(batch.column("w").is_valid()).to_pylist():
                w = np.frombuffer(row["w"], np.uint64)
                told, step = np.frombuffer(row["at"], np.uint32, len(w)).astype(np.int64), np.frombuffer(row["at"], np.int32, len(w), 4 * len(w))
                hashes.append(w)
                owners.append(np.where(told > 0, told - 1 + known, -1))
                names.append(np.frombuffer(row["names"], np.int64))
                known += len(names[-1])
                places.append(np.cumsum(step))
        w = np.concatenate(hashes)
        who, pos = np.concatenate(owners), np.concatenate(places)
        order = np.argsort(w, kind="stable")
        w, who, pos = w[order], who[order], pos[order]
        _, border = A.split_at(w)
        size = np.diff(border)
        reply = np.repeat(size > 1, size) & (who >= 0)
        yield from A.flagged(*A.position_runs(np.concatenate(names)[who[reply]], pos[reply]))

    first = A.repeated(docs, anchors_of, across=False)
    candidates = docs.join(A.collected(first, "v"), "rid").select("rid", "text", "v")
    sent = candidates.mapInArrow(extend, "shard int, rid long, w binary, at binary, names binary, first binary, length binary")
    return sent.repartition(n, "shard").mapInArrow(count, "rid long, first long, length long")


def _apart(g: np.ndarray, doc: np.ndarray, half: int) -> np.ndarray:
    """The hashes, with those that go across texts made greatest, so that they are no anchors."""
    out = g.copy()
    if len(g):
        out[doc[: len(g)] != doc[half - 1 : half - 1 + len(g)]] = np.uint64(2**64 - 1)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Key, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, the remaining words joined by blanks (``kept``)."""
    own = A.keyed(docs, key, text)
    flags = A.collected(repeated_windows(own, window), "first", "length")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *fields, *([T.StructField("kept", T.StringType())] if with_text else [])])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                buf, starts = K.flat(batch.column("text"))
                begin, end, before = K.words(buf, starts)
                gone = A.covered(batch.column("first"), batch.column("length"), before, window, len(begin))
                # The kept words with a blank behind each, in one array.
                b, size = begin[~gone], (end - begin)[~gone]
                data = np.full(int(size.sum()) + len(size), 32, np.uint8)
                data[K.ranges(np.cumsum(size + 1) - size - 1, size)] = buf[K.ranges(b, size)]
                total = np.r_[0, np.cumsum(size + 1)][np.r_[0, np.cumsum(~gone)][before]]
                raw = data.tobytes()
                kept = [raw[x : max(x, y - 1)] for x, y in zip(total.tolist(), total[1:].tolist())]
                removed = np.diff(np.r_[0, np.cumsum(gone)][before])
                columns = [batch.column("id"), pa.array(np.diff(before), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([t.decode() for t in kept], pa.string())] if with_text else [])], names=schema.names)

    return own.join(flags, "rid", "left").select("id", "text", "first", "length").mapInArrow(remove, schema)
