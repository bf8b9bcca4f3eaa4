"""Exact substring dedup with suffix arrays of shards.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

1. Strings whose anchor (see :mod:`anchors`) occurs in one document only are done with.
2. The others are cut out in pieces, each with all strings of one anchor, and dealt out by that anchor: equal strings
   meet in one shard. Equal pieces of a slice travel once, for their smallest document.
3. Each shard's pieces become a suffix array by induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings
   are sorted and named, their order is induced to all suffixes in linear time, bucket by bucket. Permuted common
   prefixes, in text order, tell where neighbours share ``LENGTH`` bytes; each such run of suffixes has a first document.
4. Strings whose document isn't the first go back to their documents, which drop the bytes they cover.

Null text is empty. Ids must be whole numbers; a null id counts as greater than all others. Rows with equal ids don't affect each other.
Texts shorter than ``LENGTH`` stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import anchors as A
from brickwork.llm import kernels as K

LENGTH = 50
#: Bytes of an anchor.
GRAM = 20
#: Bytes of pieces that are sorted at a time; a single anchor's pieces may be more.
SHARD_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max


def _rank_names(name: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by at least ``depth`` names.

    The names' alphabet is nearly as large as the string, so names are joined in pairs and named anew, again and again.
    """
    n, k = len(name), 1
    while k < depth and n and int(name.max()) + 1 < n:
        pair = name.astype(np.int64) * (n + 1)
        pair[:-k] += name[k:] + 1 if k < n else 0
        order = np.argsort(pair)
        step = np.zeros(n, np.int64)
        step[1:] = pair[order][1:] != pair[order][:-1]
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(step)
        k *= 2
    return np.argsort(name)


def _induce(t: np.ndarray, lms: np.ndarray, size: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in their order: larger suffixes left to right, then smaller ones back.

    A bucket's suffixes advance together; those of one letter that follow each other take one round each.
    """
    sa = np.full(len(t), -1, np.int32)
    tail = np.cumsum(size)
    head = tail - size
    letter = t[lms]
    per = np.bincount(letter, minlength=len(size))
    lms_first = np.cumsum(per) - per
    used = np.flatnonzero(size)

    def deal(found: np.ndarray, at: np.ndarray, sign: int) -> None:
        """Append suffixes to the buckets of their letters, in order."""
        c = t[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        count = np.bincount(c, minlength=len(size))
        rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        sa[at[c] + sign * rank] = found
        at += sign * count

    grown = head.copy()
    for c in used:
        front = done = int(head[c])
        while done < grown[c]:  # suffixes of this letter may add to their own bucket
            before = sa[done : grown[c]] - 1
            done = int(grown[c])
            before = before[before >= 0]
            same = before[(t[before] == c) & ~small[before]]
            sa[done : done + len(same)] = same
            grown[c] += len(same)
        large = sa[front : grown[c]]
        least = lms[lms_first[c] : lms_first[c] + per[c]]
        before = np.concatenate([large, least]) - 1
        before = before[before >= 0]
        before = before[t[before] > c]
        if len(before):
            deal(before, grown, 1)
    shrunk = tail.copy() - 1
    sa[0], shrunk[0] = len(t) - 1, -1  # the end of the text, which nothing comes after
    for c in used[::-1]:
        done = int(tail[c]) - 1
        while done > shrunk[c]:
            before = sa[shrunk[c] + 1 : done + 1][::-1] - 1
            done = int(shrunk[c])
            before = before[before >= 0]
            same = before[(t[before] == c) & small[before]]
            sa[done - np.arange(len(same))] = same
            shrunk[c] -= len(same)
        both = np.concatenate([sa[shrunk[c] + 1 : tail[c]][::-1], sa[head[c] : grown[c]][::-1]]) - 1
        both = both[both >= 0]
        both = both[(t[both] < c) & small[both]]
        if len(both):
            deal(both, shrunk, -1)
    return sa


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in order, compared by at least ``depth`` letters. ``t`` ends in its only 0."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    change = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(n, bool)  # smaller than the suffix after it
    small[-1] = True
    up = t[change + 1] > t[change]
    small[:-1] = np.repeat(up, np.diff(np.r_[-1, change]))[: n - 1]
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    size = np.bincount(t)
    # LMS substrings in order: induced from the LMS positions by first letter.
    by_letter = lms[np.argsort(t[lms], kind="stable")]
    rough = _induce(t, by_letter, size, small)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    # Names: neighbours get one name if their substrings are equal.
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.diff(np.r_[lms, n - 1]) + 1
    a, b = order[:-1], order[1:]
    size_a, size_b = length[number[a]], length[number[b]]
    equal = size_a == size_b
    padded = np.r_[t, np.zeros(4, t.dtype)].astype(np.uint16)
    four = np.ndarray((n,), "<u8", buffer=padded, strides=(2,))
    head = np.array([(1 << (16 * k)) - 1 for k in range(4)] + [2**64 - 1], np.uint64)
    rest, done = np.flatnonzero(equal), 0
    while len(rest):
        differ = ((four[a[rest] + done] ^ four[b[rest] + done]) & head[np.minimum(size_a[rest] - done, 4)]) != 0
        equal[rest[differ]] = False
        done += 4
        rest = rest[~differ & (size_a[rest] > done)]
    name = np.zeros(len(lms), np.int64)
    name[number[order]] = np.cumsum(np.r_[0, ~equal])
    return _induce(t, lms[_rank_names(name, (depth + 1) // 2 + 1)], size, small)


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For every suffix in ``order`` but the first, whether it shares ``length`` bytes with the one before.

    Prefixes are compared in text order (permuted), where neighbours in the text look at neighbouring places.
    """
    before = np.full(len(data), -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    eight = K.overlapping(data)
    live = at
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        live = live[eight[live + k] == eight[before[live] + k]]
    shares = np.zeros(len(data), bool)
    shares[live] = True
    return shares[order[1:]]


def first_holders(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the pieces: piece number, position in ``data``, and the least document that holds it."""
    size = end - begin
    where = K.ranges(begin, size)
    out = np.zeros(int(size.sum()) + len(size) + 1, np.uint16)
    place = np.cumsum(size + 1) - size - 1  # of each piece in the joined text
    target = K.ranges(place, size)
    out[target] = data[where].astype(np.uint16) + 2
    out[place + size] = 1
    joined = np.zeros(len(out), np.uint8)
    joined[target] = data[where]
    order = suffix_array(out, length)
    piece = np.full(len(out), -1, np.int32)
    piece[target] = np.repeat(np.arange(len(size)), size)
    whole = np.zeros(len(out), bool)
    whole[K.ranges(place, np.maximum(size - length + 1, 0))] = True
    order = order[whole[order]]
    if len(order) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.r_[0, np.cumsum(~common_prefixes(joined, order, length))]
    own = doc[piece[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
    return piece[order], order - place[piece[order]], least[group]


def _anchors(buf: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Least anchor hash of each string, which strings lie in one text, the anchors' hashes, positions and texts."""
    eight, n = K.overlapping(buf), len(buf) - gram + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, bool), none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = K.mix(eight[:n])
    for k in [*range(8, gram - 7, 8), gram - 8]:
        g = K.mix(g * np.uint64(31) + eight[k : k + n])
    doc = K.owner(starts)
    least, at = A.anchor_positions(g, length - gram + 1)
    inside = doc[: len(least)] == doc[length - 1 : length - 1 + len(least)]
    return least, inside, g, at, doc


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rid`` and runs of byte positions at which a string begins that a smaller document holds as well."""
    n, sent_as = A.shards(docs)

    def anchors_of(buf: np.ndarray, starts: np.ndarray) -> A.Found:
        _, _, g, at, doc = _anchors(buf, starts, length, gram)
        at = at[doc[at] == doc[at + gram - 1]] if len(at) else at
        return g[at], doc[at]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                buf, starts = K.flat(batch.column("text"))
                rid = batch.column("rid").to_numpy(zero_copy_only=False)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                least, inside, _, _, doc = _anchors(buf, starts, length, gram)
                first, count = A.runs(least, inside)
                if len(first) == 0:
                    continue
                live = A.surviving(least, first, doc[first], batch.column("v"))
                first, count = first[live], count[live]
                if len(first) == 0:
                    continue
                end, d = first + count + length - 1, doc[first]
                # Equal pieces: only the one of the smallest document goes on, the others' strings are held by it.
                h = K.hash_words(buf, first, end)
                order = np.lexsort((rid[d], ids[d], h))
                _, border = A.split_at(h[order])
                lead = np.repeat(order[border[:-1]], np.diff(border))
                if not K.same_bytes(buf, first[order], first[lead], (end - first)[order], (end - first)[lead]):
                    lead = order
                later = order[ids[d[order]] > ids[d[lead]]]
                own, pos = np.repeat(rid[d[later]], count[later]), K.ranges(first[later] - starts[d[later]], count[later])
                rows: list[tuple] = [(int(sent_as[r[0] % n]), r[0], None, None, None, r[1], r[2]) for r in A.packed_runs(own, pos)]
                sent = np.sort(order[ids[d[order]] == ids[d[lead]]])
                v = least[first[sent]] >> np.uint64(20)
                shard = (v % np.uint64(n)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at, border = A.split_at(shard[order])
                for a, b in zip(at.tolist(), border[1:].tolist()):
                    take = sent[order[a:b]]
                    used, count_of = np.unique(d[take], return_counts=True)
                    size = (end - first)[take]
                    data = buf[K.ranges(first[take], size)].tobytes()
                    facts = np.r_[(v[order[a:b]] // np.uint64(n) & np.uint64(2**32 - 1)).astype(np.int64), size, first[take] - starts[d[take]], count_of].astype(np.uint32)
                    rows.append((int(sent_as[shard[order[a]]]), None, pa.compress(data, "zstd", asbytes=True), facts.tobytes(), np.r_[rid[used], ids[used]].astype(np.int64).tobytes(), None, None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                    names=["shard", "rid", "data", "at", "names", "first", "length"],
                )

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, v, facts, names, known = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            direct = batch.filter(batch.column("data").is_null())
            yield from A.unpacked(direct.select(["rid", "first", "length"]))
            for row in batch.filter(batch.column("data").is_valid()).to_pylist():
                own = np.frombuffer(row["names"], np.int64).reshape(2, -1)
                packed = np.frombuffer(row["at"], np.uint32).astype(np.int64)
                m = (len(packed) - own.shape[1]) // 3
                told = np.repeat(np.arange(own.shape[1]) + known, packed[3 * m :])
                v.append(packed[:m])
                facts.append(np.stack([packed[m : 2 * m], told, packed[2 * m : 3 * m]]))
                data.append(np.frombuffer(pa.decompress(row["data"], int(facts[-1][0].sum()), "zstd", asbytes=True), np.uint8))
                names.append(own)
                known += own.shape[1]
        buf, anchor, (size, who, start) = np.concatenate(data), np.concatenate(v), np.concatenate(facts, 1)
        del data, v, facts
        rid, ids = np.concatenate(names, 1)
        begin = np.cumsum(size) - size
        # Equal pieces from several slices: again only those of the smallest document are sorted.
        h = K.hash_words(buf, begin, begin + size)
        order = np.lexsort((ids[who], h))
        _, border = A.split_at(h[order])
        lead = np.repeat(order[border[:-1]], np.diff(border))
        if not K.same_bytes(buf, begin[order], begin[lead], size[order], size[lead]):
            lead = order
        held = ids[who[order]] > ids[who[lead]]
        yield from A.flagged(rid[who[order[held]]], start[order[held]], size[order[held]] - length + 1)
        order = np.sort(order[~held])
        order = order[np.argsort(anchor[order], kind="stable")]
        # Pieces of an anchor that one document has alone repeat nothing of a smaller one.
        group, border = A.split_at(anchor[order])
        if len(group):
            holder = ids[who[order]]
            several = np.minimum.reduceat(holder, group) < np.maximum.reduceat(holder, group)
            order = order[np.repeat(several, np.diff(border))]
        group, border = A.split_at(anchor[order])
        total = np.r_[0, np.cumsum(size[order])]
        k = 0
        while k < len(group):
            last = max(int(np.searchsorted(total[border], total[border[k]] + SHARD_BYTES, side="right")) - 1, k + 1)
            take = order[border[k] : border[last]]
            piece, offset, least = first_holders(buf, begin[take], begin[take] + size[take], ids[who[take]], length)
            own = who[take][piece]
            later = ids[own] > least
            yield from A.flagged(*A.position_runs(rid[own[later]], (start[take][piece] + offset)[later]))
            k = last

    first = A.repeated(docs, anchors_of, across=True)
    candidates = docs.join(A.collected(first, "v"), "rid").select("rid", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)).alias("id"), "text", "v")
    sent = candidates.mapInArrow(cut_out, "shard int, rid long, data binary, at binary, names binary, first binary, length binary")
    return sent.repartition(n, "shard").mapInArrow(sort_shard, "rid long, first long, length long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """Key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, the remaining bytes (``kept``)."""
    own = A.keyed(docs, key, text)
    flags = A.collected(repeated_strings(own, length), "first", "length")
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    more = [T.StructField("kept", T.BinaryType())] if with_bytes else []
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *longs, T.StructField("kept_sha256", T.StringType()), *more])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                buf, starts = K.flat(batch.column("text"))
                gone = A.covered(batch.column("first"), batch.column("length"), starts, length, len(buf))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[starts[:-1][starts[:-1] < len(buf)]] |= gone[starts[:-1][starts[:-1] < len(buf)]]
                per = lambda mask: pa.array(np.diff(np.r_[0, np.cumsum(mask)][starts]), pa.int64())
                raw, at = buf[~gone].tobytes(), np.r_[0, np.cumsum(~gone)][starts].tolist()
                kept = [raw[x:y] for x, y in zip(at, at[1:])]
                columns = [batch.column("id"), pa.array(np.diff(starts), pa.int64()), per(gone), per(begins), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([K.binaries(kept)] if with_bytes else [])], names=schema.names)

    return own.join(flags, "rid", "left").select("id", "text", "first", "length").mapInArrow(remove, schema)
