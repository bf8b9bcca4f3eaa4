"""NumPy steps on the flat bytes of an Arrow text column, shared by the operators that run in Arrow batches.

A batch of texts is one byte array plus the offsets of its texts; nothing here loops over texts or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at a time; keeps a task's arrays at some hundred megabytes.
SLICE_BYTES = 4 << 20

#: The bytes that separate words: blank and 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
#: Keeps the first k bytes of a little-endian 8-byte word.
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    _, starts = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def overlapping(buf: np.ndarray) -> np.ndarray:
    """For every byte position, the eight bytes from there on as a number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf),), "<u8", buffer=padded, strides=(1,))


def words(buf: np.ndarray, starts: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each text (one more entry than texts)."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    inside = ~blank[buf]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[1:n] |= ~inside[:-1] | ~inside[1:]
    edge[0] = edge[n] = True
    begin = np.flatnonzero(inside & edge[:n])
    end = np.flatnonzero(inside & edge[1:]) + 1
    return begin, end, np.searchsorted(begin, starts)


def hash_words(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word."""
    eight, size = overlapping(buf), end - begin
    h = np.full(len(begin), seed, np.uint64) + size.astype(np.uint64)
    if len(begin) == 0:
        return h
    h = mix(h ^ (eight[begin] & _HEAD[np.minimum(size, 8)]))
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest):
        h[rest] = mix(h[rest] * _M2 + (eight[begin[rest] + done] & _HEAD[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    return h


def runs_hash(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``length`` consecutive values from every position on; shorter than ``h`` by ``length - 1``."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n] + np.uint64(seed))
    for k in range(1, length):
        out = mix(out * _M1 + h[k : k + n])
    return out


def doubled_hash(h: np.ndarray, length: int) -> np.ndarray:
    """As :func:`runs_hash`, by joining hashes of half the length: few steps for long runs."""
    if length == 1:
        return mix(h)
    half = (length + 1) // 2
    part = doubled_hash(h, half)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(part[:n] * _M1 + (part[length - half : length - half + n] ^ np.uint64(length)))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values from every position on."""
    n, length = len(h) - width + 1, 1
    if n <= 0:
        return h[:0]
    while length * 2 <= width:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    rest = width - length
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``first .. first + count - 1``, one range after the other."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(first - before, count)


def owner(starts: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to, from the number of items before each text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def binaries(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, size_b: np.ndarray) -> bool:
    """Whether all byte ranges at ``a`` equal those at ``b``."""
    if not np.array_equal(size, size_b):
        return False
    eight = overlapping(buf)
    rest, done = np.flatnonzero(size > 0), 0
    while len(rest):
        keep = _HEAD[np.minimum(size[rest] - done, 8)]
        if ((eight[a[rest] + done] ^ eight[b[rest] + done]) & keep).any():
            return False
        done += 8
        rest = rest[size[rest] > done]
    return True
