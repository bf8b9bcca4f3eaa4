"""Byte-level BPE: texts to token ids and back.

A task takes some megabytes of whole texts, splits them by the tokenizer's pattern, and folds ranked merges over the
byte arrays of the *distinct* pieces, all pieces side by side in NumPy; ids then go back to the texts by position.
Decoding puts the tokens' bytes one after the other. ``encode_words`` is the same fold in Spark SQL, with higher-order
functions and a literal rank table; the README says why it isn't the main path.

Null text is encoded as the empty text: no ids. Repeated rows get equal results; other columns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import kernels as K
from brickwork.session import materialize, spread

#: Where the tokenizer files lie, unless the package ``public_tokenizers`` can be imported.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text ahead of the merges of the public rank files. ``pieces`` follows it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of more bytes are merged one at a time, with a heap, in n log n steps.
SHORT = 64
_NONE = 1 << 30
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a public rank file."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pieces(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every match of PATTERN in the texts of a batch, and the number of matches before each text."""
    n_bytes = len(buf)
    if n_bytes == 0:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    place = np.flatnonzero((buf & 0xC0) != 0x80)
    char = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind, n = classes()[char], len(char)
    border = np.zeros(n + 3, bool)
    border[np.searchsorted(place, starts)] = True
    begins = border[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.r_[begins, True]
    # The last white space ahead of something else stands alone; a blank goes with what follows it.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~border[1:n])
    begins[last] = True
    begins[last[char[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll, where no blank and no other sign goes before
    far = np.r_[char, np.zeros(2, np.uint32)]
    q = np.flatnonzero((char == 39) & begins & run[1:] & ~border[1 : n + 1])
    one, two = far[q + 1], np.where(border[q + 2], 0, far[q + 2])
    short = np.isin(one, [115, 116, 109, 100])
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    begins[q[short | long] + 1] = False
    ends = np.r_[q[short] + 2, q[long] + 3]
    begins[ends[ends < n]] = True
    at = np.flatnonzero(begins)
    first = place[at]
    return first, np.searchsorted(first, starts)


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the neighbours of least rank, leftmost first, while any can be joined."""
    if piece in rank:
        return [rank[piece]]
    end = list(range(1, len(piece) + 1))  # of the part that begins there
    before = list(range(-1, len(piece)))
    heap = [(rank[k], i, 2) for i in range(len(piece) - 1) if (k := piece[i : i + 2]) in rank]
    heapq.heapify(heap)
    gone = bytearray(len(piece) + 1)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = end[i] if not gone[i] else len(piece)
        if gone[i] or j >= len(piece) or end[j] - i != size:
            continue
        end[i], gone[j] = end[j], 1
        if end[i] < len(piece):
            before[end[i]] = i
            if (k := piece[i : end[end[i]]]) in rank:
                heapq.heappush(heap, (rank[k], i, len(k)))
        if i and (k := piece[before[i] : end[i]]) in rank:
            heapq.heappush(heap, (rank[k], before[i], len(k)))
    out, i = [], 0
    while i < len(piece):
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Rank table in arrays: which pairs of ids join to which id, and the bytes and decimal digits of every id."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.length = np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        text = [b"%d " % i for i in range(size)]
        self.digits = np.array([len(t) for t in text], np.int64)
        self.decimal = np.frombuffer(b"".join(t.ljust(8) for t in text), np.uint8).reshape(size, 8)
        pairs = [(self.rank[t[:k]] << 32 | self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        key, to = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        self.mask = np.uint64((1 << (len(pairs) * 4).bit_length()) - 1)
        self.key, self.to = np.full(int(self.mask) + 1, 2**64 - 1, np.uint64), np.full(int(self.mask) + 1, _NONE, np.int32)
        slot = K.mix(key) & self.mask
        while len(key):  # every round, one key takes each free slot; the others try the next
            free = self.key[slot] == np.uint64(2**64 - 1)
            _, win = np.unique(np.where(free, slot, self.mask + np.uint64(1)), return_index=True)
            win = win[free[win]]
            self.key[slot[win]], self.to[slot[win]] = key[win], to[win]
            rest = np.ones(len(key), bool)
            rest[win] = False
            key, to, slot = key[rest], to[rest], (slot[rest] + np.uint64(1)) & self.mask
        # Tokens that their own merges don't lead to: a piece that equals one is that token all the same.
        data, at = self.bytes, np.r_[self.first, len(self.bytes)]
        ids, count, first = self.fold(data, at[:-1], at[1:])
        self.whole = {token[i] for i in np.flatnonzero(~((count == 1) & (ids[np.minimum(first, len(ids) - 1)] == np.arange(size)))) if token[i]}

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id that each pair of neighbours joins to, or _NONE."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = K.mix(key) & self.mask
        out = np.where(self.key[slot] == key, self.to[slot], _NONE)
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            s = slot[open_]
            out[open_] = np.where(self.key[s] == key[open_], self.to[s], _NONE)
            open_ = open_[(self.key[s] != key[open_]) & (self.key[s] != np.uint64(2**64 - 1))]
        return out

    def fold(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many pieces: all ids in one array, and how many each piece has and where they begin."""
        size = end - begin
        count, first = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        found: list[np.ndarray] = []
        done, low = 0, 0
        for width in (1, 2, 4, 6, 8, 10, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(rows) == 0:
                continue
            tok = np.full((len(rows), width + 1), -1, np.int32)
            col = np.arange(width)
            for c in range(width):
                has = np.flatnonzero(size[rows] > c)
                tok[has, c] = self.byte[buf[begin[rows[has]] + c]]
            rank = np.full((len(rows), width), _NONE, np.int32)
            for c in range(width - 1):
                has = np.flatnonzero(tok[:, c + 1] >= 0)
                rank[has, c] = self.joined(tok[has, c], tok[has, c + 1])
            live = np.arange(len(rows))
            while len(live):
                r = rank[live]
                best = r.argmin(1)
                value = r[np.arange(len(live)), best]
                go = value < _NONE
                live, best, value, r = live[go], best[go], value[go], r[go]
                if len(live) == 0:
                    break
                n = np.arange(len(live))
                move = col + (col > best[:, None])
                t = tok[live]
                t[:, :width] = np.take_along_axis(t, move, 1)
                t[n, best] = value
                r = np.take_along_axis(np.c_[r, np.full(len(live), _NONE, np.int32)], col + (col >= best[:, None]), 1)
                right = t[n, best + 1]
                r[n, best] = np.where(right >= 0, self.joined(value, np.maximum(right, 0)), _NONE)
                side = np.flatnonzero(best > 0)
                r[side, best[side] - 1] = self.joined(t[side, best[side] - 1], value[side])
                tok[live], rank[live] = t, r
            here = tok >= 0
            count[rows] = here.sum(1)
            first[rows] = done + np.cumsum(count[rows]) - count[rows]
            found.append(tok[here])
            done += len(found[-1])
        for k in np.flatnonzero(size > SHORT):
            ids = np.array(merge(buf[begin[k] : end[k]].tobytes(), self.rank), np.int32)
            count[k], first[k] = len(ids), done
            found.append(ids)
            done += len(ids)
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), count, first

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and the number of ids before each text."""
        begin, before = pieces(buf, starts)
        if len(begin) == 0:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        end = np.r_[begin[1:], len(buf)]
        _, one, back = np.unique(K.hash_words(buf, begin, end), return_index=True, return_inverse=True)
        if not K.same_bytes(buf, begin, begin[one][back], end - begin, (end - begin)[one][back]):
            one = back = np.arange(len(begin))  # two pieces with one hash: take every piece for itself
        ids, count, first = self.fold(buf, begin[one], end[one])
        if self.whole:
            for k in np.flatnonzero(count > 1):
                t = buf[begin[one[k]] : end[one[k]]].tobytes()
                if t in self.whole:
                    ids, count[k], first[k] = np.append(ids, np.int32(self.rank[t])), 1, len(ids)
        total = np.r_[0, np.cumsum(count[back])]
        return ids[K.ranges(first[back], count[back])], total[before]

    def text_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids in decimal, a blank behind each, and the number of characters before each id."""
        digits = self.digits[ids]
        return self.decimal[ids][np.arange(8) < digits[:, None]].tobytes(), np.r_[0, np.cumsum(digits)]

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes one after the other, and the number of bytes before each id."""
        length = self.length[ids]
        return self.bytes[K.ranges(self.first[ids], length)].tobytes(), np.r_[0, np.cumsum(length)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return (batch.drop_columns([name]) if name in batch.schema.names else batch).append_column(name, column)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each text as an array of integers."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for whole in batches:
            for batch in K.slices(whole, text):
                found, first = own.encode(*K.flat(batch.column(batch.schema.get_field_index(text))))
                yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found)))

    return docs.mapInArrow(run, _schema(docs, ids, T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that an array of token ids stands for; null ids give empty bytes."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield _with(batch, to, K.binaries([own.bytes_of(np.array(r or [], np.int64))[0] for r in rows]))

    return tokens.mapInArrow(run, _schema(tokens, to, T.BinaryType()))


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again; return counts and digests instead of the ids themselves."""
    path = path or vocabulary_path()
    schema = T.StructType(
        [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for whole in batches:
            for batch in K.slices(whole):
                ids, first = own.encode(*K.flat(batch.column("text")))
                decimal, d = own.text_of(ids)
                back, b = own.bytes_of(ids)
                sha = lambda data, at, less: [hashlib.sha256(data[x : max(x, y - less)]).hexdigest() for x, y in zip(at[first][:-1].tolist(), at[first][1:].tolist())]
                n = pa.array(np.diff(first), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(sha(decimal, d, 1)), pa.array(sha(back, b, 0))], names=schema.names)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def rank_table(path: str, buckets: int = 1 << 16) -> Column:
    """The ranks as one literal: an array of ``buckets`` small maps, addressed by the CRC of the token's hex."""
    import zlib

    rows: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks(path).items():
        key = token.hex().upper()
        rows[zlib.crc32(key.encode()) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), "array<map<string,int>>")


def encode_words(words: DataFrame, path: str | None = None, word: str = "word", ids: str = "ids") -> DataFrame:
    """Add the ids of each distinct word, all in Spark SQL.

    The word's bytes become an array of hex strings. ``aggregate`` over the word's length folds it: each step finds the
    neighbours of least rank, leftmost first, and joins them, or leaves the array as it is.
    """
    path, buckets = path or vocabulary_path(), 1 << 16
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def of(table: Column) -> Column:
        rank = lambda part: F.coalesce(F.try_element_at(F.get(table, (F.crc32(part.cast("binary")) % buckets).cast("int")), part), F.lit(_NONE))
        pairs = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.struct(rank(F.concat(F.get(a, i), F.get(a, i + 1))).alias("r"), i.alias("i")))
        joined = lambda a, i: F.concat(F.slice(a, F.lit(1), i), F.array(F.concat(F.get(a, i), F.get(a, i + 1))), F.slice(a, i + 3, F.size(a)))
        step = lambda a, _: F.when(F.size(a) < 2, a).otherwise(let(F.array_min(pairs(a)), lambda b: F.when(b["r"] == _NONE, a).otherwise(joined(a, b["i"]))))
        size, hexed = F.octet_length(F.col(word)), F.hex(F.col(word).cast("binary"))
        letters = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2)))
        folded = F.when(size > 1, F.aggregate(F.sequence(F.lit(2), size), letters, step)).when(size == 1, letters)
        return F.transform(F.when(rank(hexed) < _NONE, F.array(hexed)).otherwise(folded), rank)

    return words.withColumn(ids, let(rank_table(path, buckets), of))


#: ``PATTERN`` as Java's regular expressions write it: the flag gives ``\\s`` its Unicode meaning.
SQL_PATTERN = "(?U)" + PATTERN


def digests_by_words(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`digests`, by Spark SQL alone: every distinct word of the corpus is folded once, its ids are joined back to
    all its places, and decoding concatenates the tokens' bytes. The README compares its cost with that of :func:`digests`.
    """
    path = path or vocabulary_path()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(key), F.monotonically_increasing_id().alias("rid"), value.alias("text"))
    own = materialize(own, "texts")
    places = own.select("rid", F.posexplode(F.regexp_extract_all("text", F.lit(SQL_PATTERN), F.lit(0))).alias("pos", "word"))
    found = materialize(encode_words(spread(places.select("word").distinct()), path), "words")
    joined = places.join(found, "word")
    ids = joined.groupBy("rid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda s: s["ids"])).alias("ids"))
    full = own.select(key, "rid").join(ids, "rid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    token = [b""] * (max(ranks(path).values()) + 1)
    for t, r in ranks(path).items():
        token[r] = t
    table = F.from_json(F.lit(json.dumps([t.hex() for t in token])), "array<string>")
    let = lambda v, f: F.get(F.transform(F.array(v), f), 0)
    decoded = let(table, lambda names: F.unhex(F.array_join(F.transform("ids", lambda i: F.get(names, i)), "")))
    return full.select(
        key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
