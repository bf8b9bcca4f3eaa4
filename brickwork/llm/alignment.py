"""Alignment of two tokenizers: where their tokens end together, and how often each pair of ids does.

A is a byte-level BPE, B a piece model that puts a blank in front of a text. Both are laid over the bytes of blank +
text; offsets where a token of A and one of B end cut the tokens into groups, and the last tokens of a group are a link.

* **Identity map.** A group of one token on either side has the same bytes on both. For every id of A the id of B with
  the same bytes is found ahead of time, so such a link is told by its A id alone and is counted in a vector as long as
  A's vocabulary. Of other groups the last tokens never have equal bytes, since then they would begin together, and the
  group would be cut there. So a pair of ids is counted in one of the two ways, never in both.
* **Irregular pairs** are added up per task and shuffled by pair. Of two tokens that end together the shorter is a proper
  end of the longer, so there are at most as many pairs as the vocabularies have bytes (see ``Tokens.bytes_in_all``),
  however large the input is: the table of counts may be sent to every task.

Texts are encoded once; what the second pass needs of a text, the ids of its links, is stored beside its digest.
No token of either vocabulary is empty, so at most one token of a side ends at any offset.

Null and empty texts, and texts whose tokens do not give back blank + text (say, where the piece model replaces a
character), have no tokens. Repeated rows are aligned and counted each. Other columns are not read. An empty table gives
an empty table. Work and memory of a text grow with its length; a slice holds some megabytes of texts, or one longer text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import bpe
from brickwork.llm import kernels as K
from brickwork.session import materialize

A_RANKS, A_ENTRIES, B_MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts that the vector of one-to-one counts is added up in, each by one task.
VECTOR_PARTS = 16


def entry_bytes(path: str) -> dict[int, bytes]:
    """Bytes of every ordinary entry of a byte-level vocabulary, by id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes written as the character of that number
    other = [b for b in range(256) if b not in plain]  # the rest are written as characters from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["id"] for t in model["added_tokens"]}
    return {i: bytes(byte[c] for c in token) for token, i in model["model"]["vocab"].items() if i not in special}


class Tokens:
    """Bytes of every id of one tokenizer."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.length = np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token) or b"\0", np.uint8)
        self.bytes_in_all = int(self.length.sum())
        self.kind = np.min_scalar_type(max(len(token) - 1, 1))

    def lay(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[K.ranges(self.first[ids], self.length[ids])]


class Pair:
    """Both tokenizers, and the identity map between them."""

    def __init__(self, a_ranks: str, a_entries: str, b_model: str):
        import sentencepiece

        entries, ranks = entry_bytes(a_entries), bpe.ranks(a_ranks)
        if {t: i for i, t in entries.items()} != ranks:
            raise ValueError(f"{a_ranks} and {a_entries} do not number the same tokens alike")
        self.encoder = bpe.vocabulary(a_ranks)
        self.a = Tokens([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        single = [self.model.is_byte(i) for i in range(len(pieces))]
        self.b = Tokens([bytes([int(p[3:5], 16)]) if s else p.replace("▁", " ").encode() for p, s in zip(pieces, single)])
        # Where a byte's piece and an ordinary one have the same bytes, the ordinary one is mapped to; the other stays irregular.
        same = {t: i for i, t in sorted(enumerate(self.b.token), key=lambda x: (not single[x[0]], -x[0]))}
        self.identity = np.array([same.get(t, -1) if t else -1 for t in self.a.token], np.int64)

    def most_pairs(self) -> int:
        """Bound on the pairs of ids that ever end together: each end of each token, for up to two ids of the same bytes."""
        return 2 * (self.a.bytes_in_all + self.b.bytes_in_all)


@lru_cache(maxsize=2)
def pair(a_ranks: str, a_entries: str, b_model: str) -> Pair:
    return Pair(a_ranks, a_entries, b_model)


def default_paths() -> tuple[str, str, str]:
    return tuple(bpe.vocabulary_path(name) for name in (A_RANKS, A_ENTRIES, B_MODEL))


class Aligned:
    """Tokens and groups of a batch of texts: flat arrays, and where each text's part of them begins."""

    def __init__(self, own: Pair, column: pa.Array):
        buf, starts = K.flat(column)
        n = len(starts) - 1
        filled = np.diff(starts) > 0
        padded, starts = np.insert(buf, starts[:-1], 32), starts + np.arange(n + 1)
        a, a_first = own.encoder.encode(padded, starts)
        lists = own.model.encode([t or "" for t in column.to_pylist()], num_threads=1)
        b_first = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(b_first[-1]))
        a = a.astype(np.int64)
        size = np.diff(starts)
        good = filled
        for tokens, ids, first in ((own.a, a, a_first), (own.b, b, b_first)):
            laid = np.r_[0, np.cumsum(tokens.length[ids])][first]
            good = good & (np.diff(laid) == size)
        for tokens, ids, first in ((own.a, a, a_first), (own.b, b, b_first)):
            chosen = np.flatnonzero(good)
            other = tokens.lay(ids[np.repeat(good, np.diff(first))]) != padded[np.repeat(good, size)]
            if other.any():
                good = good.copy()
                good[np.repeat(chosen, size[chosen])[other]] = False
        a, b = a[np.repeat(good, np.diff(a_first))], b[np.repeat(good, np.diff(b_first))]
        count = lambda first: np.r_[0, np.cumsum(np.where(good, np.diff(first), 0))]
        self.a, self.b, self.a_first, self.b_first = a, b, count(a_first), count(b_first)
        text_end = np.r_[0, np.cumsum(np.where(good, size, 0))]
        total = int(text_end[-1])
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        a_end, b_end = np.cumsum(own.a.length[a]), np.cumsum(own.b.length[b])
        in_a[a_end] = in_b[b_end] = True
        common = np.flatnonzero(in_a & in_b)
        self.first = np.searchsorted(common, text_end, side="right")  # groups before each text
        self.a_last, self.b_last = np.searchsorted(a_end, common), np.searchsorted(b_end, common)

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """All groups as ``a1,a2|b1;`` one after the other, and the number of characters before each text."""
        a_cut, b_cut = np.r_[0, self.a_last + 1], np.r_[0, self.b_last + 1]
        group = np.arange(len(self.a_last))
        a_at = np.arange(len(self.a)) + b_cut[np.repeat(group, np.diff(a_cut))]
        b_at = np.arange(len(self.b)) + a_cut[np.repeat(group, np.diff(b_cut)) + 1]
        ids = np.zeros(len(self.a) + len(self.b), np.int64)
        ids[a_at], ids[b_at] = self.a, self.b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[a_at[self.a_last]], sign[b_at[self.b_last]] = ord("|"), ord(";")
        digits = np.ones(len(ids), np.int64)
        for k in range(1, 10):
            digits += ids >= 10**k
        end = np.cumsum(digits + 1)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = sign
        rest, left = ids, np.arange(len(ids))
        place = end - 2
        while len(left):
            out[place[left]] = 48 + rest[left] % 10
            rest = rest // 10
            place = place - 1
            left = left[rest[left] > 0]
        return out, np.r_[0, end][self.a_first + self.b_first]


def _arrays(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32)))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Ids of each text in both tokenizers, ``a`` and ``b``, and where groups end: ``a_last`` and ``b_last``, the places of
    the last token of every group within ``a`` and ``b``."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(*paths)
        for whole in batches:
            for batch in K.slices(whole):
                x = Aligned(own, batch.column("text"))
                each = K.owner(x.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _arrays(x.a, x.a_first), _arrays(x.b, x.b_first), _arrays(x.a_last - x.a_first[each], x.first), _arrays(x.b_last - x.b_first[each], x.first)],
                    names=[key, "a", "b", "a_last", "b_last"],
                )

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema[key], *[T.StructField(c, ints) for c in ("a", "b", "a_last", "b_last")]])
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Numbers and digest of each text's groups, and its links: ``same`` holds the A ids of one-to-one links that the
    identity map tells, ``a`` and ``b`` the ids of all others, packed in the narrowest type that holds the vocabulary."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(*paths)
        for whole in batches:
            for batch in K.slices(whole):
                x = Aligned(own, batch.column("text"))
                data, at = x.written()
                a, b = x.a[x.a_last], x.b[x.b_last]
                regular = own.identity[a] == b
                cut = np.r_[0, np.cumsum(regular)][x.first]
                odd = x.first - cut
                packed = lambda values, kind, first: K.binaries([values[p:q].astype(kind).tobytes() for p, q in zip(first[:-1].tolist(), first[1:].tolist())])
                digest = [hashlib.sha256(data[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
                numbers = [pa.array(np.diff(f)) for f in (x.a_first, x.b_first, x.first, x.first)]
                links = [packed(a[regular], own.a.kind, cut), packed(a[~regular], own.a.kind, odd), packed(b[~regular], own.b.kind, odd)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digest), *links], names=schema.names)

    fields = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
    fields += [("same", T.BinaryType()), ("a", T.BinaryType()), ("b", T.BinaryType())]
    schema = T.StructType([docs.schema[key], *[T.StructField(*f) for f in fields]])
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _joined(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and the number of ids before each row."""
    data, at = K.flat(column.cast(pa.large_binary()))
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), at // np.dtype(kind).itemsize


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of ``n`` for each distinct pair."""
    found, back = np.unique(a * width + b, return_inverse=True)
    return found // width, found % width, np.bincount(back, n, len(found)).astype(np.int64)


def pair_counts(links: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """``a``, ``b`` and ``n``: how many links of the whole corpus hold each pair of ids."""
    paths = paths or default_paths()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(*paths)
        vector, width = np.zeros(len(own.a.token), np.int64), len(own.b.token)
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            vector += np.bincount(_joined(batch.column("same"), own.a.kind)[0], minlength=len(vector))
            a, b = _joined(batch.column("a"), own.a.kind)[0], _joined(batch.column("b"), own.b.kind)[0]
            held = _added(np.r_[held[0], a], np.r_[held[1], b], np.r_[held[2], np.ones(len(a), np.int64)], width)
        none = lambda k, kind: pa.nulls(k, kind)
        parts = np.array_split(vector, VECTOR_PARTS)
        if vector.any():
            head = [pa.array(range(VECTOR_PARTS), pa.int32()), K.binaries([p.tobytes() for p in parts])]
            yield pa.RecordBatch.from_arrays([*head, *[none(VECTOR_PARTS, pa.int64())] * 3], names=names)
        for k in range(0, len(held[0]), 100_000):
            cut = [pa.array(c[k : k + 100_000]) for c in held]
            yield pa.RecordBatch.from_arrays([none(len(cut[0]), pa.int32()), none(len(cut[0]), pa.binary()), *cut], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = pair(*paths), {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("vector").to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(data, np.int64)
        first = np.r_[0, np.cumsum([len(p) for p in np.array_split(own.identity, VECTOR_PARTS)])]
        for part, vector in total.items():
            at = np.flatnonzero(vector)
            a = at + first[part]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(own.identity[a]), pa.array(vector[at])], names=["a", "b", "n"])

    names = ["part", "vector", "a", "b", "n"]
    made = links.select("same", "a", "b").mapInArrow(count, "part int, vector binary, a long, b long, n long")
    partial = materialize(made, "links")
    regular = partial.where("vector is not null").select("part", "vector").repartition(VECTOR_PARTS, "part").mapInArrow(add, "a long, b long, n long")
    irregular = partial.where("vector is null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return regular.unionByName(irregular)


def scores(links: DataFrame, counts: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Add ``n_best``, the links whose count is the highest of their B id, and ``count_sum``, the sum of counts over links.

    ``counts`` has at most ``Pair.most_pairs`` rows, a number that the vocabularies set; it goes to every task.
    """
    paths = paths or default_paths()
    own = pair(*paths)
    table = counts.select("a", "b", "n").toArrow()
    if table.num_rows > own.most_pairs():
        raise ValueError("more pairs than the vocabularies allow")
    a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
    best = np.zeros(len(own.b.token), np.int64)
    np.maximum.at(best, b, n)
    width = len(own.b.token)
    regular = own.identity[a] == b
    vector = np.zeros(len(own.a.token), np.int64)
    vector[a[regular]] = n[regular]
    keys = a[~regular] * width + b[~regular]
    order = np.argsort(keys)
    shared = links.sparkSession.sparkContext.broadcast((vector, best, keys[order], n[~regular][order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(*paths)
        vector, best, keys, n = shared.value
        top = np.where(own.identity >= 0, best[own.identity], -1)
        for batch in batches:
            same, first = _joined(batch.column("same"), own.a.kind)
            a, cut = _joined(batch.column("a"), own.a.kind)
            b, _ = _joined(batch.column("b"), own.b.kind)
            own_n = vector[same]
            odd_n = n[np.searchsorted(keys, a * width + b)] if len(a) else a
            total = lambda x, y: np.diff(np.r_[0, np.cumsum(x)][first]) + np.diff(np.r_[0, np.cumsum(y)][cut])
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total(own_n == top[same], odd_n == best[b])), pa.array(total(own_n, odd_n))], names=[*names, "n_best", "count_sum"])

    names = [c for c in links.columns if c not in ("same", "a", "b", "n_best", "count_sum")]
    schema = T.StructType([links.schema[c] for c in names] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return links.mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Per text: numbers of tokens, groups and links, the digest of its groups, and the counts of its links."""
    stored = materialize(encoded(docs, key, text, paths), "aligned")
    return scores(stored, pair_counts(stored, paths), paths)
