"""Line dedup by an exact set-similarity join.

A line's set holds its runs of ``GRAM`` words (the whole line, if it has fewer). A line is removed if its set has a Jaccard
similarity of ``THRESHOLD`` or more with the set of an earlier line, by document id, then line number. The join:

* Tokens are ordered by rarity: those that are frequent (counted over all lines) come last, by frequency, the others by hash.
* Prefix filter: similar sets share one of their first ``n - ceil(t n) + 1`` tokens. Tokens that are in one prefix only
  are dropped before any line travels.
* Lines with one set form a class; its first line stands for it, the others are removed. Sets are told apart by 128 bits;
  lines of one token by that token and a print of its words.
* Classes that share a prefix token are compared in blocks; tokens with the same classes are one group. Two classes are
  compared in one group only, that of the least token which both prefixes hold. In a block, length and positional filters go
  ahead of the verification on the full sets of 64-bit tokens; where one token decides, on the words.

Null and empty texts and lines of white space are never removed. Ids are whole numbers, a null id comes last. Of repeated
rows, which nothing tells apart, each counts as the same lines: they keep or lose them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.llm import anchors as A
from brickwork.llm import blocks as B
from brickwork.llm import kernels as K
from brickwork.llm.native import unused
from brickwork.session import materialize

GRAM, THRESHOLD = 5, 0.8
#: Length of the list of frequent tokens that fixes their order, and how often a slice must hold a token to count it.
FREQUENT, OFTEN = 65_536, 8
_LAST = np.iinfo(np.int64).max
#: A line's number within a slice is packed with the upper bits of its tokens for sorting, if it fits in the others.
_BITS = np.uint64(42)
_LINES = 1 << 22
#: Rows, and tokens of pairs, worked on at a time.
_ROWS, _TOKENS = 4096, 1_000_000
#: Tokens are told apart roughly by so many of their upper bits.
_BUCKET_BITS = 20
_BUCKET = np.uint64(64 - _BUCKET_BITS)
_S32, _ODD = np.uint64(32), np.uint64(0x9E3779B97F4A7C15)

Order = tuple[np.ndarray, np.ndarray]


def line_offsets(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines of a slice (and the end), and text and number within the text of each."""
    at = np.unique(np.r_[starts, np.flatnonzero(buf == 10) + 1, len(buf)])
    text = np.searchsorted(starts, at[:-1], side="right") - 1
    return at, text, np.arange(len(at) - 1) - np.searchsorted(at, starts[text])


def grams(buf: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words of each line, in no order, and the line of each; shorter lines have one run, of all their words."""
    begin, end, before = K.words(buf, at)
    h, line = K.hash_words(buf, begin, end), K.owner(before)
    n = max(len(h) - gram + 1, 0)
    run = h[:n].copy()
    for k in range(1, gram):
        run ^= run >> _S32
        run *= _ODD
        run += h[k : k + n]
    inside = line[:n] == line[gram - 1 :]
    count = np.diff(before)
    short = np.flatnonzero((count > 0) & (count < gram))
    total = np.zeros(len(short), np.uint64)
    for k in range(gram - 1):
        has = count[short] > k
        total[has] = K.mix(total[has] * np.uint64(31) + h[before[short[has]] + k])
    return np.r_[K.mix(run[inside]), total], np.r_[line[:n][inside], short]


def token_sets(buf: np.ndarray, at: np.ndarray, gram: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens (64 bits of hash) of each line, by line, then frequent ones last by rank, then token; and their line."""
    s, line = grams(buf, at, gram)
    if len(s) == 0:
        return s, line
    late, place = frequent(s, order)
    if len(at) > _LINES:
        rank = np.zeros(len(s), np.int64)
        rank[late] = place + 1
        by = np.lexsort((s, rank, line))
        s, line = s[by], line[by]
    else:
        key = line.astype(np.uint64) << _BITS | s >> np.uint64(23)
        key[late] = line[late].astype(np.uint64) << _BITS | np.uint64(1 << 41) | place.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key, s = key[by], s[by]
        # Different tokens that agree in their upper bits are put in order as well.
        same = np.flatnonzero((key[1:] == key[:-1]) & (s[1:] != s[:-1]))
        if len(same):
            tied = np.flatnonzero(np.isin(key, key[same]))
            s[tied] = s[tied][np.lexsort((s[tied], key[tied]))]
        line = (key >> _BITS).astype(np.int64)
    new = np.r_[True, (s[1:] != s[:-1]) | (line[1:] != line[:-1])]
    return s[new], line[new]


def frequent(token: np.ndarray, order: Order | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the frequent tokens are, and their ranks."""
    if order is None or len(order[0]) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, rank = order
    seen = np.zeros(1 << _BUCKET_BITS, bool)
    seen[known >> _BUCKET] = True
    at = np.flatnonzero(seen[token >> _BUCKET])
    k = np.minimum(np.searchsorted(known, token[at]), len(known) - 1)
    found = known[k] == token[at]
    return at[found], rank[k[found]]


def text_pieces(buf: np.ndarray, at: np.ndarray) -> pa.Array:
    """The lines of a slice as an Arrow column."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))


def first_run(line: bytes, gram: int) -> list[bytes]:
    """The words of the first run: of a line with one token, all that its set holds."""
    return line.split(None, gram)[:gram]


def word_print(line: bytes, gram: int) -> int:
    """64 bits of the first run's words, whatever separates them; independent of the tokens."""
    return int.from_bytes(hashlib.blake2b(b" ".join(first_run(line, gram)), digest_size=8).digest(), "little", signed=True)


def prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens the prefixes of sets of these sizes hold."""
    return np.where(size > 0, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)


def token_order(docs: DataFrame, gram: int) -> Order:
    """Frequent tokens and their ranks by frequency: a list of bounded length, for the driver and all tasks.

    Every slice of some megabytes reports the tokens that it holds often. The order decides on work, never on results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                buf, starts = K.flat(batch.column("text"))
                token, line = grams(buf, line_offsets(buf, starts)[0], gram)
                bucket = (token >> _BUCKET).astype(np.int64)
                often = (np.bincount(bucket, minlength=1 << _BUCKET_BITS) >= OFTEN)[bucket]  # can be held often
                token, line = token[often], line[often]
                by = np.lexsort((line, token))
                token, line = token[by], line[by]
                once = np.r_[True, (token[1:] != token[:-1]) | (line[1:] != line[:-1])][: len(token)]
                v, n = np.unique(token[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[n >= OFTEN].astype(np.int64)), pa.array(n[n >= OFTEN])], names=["v", "n"])

    counts = docs.select("text").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "v").limit(FREQUENT).collect()
    v, n = np.array([r["v"] for r in top], np.int64).astype(np.uint64), np.array([r["n"] for r in top], np.int64)
    place = np.empty(len(v), np.int64)
    place[np.lexsort((v, n))] = np.arange(len(v))
    by_value = np.argsort(v)
    return v[by_value], place[by_value]


def candidates(docs: DataFrame, gram: int, threshold: float, order: Order) -> DataFrame:
    """Lines with a prefix token that occurs again: rid, id, line, key ``c``, two hashes of the set, text, such tokens."""

    def sets(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Offsets, texts and numbers of lines; tokens; of the lines that have any: line, first token, how many; tokens of prefixes, and whose."""
        at, text, number = line_offsets(buf, starts)
        token, line = token_sets(buf, at, gram, order)
        begin, border = A.split_at(line)
        size = np.diff(border)
        head = prefix(size, threshold)
        return at, text, number, token, line[begin], begin, size, K.ranges(begin, head), np.repeat(np.arange(len(begin)), head)

    def find(buf: np.ndarray, starts: np.ndarray) -> A.Found:
        _, text, _, token, line, _, _, first, whose = sets(buf, starts)
        return token[first], text[line[whose]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.cut(whole):
                buf, starts = K.flat(batch.column("text"))
                at, text, number, token, line, begin, size, first, whose = sets(buf, starts)
                live = A.surviving(token, first, text[line[whose]], batch.column("v"))
                first, whose = first[live], whose[live]
                if len(first) == 0:
                    continue
                edge, border = A.split_at(whose)
                whose = whose[edge]
                own, size = line[whose], size[whose]
                every = token[K.ranges(begin[whose], size)]
                total = lambda h: np.add.reduceat(h, np.cumsum(size) - size).astype(np.int64)
                rid = batch.column("rid").to_numpy(zero_copy_only=False)[text[own]]
                c = K.mix(rid.astype(np.uint64) ^ K.mix(number[own].astype(np.uint64))).astype(np.int64)
                held = text_pieces(buf, at).take(pa.array(own)).cast(pa.string())
                q = total(K.mix(every ^ np.uint64(0x5BD1E995)))
                for k in np.flatnonzero(size == 1):  # both sums would hold no more than the one token
                    q[k] = word_print(held[k].as_buffer().to_pybytes(), gram)
                columns = [
                    pa.array(rid), pa.array(batch.column("id").to_numpy(zero_copy_only=False)[text[own]]), pa.array(number[own], pa.int32()), pa.array(c),
                    pa.array(total(K.mix(every))), pa.array(q), held,
                    pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(token[first].astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "line", "c", "p", "q", "words", "tokens"])

    again = A.collected(A.repeated(docs, find, across=False), "v")
    return docs.join(again, "rid").select("rid", "id", "text", "v").mapInArrow(run, "rid long, id long, line int, c long, p long, q long, words string, tokens array<long>")


def _common(number: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of pairs of rows (from, to) with the numbers that both rows of a pair hold: the pair within the run, and the number."""
    before = np.r_[0, np.cumsum(size[x] + size[y])]
    at = 0
    while at < len(x):
        end = max(int(np.searchsorted(before, before[at] + _TOKENS, side="right")) - 1, at + 1)
        a, b = x[at:end], y[at:end]
        pair = np.r_[np.repeat(np.arange(len(a)), size[a]), np.repeat(np.arange(len(a)), size[b])]
        both = number[np.r_[K.ranges(start[a], size[a]), K.ranges(start[b], size[b])]]
        key = np.sort(pair.astype(np.uint64) << _BITS | both)
        twice = key[1:][key[1:] == key[:-1]]
        yield at, end, (twice >> _BITS).astype(np.int64), twice & ((np.uint64(1) << _BITS) - np.uint64(1))
        at = end


def _candidate_pairs(rows: pa.Table, group: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group, the earlier one first, that meet in this place and pass the length filter."""
    spot = rows.column("c").to_numpy()  # equal for repeated rows: one of them stands for all, as their results are the same
    by = np.lexsort((spot, group))
    one = np.sort(by[np.r_[True, (spot[by[1:]] != spot[by[:-1]]) | (group[by[1:]] != group[by[:-1]])]])
    by = one[np.argsort(group[one], kind="stable")]
    _, border = A.split_at(group[by])
    after = np.repeat(border[1:], np.diff(border)) - np.arange(len(by)) - 1
    x, y = by[np.repeat(np.arange(len(by)), after)], by[K.ranges(np.arange(len(by)) + 1, after)]
    own, across = rows.column("own").to_numpy(), rows.column("i").to_numpy() != rows.column("j").to_numpy()
    good = ~across[x] | (own[x] != own[y])
    good &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
    return x[good], y[good]


def _similar(rows: pa.Table, group: np.ndarray, gram: int, threshold: float, order: Order, least: np.ndarray | None = None) -> np.ndarray:
    """Rows that are similar to an earlier one of their group, of repeated rows one; ``rows`` are ordered by id, rid and line.

    ``least`` has each group's token: a pair is left to the group of the least token that both prefixes hold, where it meets too.
    """
    buf, at = K.flat(rows.column("words").combine_chunks())
    token, row = token_sets(buf, at, gram, order)
    n = np.bincount(row, minlength=rows.num_rows)
    start = np.cumsum(n) - n
    x, y = _candidate_pairs(rows, group, n, threshold)
    need = np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-9)
    head = prefix(n, threshold)
    value, number = np.unique(token[K.ranges(start, head)].view(np.int64), return_inverse=True)
    first = None if least is None else np.searchsorted(value, least)
    shared, here = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for a, b, pair, held in _common(number.astype(np.uint64), np.cumsum(head) - head, head, x, y):
        shared[a:b] = np.bincount(pair, minlength=b - a)
        if first is not None:
            here[a + pair[held < first[group[x[a + pair]]]]] = False
    # Positional filter, at the end of the prefix that ends first: what both hold up to there is in both prefixes.
    here &= shared + np.maximum(n[x] - head[x], n[y] - head[y]) >= need
    x, y, need, shared = x[here], y[here], need[here], shared[here]
    hit, raw = np.zeros(rows.num_rows, bool), buf.tobytes()
    used = np.unique(np.r_[x, y])
    number = np.zeros(len(token), np.uint64)
    at_used = K.ranges(start[used], n[used])
    number[at_used] = np.unique(token[at_used], return_inverse=True)[1]
    by = np.lexsort((-shared, y))
    x, y, need = x[by], y[by], need[by]
    best = np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)
    for turn in (best, ~best):  # the most promising pair of each row first; the others, if that is none
        todo = np.flatnonzero(turn & ~hit[y])
        i, j = x[todo], y[todo]
        for a, b, pair, _ in _common(number, start, n, i, j):
            good = np.bincount(pair, minlength=b - a) >= need[todo[a:b]]
            for m in a + np.flatnonzero(good & (n[i[a:b]] == 1) & (n[j[a:b]] == 1)):
                good[m - a] = first_run(raw[at[i[m]] : at[i[m] + 1]], gram) == first_run(raw[at[j[m]] : at[j[m] + 1]], gram)
            hit[j[a:b][good]] = True
    return np.flatnonzero(hit)


def matches(pairs: DataFrame, gram: int, threshold: float, order: Order) -> DataFrame:
    """``rid`` and ``line`` of the lines that an earlier one is similar to, from rows of blocks."""
    keys = ["g", "i", "j"]

    def work(held: list[pa.Table]) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(held)), [t.num_rows for t in held])
        least = np.array([t.column("g")[0].as_py() for t in held])
        rows = pa.concat_tables(held)
        by = np.lexsort([rows.column(c).to_numpy() for c in ("line", "rid", "id")])
        rows, group = rows.take(pa.array(by)), group[by]
        hit = pa.array(_similar(rows, group, gram, threshold, order, least))
        return pa.RecordBatch.from_arrays([rows.column(c).take(hit).combine_chunks() for c in ("rid", "line")], names=["rid", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for group in B.by_group(batches, keys):
            held.append(group)
            rows += group.num_rows
            if rows >= _ROWS:
                yield work(held)
                held, rows = [], 0
        if held:
            yield work(held)

    return B.together(pairs, *keys).mapInArrow(run, "rid long, line int")


def removed(own: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``rid`` and ``line`` (from 0) of all lines to remove; ``own`` has rid, id and text."""
    own = own.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)))
    order = token_order(own, gram)
    found = materialize(candidates(own, gram, threshold, order), "lines")
    place = F.struct("id", "rid", "line")
    classes = found.groupBy("p", "q").agg(F.min(place).alias("m"), F.count("*").alias("n"))
    doubled = classes.where(F.col("n") > 1).select("p", "q", "m")
    copies = materialize(found.join(doubled, ["p", "q"]).where(place != F.col("m")).select("rid", "line", "c").distinct(), "copies")
    single = found.select("c", "id", "rid", "line", "words", "tokens").join(copies.select("c"), "c", "left_anti")
    tokens = single.select("c", F.explode("tokens").alias("t")).distinct()
    lists = tokens.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s")).where(F.col("n") > 1)
    group = lists.groupBy("n", "s").agg(F.min("t").alias("t")).select("t", "n")
    member = tokens.join(group, "t").select(F.col("t").alias("g"), "c", "n")
    pairs = B.block_pairs(member, "g", "c", "n")
    texts = single.select("c", "id", "rid", "line", "words")
    near = matches(pairs.join(texts, "c").select("g", "i", "j", "own", "c", "id", "rid", "line", "words"), gram, threshold, order)
    return copies.select("rid", "line").unionByName(near).distinct()


def _lists(own: DataFrame, gram: int, threshold: float) -> DataFrame:
    return removed(own, gram, threshold).groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Key, ``n_lines``, ``n_removed`` and ``removed``, the numbers of the removed lines (from 0), of every document."""
    own = A.keyed(docs, key, text)
    rows = own.select("rid", F.col("id").alias(key), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = rows.join(_lists(own, gram, threshold), "rid", "left")
    none = F.array().cast("array<int>")
    return out.select(key, "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without their removed lines, other columns as they are. Documents that lose all lines keep an empty text."""
    value, rid, gone = F.coalesce(F.col(text).cast("string"), F.lit("")), unused(docs, "_rid"), unused(docs, "_removed")
    lists = _lists(A.keyed(docs, key, text), gram, threshold).withColumnsRenamed({"rid": rid, "removed": gone})
    rows = docs.withColumn(rid, F.xxhash64(F.col(key), value)).join(lists, rid, "left")
    kept = F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s, i: F.when(~F.array_contains(gone, i), s)), lambda s: s.isNotNull()), "\n")
    return rows.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
