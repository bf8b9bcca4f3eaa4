"""Spelling variants: words one edit away from a more frequent word, found with FM-index search schemes.

**Words.** A task takes some megabytes of whole texts, finds the runs of letters, and counts the distinct ones of each
text once; one row per distinct word and slice goes to the sum over all texts.

**Search.** Of two words that differ by one inserted, deleted or replaced code point, one half of the first is found
unchanged in the second: its first half at the begin, or its second half at the end. There are two searches: match the
first half exactly and extend to the right over the second allowing one error, and match the second half exactly and
extend to the left over the first. Both halves end at a word's delimiter, so a search never turns: the first runs on the
FM-index of the vocabulary read backwards, the second on that read forwards, the two halves of a bidirectional index.
A state is an interval of suffix ranks; to put a letter in front costs one rank query for each of its ends. All states
of all words of a shard advance together, one letter a step.

**Shards.** A word can only be found where it shares the exact half, so words are dealt out by (side, half): as a text
under the halves that a word of one code point less, as many, or one more would look for, and as a query under its
own. A half that more than ``SHARD_WORDS`` texts share is cut into chunks: texts and queries are each dealt out by a hash,
and every chunk of texts meets every chunk of queries, so no shard grows with the input. A match counts if both rows come
from one half, and from the right if the left did not find it already; so partial counts add up without the pairs ever
being shuffled.

**Roots.** Forms grow at least twofold in number along a chain, so pointers are doubled a few times, on words that have
a form only.

Null ids count as empty text, null and empty texts have no words, repeated rows count each. A text or word may have any
length. Of near words of equal number the smallest in code-point order is the form. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.llm import kernels as K
from brickwork.session import broadcast_if_small, materialize

#: Words of fewer code points, or fewer occurrences, are left out.
MIN_POINTS, MIN_OCCURRENCES = 5, 3
#: One in so many (text, run) pairs loses a code point.
DROP_ONE_IN = 97
#: Texts, and queries, that a shard is laid out for.
SHARD_WORDS = 1 << 15
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LEAD = 0xC3  # of the two bytes of U+00C0 .. U+00FF


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For 0 .. 64 zero bytes behind it: what each byte value, at each of the four places of a CRC, becomes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the byte-wise CRC table
    out = np.zeros((65, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(64):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of two strings one after the other, from the CRC of each and the second's size in bytes."""
    table, crc, left = _shifts(), first.astype(np.uint32), size.astype(np.int64).copy()
    while True:
        now = np.minimum(left, 64)
        crc = table[now, 0, crc & 255] ^ table[now, 1, crc >> 8 & 255] ^ table[now, 2, crc >> 16 & 255] ^ table[now, 3, crc >> 24]
        left -= now
        if not left.any():
            return crc ^ second.astype(np.uint32)


def runs(buf: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Every run of letters, A-Z lower-cased, as binary, and the text it is in."""
    inside = _LETTER[buf] | (buf == _LEAD)
    inside[1:] |= buf[:-1] == _LEAD
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[starts] = edge[n] = True
    edge[1:n] |= ~inside[:-1] | ~inside[1:]
    begin, end = np.flatnonzero(inside & edge[:n]), np.flatnonzero(inside & edge[1:]) + 1
    offsets = np.r_[0, np.cumsum(end - begin)]
    kept = _LOWER[buf[inside]]
    found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
    return found, np.searchsorted(starts, begin, side="right") - 1


def slice_counts(ids: list, column: pa.Array, least: int = MIN_POINTS, one_in: int = DROP_ONE_IN) -> dict[str, int]:
    """Words of at least ``least`` code points in a batch of texts, and how often each occurs."""
    buf, starts = K.flat(column)
    if len(buf) == 0:
        return {}
    found, text = runs(buf, starts)
    if len(found) == 0:
        return {}
    coded = found.dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    size, crc = np.array([len(w) for w in words]), np.array([zlib.crc32(w) for w in words], np.uint32)
    both, times = np.unique(text.astype(np.int64) * len(words) + code, return_counts=True)
    text, code = both // len(words), both % len(words)
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = joined_crc(prefix[text], crc[code], size[code])
    altered = h % one_in == 0
    total = np.bincount(code[~altered], times[~altered], len(words)).astype(np.int64)
    out = {w: t for w, t in zip((x.decode() for x in words), total.tolist()) if t and len(w) >= least}
    for k in np.flatnonzero(altered):
        word = words[code[k]].decode()
        at = int(h[k]) % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] = out.get(word, 0) + int(times[k])
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_POINTS, occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """``word`` and ``n``, the number of its occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                found = slice_counts(batch.column("id").to_pylist(), batch.column("text"), least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Index:
    """FM-index of words, read backwards, each behind a delimiter: rank queries on the sorted (letter, rank) pairs.

    Delimiters are told apart by the number of their word and sort ahead of all letters, so that comparisons end there.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray):
        """``data`` holds the letters of all words in the order in which a search reads them."""
        end = np.cumsum(size)
        self.words, n = len(size), len(data) + len(size)
        at = np.repeat(2 * end - size + np.arange(self.words), size) - 1 - np.arange(len(data))  # each word turned round
        owner = np.repeat(np.arange(self.words), size)
        text, word = np.zeros(n, np.int64), np.zeros(n, np.int64)
        text[at], word[at] = data.astype(np.int64) + 1, owner
        stop = end + np.arange(self.words)
        word[stop] = np.arange(self.words)
        rank = np.where(text > 0, text + self.words, word)
        _, rank = np.unique(rank, return_inverse=True)
        length = 1
        while length < n and rank.max() < n - 1:
            later = np.zeros(n, np.int64)
            later[:-length] = rank[length:] + 1
            _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
            length *= 2
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.n, self.before, self.word = n, text[suffix - 1], word[suffix]
        self.keys = np.sort(self.before * n + np.arange(n))
        self.letters = np.unique(data).astype(np.int64) + 1

    def put(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with a letter and then as those of the given intervals."""
        return np.searchsorted(self.keys, letter * self.n + low), np.searchsorted(self.keys, letter * self.n + high)

    def every_letter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (interval, letter) pairs for which the letter stands in front of some suffix of the interval."""
        width = high - low
        wide = np.flatnonzero(width > len(self.letters))
        some = np.flatnonzero(width <= len(self.letters))
        state, letter = np.repeat(some, width[some]), self.before[K.ranges(low[some], width[some])]
        both = np.unique(state[letter > 0] * 512 + letter[letter > 0])
        state = np.r_[both // 512, np.repeat(wide, len(self.letters))]
        return state, np.r_[both % 512, np.tile(self.letters, len(wide))]


def search(index: Index, data: np.ndarray, first: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all words that begin with the ``exact`` first letters of a query and differ from it by one edit."""
    data = data.astype(np.int64) + 1
    who = np.arange(len(size))
    low, high = np.zeros(len(who), np.int64), np.full(len(who), index.words, np.int64)
    for step in range(int(exact.max(initial=0))):
        own = np.flatnonzero((exact > step) & (high > low))
        low[own], high[own] = index.put(data[first[own] + step], low[own], high[own])
    clean = tuple(x[high > low] for x in (who, exact, low, high))  # no error yet
    late = tuple(np.zeros(0, np.int64) for _ in range(4))  # one error made
    found: list[np.ndarray] = []
    while len(clean[0]) or len(late[0]):
        who, at, low, high = late
        done = at == size[who]
        rows = np.repeat(who[done], (high - low)[done])
        rank = K.ranges(low[done], (high - low)[done])
        whole = index.before[rank] == 0  # the word ends here
        found.append(np.c_[rows[whole], index.word[rank[whole]]])
        who, at, low, high = (x[~done] for x in late)
        low, high = index.put(data[first[who] + at], low, high)
        alive = high > low
        parts = [(who[alive], at[alive] + 1, low[alive], high[alive])]
        # The letter that the query has here, and words lack
        who, at, low, high = clean
        inside = at < size[who]
        parts.append((who[inside], at[inside] + 1, low[inside], high[inside]))
        # A letter that words have: as in the query, in place of the query's, or ahead of it
        state, letter = index.every_letter(low, high)
        who, at = who[state], at[state]
        low, high = index.put(letter, low[state], high[state])
        alive = high > low
        who, at, low, high, letter = who[alive], at[alive], low[alive], high[alive], letter[alive]
        parts.append((who, at, low, high))
        inside = at < size[who]
        own = np.zeros(len(who), np.int64)
        own[inside] = data[first[who[inside]] + at[inside]]
        same, other = inside & (letter == own), inside & (letter != own)
        parts.append((who[other], at[other] + 1, low[other], high[other]))
        clean = (who[same], at[same] + 1, low[same], high[same])
        late = tuple(np.concatenate(x) for x in zip(*parts))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, one after the other (all are below 256), and where each begins and its length."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.cumsum(size) - size, size


def near_in_shard(rows: pa.Table) -> pa.Table:
    """Near words of each query of a shard: their number, the largest of their numbers, and the smallest such word."""
    asks = rows.column("asks").to_numpy()
    texts, queries = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
    words, asked_words = (t.column("word").to_pylist() for t in (texts, queries))
    if not words or not asked_words:
        return NEAR.empty_table()
    right = bool(rows.column("side")[0].as_py())
    turn = (lambda w: w[::-1]) if right else (lambda w: w)
    data, _, size = _letters([turn(w) for w in words])
    asked, first, length = _letters([turn(w) for w in asked_words])
    half = queries.column("size").to_numpy().astype(np.int64)
    who, word = search(Index(data, size), asked, first, length, half)
    group = pa.concat_tables([queries, texts]).column("half").combine_chunks().dictionary_encode().indices.to_numpy()
    own = group[: len(half)][who] == group[len(half) :][word]
    who, word = who[own], word[own]
    if right:  # what begins with the query's first half has been found from the left
        rest, last = length[who] - half[who], np.cumsum(size)[word] - 1
        other = rest > size[word]
        for k in range(int(rest.max(initial=0))):
            on = np.flatnonzero((k < rest) & ~other)
            other[on] = asked[first[who[on]] + length[who[on]] - 1 - k] != data[last[on] - k]
        who, word = who[other], word[other]
    n = texts.column("n").to_numpy()
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((place[word], -n[word], who))
    who, word = who[by], word[by]
    asker, at, count = np.unique(who, return_index=True, return_counts=True)
    best = word[at]
    columns = [[asked_words[k] for k in asker.tolist()], count, n[best], [words[k] for k in best.tolist()]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, NEAR)], schema=NEAR)


def dealt(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words as texts and as queries, with the shard of each."""
    size, word = F.char_length("word"), F.col("word")
    part = lambda side, n, asks: F.struct(F.lit(side).alias("side"), n.cast("int").alias("size"), F.lit(asks).alias("asks"))
    halves = lambda side: [part(side, F.floor((size + (side + d)) / 2), False) for d in (-1, 0, 1)]
    asked = [part(0, F.floor(size / 2), True), part(1, size - F.floor(size / 2), True)]
    every = words.withColumn("part", F.explode(F.array_distinct(F.array(*halves(0), *halves(1), *asked)))).select("word", "n", "part.*")
    every = every.withColumn("half", F.when(F.col("side") == 0, F.substring(word, F.lit(1), F.col("size"))).otherwise(F.substring(word, size - F.col("size") + 1, F.col("size"))))
    texts = materialize(every.where(~F.col("asks")).groupBy("side", "half").agg(F.count("*").alias("texts")), "halves")
    shards = max(1, -(-int(texts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]) // (2 * shard_words)))
    hot = texts.where(F.col("texts") > shard_words).select("side", "half", F.ceil(F.col("texts") / shard_words).cast("int").alias("chunks"))
    every = every.join(broadcast_if_small(hot), ["side", "half"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    text_chunk, query_chunk = F.when(F.col("asks"), F.col("other")).otherwise(own), F.when(F.col("asks"), own).otherwise(F.col("other"))
    shard = F.pmod(F.xxhash64("side", "half", text_chunk, query_chunk), F.lit(shards)) * 2 + F.col("side")
    # Two chunks of one half may share a shard, where a text of one must not answer a query of the other.
    group = F.concat_ws(",", F.col("half"), text_chunk.cast("string"), query_chunk.cast("string"))
    return every.select(shard.alias("shard"), "side", "size", "asks", group.alias("half"), "word", "n")


def near(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word``, ``n_near``, and the near word of largest number, ``best``, with its number ``best_n``; of words that have any."""
    found = dealt(words, shard_words).groupBy("shard").applyInArrow(near_in_shard, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: the end of each chain."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = links.join(after, "root", "left")
        links = materialize(moved.select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")), "roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def group(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Form, root and near words of each word of a table of ``word`` and ``n``."""
    words = materialize(words.select("word", "n"), "words")
    form = F.when(F.col("best_n") >= 2 * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    found = words.join(near(words, shard_words), "word", "left").withColumn("f", form)
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")), "forms")
    roots = rooted(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
