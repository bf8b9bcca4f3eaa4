"""N-gram Jaccard join: MinHash banding, verified on the full sets.

A document's set holds its runs of ``GRAM`` words (the whole text, if it has fewer words). Documents with equal text
form a class; classes are joined. ``bands_for`` picks bands and rows for the wanted recall at the threshold. Classes
that share a band are chained to the least class of the band; each chained component is compared in blocks, every
two classes on their full sets. So no bucket is expanded into pairs, and a class of thousands of copies counts as one.

Null and empty texts, and texts of white space, have no set: they link to nothing, and only equal ones share a
class. Ids are whole numbers; a null id comes last. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import anchors as A
from brickwork.llm import blocks as B
from brickwork.llm import kernels as K
from brickwork.llm.components import components
from brickwork.llm.native import unused
from brickwork.session import materialize

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.995
_LAST = np.iinfo(np.int64).max


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """Bands and rows: the fewest bands of ``rows`` hashes that find a pair at the threshold with the wanted recall."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


def grams(buf: np.ndarray, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words of each text, and the text of each; shorter texts have one run, of all their words."""
    begin, end, before = K.words(buf, starts)
    h, doc = K.hash_words(buf, begin, end), K.owner(before)
    if len(h) == 0:
        return h, doc
    run = K.runs_hash(h, gram)
    inside = doc[: len(run)] == doc[gram - 1 : gram - 1 + len(run)]
    count = np.diff(before)
    short = np.flatnonzero((count > 0) & (count < gram))
    total = np.zeros(len(short), np.uint64)
    for k in range(gram - 1):
        has = count[short] > k
        total[has] = K.mix(total[has] * np.uint64(31) + h[before[short[has]] + k])
    s, d = np.r_[run[inside], total], np.r_[doc[: len(run)][inside], short]
    order = np.argsort(d, kind="stable")
    return s[order], d[order]


def signatures(docs: DataFrame, bands: int, rows: int, gram: int = GRAM) -> DataFrame:
    """Keys of each row (rid, id, p, q) and one hash per band; no bands for texts without words."""
    rng = np.random.default_rng(20)
    times = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                s, d = grams(*K.flat(batch.column("text")), gram)
                has, first = np.unique(d, return_index=True)
                out = np.zeros((bands, len(has)), np.uint64)
                for k in range(bands * rows if len(has) else 0):
                    least = np.minimum.reduceat(s * times[k] + plus[k], first)
                    out[k // rows] = K.mix(out[k // rows] * np.uint64(31) + (least ^ np.uint64(k)))
                size = np.zeros(batch.num_rows + 1, np.int32)
                size[has + 1] = bands
                values = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(out.T.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "id", "p", "q")], values], names=["rid", "id", "p", "q", "bands"])

    return docs.mapInArrow(run, "rid long, id long, p long, q long, bands array<long>")


def compare(texts: pa.Array, own: np.ndarray, gram: int, threshold: float) -> np.ndarray:
    """Matrix of linked texts: of one block among each other, or of two blocks across."""
    s, d = grams(*K.flat(texts), gram)
    n = len(own)
    order = np.lexsort((d, s))
    s, d = s[order], d[order]
    keep = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.zeros(0, bool)
    s, d = s[keep], d[keep]
    size = np.bincount(d, minlength=n).astype(np.float64)
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    name = np.cumsum(new) - 1
    shared = np.bincount(name)[name] > 1 if len(s) else np.zeros(0, bool)
    _, column = np.unique(name[shared], return_inverse=True)
    row, both = d[shared], np.zeros((n, n))
    width = 4096
    cut = np.searchsorted(column, np.arange(0, (column.max() + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - k * width] = 1
        both += part @ part.T
    union = size[:, None] + size[None] - both
    linked = (both >= threshold * union - 1e-9) & (both > 0)
    if own.min() != own.max():
        linked &= own[:, None] != own[None]
    np.fill_diagonal(linked, False)
    return linked


def _reached(linked: np.ndarray) -> np.ndarray:
    """Least number that each node is connected to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def verified(candidates: DataFrame, gram: int, threshold: float) -> DataFrame:
    """``c``, ``links`` and ``low`` from rows of blocks (g, i, j, own, c, text): number of links, least class reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.by_group(batches, ["g", "i", "j"]):
            if rows.num_rows < 2:
                continue
            rows = rows.sort_by("c")
            linked = compare(rows.column("text").combine_chunks(), rows.column("own").to_numpy(), gram, threshold)
            hit = np.flatnonzero(linked.any(1))
            if len(hit):
                c, low = rows.column("c").to_numpy(), _reached(linked)
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(linked[hit].sum(1).astype(np.int64)), pa.array(c[low[hit]])], names=["c", "links", "low"])

    return B.together(candidates, "g", "i", "j").mapInArrow(run, "c long, links long, low long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: ``rid``, key, ``class_id`` (least id of the equal texts), ``n_copies``, ``n_links`` (classes linked to), ``group_id``.

    A group is what links connect; its id is the least id of its documents.
    """
    bands, rows = bands_for(threshold, recall)
    own = A.keyed(docs, key, text).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)))
    # Two hashes of the whole text, by which equal texts are known.
    prints = own.withColumns({"p": F.xxhash64("text", F.lit(1)), "q": F.xxhash64(F.lit(2), "text", F.length("text"))})
    marked = materialize(signatures(prints, bands, rows, gram), "signatures")
    classes = marked.groupBy("p", "q").agg(F.min(F.struct("id", "rid")).alias("m"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("p", "q", F.col("m.rid").alias("c"), F.col("m.id").alias("class_id"), "n_copies", "bands"), "classes")
    bucket = classes.select("c", F.posexplode("bands").alias("k", "b"))
    least = bucket.groupBy("k", "b").agg(F.min("c").alias("m"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    chained = components(bucket.join(least, ["k", "b"]).where(F.col("c") != F.col("m")).select(F.col("c").alias("a"), F.col("m").alias("b")))
    member = materialize(chained.select(F.col("node").alias("c"), F.col("component").alias("g")), "members")
    size = member.groupBy("g").agg(F.count("*").alias("n"))
    pairs = B.block_pairs(member.join(size, "g"), "g", "c", "n")
    # Always by shuffle: one plan at every size.
    texts = own.join(member.select(F.col("c").alias("rid")).hint("shuffle_merge"), "rid", "left_semi").dropDuplicates(["rid"]).select(F.col("rid").alias("c"), "text")
    found = materialize(verified(pairs.join(texts, "c").select("g", "i", "j", "own", "c", "text"), gram, threshold), "links")
    links = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    linked = components(found.select(F.col("c").alias("a"), F.col("low").alias("b")))
    ids = classes.select("p", "q", "c", "class_id", "n_copies")
    group = ids.join(linked, ids["c"] == linked["node"]).groupBy("component").agg(F.min(F.struct("class_id", "c")).alias("first"))
    known = linked.join(group, "component").select(F.col("node").alias("c"), "first").join(links, "c", "left")
    full = ids.join(known, "c", "left").withColumn("first", F.coalesce("first", F.struct("class_id", "c")))
    out = marked.select("rid", "id", "p", "q").join(full, ["p", "q"])
    real = lambda c: F.when(c != _LAST, c)
    return out.select(
        "rid", real(F.col("id")).alias(key), real(F.col("class_id")).alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real(F.col("first.class_id")).alias("group_id"), F.col("first.c").alias("_keeper"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each group, the one of least id; columns as they are. Of repeated rows, one stays."""
    rid = unused(docs, "_rid")
    kept = join(docs, key, text, gram, threshold, recall).where(F.col("rid") == F.col("_keeper")).select(F.col("rid").alias(rid)).distinct()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn(rid, F.xxhash64(F.col(key), value))
    return rows.join(kept, rid, "left_semi").dropDuplicates([rid]).select(*[F.col(f"`{c}`") for c in docs.columns])
