"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (letters and digits, ASCII lower-cased), pairs of neighbours, and pairs with one word
between, hashed to ``BUCKETS`` numbers; a feature counts once per text. Per-coordinate learning rates and the L1 term
leave few weights other than zero, so the model is a short list that is sent to every task.

Null and empty texts have no feature: their score is that of the bias alone. Null labels and null keys train nothing.
Repeated rows get equal scores. Texts are read whole; work and memory of one grow with its length. An empty table, or no
labelled rows, gives a score of next to 0 for all. Other columns are not read, or stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.llm import kernels as K

BUCKETS = 1 << 20
#: Bound of the labelled sample that a model is fitted on: the rows whose id, then text, has the least hash.
MAX_TRAINING_ROWS = 16_384
#: Chosen by the log loss over four folds of the labelled rows of the 0.1 tables that are not held out; see the README.
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 0.0
#: Share of a class beyond which the score rejects a text.
THRESHOLD = 0.7

#: Bytes that aren't part of a word here: all ASCII but letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SKIP = np.uint64(0x9E6C63D0876A9A47)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts of a batch, and the text each belongs to; a feature may come twice."""
    buf, starts = K.flat(column)
    buf = _LOWER[buf]
    begin, end, first = K.words(buf, starts, _BREAK)
    h, doc = K.hash_words(buf, begin, end), K.owner(first)
    parts, owners = [h], [doc]
    for gap, seed in ((1, np.uint64(1)), (2, _SKIP)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append(K.mix(h[:-gap] * seed + (h[gap:] ^ seed))[same])
            owners.append(doc[gap:][same])
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int64), np.concatenate(owners)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each (order, print), once per task however many copies of the text there are."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        keys = list(zip(whole.column("order").to_pylist(), whole.column("print").to_pylist()))
        new = [k not in seen and not seen.add(k) for k in keys]
        for batch in K.slices(whole.filter(pa.array(new, pa.bool_()))):
            f, doc = features(batch.column("text"))
            both = np.unique(doc * BUCKETS + f)
            cut = np.searchsorted(both, np.arange(batch.num_rows + 1) * BUCKETS)
            f = (both % BUCKETS).astype(np.int32)
            packed = [f[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("print"), K.binaries(packed)], names=["order", "print", "features"])


def fit_rows(examples: list[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the examples in their order; feature numbers and weights other than zero, and the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == BUCKETS, 0.0, L1)  # the bias is not shrunk
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for f, y in examples:
            i = np.append(f, BUCKETS)
            w = weight(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    every = np.arange(BUCKETS + 1)
    w = weight(every)
    kept = np.flatnonzero(w[:BUCKETS])
    return kept, w[kept], float(w[BUCKETS])


def chosen_rows(docs: DataFrame, labels: DataFrame | None, key: str, text: str, label: str, max_rows: int) -> list[tuple]:
    """``(order, print, label, copies)`` of the at most ``max_rows`` labelled rows whose key, then text, has the least hash.

    Only keys and hashes are joined to the labels, counted where they lie; texts stay where they are.
    """
    value, place = F.col(text).cast("string"), ["order", "print", "label"]
    number = F.col(label).cast("double").alias("label")
    own = [F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("order"), F.xxhash64(value).alias("print")]
    if labels is None:
        joined = docs.where(F.col(label).isNotNull()).select(*own, number).groupBy(*place).agg(F.count("*").alias("copies"))
    else:
        rows = docs.select(*own).groupBy("key", "order", "print").agg(F.count("*").alias("rows"))
        known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key"), number).agg(F.count("*").alias("times"))
        joined = rows.join(known, "key").groupBy(*place).agg(F.sum(F.col("rows") * F.col("times")).alias("copies"))
    out, left = [], max_rows
    for row in joined.orderBy(*place).limit(max_rows).collect():
        if left <= 0:
            break
        out.append((row["order"], row["print"], row["label"], min(left, row["copies"])))
        left -= row["copies"]
    return out


def training_rows(
    docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS
) -> DataFrame | None:
    """``order``, ``print``, ``label`` and ``features`` of the chosen rows, repeated ones each; None if there are none.

    The chosen keys and hashes, at most ``max_rows`` of them, go to the documents; features are made there.
    """
    chosen = chosen_rows(docs, labels, key, text, label, max_rows)
    if not chosen:
        return None
    table = docs.sparkSession.createDataFrame(chosen, "order long, print long, label double, copies long")
    value = F.col(text).cast("string")
    texts = docs.select(F.xxhash64(F.col(key)).alias("order"), F.xxhash64(value).alias("print"), value.alias("text"))
    found = texts.join(F.broadcast(table.select("order", "print").distinct()), ["order", "print"])
    made = found.mapInArrow(_feature_rows, "order long, print long, features binary").dropDuplicates(["order", "print"])
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    return made.join(F.broadcast(table), ["order", "print"]).select("order", "print", "label", "features", each).drop("copy")


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "print", "label"])
    kept, w, bias = fit_rows([(np.frombuffer(f, np.int32).astype(np.int64), float(y)) for f, y in zip(rows["features"], rows["label"])])
    return pd.DataFrame({"at": [kept.astype(np.int32).tobytes()], "weight": [w.tobytes()], "bias": [bias]})


def train(
    docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled documents, those whose key, then text, has the least hash.

    Labels are those of the same key in ``labels``, or without it a column of ``docs``. Repeated documents, and repeated
    labels, count each. Features are made where the texts lie; one task then runs the updates, over at most ``max_rows``
    short arrays.
    """
    rows = training_rows(docs, labels, key, text, label, max_rows)
    if rows is None:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    model = rows.groupBy().applyInPandas(_train, "at binary, weight binary, bias double").first()
    return np.frombuffer(model["at"], np.int32).astype(np.int64), np.frombuffer(model["weight"], np.float64), model["bias"]


def _dense(at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, used = np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
    table[at], used[at] = weight, True
    return table, used


def _scores(column: pa.Array, table: np.ndarray, used: np.ndarray, bias: float) -> np.ndarray:
    f, doc = features(column)
    hit = used[f]
    both = np.unique(doc[hit] * BUCKETS + f[hit])
    total = np.bincount(both // BUCKETS, table[both % BUCKETS], len(column)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of every text."""
    at, weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(at, weight)
        for whole in batches:
            for batch in K.slices(whole):
                p = _scores(batch.column("text"), *dense, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, columns as they are."""
    at, weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(at, weight)
        for batch in batches:
            for part in K.slices(batch, text):
                p = _scores(part.column(part.schema.get_field_index(text)), *dense, bias)
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Whether the CRC of the key, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
