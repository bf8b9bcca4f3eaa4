"""Benchmark decontamination by spaced seeds.

A seed is a window of words of which a fixed mask ignores some, hashed. Test items give all their seeds, training
texts theirs, and both are joined. Around each hit, text and item are laid on top of each other and the overlap is
verified: a window of ``VERIFIED`` words (or the whole item, if shorter) in which at least ``MIN_SHARE`` of the words agree.
So passages with single words replaced are found as well. The masks of an item go by its length and leave no gap: however
the words that may differ are placed in a window, some seed of it is untouched (a test tries all placements). Items of up to
4 words must be held whole.

Words are runs of letters and digits, in lower case. Items without words, among them null and empty ones, have no
seeds and contaminate nothing. Null and empty texts are clean. Rows of one doc_id are told apart by
their text; repeated rows get equal results. Items of one id count as one, whichever of their texts is held; a null id
is an id like others. A word that is an item by itself marks every text that holds it. An empty table on either side gives clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.llm.native import let, positions
from brickwork.session import materialize

VERIFIED = 20
MIN_SHARE = 0.8
#: For items of at least so many words, up to the next entry: their masks. 1: the word counts; 0: it is ignored. A mask begins
#: and ends with 1, so a seed never reaches over the end of a text whose last words agree.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011", "11101", "10111"),  # one word may differ
    10: ("111011", "11010011", "111001001"),  # two
    15: ("111011", "1010001011"),  # three, from 20 words on four in a window
}
#: Seeds of the test side are broadcast up to this many (24 bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 500_000


def _key(key: str) -> Column:
    """The key as text, null as the empty text, so that rows without key join as well."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(found: Column, masks: tuple[str, ...]) -> Column:
    """All seeds of a text: first those of the first mask by position, then those of the next."""

    def masked(h: Column, mask: str) -> Column:
        shown = [k for k, c in enumerate(mask) if c == "1"]
        return F.transform(positions(F.size(h) - (len(mask) - 1)), lambda i: F.xxhash64(F.lit(int(mask, 2)), *[F.get(h, i + k) for k in shown]))

    def of(h: Column) -> Column:
        return F.concat(*[masked(h, mask) for mask in masks])

    return let(F.transform(found, lambda w: F.xxhash64(w)), of)


def _seeded(rows: DataFrame, keys: list[str], found: Column, masks) -> DataFrame:
    """Keys, number of words ``n``, and number ``k`` and value of every seed.

    The outer form of explode keeps Spark from adding a filter that would make all seeds a second time.
    """
    both = let(found, lambda w: F.struct(F.size(w).alias("n"), seeds(w, masks).alias("s")))
    out = rows.select(*keys, both.alias("_z"))
    return out.select(*keys, F.col("_z.n").alias("n"), F.posexplode_outer("_z.s").alias("k", "seed")).where(F.col("seed").isNotNull())


def _at(masks) -> Column:
    """Position of a seed in the text, from its number ``k`` among the text's seeds and the text's words ``n``."""
    at, before = F.col("k"), F.lit(0)
    out = at
    for m in masks[:-1]:
        before = before + F.greatest(F.col("n") - (len(m) - 1), F.lit(0))
        out = F.when(at >= before, at - before).otherwise(out)
    return out


def _share(text: Column, item: Column, shift: Column) -> Column:
    """Greatest share of equal words in a window of the item laid over the text."""

    def of(equal: Column) -> Column:
        size = F.least(F.lit(VERIFIED), F.size(item))
        total = lambda i: F.aggregate(F.slice(equal, i + 1, size), F.lit(0), lambda a, b: a + b)
        return F.array_max(F.transform(positions(F.size(item) - size + 1), lambda i: total(i) / size))

    same = F.transform(item, lambda w, j: F.when((j + shift >= 0) & (F.get(text, F.greatest(j + shift, F.lit(0))) == w), 1).otherwise(0))
    return let(same, of)


def _item_seeds(tests: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``_item``, position ``q`` and ``seed`` of all seeds of the items, each by the masks of its length; and the masks in use."""
    size = F.size("_words")
    least = F.greatest(*[F.when(size >= n, n).otherwise(0) for n in MASKS])
    lengths = sorted(r[0] for r in tests.select(least).distinct().collect() if r[0])
    out = tests.select("_item", F.lit(0).alias("q"), F.lit(0).cast("long").alias("seed")).limit(0)
    for n in lengths:
        found = _seeded(tests.where(least == n), ["_item"], F.col("_words"), MASKS[n])
        out = out.unionByName(found.select("_item", _at(MASKS[n]).alias("q"), "seed"))
    return out, tuple(dict.fromkeys(m for n in lengths or [1] for m in MASKS[n]))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps, best first by document: ``_id``, ``_print`` (key and fingerprint of the text), item, share."""
    value = F.col(text).cast("string")
    own = docs.select(_key(key).alias("_id"), F.xxhash64(value).alias("_print"), value.alias("_text"))
    tests = materialize(benchmark.select(F.col(item).alias("_item"), words(F.col(item_text).cast("string")).alias("_words")).distinct(), "items")
    test_seeds, masks = _item_seeds(tests)
    test_seeds = materialize(test_seeds, "seeds")
    small = test_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    mine = _seeded(own, ["_id", "_print"], words(F.col("_text")), masks)
    hits = mine.join(F.broadcast(test_seeds) if small else test_seeds, "seed")
    # Stored: both uses below would make all seeds of the texts again.
    hits = hits.groupBy("_id", "_print", "_item").agg(F.collect_set(_at(masks) - F.col("q")).alias("shifts"))
    hits = materialize(hits, "hits")
    # Few documents are hit: their texts and items are fetched only now.
    texts = own.join(hits.select("_id", "_print").distinct(), ["_id", "_print"], "left_semi").dropDuplicates(["_id", "_print"])
    laid = hits.join(tests.withColumnRenamed("_item", "_own_item"), F.col("_item").eqNullSafe(F.col("_own_item"))).join(texts.select("_id", "_print", words(F.col("_text")).alias("_own")), ["_id", "_print"])
    share = F.array_max(F.transform("shifts", lambda s: _share(F.col("_own"), F.col("_words"), s)))
    laid = laid.select("_id", "_print", "_item", share.alias("share"))
    return laid.where(F.col("share") >= MIN_SHARE)


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Key, ``contaminated``, ``n_items``, and the item of greatest overlap (least id on ties) with its ``share``."""
    verified = overlaps(docs, benchmark, key, text, item, item_text)
    best = verified.groupBy("_id", "_print").agg(
        F.countDistinct(F.struct("_item")).alias("n_items"), F.max("share").alias("share"), F.min_by("_item", F.struct(-F.col("share"), F.col("_item"))).alias("item_id")
    )
    rows = docs.select(F.col(key).alias("_key"), _key(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_print"))
    out = rows.join(best, ["_id", "_print"], "left")
    return out.select(
        F.col("_key").alias(key), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("share", F.lit(0.0)).alias("share")
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, columns as they are."""
    verified = overlaps(docs, benchmark, key, text, item, item_text).select("_id", "_print").distinct()
    return docs.join(verified, (_key(key) == verified["_id"]) & (F.xxhash64(F.col(text).cast("string")) == verified["_print"]), "left_anti")
