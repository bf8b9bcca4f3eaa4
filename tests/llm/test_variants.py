"""Operator 13 against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brickwork.llm import queries, variants

SF_DIR = "/root/testdata/sf0.001"


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters if c != word[k])


def plain_groups(words):
    letters = sorted(set("".join(words)))
    close = {w: {e for e in edits(w, letters) if e in words} for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda t: (-words[t], t), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield (w, form[w], root, words[w], len(close[w]), words.get(form[w]))


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_joined_crc():
    rng = random.Random(1)
    a = [bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(60)]
    b = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 200, 1000]))) for _ in range(60)]
    found = variants.joined_crc(np.array([zlib.crc32(x) for x in a]), np.array([zlib.crc32(x) for x in b]), np.array([len(x) for x in b]))
    assert found.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def random_words(rng, count, letters, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(5, longest))): rng.choice([3, 4, 6, 8, 8, 16, 40, 100]) for _ in range(count)}


@pytest.mark.parametrize("letters,longest,shard", [("ab", 9, 1 << 15), ("ab", 12, 20), ("abcéÿ", 7, 50), ("a", 60, 1000)])
def test_group(spark, letters, longest, shard):
    words = random_words(random.Random(letters + str(shard)), 400, letters, longest)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(variants.group(df, shard)) == sorted(plain_groups(words), key=str)


def test_half_shared_by_many(spark):
    rng = random.Random(4)
    words = {"stem" + "".join(rng.choice("abcd") for _ in range(4)): rng.randrange(3, 50) for _ in range(300)} | {"x" * 700: 5, "x" * 701: 30, "x" * 350 + "y" + "x" * 350: 90}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    shards = variants.dealt(df, 16)
    assert shards.where("half like 'stem,%'").select("half").distinct().count() > 50
    assert got(variants.group(df, 16)) == sorted(plain_groups(words), key=str)


def test_vocabulary(spark):
    rng = random.Random(8)
    runs = ["hello", "World", "ÀÉÿé×", "naïve", "ab", "spelling", "spellingspelling" * 6, "x" * 300, "中文hello", "ABCDE9abcde"]
    rows = [(None if k % 11 == 0 else k % 40, None if k == 3 else "" if k == 4 else " ".join(rng.choice(runs) for _ in range(rng.randrange(40)))) for k in range(500)]
    hit = next(i for i in range(100, 100_000) if zlib.crc32(f"{i}:spelling".encode()) % 97 == 0)
    rows.append((hit, "spelling Spelling\nSPELLING"))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, n int, word string").repartition(3)
    words = plain_words(rows)
    assert any(len(w) == 7 and w not in runs for w in words)
    assert {r["word"]: r["n"] for r in variants.vocabulary(df).collect()} == words


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.vocabulary(empty)).count() == 0
    assert variants.group(variants.vocabulary(spark.createDataFrame([(1, None), (2, ""), (3, "12 ,")], "doc_id long, text string"))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_spelling_variants"](spark, SF_DIR)) == sorted(plain_groups(plain_words(rows)), key=str)
