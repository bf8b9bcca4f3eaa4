"""Operator 12: exact sizes, gapless slots, and uniform arrangements."""

import zlib
from collections import Counter

import numpy as np
import pytest

from brickwork.llm import queries, sharding

SF_DIR = "/root/testdata/sf0.001"


def test_matrix_margins():
    rows, leaf = 1000, 64
    sizes = np.array([300, 1, 0, 499, 200])
    matrix = sharding.Matrix(rows, sizes, 3, leaf)
    again = sharding.Matrix(rows, sizes, 3, leaf)
    found = [matrix.row(k) for k in range(matrix.leaves)]
    assert [c.sum() for c, _ in found] == [64] * 15 + [40]
    assert (sum(c for c, _ in found) == sizes).all()
    total = np.zeros(5, np.int64)
    for cells, before in found:
        assert (before == total).all()
        total += cells
    for k in (15, 0, 7, 7, 8):  # any order of visits gives the same rows
        assert all((a == b).all() for a, b in zip(again.row(k), found[k]))
    placed = [matrix.place(k) for k in range(matrix.leaves)]
    block, arrival = np.concatenate([p[0] for p in placed]), np.concatenate([p[1] for p in placed])
    for b, size in enumerate(sizes):
        assert sorted(arrival[block == b]) == list(range(size))


@pytest.mark.parametrize("good,bad,n", [(5, 7, 6), (1, 1, 1), (300, 2000, 500), (0, 5, 3), (5, 0, 3)])
def test_draw_one_follows_the_distribution(good, bad, n):
    rng, other = np.random.default_rng(1), np.random.default_rng(2)
    a = np.array([sharding.draw_one(rng, good, bad, n) for _ in range(4000)])
    b = other.hypergeometric(good, bad, n, 4000)
    assert a.min() >= max(0, n - bad) and a.max() <= min(n, good)
    assert abs(a.mean() - b.mean()) < 0.1 * max(b.std(), 0.01) + 1e-9 and abs(a.std() - b.std()) < 0.06 * max(b.std(), 0.01) + 1e-9


def test_draw_beyond_numpy():
    cells = np.array([3 * 10**9, 10**9, 0, 6 * 10**9])
    got = sharding.draw(np.random.default_rng(5), cells, 4 * 10**9)
    assert got.sum() == 4 * 10**9 and (got <= cells).all()
    assert (abs(got - 0.4 * cells) < 300_000).all()


def test_rows_and_clashing_names(spark):
    rows = [(i % 3 or None, None if i % 5 == 0 else f"t{i % 7}", "x", i, "y", "z") for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long, `row` string, `a.b` string").repartition(5)
    out = sharding.shuffle(df, 7, seed=4, leaf_rows=64, block_rows=50)
    assert out.columns == ["doc_id", "text", "row", "a.b", "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
    for k in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(144 if k < 2 else 143))


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shuffle(empty, 4).count() == 0
    few = sharding.shuffle(spark.range(3), 5).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_every_arrangement_is_equally_likely():
    seen = Counter()
    sizes, shard, first = sharding.block_sizes(5, 2, 2)
    assert sizes.tolist() == [1, 2, 2] and shard.tolist() == [0, 0, 1] and first.tolist() == [0, 1, 0]
    for seed in range(6000):
        matrix = sharding.Matrix(5, sizes, seed, 2)
        block, arrival = (np.concatenate(x) for x in zip(*[matrix.place(k) for k in range(3)]))
        order = [np.random.default_rng([seed, 2, b]).permutation(int(s)) for b, s in enumerate(sizes)]
        seen[tuple((int(shard[b]), int(first[b] + order[b][a])) for b, a in zip(block, arrival))] += 1
    assert len(seen) == 120
    assert sum((n - 50) ** 2 / 50 for n in seen.values()) < 180  # chi-square with 119 degrees of freedom


def test_write(spark, tmp_path):
    sharding.write(spark.range(100).withColumnRenamed("id", "doc_id"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().orderBy("shard").collect() == [(0, 34), (1, 33), (2, 33)]


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    data = Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    got = queries.QUERIES["op12_hypergeometric_shards"](spark, SF_DIR).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == data
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    count = Counter(r["shard"] for r in got)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for k, n in count.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
