"""Reductions with merges of the user's own."""

import random

import pytest

from brickwork.operators import folds


def spans():
    """States that are no sums: least and greatest value, and the texts in order."""

    def add(state, batch):
        for r in batch.to_pylist():
            state = (min(state[0], r["v"]), max(state[1], r["v"]), state[2] + [r["t"]], state[3])
        return state

    def merge(a, b):
        return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], max(a[3], b[3]) + 1)

    return lambda: (10**9, -1, [], 0), add, merge, lambda s: {"lo": s[0], "hi": s[1], "texts": s[2], "depth": s[3]}


SCHEMA = "lo bigint, hi bigint, texts array<string>, depth int"


@pytest.mark.parametrize("fan_in,depth", [(2, 5), (4, 12), (64, 31)])
def test_tree_of_merges(spark, fan_in, depth):
    df = spark.range(0, 320, 1, 32).selectExpr("id as v", "cast(id as string) as t")
    row = folds.fold(df, *spans(), SCHEMA, fan_in=fan_in).first()
    assert (row.lo, row.hi, row.texts) == (0, 319, [str(i) for i in range(320)])  # states are merged in order
    assert row.depth <= depth  # merges on the longest way: those of one task, times the rounds


def test_keys_nulls_and_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(5), rng.randrange(1000), "x") for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, j int, v bigint, t string").repartition(9)
    found = {(r.k, r.j): (r.lo, r.hi, len(r.texts)) for r in folds.fold(df, *spans(), SCHEMA, by=["k", "j"], fan_in=3).collect()}
    groups = {}
    for k, j, v, _ in rows:
        groups.setdefault((k, j), []).append(v)
    assert found == {k: (min(v), max(v), len(v)) for k, v in groups.items()}


def test_nothing(spark):
    empty = spark.createDataFrame([], "k string, v bigint, t string")
    assert folds.fold(empty, *spans(), SCHEMA).first().hi == -1
    assert folds.fold(empty, *spans(), SCHEMA, by=["k"]).count() == 0
    with pytest.raises(ValueError):
        folds.fold(empty, *spans(), SCHEMA, fan_in=1)


def test_states_are_dealt_by_their_size_and_taken_some_at_a_time(spark, monkeypatch):
    """Before, a round took the states of all keys in a fixed number of partitions, and a batch of them at once."""
    monkeypatch.setattr(folds, "ROUND_BYTES", 1 << 10, raising=False)
    monkeypatch.setattr(folds, "TAKEN", 3, raising=False)
    df = spark.range(0, 300, 1, 4).selectExpr("id % 100 as k", "id as v", "repeat('x', 100) as t")
    done = folds.fold(df, *spans(), SCHEMA, by=["k"], fan_in=2)
    assert {r.k: (r.lo, r.hi, len(r.texts)) for r in done.collect()} == {k: (k, k + 200, 3) for k in range(100)}
    assert done.selectExpr("spark_partition_id() as p").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
