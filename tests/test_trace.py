"""Trace, lane and run operators on hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork import schemas
from brickwork.functions import labels as fl
from brickwork.functions.student import two_sided_p
from brickwork.operators import lanes, ordinals, runs, trace

COLUMNS = "seq bigint, func string, start_us bigint, end_us bigint, filename string, worker string, thread bigint, process bigint"
S = 1_000_000


def calls(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


SMALL = [
    ("load", 0, 2 * S, "a.nii", "node-1.x", 7, 70),
    ("dump", 3 * S, 5 * S, "a.nii", "node-1.x", 7, 70),
    ("load", 1 * S, 4 * S, None, "node-0.x", 7, 71),
    ("load", 0, 9 * S, "b.nii", None, 5, 72),
    ("load", 6 * S, 6 * S, "b.nii", "node-1.x", 3, 73),
]


def test_steps_give_divisor_counts(spark):
    rows = [("f", i * S, i * S, "x", "w", step, 0) for step in (1, 2, 3, 5) for i in range(0, 1000, step)]
    found = {r.active: r.threads for r in trace.concurrency(calls(spark, rows)).collect()}
    assert found == {float(i): 1 + (i % 2 == 0) + (i % 3 == 0) + (i % 5 == 0) for i in range(1000)}


def test_concurrency_matches_numpy(spark):
    rng = np.random.default_rng(3)
    starts = rng.integers(0, 50 * S, 60)
    rows = [("f", int(s), int(s + d), "x", "w", int(t), 0) for s, d, t in zip(starts, rng.integers(0, 30 * S, 60), rng.integers(0, 6, 60))]
    seen = {}
    for _, s, e, _, _, t, _ in rows:
        for p in np.linspace(round(s / S), round(e / S), 100):
            seen.setdefault(p, set()).add(t)
    points = trace.concurrency(calls(spark, rows))
    assert {r.active: r.threads for r in points.collect()} == {p: len(t) for p, t in seen.items()}
    counts = np.array([len(t) for t in seen.values()])
    one = trace.concurrency_summary(points).first()
    assert (one["count"], one["min"], one["max"]) == (counts.size, counts.min(), counts.max())
    assert one["mean"] == pytest.approx(counts.mean()) and one["std"] == pytest.approx(counts.std(ddof=1))
    assert [one["p25"], one["p50"], one["p75"]] == pytest.approx(np.percentile(counts, [25, 50, 75]).tolist())


def test_points_round_halves_to_even(spark):
    rows = calls(spark, [("f", S // 2, 3 * S // 2, "x", "w", 1, 0), ("f", 5 * S // 2, 5 * S // 2, "x", "w", 1, 0)])
    ends = trace.active_points(rows).groupBy("seq").agg(F.min("active").alias("a"), F.max("active").alias("b"))
    assert sorted((r.a, r.b) for r in ends.collect()) == [(0.0, 2.0), (2.0, 2.0)]


def test_threads_with_equal_ids_on_two_hosts(spark):
    rows = calls(spark, [("f", 0, 0, "x", "w1", 1, 0), ("f", 0, 0, "x", "w2", 1, 0)])
    assert trace.concurrency(rows).first().threads == 1
    assert trace.concurrency(rows, thread_key=("worker", "thread")).first().threads == 2


def test_idle_and_wasted(spark):
    t = calls(spark, SMALL)
    # Lanes: (node-1, 7) busy 4 of 5, (node-0, 7) busy 3 of 4, (node-1, 3) busy 0 of 6.
    assert trace.idle_time(t).first().idle == 1 + 1 + 6
    assert trace.cores_used(t).first().cores == 3
    assert trace.wasted_time(t).first().wasted == 9 * 3 - (4 + 3 + 9)
    known = t.where("worker is not null")
    assert trace.wasted_time(known).first().wasted >= trace.idle_time(known).first().idle


def test_metric_rows_agree_with_the_single_operators(spark):
    t = calls(spark, SMALL).withColumn("run", F.lit(1))
    for kind, single in (("idle", trace.idle_time), ("wasted", trace.wasted_time)):
        found = {r.metric: r.us / S for r in trace.metric_rows(t, ["run"], kind).collect()}
        assert found == {kind: single(t, ["run"]).first()[kind], "load": 14.0, "dump": 2.0}
    with pytest.raises(ValueError):
        trace.metric_rows(t, ["run"], "other")


def test_counts_and_files(spark):
    t = calls(spark, SMALL)
    assert {r.func: r.n for r in trace.func_count(t).collect()} == {"load": 3, "dump": 1}
    chosen = t.where("func = 'dump'")
    assert sorted(r.seq for r in trace.same_file_events(t, chosen).collect()) == [0, 1]
    assert trace.union_traces(t, t).count() == 2 * len(SMALL)


def test_names(spark):
    row = spark.createDataFrame(
        [("load", "node-a-b.site.org", "host", "sub-01-a", "spark:multi-increment:n_worker=4:block_size='5000':delay=1.5")],
        "f string, w string, w2 string, s string, l string",
    )
    one = row.select(
        fl.shown_func(F.col("f")), fl.shown_func(F.lit("calculate_Histogram")), fl.short_worker(F.col("w")),
        fl.short_worker(F.col("w2")), fl.subject_of(F.col("s")), fl.label_app(F.col("l")), fl.label_param(F.col("l"), "block_size"),
        fl.label_param(F.col("l"), "worker"), fl.thousands(F.lit(1234567.5)), fl.func_kind(F.lit("run_group")), fl.func_kind(F.lit("x")),
    ).first()
    assert tuple(one) == ("Read", "Calculate_histogram", "ab", "", "a", "multi-increment", "5000", None, "1,234,568", "Group", None)


def test_required_columns(spark):
    t = calls(spark, SMALL)
    assert schemas.require_trace(t, "worker", "Spark") is t
    with pytest.raises(ValueError):
        schemas.require_trace(t, "lane", "dask")
    with pytest.raises(ValueError):
        schemas.require_trace(t.drop("process"), "worker", "spark")
    with pytest.raises(ValueError):
        schemas.require_trace(t, "worker", "other")


def test_exactly_one_free_parameter():
    assert runs.free_parameter(["a", "b"], {"a": 1}) == "b"
    for fixed in ({}, {"a": 1, "b": 2}):
        with pytest.raises(ValueError):
            runs.free_parameter(["a", "b"], fixed)


def test_app_names_do_not_mix(spark):
    labels = ["spark:increment:n=1:k=5", "spark:multi-increment:n=1:k=5", "dask:increment:n=2:k=55", "dask:increment:n=3:k=5"]
    frame = spark.createDataFrame([(l,) for l in labels], "label string")
    found = runs.runs_one_free_param(frame, "increment", ["n", "k"], {"k": 5}).collect()
    assert sorted((r.label, r.free) for r in found) == [(labels[3], 3.0), (labels[0], 1.0)]


@pytest.mark.parametrize("t,df,p", [(2, 10, 0.0733880), (2, 1, 0.2951672), (0, 5, 1.0), (12.7062, 1, 0.05), (1.959964, 1e6, 0.05), (-4.587, 10, 0.001)])
def test_p_values(t, df, p):
    assert two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=2e-4)


def test_p_values_against_closed_forms():
    t = np.array([0.1, 1.0, 5.0, 40.0, 300.0])
    one = 1 - 2 / math.pi * np.arctan(t)
    two = 1 - t / np.sqrt(2 + t * t)
    assert two_sided_p(t, np.full(5, 1.0)) == pytest.approx(one, rel=1e-8)
    assert two_sided_p(t, np.full(5, 2.0)) == pytest.approx(two, rel=1e-6)


def test_welch_of_single_runs_is_undefined(spark):
    rows = spark.createDataFrame([("dask", 1.0, 5.0), ("spark", 1.0, 6.0)], "framework string, free double, total double")
    one = runs.welch_ttest(rows).first()
    assert (one.t, one.df, one.p, one.stars) == (None, None, None, "")


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_row_numbers_with_a_hot_group(spark, window_rows):
    rng = np.random.default_rng(4)
    order = rng.permutation(3000)
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 7}", int(o)) for i, o in enumerate(order)]
    frame = spark.createDataFrame(rows, "g string, o bigint")
    found = ordinals.with_row_number(frame, "n", ["o"], ["g"], window_rows).collect()
    groups = {}
    for g, o in rows:
        groups.setdefault(g, []).append(o)
    expected = {(g, o): i + 1 for g, os in groups.items() for i, o in enumerate(sorted(os))}
    assert {(r.g, r.o): r.n for r in found} == expected and len(found) == 3000
    total = ordinals.with_row_number(frame, "n", ["o"], (), window_rows).collect()
    assert {r.o: r.n for r in total} == {i: i + 1 for i in range(3000)}


def test_lanes_follow_first_appearance(spark):
    t = calls(spark, SMALL)
    lane = {(r.worker, r.thread): r.lane for r in lanes.lane_table(t).collect()}
    assert lane == {("node-1.x", 7): "worker01::thread1", ("node-1.x", 3): "worker01::thread2", ("node-0.x", 7): "worker02::thread1"}
    placed = {r.lane: (r.bottom, r.top) for r in lanes.gantt_lanes(lanes.lane_table(lanes.first_calls(t))).collect()}
    assert placed == {"worker01::thread1": (0.0, 1.0), "worker01::thread2": (1.5, 2.5), "worker02::thread1": (19.0, 20.0)}
    flat = {r.lane: (r.bottom, r.top) for r in lanes.gantt_lanes_flat(lanes.flat_lane_table(t)).collect()}
    assert flat == {"1::thread1": (-0.5, 0.5), "1::thread2": (0.5, 1.5), "0::thread1": (1.5, 2.5)}


def test_lanes_per_run(spark):
    t = calls(spark, SMALL).withColumn("run", F.col("seq") % 2)
    found = {(r.run, r.worker, r.thread): r.lane for r in lanes.lane_table(t, ["run"]).collect()}
    assert found[(0, "node-0.x", 7)] == "worker02::thread1" and found[(1, "node-1.x", 7)] == "worker01::thread1"
    assert lanes.gantt_lanes(lanes.lane_table(t, ["run"]), ["run"]).count() == len(found)


def test_merging_twice_equals_merging_once(spark, tmp_path):
    from brickwork.sources import traces

    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    rows = [("load", 0.0, 1.0, "f", "w", 1, 2, "l", "r1"), ("dump", 1.0, 2.0, "f", "w", 1, 2, "l", "r2")]
    names = "func string, start double, end double, filename string, worker string, thread long, process long, label string, run_id string"
    spark.createDataFrame(rows, names).write.partitionBy("label", "run_id").csv(logs)
    traces.merge_traces(spark, logs, out)
    once = spark.read.csv(out).count()
    traces.merge_traces(spark, logs, out)
    assert once == 2 and spark.read.csv(out).count() == once


def test_storage_fault_is_not_a_bad_file(monkeypatch):
    import pytest

    from brickwork.sources import nifti

    def fail(path):
        raise OSError("passing fault")

    monkeypatch.setattr(nifti, "open_file", fail)
    with pytest.raises(OSError):
        nifti._read_header("x.nii", 1000)


def test_concurrency_over_long_and_odd_calls(spark):
    """Calls over many stretches, backwards, with nulls, and a run that holds most of the calls."""
    import random
    from collections import defaultdict

    rng = random.Random(4)
    rows = []
    for _ in range(400):
        b = rng.randrange(0, 20_000)
        e = b + rng.choice([0, 1, 50, 299, 300, 5_000, 200_000, -700])
        rows.append(("a" if rng.random() < 0.8 else "b", rng.choice([1, 2, 3, None]), b * 1_000_000, e * 1_000_000))
    rows += [("a", 7, None, 5_000_000), ("a", 7, 5_000_000, None), ("a", 1, 0, 10**15)]
    found = trace.concurrency(spark.createDataFrame(rows, "run string, thread long, start_us long, end_us long"), ["run"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # distinct calls, and calls by stretch; never points
    want = defaultdict(set)
    for run, thread, b, e in rows:
        if thread is None:
            continue
        b, e = (None if t is None else float(round(t / 1e6)) for t in (b, e))
        if b is not None and b == e:
            points = [b]
        else:
            points = [e if i == 99 else None if b is None or e is None else b + i * ((e - b) / 99) for i in range(100)]
        for p in points:
            want[run, p].add(thread)
    got = {(r.run, r.active): r.threads for r in found.collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_calls_on_a_hot_file(spark, monkeypatch):
    """One file name in half of all rows, and no table small enough to broadcast."""
    monkeypatch.setattr(trace, "broadcast_if_small", lambda df: df)
    rows = [(i, "hot.nii" if i % 2 else None if i % 50 == 0 else f"f{i % 400}.nii") for i in range(4000)]
    calls = spark.createDataFrame(rows, "seq long, filename string").repartition(8)
    for picked in (["hot.nii", "f2.nii", "f8.nii"], ["f2.nii"], [None, "hot.nii"], []):
        selected = spark.createDataFrame([(n,) for n in picked], "filename string")
        found = trace.same_file_events(calls, selected)
        assert sorted(r.seq for r in found.collect()) == [i for i, n in rows if n is not None and n in picked]
    shuffled = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in shuffled and "LeftSemi" in shuffled
    # What is left for the shuffle holds no hot name.
    rest = calls.join(spark.createDataFrame([("hot.nii",)], "filename string"), "filename", "left_anti")
    assert rest.groupBy("filename").count().agg(F.max("count")).first()[0] < 100


def test_hooks_of_reports(spark):
    from brickwork.plans import jobs
    from brickwork.sources import tables

    calls = tables.trace(spark, "/root/testdata/sf0.001")
    about = ("increment", ["n_worker", "block_size", "iterations", "delay"], {"block_size": "5000", "iterations": 5, "delay": "1.0"})

    def upper(df):
        return df.withColumn("func", F.upper("func"))

    def span(df, by):
        return df.groupBy(*by).agg((F.max("end_us") - F.min("start_us")).alias("us"))

    def early(df):
        return df.where("start_us < 1000000000000")

    stats = jobs.run_report(calls, *about, overhead=span, pre_process=early, func_remap=upper).stats.collect()
    names = {r.metric for r in stats}
    assert "span" in names and {"LOAD", "DUMP"} <= names and names - {"span"} == {n.upper() for n in names - {"span"}}
    plain = {r.metric for r in jobs.run_report(calls, *about).stats.collect()}
    assert "idle" in plain and not any(n.isupper() for n in plain)
    lanes = jobs.lane_report(calls, pre_process=early, func_remap=upper)
    assert lanes.agg(F.max("start_us")).first()[0] < 10**12 and {r.func for r in lanes.select("func").distinct().collect()} == names - {"span"}


def test_points_are_made_where_they_are_grouped(spark):
    """Before, all points of all calls were shuffled."""
    rows = calls(spark, [("f", i * S, (i + 200) * S, "x", "w", 1, 0) for i in (0, 1, 2)]).withColumn("seq", F.expr("if(seq = 2, null, seq)"))
    twice = rows.unionByName(rows)
    found = {}
    for by in ((), ("seq",)):
        done = trace.active_points(twice, by=by).groupBy("seq").agg(F.count("*").alias("n"), F.countDistinct("active").alias("points"))
        found[by] = sorted(done.collect(), key=str)
        plan = done._jdf.queryExecution().sparkPlan().toString()
        if by:  # the tree is printed from the top: nothing is dealt out again above the step that makes points
            assert "hashpartitioning" not in plan.split("Generate")[0] and "REPARTITION_BY_NUM" in plan.split("Generate")[1]
    assert found[()] == found[("seq",)] and [r.n for r in found[()]] == [200] * 3


def test_many_points_go_to_more_tasks(spark, monkeypatch):
    """Before, the number of tasks that tell points apart was fixed, whatever the number of calls."""
    monkeypatch.setattr(trace, "TASK_POINTS", 200, raising=False)
    rows = calls(spark, [("f", i * 400 * S, (i * 400 + 99) * S, "x", "w", i, 0) for i in range(64)])
    points = trace.concurrency(rows)
    assert points.count() == 6400
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert points.selectExpr("spark_partition_id() as p").distinct().count() > few
    ends = trace.active_points(rows, by=["seq"]).selectExpr("spark_partition_id() as p").distinct().count()
    assert ends > few
