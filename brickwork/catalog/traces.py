"""Queries on run traces, comparisons of runs, and timeline lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import query, with_views
from brickwork.functions import labels as fl
from brickwork.operators import lanes, runs, trace
from brickwork.session import materialize, scratch_path
from brickwork.sources import tables, traces

PARAMETERS = ["n_worker", "block_size", "iterations", "delay"]
FIXED = {"block_size": "5000", "iterations": 5, "delay": "1.0"}
TYPES = {"n_worker": "bigint", "block_size": "bigint", "iterations": "bigint", "delay": "double"}
RUN = ["framework", "n_worker", "rep"]

_SEC = "cast({} as double) / 1000000"
_RUNTIME = "end_us - start_us"


def _trace(spark, sf_dir):
    return tables.trace(spark, sf_dir)


def _shown(spark, sf_dir):
    return trace.with_effective_thread(trace.with_shown_func(_trace(spark, sf_dir)))


# -------------------------------------------------------- files and catalogue


def _logs(spark, sf_dir):
    folder = scratch_path(spark, "logs")
    traces.write_trace(_trace(spark, sf_dir), folder)
    return folder


_FILE_ROWS = with_views(
    "trace",
    body="""select label, run_id, func, start_us, end_us, filename, worker, thread, process from trace""",
)
_FILE_COLUMNS = ["label", "run_id", "func", "start_us", "end_us", "filename", "worker", "thread", "process"]


@query("trace_scan", _FILE_ROWS)
def trace_scan(spark, sf_dir):
    return traces.scan_traces(spark, _logs(spark, sf_dir)).select(*_FILE_COLUMNS)


@query("trace_merge", _FILE_ROWS)
def trace_merge(spark, sf_dir):
    merged = scratch_path(spark, "summaries")
    traces.merge_traces(spark, _logs(spark, sf_dir), merged)
    return traces.scan_traces(spark, merged).select(*_FILE_COLUMNS)


@query("trace_merge_logs", _FILE_ROWS)
def trace_merge_logs(spark, sf_dir):
    """Logs of half the workers, merged twice; then all logs, of which those of the first half have grown."""
    folder, merged = scratch_path(spark, "raw"), scratch_path(spark, "merged")
    calls = _trace(spark, sf_dir)
    traces.write_logs(calls.where("thread % 4 = 0"), folder)
    traces.merge_logs(spark, folder, merged)
    traces.merge_logs(spark, folder, merged)
    traces.write_logs(calls, folder)
    traces.merge_logs(spark, folder, merged)
    return traces.scan_merged(spark, merged).select(*_FILE_COLUMNS)


@query("run_catalog", with_views("trace", body="select distinct label, run_id, framework from trace"))
def run_catalog(spark, sf_dir):
    return traces.run_catalog(traces.list_trace_files(spark, _logs(spark, sf_dir)))


_PATHS = """select distinct label, 'benchmarks/' || label || '/summary-' || filename || '-' || run_id || '.csv' as path
            from trace"""


def _paths(spark, sf_dir):
    path = F.concat(
        F.lit("benchmarks/"), "label", F.lit("/summary-"), "filename", F.lit("-"), "run_id", F.lit(".csv")
    )
    return _trace(spark, sf_dir).select("label", path.alias("path")).distinct()


@query(
    "run_ordinal_files",
    with_views(
        "trace", p=_PATHS,
        body="select label, path, row_number() over (partition by label order by path) as rep from p",
    ),
)
def run_ordinal_files(spark, sf_dir):
    return runs.run_ordinal_files(_paths(spark, sf_dir))


# ---------------------------------------------------------------- projections


@query(
    "parse_run_label",
    with_views(
        "trace",
        body="""select label, framework, 'increment' as app, n_worker, cast(5000 as bigint) as block_size,
                  cast(case when rep = 9 then 25 else 5 end as bigint) as iterations,
                  cast(1 as double) as delay, count(*) as n
                from trace group by all""",
    ),
)
def parse_run_label(spark, sf_dir):
    # One label stands for many calls, so labels are counted before they are parsed.
    labels = _trace(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return runs.parse_run_label(labels, TYPES)


@query("runtime", with_views("trace", body=f"select seq, {_SEC.format('(end_us - start_us)')} as runtime from trace"))
def runtime(spark, sf_dir):
    return trace.with_runtime(_trace(spark, sf_dir)).select("seq", "runtime")


@query("remap_func", with_views("shown", body="select seq, func from shown"))
def remap_func(spark, sf_dir):
    return trace.with_shown_func(_trace(spark, sf_dir)).select("seq", "func")


@query(
    "func_category",
    with_views(
        "trace",
        body="""select seq, func, case when func in ('increment', 'calculate_histogram', 'combine_histogram')
                  then 'Compute' end as kind from trace""",
    ),
)
def func_category(spark, sf_dir):
    return _trace(spark, sf_dir).select("seq", "func", fl.func_kind(F.col("func")).alias("kind"))


@query(
    "short_worker",
    with_views(
        "trace",
        body="""select seq, split_part(replace(substr(worker, strpos(worker, '-') + 1), '-', ''), '.', 1) as worker_name
                from trace""",
    ),
)
def short_worker(spark, sf_dir):
    return _trace(spark, sf_dir).select("seq", fl.short_worker(F.col("worker")).alias("worker_name"))


@query("effective_thread", with_views("shown", body="select seq, thread from shown"))
def effective_thread(spark, sf_dir):
    return trace.with_effective_thread(_trace(spark, sf_dir)).select("seq", "thread")


# Sample points of every call; the aggregate keeps the result at one row per call.
_POINTS = """
    select seq, i, case when i = 99 then e else b + i * ((e - b) / 99) end as active
    from (select seq, unnest(range(0, 100)) as i, round_even(cast(start_us as double) / 1000000, 0) as b,
                 round_even(cast(end_us as double) / 1000000, 0) as e from trace)"""


@query(
    "active_points",
    with_views(
        "trace", p=_POINTS,
        body="""select seq, count(*) as n, count(distinct active) as points, min(active) as first, max(active) as last,
                  max(case when i = 33 then active end) as third
                from p group by seq""",
    ),
)
def active_points(spark, sf_dir):
    points = trace.active_points(_trace(spark, sf_dir).select("seq", "start_us", "end_us"), by=["seq"])
    return points.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("active").alias("points"), F.min("active").alias("first"),
        F.max("active").alias("last"), F.max(F.when(F.col("point") == 33, F.col("active"))).alias("third"),
    )


@query(
    "lossless_int",
    with_views(
        "trace",
        v="select distinct cast(n_worker as double) as free from trace",
        body="""select free, case when (select bool_and(free = floor(free)) from v)
                  then cast(free as bigint) end as whole from v""",
    ),
)
def lossless_int(spark, sf_dir):
    values = _trace(spark, sf_dir).select(F.col("n_worker").cast("double").alias("free"))
    return runs.lossless_int(values)


@query(
    "lossless_int_mixed",
    with_views("trace", body=f"select distinct {_SEC.format('end_us')} as free, cast(null as bigint) as whole from trace"),
)
def lossless_int_mixed(spark, sf_dir):
    values = _trace(spark, sf_dir).select(trace.seconds(F.col("end_us")).alias("free"))
    return runs.lossless_int(values)


@query(
    "significance_stars",
    with_views(
        "trace",
        body="""select seq, case when p <= 0.0005 then '***' when p <= 0.005 then '**' when p <= 0.05 then '*' else '' end
                  as stars from (select seq, (seq % 1000) / 10000.0::double as p from trace)""",
    ),
)
def significance_stars(spark, sf_dir):
    p = F.pmod("seq", F.lit(1000)).cast("double") / F.lit(10000.0)
    return _trace(spark, sf_dir).select("seq", fl.stars(p).alias("stars"))


@query(
    "format_total",
    with_views(
        "trace",
        t=f"select thread, {_SEC.format('sum(end_us - start_us)')} as total from trace group by thread",
        body="select thread, format('{:,}', cast(round_even(total * 100, 0) as bigint)) as shown from t",
    ),
)
def format_total(spark, sf_dir):
    totals = _trace(spark, sf_dir).groupBy("thread").agg(trace.seconds(F.sum(trace.runtime_us())).alias("total"))
    return totals.select("thread", fl.thousands(F.col("total") * 100).alias("shown"))


# -------------------------------------------------------------------- filters


@query(
    "runs_one_free_param",
    with_views("trace", body="select distinct label, run_id, cast(n_worker as double) as free from trace where rep <> 9"),
)
def runs_one_free_param(spark, sf_dir):
    found = materialize(_trace(spark, sf_dir).select("label", "run_id").distinct(), "runs")
    return runs.runs_one_free_param(found, "increment", PARAMETERS, FIXED)


@query(
    "runs_by_free_param",
    with_views("trace", body="select distinct framework, label, run_id, cast(n_worker as double) as free from trace where rep <> 9"),
)
def runs_by_free_param(spark, sf_dir):
    found = materialize(_trace(spark, sf_dir).select("framework", "label", "run_id").distinct(), "runs")
    return runs.runs_by_free_param(runs.runs_one_free_param(found, "increment", PARAMETERS, FIXED))


@query("filter_worker", with_views("trace", body="select seq, worker from trace where worker = 'node-3.local'"))
def filter_worker(spark, sf_dir):
    return trace.of_worker(_trace(spark, sf_dir), "node-3.local").select("seq", "worker")


@query(
    "same_file_events",
    with_views(
        "trace",
        body="""select seq, filename from trace where filename in
                (select filename from trace where end_us - start_us > 200000000)""",
    ),
)
def same_file_events(spark, sf_dir):
    calls = _trace(spark, sf_dir)
    long_calls = calls.where(trace.runtime_us() > 200 * trace.SECOND)
    return trace.same_file_events(calls, long_calls).select("seq", "filename")


# --------------------------------------------------------------- per function


@query(
    "avg_func_time",
    with_views(
        "trace",
        body="""select func, cast(sum(end_us - start_us) as double) / count(*) / 1000000 as runtime
                from trace group by func""",
    ),
)
def avg_func_time(spark, sf_dir):
    return trace.avg_func_time(_trace(spark, sf_dir))


@query("func_count", with_views("trace", body="select func, count(filename) as n from trace group by func"))
def func_count(spark, sf_dir):
    return trace.func_count(_trace(spark, sf_dir))


@query(
    "func_total",
    with_views("shown", body=f"select func, {_SEC.format('sum(end_us - start_us)')} as runtime from shown group by func"),
)
def func_total(spark, sf_dir):
    return trace.func_total(_shown(spark, sf_dir)).orderBy("func")


@query("sorted_functions", with_views("trace", body="select distinct func from trace order by func"))
def sorted_functions(spark, sf_dir):
    return trace.sorted_functions(_trace(spark, sf_dir))


@query(
    "distinct_values",
    with_views(
        "trace",
        body="""select 'worker' as kind, worker as value from trace union
                select 'thread', cast(thread as varchar) from trace union select 'func', func from trace""",
    ),
)
def distinct_values(spark, sf_dir):
    return trace.distinct_values(_trace(spark, sf_dir))


@query(
    "union_traces",
    with_views(
        "trace",
        body="""select seq, func from (select * from trace where framework = 'spark' union all
                select * from trace where n_worker = 4)""",
    ),
)
def union_traces(spark, sf_dir):
    calls = _trace(spark, sf_dir)
    both = trace.union_traces(calls.where("framework = 'spark'"), calls.where("n_worker = 4"))
    return both.select("seq", "func")


# ---------------------------------------------------------------- concurrency

_ACTIVE = """
    select framework, n_worker, rep, active, count(distinct thread) as threads
    from (select framework, n_worker, rep, thread, case when i = 99 then e else b + i * ((e - b) / 99) end as active
          from (select framework, n_worker, rep, thread, unnest(range(0, 100)) as i,
                       round_even(cast(start_us as double) / 1000000, 0) as b,
                       round_even(cast(end_us as double) / 1000000, 0) as e from shown))
    group by framework, n_worker, rep, active"""


@query(
    "concurrency",
    with_views(
        "shown", a=_ACTIVE,
        body="""select framework, n_worker, rep, threads, count(*) as points, min(active) as first, max(active) as last
                from a group by all""",
    ),
)
def concurrency(spark, sf_dir):
    points = trace.concurrency(_shown(spark, sf_dir), RUN)
    return points.groupBy(*RUN, "threads").agg(
        F.count(F.lit(1)).alias("points"), F.min("active").alias("first"), F.max("active").alias("last")
    )


@query(
    "concurrency_summary",
    with_views(
        "shown", a=_ACTIVE,
        body="""select framework, n_worker, rep, count(*) as count, avg(threads) as mean,
                  round(stddev_samp(threads), 9) as std, min(threads) as min,
                  cast(quantile_cont(threads, 0.25) as double) as p25, cast(quantile_cont(threads, 0.5) as double) as p50,
                  cast(quantile_cont(threads, 0.75) as double) as p75, max(threads) as max
                from a group by framework, n_worker, rep""",
    ),
)
def concurrency_summary(spark, sf_dir):
    summary = trace.concurrency_summary(trace.concurrency(_shown(spark, sf_dir), RUN), RUN)
    return summary.withColumn("std", F.round("std", 9))


# ---------------------------------------------------------------- idle, waste

_LANES = """select framework, n_worker, rep, worker, thread, sum(end_us - start_us) as r, max(end_us) as m
            from shown where worker is not null and thread is not null
            group by framework, n_worker, rep, worker, thread"""
_RUN_SQL = "framework, n_worker, rep"


@query(
    "thread_busy",
    with_views("shown", g=_LANES, body=f"select {_RUN_SQL}, worker, thread, cast(r as bigint) as busy_us, m as last_us from g"),
)
def thread_busy(spark, sf_dir):
    return trace.thread_busy(_shown(spark, sf_dir), RUN)


@query("cores_used", with_views("shown", g=_LANES, body=f"select {_RUN_SQL}, count(*) as cores from g group by {_RUN_SQL}"))
def cores_used(spark, sf_dir):
    return trace.cores_used(_shown(spark, sf_dir), RUN)


@query(
    "wasted_time",
    with_views(
        "shown", g=_LANES,
        body=f"select {_RUN_SQL}, {_SEC.format('(max(m) * count(*) - sum(r))')} as wasted from g group by {_RUN_SQL}",
    ),
)
def wasted_time(spark, sf_dir):
    return trace.wasted_time(_shown(spark, sf_dir), RUN)


@query(
    "idle_time",
    with_views("shown", g=_LANES, body=f"select {_RUN_SQL}, {_SEC.format('sum(m - r)')} as idle from g group by {_RUN_SQL}"),
)
def idle_time(spark, sf_dir):
    return trace.idle_time(_shown(spark, sf_dir), RUN)


@query(
    "makespan",
    with_views("trace", body=f"select {_RUN_SQL}, {_SEC.format('max(end_us)')} as makespan from trace group by {_RUN_SQL}"),
)
def makespan(spark, sf_dir):
    return trace.makespan(_trace(spark, sf_dir), RUN)


@query(
    "trace_extent",
    with_views(
        "trace",
        body=f"""select {_SEC.format('max(end_us)')} as x_limit, count(distinct (worker, thread)) as lanes from trace""",
    ),
)
def trace_extent(spark, sf_dir):
    return trace.trace_extent(_trace(spark, sf_dir))


# -------------------------------------------------------------------- reports

_METRICS = {
    "g": _LANES,
    "metric": f"""
        select {_RUN_SQL}, '{{kind}}' as metric, {{value}} as us from g group by {_RUN_SQL}
        union all select {_RUN_SQL}, func, sum(end_us - start_us) from shown group by {_RUN_SQL}, func""",
}


def _metric_views(kind: str) -> dict[str, str]:
    value = {"idle": "sum(m - r)", "wasted": "max(m) * count(*) - sum(r)"}[kind]
    return {"g": _METRICS["g"], "metric": _METRICS["metric"].format(kind=kind, value=value)}


def _metrics(spark, sf_dir, kind="idle"):
    return trace.metric_rows(_shown(spark, sf_dir), RUN, kind)


_STATS = """
    select framework, n_worker, metric, round(avg(us) / 1000000, 6) as mean,
      round(stddev_pop(us) / 1000000, 6) as std,
      row_number() over (partition by framework, n_worker
                         order by case when metric in ('idle', 'wasted') then 0 else 1 end, metric) - 1 as position
    from metric group by framework, n_worker, metric"""


def _rounded(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query("stacked_stats", with_views("shown", **_metric_views("idle"), body=_STATS))
def stacked_stats(spark, sf_dir):
    return _rounded(runs.stacked_stats(_metrics(spark, sf_dir), ["framework", "n_worker"]), "mean", "std")


@query("stacked_stats_wasted", with_views("shown", **_metric_views("wasted"), body=_STATS))
def stacked_stats_wasted(spark, sf_dir):
    return _rounded(runs.stacked_stats(_metrics(spark, sf_dir, "wasted"), ["framework", "n_worker"]), "mean", "std")


@query(
    "stacked_totals",
    with_views(
        "shown", **_metric_views("idle"),
        s="select framework, n_worker, metric, avg(us) / 1000000 as mean from metric group by all",
        body="select framework, n_worker, round(sum(mean), 6) as total from s group by all",
    ),
)
def stacked_totals(spark, sf_dir):
    by = ["framework", "n_worker"]
    return _rounded(runs.stacked_totals(runs.stacked_stats(_metrics(spark, sf_dir), by), by), "total")


@query(
    "run_totals",
    with_views("shown", **_metric_views("idle"), body=f"select {_RUN_SQL}, {_SEC.format('sum(us)')} as total from metric group by {_RUN_SQL}"),
)
def run_totals(spark, sf_dir):
    return runs.run_totals(_metrics(spark, sf_dir), RUN)


@query(
    "max_height",
    with_views(
        "shown", **_metric_views("idle"),
        s="select framework, n_worker, metric, avg(us) / 1000000 as mean from metric group by all",
        body="select round(max(t), 6) as max_height from (select sum(mean) as t from s group by framework, n_worker)",
    ),
)
def max_height(spark, sf_dir):
    by = ["framework", "n_worker"]
    totals = runs.stacked_totals(runs.stacked_stats(_metrics(spark, sf_dir), by), by)
    return _rounded(runs.max_height(totals), "max_height")


@query(
    "makespan_stats",
    with_views(
        "trace", m=f"select {_RUN_SQL}, max(end_us) as us from trace group by {_RUN_SQL}",
        body="""select framework, n_worker, round(avg(us) / 1000000, 6) as mean,
                  round(stddev_pop(us) / 1000000, 6) as std from m group by framework, n_worker""",
    ),
)
def makespan_stats(spark, sf_dir):
    ends = _trace(spark, sf_dir).groupBy(*RUN).agg(F.max("end_us").alias("us"))
    return _rounded(runs.makespan_stats(ends, ["framework", "n_worker"]), "mean", "std")


# The p-value integrates the tail of Student's t by Simpson's rule, after t = sqrt(df) tan(a).
_WELCH = {
    "tot": f"select {_RUN_SQL}, {_SEC.format('sum(us)')} as total from metric group by {_RUN_SQL}",
    "st": """select n_worker, framework, avg(total) as m, var_samp(total) / count(*) as q, count(*) as n
             from tot group by n_worker, framework""",
    "w": """select a.n_worker, a.framework as "left", b.framework as "right", (a.m - b.m) / sqrt(a.q + b.q) as t,
              (a.q + b.q) * (a.q + b.q) / (a.q * a.q / (a.n - 1) + b.q * b.q / (b.n - 1)) as df
            from st a join st b on a.n_worker = b.n_worker and a.framework = 'dask' and b.framework = 'spark'""",
    "p": """select n_worker, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * sum(
                case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end
                * pow(cos(a + i * h), df - 1)) * h / 3 as p
            from (select *, (pi() / 2 - a) / 2000 as h from
                  (select *, atan(abs(t) / sqrt(df)) as a, unnest(range(0, 2001)) as i from w))
            group by n_worker, df, h""",
}


@query(
    "welch_ttest",
    with_views(
        "shown", **_metric_views("idle"), **_WELCH,
        body="""select n_worker, "left", "right", round(t, 6) as t, round(df, 6) as df, round(p, 6) as p,
                  case when p <= 0.0005 then '***' when p <= 0.005 then '**' when p <= 0.05 then '*' else '' end as stars
                from w join p using (n_worker)""",
    ),
)
def welch_ttest(spark, sf_dir):
    totals = runs.run_totals(_metrics(spark, sf_dir), RUN)
    return _rounded(runs.welch_ttest(totals, ["n_worker"]), "t", "df", "p")


# ---------------------------------------------------------------------- lanes

_W = """select worker, min(seq) as first_seq, row_number() over (order by min(seq)) as number
        from trace group by worker"""
_T = """select worker, thread, min(seq) as first_seq,
          row_number() over (partition by worker order by min(seq)) as thread_number
        from trace group by worker, thread"""
_L = """select worker, thread, thread_number, 'worker' || lpad(cast(number as varchar), 2, '0') as worker_name,
          'worker' || lpad(cast(number as varchar), 2, '0') || '::thread' || cast(thread_number as varchar) as lane
        from t join w using (worker)"""


@query(
    "worker_ordinal",
    with_views("trace", w=_W, body="select *, 'worker' || lpad(cast(number as varchar), 2, '0') as worker_name from w"),
)
def worker_ordinal(spark, sf_dir):
    return lanes.worker_ordinal(_trace(spark, sf_dir))


@query("thread_ordinal", with_views("trace", body=_T))
def thread_ordinal(spark, sf_dir):
    return lanes.thread_ordinal(_trace(spark, sf_dir))


@query("lane_label", with_views("trace", w=_W, t=_T, body=_L))
def lane_label(spark, sf_dir):
    return lanes.lane_table(lanes.first_calls(_trace(spark, sf_dir)))


@query("lane_sort", with_views("trace", w=_W, t=_T, l=_L, body="select * from l order by worker_name, thread_number"))
def lane_sort(spark, sf_dir):
    return lanes.lane_sort(lanes.lane_table(lanes.first_calls(_trace(spark, sf_dir))))


@query(
    "map_thread_number",
    with_views("trace", t=_T, body="select seq, thread_number from trace join t using (worker, thread)"),
)
def map_thread_number(spark, sf_dir):
    calls = _trace(spark, sf_dir)
    return trace.with_thread_number(calls, lanes.thread_ordinal(calls)).select("seq", "thread_number")


_G = """select lane, 1.5::double * (row_number() over (order by worker_name, thread_number) - 1)
          + 16.0::double * (dense_rank() over (order by worker_name) - 1) as bottom from l"""


@query("gantt_lanes", with_views("trace", w=_W, t=_T, l=_L, g=_G, body="select lane, bottom, bottom + 1 as top from g"))
def gantt_lanes(spark, sf_dir):
    return lanes.gantt_lanes(lanes.lane_table(lanes.first_calls(_trace(spark, sf_dir)))).select("lane", "bottom", "top")


_FLAT = {
    "named": "select seq, thread, split_part(replace(substr(worker, strpos(worker, '-') + 1), '-', ''), '.', 1) as worker_name from trace",
    "t": """select worker_name, thread, row_number() over (partition by worker_name order by min(seq)) as thread_number
            from named group by worker_name, thread""",
    "i": "select *, row_number() over (order by worker_name desc, thread_number) - 1 as i from t",
}


@query(
    "gantt_lanes_flat",
    with_views(
        "trace", **_FLAT,
        body="""select worker_name || '::thread' || cast(thread_number as varchar) as lane, i - 0.5::double as bottom,
                  i - 0.5::double + 1 as top from i""",
    ),
)
def gantt_lanes_flat(spark, sf_dir):
    flat = lanes.gantt_lanes_flat(lanes.flat_lane_table(_trace(spark, sf_dir)))
    return flat.select("lane", "bottom", "top")


_COLORS = "select func, (row_number() over (order by func) - 1) % 8 as color from (select distinct func from shown)"


@query("func_color_index", with_views("shown", body=_COLORS))
def func_color_index(spark, sf_dir):
    return lanes.func_color_index(_shown(spark, sf_dir))
