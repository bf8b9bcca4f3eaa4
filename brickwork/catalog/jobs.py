"""Queries that run whole jobs, over image files and traces made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog import traces as ct
from brickwork.catalog import voxels as cv
from brickwork.catalog.base import query, with_views
from brickwork.operators import slabs
from brickwork.plans import jobs
from brickwork.session import scratch_path
from brickwork.sources import nifti, tables, traces


def _new_folder(spark, name):
    return scratch_path(spark, name).removeprefix("file:")


def _scanned(spark, folder):
    return slabs.flatten_slabs(nifti.scan_blocks(spark, folder))


@query("increment_job", with_views("plane", body=cv._PLANE_VOXELS.format("(v + 3 * 20000) % 65536")))
def increment_job(spark, sf_dir):
    target = _new_folder(spark, "incremented")
    jobs.increment_job(spark, cv._files(spark, sf_dir), target, iterations=3, amount=20000)
    return _scanned(spark, target)


@query(
    "multi_increment_job",
    with_views(
        "plane",
        n="select count(distinct block_id) as n from plane",
        d="""select block_id, it, (block_id * 31 + it * 17 + 1234) % n as donor
             from (select distinct block_id, unnest(range(0, 3)) as it from plane) cross join n""",
        a="""select d.block_id, x, y, z, sum(v) as s from d join plane p on p.block_id = d.donor
             group by d.block_id, x, y, z""",
        body="""select p.block_id, (x * 8 + y) * depth + z as pos, x, y, z, cast((v + s) % 65536 as bigint) as v
                from plane p join a using (block_id, x, y, z)""",
    ),
)
def multi_increment_job(spark, sf_dir):
    target = _new_folder(spark, "multi")
    ids = tables.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / tables.slab_depth(spark, sf_dir)).alias("block_id")
    ).distinct()
    count = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = ids.withColumn("it", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).withColumn(
        "donor", F.pmod(F.col("block_id") * 31 + F.col("it") * 17 + 1234, count)
    )
    jobs.multi_increment_job(spark, cv._files(spark, sf_dir), target, iterations=3, draws=draws)
    return _scanned(spark, target)


@query(
    "multi_increment_job_seeded",
    with_views(
        "plane",
        n="select count(distinct block_id) as n from plane",
        d="select it, cast('0x' || left(md5('1234-' || it), 15) as bigint) % n as donor from n cross join (select unnest(range(0, 2)) as it)",
        a="select x, y, z, sum(v) as s from d join plane p on p.block_id = d.donor group by x, y, z",
        body="""select p.block_id, (x * 8 + y) * depth + z as pos, x, y, z, cast((v + s) % 65536 as bigint) as v
                from plane p join a using (x, y, z)""",
    ),
)
def multi_increment_job_seeded(spark, sf_dir):
    target = _new_folder(spark, "multi")
    jobs.multi_increment_job(spark, cv._files(spark, sf_dir), target, 2, policy="per_iteration")
    return _scanned(spark, target)


@query(
    "histogram_job",
    with_views("plane", h="select least(v, 65534) as bin, count(*) as n from plane group by 1", body=cv._DENSE),
)
def histogram_job(spark, sf_dir):
    return jobs.histogram_job(spark, cv._files(spark, sf_dir), _new_folder(spark, "histogram"))


@query(
    "kmeans_job",
    with_views(
        "plane", **cv._label_views("plane"),
        body="select block_id, (x * 8 + y) * depth + z as pos, x, y, z, label as v from plane join lab using (v)",
    ),
)
def kmeans_job(spark, sf_dir):
    target = _new_folder(spark, "classified")
    jobs.kmeans_job(spark, cv._files(spark, sf_dir), target)
    return _scanned(spark, target)


_COHORT = f"""
    select 'site-' || cast(block_id % 5 as varchar) as site, cast(block_id as varchar) as subject,
      count(*) filter (where v > {cv.THRESHOLD}) as volume from plane group by block_id"""


def _cohort(spark, sf_dir):
    return jobs.cohort_job(spark, cv.cohort_files(spark, sf_dir), cv.THRESHOLD)


@query("cohort_job", with_views("plane", body=_COHORT))
def cohort_job(spark, sf_dir):
    return _cohort(spark, sf_dir)[0].select("site", "subject", "volume")


@query(
    "cohort_job_sites",
    with_views(
        "plane", c=_COHORT,
        body="select site, cast(sum(volume) as double) / count(*) as mean_volume, count(*) as images from c group by site",
    ),
)
def cohort_job_sites(spark, sf_dir):
    return _cohort(spark, sf_dir)[1]


@query(
    "cohort_job_participants",
    with_views(
        "plane", c=_COHORT,
        p="""select site, cast(subject as bigint) // 10 as subject, cast(sum(volume) as double) / count(*) as volume,
             count(*) as images from c group by 1, 2""",
        body="select site, sum(volume) / count(*) as mean_volume, cast(sum(images) as bigint) as images from p group by site",
    ),
)
def cohort_job_participants(spark, sf_dir):
    # Up to two images per participant, below a folder whose name looks like a subject's.
    source = _new_folder(spark, "cohort")
    subject = F.regexp_replace("path", r"/sub-a-(\d*?)\d/", "/sub-a-$1/")
    nifti.write_blocks(tables.cohort_slabs(spark, sf_dir).withColumn("path", subject), source + "/sub-all/set", below="/data")
    return jobs.cohort_job(spark, source + "/sub-all/set", cv.THRESHOLD)[1]


def _participant(person):
    """Foreground, number and maximum of a participant's voxels, a plane at a time."""
    volume, voxels, brightest = 0, 0, 0
    for image in person.images:
        for planes in image.planes(1):
            volume, voxels = volume + int((planes > cv.THRESHOLD).sum()), voxels + planes.size
            brightest = max(brightest, int(planes.max()))
    return {"volume": volume, "voxels": voxels, "brightest": brightest}


def _site(site, rows):
    volumes = [r["volume"] for r in rows]
    return {"participants": len(volumes), "mean_volume": sum(volumes) / len(volumes)}


def _participants(spark, sf_dir, run=None):
    source = cv.cohort_files(spark, sf_dir)
    result, group = "volume bigint, voxels bigint, brightest bigint", "participants bigint, mean_volume double"
    return jobs.participant_job(spark, source, _participant, result, _site, group, run)


@query(
    "per_participant",
    with_views(
        "plane",
        body=f"""select 'site-' || cast(block_id % 5 as varchar) as site, cast(block_id as varchar) as subject,
                   count(*) filter (where v > {cv.THRESHOLD}) as volume, count(*) as voxels, max(v) as brightest,
                   cast(null as varchar) as error from plane group by block_id""",
    ),
)
def per_participant(spark, sf_dir):
    return _participants(spark, sf_dir)[0]


@query(
    "per_site",
    with_views(
        "plane", c=_COHORT,
        body="""select site, count(*) as participants, cast(sum(volume) as double) / count(*) as mean_volume,
                  cast(null as varchar) as error from c group by site""",
    ),
)
def per_site(spark, sf_dir):
    return _participants(spark, sf_dir)[1]


def _emitted(app, images, whole=(), parameters="", named="name"):
    """SQL for the calls of one application: some per image, some under one name for all."""
    label = f"'spark:{app}:n_worker=4{parameters}' as label"
    parts = [f"select {label}, cast({named if f == 'run_participant' else 'name'} as varchar) as filename, '{f}' as func from plane" for f in images]
    return parts + [f"select {label}, '{name}' as filename, '{f}' as func" for f, name in whole]


@query(
    "trace_emit",
    with_views(
        "plane",
        e=" union ".join(
            _emitted("increment", ["load", "increment", "dump"], parameters=":iterations=2")
            + _emitted("multi-increment", ["load", "increment", "dump"], parameters=":iterations=1:seed=1234")
            + _emitted("histogram", ["load", "flatten", "calculate_histogram"], [("combine_histogram", "all_file"), ("save_histogram", "all_file")])
            + _emitted("kmeans", ["load", "classify_block", "dump"], [("get_labels", "all"), ("update_centroids", "all")], ":iterations=3")
            + _emitted("bids", ["load", "run_participant"], [("run_group", "all_file")], named="block_id")
        ),
        body="select label, filename, func, true as ok from e",
    ),
)
def trace_emit(spark, sf_dir):
    logs, images = _new_folder(spark, "logs"), cv._files(spark, sf_dir)
    run = jobs.Run({"n_worker": 4}, logs)
    jobs.increment_job(spark, images, _new_folder(spark, "traced"), iterations=2, run=run)
    ids = nifti.block_table(spark, images).select("block_id")
    draws = ids.select("block_id", F.lit(0).cast("bigint").alias("it"), F.pmod(F.col("block_id") + 1, ids.agg(F.count(F.lit(1))).scalar()).alias("donor"))
    jobs.multi_increment_job(spark, images, _new_folder(spark, "traced"), 1, draws=draws, run=run)
    jobs.histogram_job(spark, images, _new_folder(spark, "traced"), run=run)
    jobs.kmeans_job(spark, images, _new_folder(spark, "traced"), run=run)
    jobs.cohort_job(spark, cv.cohort_files(spark, sf_dir), cv.THRESHOLD, run)
    calls = traces.scan_traces(spark, logs)
    sound = F.bool_and((F.col("end_us") >= F.col("start_us")) & F.col("worker").isNotNull() & (F.col("process") > 0))
    return calls.groupBy("label", "filename", "func").agg(sound.alias("ok"))


_CHOSEN = {"chosen": "select *, cast(n_worker as double) as free from shown where rep <> 9"}
_LONG = {
    "g": """select framework, free, rep, worker, thread, sum(end_us - start_us) as r, max(end_us) as m
            from chosen group by all""",
    "metric": """select framework, free, rep, 'idle' as metric, sum(m - r) as us from g group by framework, free, rep
                 union all select framework, free, rep, func, sum(end_us - start_us) from chosen
                 group by framework, free, rep, func""",
}


def _report(spark, sf_dir):
    return jobs.run_report(tables.trace(spark, sf_dir), "increment", ct.PARAMETERS, ct.FIXED)


@query("run_report", with_views("shown", **_CHOSEN, **_LONG, body=ct._STATS.replace("n_worker", "free")))
def run_report(spark, sf_dir):
    return ct._rounded(_report(spark, sf_dir).stats, "mean", "std")


@query(
    "run_report_tests",
    with_views(
        "shown", **_CHOSEN, **_LONG,
        **{k: v.replace("n_worker", "free") for k, v in ct._WELCH.items()},
        body="""select free, "left", "right", round(t, 6) as t, round(df, 6) as df, round(p, 6) as p,
                  case when p <= 0.0005 then '***' when p <= 0.005 then '**' when p <= 0.05 then '*' else '' end as stars
                from w join p using (free)""",
    ),
)
def run_report_tests(spark, sf_dir):
    return ct._rounded(_report(spark, sf_dir).tests, "t", "df", "p")


@query(
    "makespan_report",
    with_views(
        "trace",
        m="""select framework, cast(n_worker as double) as free, rep, max(end_us) as us from trace where rep <> 9
             group by all""",
        body="""select framework, free, round(avg(us) / 1000000, 6) as mean, round(stddev_pop(us) / 1000000, 6) as std
                from m group by framework, free""",
    ),
)
def makespan_report(spark, sf_dir):
    report = jobs.makespan_report(tables.trace(spark, sf_dir), "increment", ct.PARAMETERS, ct.FIXED)
    return ct._rounded(report, "mean", "std")


@query(
    "lane_report",
    with_views(
        "shown", w=ct._W.replace("from trace", "from shown"), t=ct._T.replace("from trace", "from shown"), l=ct._L,
        g="""select *, 1.5::double * (row_number() over (order by worker_name, thread_number) - 1)
             + 16.0::double * (dense_rank() over (order by worker_name) - 1) as bottom from l""",
        c=ct._COLORS,
        body="""select seq, func, lane, bottom, bottom + 1 as top, color,
                  cast(end_us - start_us as double) / 1000000 as runtime
                from shown join g using (worker, thread) join c using (func)""",
    ),
)
def lane_report(spark, sf_dir):
    report = jobs.lane_report(tables.trace(spark, sf_dir))
    return report.select("seq", "func", "lane", "bottom", "top", "color", "runtime")
