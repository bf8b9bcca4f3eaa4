"""Composite jobs: from a folder of images, or of traces, to results on storage.

``run`` holds what only names a run (node count, block size, …): it goes to the run label and
changes no computation.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork import schemas
from brickwork.operators import clustering, cohort, lanes, participants, runs, slabs, trace, voxels
from brickwork.session import materialize
from brickwork.sources import listing, nifti, traces


@dataclass
class Run:
    """Names of a run and the folder that takes its trace; without a folder nothing is logged."""

    label: Mapping[str, object] = field(default_factory=dict)
    trace_folder: str | None = None

    def origin(self) -> float | None:
        return time.time() if self.trace_folder else None

    def log(self, app: str, written: DataFrame, own: Sequence[dict] = (), **params: object) -> None:
        """Append the calls gathered by a job, in the column ``calls`` of what its tasks stored, and the driver's ``own``."""
        if not self.trace_folder:
            return
        pairs = {**self.label, **params}
        label = ":".join(["spark", app, *(f"{k}={v}" for k, v in pairs.items())])
        calls = slabs.call_rows(written)
        if own:
            calls = calls.unionByName(written.sparkSession.createDataFrame(list(own), schemas.CALL))
        named = calls.withColumn("label", F.lit(label)).withColumn("run_id", F.lit(str(uuid.uuid4())))
        traces.write_trace(named, self.trace_folder)


def _status(written: DataFrame, blocks: DataFrame) -> DataFrame:
    """Status of all images; for one that could not be read, what was wrong with it."""
    unread = blocks.where(F.col("error").isNotNull()).select("path", F.col("error").alias("status"))
    return nifti.write_status(written).unionByName(unread)


def increment_job(
    spark: SparkSession, source: str, target: str, iterations: int = 1, amount: int = 1, run: Run | None = None
) -> DataFrame:
    """Add a constant to all images; returns ``(path, status)``. Map-only: no shuffle of voxels."""
    run = run or Run()
    origin = run.origin()
    blocks = nifti.block_table(spark, source)
    ranges = nifti.plane_ranges(blocks)
    # Additions of constants collapse into one; a traced run keeps one call per iteration.
    once = [slabs.increment_step(amount * iterations)]
    steps = once if origin is None else [slabs.increment_step(amount, origin) for _ in range(iterations)]
    written = nifti.rewrite_ranges(ranges, target, *steps, origin=origin)
    run.log("increment", written, iterations=iterations)
    return _status(written, blocks)


def multi_increment_job(
    spark: SparkSession,
    source: str,
    target: str,
    iterations: int = 1,
    seed: int = 1234,
    policy: str = "per_block",
    draws: DataFrame | None = None,
    run: Run | None = None,
) -> DataFrame:
    """Add randomly drawn original images to every image; returns ``(path, status)``.

    ``draws(block_id, it, donor)`` replaces the seeded draw; images are numbered in path order.

    Only file metadata is joined. A task takes the same planes of many images, so a donor that several of them drew is
    read there once; equal draws are one addition by a factor.
    """
    run = run or Run()
    origin = run.origin()
    blocks = nifti.block_table(spark, source)
    voxels.require_one_shape(blocks.where(F.col("error").isNull()))
    good = listing.block_ordinal(blocks.where(F.col("error").isNull()).drop("block_id"))
    entry = "array<struct<path:string,its:array<bigint>>>"
    if iterations > 0:
        if draws is None:
            draws = voxels.assign_donors(good.select("block_id"), iterations, seed, policy)
        draws = draws.where(F.col("it") < iterations)
        if "block_id" not in draws.columns:
            # One row per iteration, so this array is as long as the parameter says.
            pairs = F.array(*[F.struct(F.lit(r.it).alias("it"), F.lit(r.donor).alias("donor")) for r in draws.collect()])
            draws = good.select("block_id", F.inline(pairs).alias("it", "donor"))
        # At most ``iterations`` entries per block.
        times = draws.groupBy("block_id", "donor").agg(F.sort_array(F.collect_list(F.col("it").cast("bigint"))).alias("its"))
        named = times.join(good.select(F.col("block_id").alias("donor"), "path"), "donor")
        lists = named.groupBy("block_id").agg(F.collect_list(F.struct("path", "its")).alias("donors"))
        good = good.join(lists, "block_id", "left")
    else:
        good = good.withColumn("donors", F.lit(None).cast(entry))
    plan = materialize(good, "plan")
    if nifti.target_of(spark, target).in_place:
        ranges = nifti.shared_ranges(plan)
    else:  # parts are written in the order of their planes, so each image is read for itself
        ranges = nifti.plane_ranges(plan).withColumn("group", F.col("block_id"))
    written = nifti.rewrite_ranges(ranges, target, origin=origin, read=nifti.shared_step(origin))
    run.log("multi-increment", written, iterations=iterations, seed=seed)
    return _status(written, blocks)


def histogram_job(spark: SparkSession, source: str, target: str, unreadable: str = "raise", run: Run | None = None) -> DataFrame:
    """Dense histogram of all images, also written as ``histogram.csv``.

    An image that can't be read ends the job, unless ``unreadable`` is ``"skip"``.
    """
    run = run or Run()
    origin = run.origin()
    ranges = nifti.plane_ranges(nifti.complete(nifti.block_table(spark, source), unreadable))
    counts, calls = _partials(slabs.range_counts(ranges, origin), origin)
    own, began = [], time.time()
    bins = slabs.bin_frequency(slabs.merge_counts(counts))
    total = materialize(voxels.dense_histogram(bins), "histogram")
    if origin is not None:
        own.append(nifti.call("combine_histogram", "all_file", began, origin))
    began = time.time()
    traces.write_histogram(total, target)
    if origin is not None:
        own.append(nifti.call("save_histogram", "all_file", began, origin))
        run.log("histogram", calls, own)
    return total


def _partials(partials: DataFrame, origin: float | None) -> tuple[DataFrame, DataFrame | None]:
    """Partial results of a reducing step, and its calls where the run is traced."""
    return (partials, None) if origin is None else slabs.traced(partials)


def kmeans_job(
    spark: SparkSession, source: str, target: str, count: int = 3, iterations: int = 3, run: Run | None = None
) -> tuple[list[float], DataFrame]:
    """Cluster the intensities of all images and write label images; two scans in all."""
    run = run or Run()
    origin = run.origin()
    blocks = nifti.block_table(spark, source)
    ranges = nifti.plane_ranges(blocks)
    counts, calls = _partials(slabs.range_counts(ranges, origin), origin)
    own: list[dict] = []
    note = None if origin is None else lambda func, began: own.append(nifti.call(func, "all", began, origin))
    centroids = clustering.fit_frequency(slabs.merge_counts(counts), count, iterations, note)
    label = slabs.classify_step(centroids, origin)
    written = nifti.rewrite_ranges(ranges, target, label, prefix="classified-", origin=origin)
    if origin is not None:
        first = calls.select(F.filter("calls", lambda c: c["func"] == "load").alias("calls"))
        run.log("kmeans", written.select("calls").unionByName(first), own, iterations=iterations)
    return centroids, _status(written, blocks)


def cohort_job(spark: SparkSession, source: str, threshold: int, run: Run | None = None) -> tuple[DataFrame, DataFrame]:
    """Volumes per image and, over participants, means per site of a tree ``<site>/sub-<id>/…``."""
    run = run or Run()
    origin = run.origin()
    blocks = nifti.block_table(spark, source, recursive=True)
    partial, calls = _partials(slabs.range_volumes(nifti.plane_ranges(blocks), threshold, origin), origin)
    unread = blocks.where(F.col("error").isNotNull()).select(
        "block_id", F.lit(None).cast("bigint").alias("volume"), "error"
    )
    images = listing.subject_images(blocks, listing.qualified(spark, source))
    ids = blocks.select("path", F.col("block_id").alias("image_id"))
    volumes = cohort.participant_volume(images.join(ids, "path"), slabs.merge_volumes(partial).unionByName(unread))
    stored = materialize(volumes, "volumes")
    means = cohort.site_mean_volume(stored)
    if origin is not None:
        began = time.time()
        means = materialize(means, "means")
        run.log("bids", calls, [nifti.call("run_group", "all_file", began, origin)])
    return stored, means


def participant_job(
    spark: SparkSession,
    source: str,
    function: participants.Function,
    schema: T.StructType | str,
    group: participants.GroupFunction | None = None,
    group_schema: T.StructType | str | None = None,
    run: Run | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Run ``function`` on every participant of a tree ``<site>/sub-<id>/…`` and then ``group`` on every site.

    Returns the results per participant and per site, with ``error`` where a function, or an image, failed.
    """
    run = run or Run()
    origin = run.origin()
    blocks = nifti.block_table(spark, source, recursive=True)
    images = listing.subject_images(blocks, listing.qualified(spark, source)).join(blocks, "path")
    done = materialize(participants.per_participant(images, function, schema, origin), "participants")
    calls, sites = done.select("calls"), None
    if group is not None:
        sites = materialize(participants.per_site(done.drop("calls"), group, group_schema, origin), "sites")
        calls = calls.unionByName(sites.select("calls"))
    run.log("bids", calls)
    return done.drop("calls"), None if sites is None else sites.drop("calls")


@dataclass
class Report:
    """Tables behind a stacked-bar comparison of runs."""

    stats: DataFrame
    totals: DataFrame
    tests: DataFrame


def run_report(
    calls: DataFrame,
    app: str,
    parameters: Sequence[str],
    fixed: Mapping[str, object],
    overhead: str | Callable[[DataFrame, Sequence[str]], DataFrame] = "idle",
    pre_process: Callable[[DataFrame], DataFrame] | None = None,
    catalog: DataFrame | None = None,
    func_remap: Callable[[DataFrame], DataFrame] = trace.with_shown_func,
) -> Report:
    """Where the time of runs went, per framework and value of the free parameter.

    ``calls`` is a trace with ``label`` and ``run_id``; ``func_remap`` names its functions for the report and
    ``pre_process`` is any change of it after that; ``overhead`` is as in :func:`brickwork.operators.trace.metric_rows`;
    ``catalog`` is the run catalogue, where one is at hand.
    """
    chosen = runs.calls_one_free_param(calls, app, parameters, fixed, catalog)
    shown = trace.with_effective_thread(chosen.transform(func_remap))
    shown = shown.transform(pre_process) if pre_process else shown
    by = ["framework", "free", "run_id"]
    metrics = materialize(trace.metric_rows(shown, by, overhead), "run_metrics")
    stats = runs.stacked_stats(metrics)
    tests = runs.welch_ttest(runs.run_totals(metrics, by))
    return Report(stats, runs.stacked_totals(stats), tests)


def makespan_report(
    calls: DataFrame,
    app: str,
    parameters: Sequence[str],
    fixed: Mapping[str, object],
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Mean and deviation of the makespan, per framework and value of the free parameter."""
    chosen = runs.calls_one_free_param(calls, app, parameters, fixed, catalog)
    ends = chosen.groupBy("framework", "free", "run_id").agg(F.max("end_us").alias("us"))
    return runs.makespan_stats(ends)


def lane_report(
    calls: DataFrame,
    by: Sequence[str] = (),
    pre_process: Callable[[DataFrame], DataFrame] | None = None,
    func_remap: Callable[[DataFrame], DataFrame] = trace.with_shown_func,
) -> DataFrame:
    """Calls with lane, vertical place, colour number and runtime, ready to be drawn.

    ``func_remap`` and ``pre_process`` change the trace as in :func:`run_report`. Calls without worker or thread stay,
    with an empty lane.
    """
    schemas.require_columns(calls, "seq", "framework", "worker", "process", *by)
    shown = trace.with_effective_thread(calls.transform(func_remap))
    shown = shown.transform(pre_process) if pre_process else shown
    firsts = lanes.first_calls(shown, by)
    placed = materialize(lanes.gantt_lanes(lanes.lane_table(firsts, by), by), "lanes")
    keyed = shown.join(lanes.broadcast_if_small(placed), [*by, "worker", "thread"], "left")
    colored = keyed.join(lanes.broadcast_if_small(lanes.func_color_index(firsts)), "func", "left")
    return trace.with_runtime(colored)
