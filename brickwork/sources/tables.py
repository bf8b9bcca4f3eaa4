"""Views that give the star-schema test tables the shapes the operators take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from brickwork import schemas
from brickwork.functions.batches import chain, column, pack
from brickwork.functions.intensity import LEVELS
from brickwork.sources import nifti

#: Every 64-long vector is one 4x4x4 block.
SIDE = 4
#: In the slab form, vectors are the 8x8 planes of images of at most this depth.
PLANE_SIDE, MAX_DEPTH = 8, 64
FRAMEWORKS, NODES = ("spark", "dask"), (2, 4, 8)
ORIGIN = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels without position ``(block_id, v)``."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(16)).cast("bigint").alias("block_id"),
        F.pmod(F.floor("l_extendedprice"), F.lit(LEVELS).cast("bigint")).alias("v"),
    )


def _intensity(e):
    return F.floor((e.cast("double") + 1.0) * 32767.5)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array per block ``(block_id, path, dims, v)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("block_id"),
        F.concat(F.lit("/data/block-"), F.col("vec_id").cast("string"), F.lit(".nii")).alias("path"),
        F.array(*[F.lit(SIDE).cast("bigint")] * 3).alias("dims"),
        F.transform("embedding", _intensity).alias("v"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per voxel ``(block_id, pos, x, y, z, v)``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    side, pos = F.lit(SIDE), F.col("i").cast("bigint")
    return rows.select(
        F.col("vec_id").alias("block_id"),
        pos.alias("pos"),
        F.floor(pos / (side * side)).alias("x"),
        F.pmod(F.floor(pos / side), side.cast("bigint")).alias("y"),
        F.pmod(pos, side.cast("bigint")).alias("z"),
        _intensity(F.col("e")).alias("v"),
    )


def donors(spark: SparkSession, sf_dir: str, iterations: int = 3) -> DataFrame:
    """Arithmetic donor table ``(block_id, it, donor)``, the same in every engine."""
    base = table(spark, sf_dir, "embeddings")
    ids = base.select(F.col("vec_id").alias("block_id"))
    steps = ids.withColumn("it", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))))
    count = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    return steps.withColumn("donor", F.pmod(F.col("block_id") * 31 + F.col("it") * 17 + 1234, count))


def iteration_donors(spark: SparkSession, sf_dir: str, iterations: int = 3) -> DataFrame:
    """Arithmetic donor table with one draw per iteration, ``(it, donor)``."""
    count = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    steps = spark.range(iterations).select(F.col("id").alias("it"))
    return steps.withColumn("donor", F.pmod(F.col("it") * 17 + 1234, count))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort ``(site, subject, image_id, path)``."""
    site = F.concat(F.lit("site-"), F.col("label").cast("string"))
    subject = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        site.alias("site"),
        subject.alias("subject"),
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("/cohort/"), site, F.lit("/sub-a-"), subject, F.lit("/anat/T1w.nii")).alias("path"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run traces of 2 frameworks x 3 node counts x 10 repetitions."""
    e = table(spark, sf_dir, "events")
    event = F.col("event_id")
    func = (
        F.when(F.col("event_type") == "error", "load")
        .when(F.col("event_type") == "click", "increment")
        .when(F.col("event_type") == "view", "calculate_histogram")
        .when(F.col("event_type") == "purchase", "dump")
        .otherwise("combine_histogram")
    )
    start = F.expr(f"timestampdiff(MICROSECOND, {ORIGIN}, ts)")
    half, third = F.pmod(event, F.lit(2)), F.pmod(F.floor(event / 2), F.lit(3).cast("bigint"))
    rep = F.pmod(F.floor(event / 6), F.lit(10).cast("bigint"))
    labels = [
        f"{framework}:increment:n_worker={nodes}:block_size='5000':iterations={iterations}:delay=1.0"
        for framework in FRAMEWORKS
        for nodes in NODES
        for iterations in (5, 25)
    ]
    # A constant list keeps the label cheap where filters on it are pushed down to the scan.
    which = half * 6 + third * 2 + F.when(rep == 9, 1).otherwise(0)
    return e.select(
        event.alias("seq"),
        func.alias("func"),
        start.alias("start_us"),
        (start + F.round(F.col("value") * 1000000).cast("bigint")).alias("end_us"),
        F.concat(F.lit("file-"), F.pmod(event, F.lit(50)).cast("string"), F.lit(".nii")).alias("filename"),
        F.concat(F.lit("node-"), F.pmod("user_id", F.lit(8)).cast("string"), F.lit(".local")).alias("worker"),
        F.col("user_id").alias("thread"),
        F.pmod("user_id", F.lit(32)).cast("bigint").alias("process"),
        _pick(FRAMEWORKS, half).alias("framework"),
        _pick(NODES, third).cast("bigint").alias("n_worker"),
        rep.alias("rep"),
        _pick(labels, which).alias("label"),
    ).withColumn("run_id", F.concat_ws("-", "framework", "n_worker", "rep"))


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def slab_depth(spark: SparkSession, sf_dir: str) -> int:
    """Greatest image depth that gives all images the same shape."""
    n = table(spark, sf_dir, "embeddings").count()
    return max(d for d in range(1, MAX_DEPTH + 1) if n % d == 0)


def slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed planes: vector ``i`` is plane ``i % depth`` of image ``i // depth``."""
    depth = slab_depth(spark, sf_dir)
    dims = [PLANE_SIDE, PLANE_SIDE, depth]
    header = nifti.new_header(dims)
    block = F.floor(F.col("vec_id") / depth)
    parts = table(spark, sf_dir, "embeddings").select(
        block.alias("block_id"),
        F.format_string("/data/image-%08d.nii", block).alias("path"),
        F.pmod("vec_id", F.lit(depth)).alias("slab"),
        "embedding",
    )
    arrow = to_arrow_schema(schemas.SLAB)
    same = {"dims": dims, "header": header, "affine": nifti.affine_of(header), "calls": [], "error": None}

    def pack_rows(batches):
        for batch in batches:
            lists = column(batch, "embedding")
            values = np.floor((lists.flatten().to_numpy().astype(float) + 1.0) * 32767.5).astype("<u2")
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            rows = {n: column(batch, n) for n in ("block_id", "path", "slab")}
            rows |= {n: [v] * len(batch) for n, v in same.items()} | {"payload": pack(values, starts)}
            yield pa.RecordBatch.from_pydict({n: rows[n] for n in arrow.names}, schema=arrow)

    return chain(parts, schemas.SLAB, pack_rows)


def cohort_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same planes as a cohort: image ``b`` belongs to site ``b % 5`` and subject ``b``."""
    block = F.col("block_id").cast("string")
    site = F.pmod("block_id", F.lit(5)).cast("string")
    path = F.concat(
        F.lit("/data/site-"), site, F.lit("/sub-a-"), block, F.lit("/anat/"), F.substring_index("path", "/", -1)
    )
    return slabs(spark, sf_dir).withColumn("path", path)
