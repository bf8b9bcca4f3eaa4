"""Queries on voxels, blocks, clusters and cohorts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from brickwork.catalog.base import query, with_views
from brickwork.functions.batches import chain, unpack
from brickwork.operators import clustering, cohort, folds, slabs, voxels
from brickwork.sources import images, listing, nifti, tables, traces
from brickwork.session import scratch_path

THRESHOLD = 32767
CHUNK_BYTES = 26

# k-means unrolled: three iterations from evenly spaced start centroids.
_KS = "select unnest(range(0, 3)) as k"
_START = """
    select k, case k when 2 then cast(hi as double) else lo + k * ((cast(hi as double) - lo) / 2) end as c
    from ks cross join (select min(v) as lo, max(v) as hi from f)"""


def _kmeans_views(source: str, iterations: int = 3) -> dict[str, str]:
    views = {"f": f"select v, count(*) as n from {source} group by v", "ks": _KS, "c0": _START}
    for i in range(iterations):
        views[f"d{i}"] = f"select f.v, f.n, c.k, (f.v - c.c) * (f.v - c.c) as d from f cross join c{i} c"
        views[f"r{i}"] = f"select v, n, k, row_number() over (partition by v order by d, k) as rn from d{i}"
        views[f"s{i}"] = (
            f"select k, cast(sum(v * n) as double) as s, cast(sum(n) as double) as n from r{i} where rn = 1 group by k"
        )
        views[f"c{i + 1}"] = (
            f"select ks.k, coalesce(s.s, 0) / greatest(coalesce(s.n, 0), 1) as c from ks left join s{i} s on ks.k = s.k"
        )
    return views


def _label_views(source: str, iterations: int = 3) -> dict[str, str]:
    """Label of every intensity under the final centroids."""
    return _kmeans_views(source, iterations) | {
        "lab": f"""select v, arg_min(k, {{'d': (v - c) * (v - c), 'k': k}}) as label
                   from f cross join c{iterations} group by v"""
    }


def _joined(values):
    return F.array_join(values, ",")


def _centroids(spark, sf_dir):
    return clustering.fit(tables.voxels(spark, sf_dir).select("v"))


# ---------------------------------------------------------------- projections


@query("increment", with_views("voxel", body="select block_id, pos, (v + 1) % 65536 as v from voxel"))
def increment(spark, sf_dir):
    return voxels.increment(tables.voxels(spark, sf_dir)).select("block_id", "pos", "v")


@query("increment_iter", with_views("voxel", body="select block_id, pos, (v + 25 * 3000) % 65536 as v from voxel"))
def increment_iter(spark, sf_dir):
    return voxels.increment(tables.voxels(spark, sf_dir), 3000, 25).select("block_id", "pos", "v")


@query("flatten", with_views("voxel", body="select block_id, pos, x, y, z, v from voxel"))
def flatten(spark, sf_dir):
    return voxels.flatten(tables.blocks(spark, sf_dir))


@query(
    "rechunk",
    with_views(
        "voxel",
        n="select block_id, pos, v, (128 + 25) // 26 as n from voxel",
        p="""select block_id, v, pos,
             case when pos < (64 % n) * (64 // n + 1) then pos // (64 // n + 1)
                  else 64 % n + (pos - (64 % n) * (64 // n + 1)) // (64 // n) end as chunk from n""",
        body="""select block_id, chunk, count(*) as n, string_agg(cast(v as varchar), ',' order by pos) as v
                from p group by block_id, chunk""",
    ),
)
def rechunk(spark, sf_dir):
    chunks = voxels.rechunk(tables.blocks(spark, sf_dir), CHUNK_BYTES)
    return chunks.select("block_id", "chunk", F.size("v").cast("bigint").alias("n"), _joined("v").alias("v"))


@query(
    "slab_split",
    with_views(
        "voxel",
        body="""select block_id, x, string_agg(cast(v as varchar), ',' order by pos) as v
                from voxel group by block_id, x""",
    ),
)
def slab_split(spark, sf_dir):
    return voxels.slab_split(tables.blocks(spark, sf_dir)).select("block_id", "x", _joined("v").alias("v"))


@query("linspace_centroids", with_views("flat_voxel", **_kmeans_views("flat_voxel", 0), body="select k, c from c0"))
def linspace_centroids(spark, sf_dir):
    return clustering.linspace_centroids(voxels.extent(tables.flat_voxels(spark, sf_dir)), 3)


@query(
    "sq_distance",
    with_views(
        "voxel", **_kmeans_views("voxel", 0),
        body="select block_id, pos, k, (v - c) * (v - c) as d from voxel cross join c0",
    ),
)
def sq_distance(spark, sf_dir):
    rows = tables.voxels(spark, sf_dir)
    start = clustering.centroid_values(clustering.linspace_centroids(voxels.extent(rows), 3))
    return voxels.squared_distances(rows, start)


@query(
    "nearest_label",
    with_views(
        "voxel", **_label_views("voxel", 0), body="select block_id, pos, label from voxel join lab using (v)"
    ),
)
def nearest_label(spark, sf_dir):
    rows = tables.voxels(spark, sf_dir)
    start = clustering.centroid_values(clustering.linspace_centroids(voxels.extent(rows), 3))
    return clustering.classify(rows, start).select("block_id", "pos", "label")


@query(
    "array_add",
    with_views(
        "voxel", "donor",
        body="""select a.block_id, d.donor, string_agg(cast((a.v + b.v) % 65536 as varchar), ',' order by a.pos) as v
                from voxel a join donor d on a.block_id = d.block_id and d.it = 0
                join voxel b on b.block_id = d.donor and b.pos = a.pos group by a.block_id, d.donor""",
    ),
)
def array_add(spark, sf_dir):
    given = tables.donors(spark, sf_dir, 1).select("block_id", "donor")
    added = voxels.add_blocks(tables.blocks(spark, sf_dir), given)
    return added.select("block_id", "donor", _joined("v").alias("v"))


@query(
    "add_affine",
    with_views("block", body="select block_id, '0,0,1,0;0,1,0,0;1,0,0,0;0,0,0,1' as affine from block"),
)
def add_affine(spark, sf_dir):
    placed = voxels.with_affine(tables.blocks(spark, sf_dir), voxels.AXIS_REVERSAL)
    rows = F.transform("affine", lambda row: F.array_join(F.transform(row, lambda a: a.cast("int").cast("string")), ","))
    return placed.select("block_id", F.array_join(rows, ";").alias("affine"))


# ------------------------------------------------------------------ histogram

_BINNED = "select block_id, least(v, 65534) as bin, count(*) as n from flat_voxel group by all"
_DENSE = """select s.bin, cast(coalesce(h.n, 0) as bigint) as n
            from (select unnest(range(0, 65535)) as bin) s left join h on s.bin = h.bin"""


@query("block_histogram", with_views("flat_voxel", body=_BINNED))
def block_histogram(spark, sf_dir):
    return voxels.block_histogram(tables.flat_voxels(spark, sf_dir))


@query(
    "merge_histogram",
    with_views("flat_voxel", p=_BINNED, body="select bin, cast(sum(n) as bigint) as n from p group by bin"),
)
def merge_histogram(spark, sf_dir):
    return voxels.merge_histograms(voxels.block_histogram(tables.flat_voxels(spark, sf_dir)))


@query(
    "histogram",
    with_views("flat_voxel", h="select least(v, 65534) as bin, count(*) as n from flat_voxel group by 1", body=_DENSE),
)
def histogram(spark, sf_dir):
    return voxels.histogram(tables.flat_voxels(spark, sf_dir))


@query(
    "histogram_slabs",
    with_views("plane", h="select least(v, 65534) as bin, count(*) as n from plane group by 1", body=_DENSE),
)
def histogram_slabs(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir)
    return voxels.dense_histogram(slabs.bin_frequency(slabs.slab_frequency(planes)))


@query("voxel_extent", with_views("flat_voxel", body="select min(v) as lo, max(v) as hi from flat_voxel"))
def voxel_extent(spark, sf_dir):
    return voxels.extent(tables.flat_voxels(spark, sf_dir))


@query("chunk_count", "select 5 * count(*) as n from embeddings")
def chunk_count(spark, sf_dir):
    return voxels.chunk_total(voxels.rechunk(tables.blocks(spark, sf_dir), CHUNK_BYTES))


# ----------------------------------------------------------------- clustering


@query("intensity_frequency", with_views("flat_voxel", body="select v, count(*) as n from flat_voxel group by v"))
def intensity_frequency(spark, sf_dir):
    return clustering.intensity_frequency(tables.flat_voxels(spark, sf_dir))


@query(
    "cluster_stats",
    with_views(
        "flat_voxel", **_kmeans_views("flat_voxel", 1), body="select k, cast(s as bigint) as s, cast(n as bigint) as n from s0"
    ),
)
def cluster_stats(spark, sf_dir):
    rows = tables.flat_voxels(spark, sf_dir)
    start = clustering.centroid_values(clustering.linspace_centroids(voxels.extent(rows), 3))
    return clustering.cluster_stats(clustering.intensity_frequency(rows), start)


@query("update_centroids", with_views("flat_voxel", **_kmeans_views("flat_voxel", 1), body="select k, c from c1"))
def update_centroids(spark, sf_dir):
    return clustering.update_centroids(cluster_stats(spark, sf_dir), 3)


@query("kmeans", with_views("flat_voxel", **_kmeans_views("flat_voxel"), body="select k, c from c3"))
def kmeans(spark, sf_dir):
    return clustering.centroid_table(spark, clustering.fit(tables.flat_voxels(spark, sf_dir)))


@query("kmeans_slabs", with_views("plane", **_kmeans_views("plane"), body="select k, c from c3"))
def kmeans_slabs(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir)
    return clustering.centroid_table(spark, clustering.fit_frequency(slabs.slab_frequency(planes)))


_CLASSIFIED = with_views(
    "voxel", **_label_views("voxel"), body="select block_id, pos, v, label from voxel join lab using (v)"
)


@query("kmeans_classify", _CLASSIFIED)
def kmeans_classify(spark, sf_dir):
    rows = tables.voxels(spark, sf_dir).select("block_id", "pos", "v")
    return clustering.classify(rows, _centroids(spark, sf_dir))


@query("zip_positional", with_views("voxel", **_label_views("voxel"), body="select pos, v, label from voxel join lab using (v)"))
def zip_positional(spark, sf_dir):
    rows = tables.voxels(spark, sf_dir).select("pos", "v")
    return clustering.classify(rows, _centroids(spark, sf_dir))


@query("assign_cross", _CLASSIFIED)
def assign_cross(spark, sf_dir):
    rows = tables.voxels(spark, sf_dir).select("block_id", "pos", "v")
    return clustering.classify_by_table(rows, clustering.centroid_table(spark, _centroids(spark, sf_dir)))


@query(
    "nearest_row_per_centroid",
    with_views(
        "voxel", **_kmeans_views("voxel"),
        body="""select block_id, x, z, k, arg_min(y, {'d': (v - c) * (v - c), 'y': y}) as y
                from voxel cross join c3 group by block_id, x, z, k""",
    ),
)
def nearest_row_per_centroid(spark, sf_dir):
    return clustering.nearest_row_per_centroid(tables.blocks(spark, sf_dir), _centroids(spark, sf_dir))


@query(
    "nearest_row_per_centroid_slabs",
    with_views(
        "plane", **_kmeans_views("plane"),
        body="""select block_id, x, z, k, arg_min(y, {'d': (v - c) * (v - c), 'y': y}) as y
                from plane cross join c3 group by block_id, x, z, k""",
    ),
)
def nearest_row_per_centroid_slabs(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir)
    return slabs.slab_nearest_rows(planes, clustering.fit_frequency(slabs.slab_frequency(planes)))


# ------------------------------------------------------- blocks and donors


@query("lookup_block", with_views("voxel", body="select block_id, pos, v from voxel where block_id = 7"))
def lookup_block(spark, sf_dir):
    return voxels.lookup_block(tables.voxels(spark, sf_dir), 7).select("block_id", "pos", "v")


@query("sample_block", with_views("block", body="select block_id, path, len(v) as n from block order by path limit 1"))
def sample_block(spark, sf_dir):
    first = voxels.sample_block(tables.blocks(spark, sf_dir))
    return first.select("block_id", "path", F.size("v").cast("bigint").alias("n"))


@query("stack_blocks", with_views("voxel", body="select block_id * 64 + pos as pos, v from voxel"))
def stack_blocks(spark, sf_dir):
    return voxels.stack_blocks(tables.blocks(spark, sf_dir))


@query(
    "block_ordinal",
    with_views("block", body="select path, row_number() over (order by path) - 1 as block_id from block"),
)
def block_ordinal(spark, sf_dir):
    return listing.block_ordinal(tables.blocks(spark, sf_dir).select("path"))


@query(
    "donor_assignment",
    """select block_id, it, cast('0x' || left(md5('1234-' || it || '-' || block_id), 15) as bigint)
         % (select count(*) from embeddings) as donor
       from (select vec_id as block_id, unnest(range(0, 3)) as it from embeddings)""",
)
def donor_assignment(spark, sf_dir):
    return voxels.assign_donors(tables.blocks(spark, sf_dir).select("block_id"), 3, 1234)


@query(
    "multi_increment_per_iteration",
    with_views(
        "voxel",
        d="""select it, (it * 17 + 1234) % (select count(*) from embeddings) as donor
             from (select unnest(range(0, 3)) as it)""",
        a="select v.pos, sum(v.v) as s from d join voxel v on v.block_id = d.donor group by v.pos",
        body="select block_id, pos, cast((v + s) % 65536 as bigint) as v from voxel join a using (pos)",
    ),
)
def multi_increment_per_iteration(spark, sf_dir):
    draws = tables.iteration_donors(spark, sf_dir)
    return voxels.multi_increment_per_iteration(tables.voxels(spark, sf_dir), draws)


@query(
    "multi_increment_per_block",
    with_views(
        "voxel", "donor",
        a="""select d.block_id, v.pos, sum(v.v) as s from donor d join voxel v on v.block_id = d.donor
             group by d.block_id, v.pos""",
        body="select block_id, pos, cast((v + s) % 65536 as bigint) as v from voxel join a using (block_id, pos)",
    ),
)
def multi_increment_per_block(spark, sf_dir):
    return voxels.multi_increment_per_block(tables.voxels(spark, sf_dir), tables.donors(spark, sf_dir))


@query(
    "multi_increment_blocks",
    with_views(
        "voxel", "donor",
        a="""select d.block_id, v.pos, sum(v.v) as s from donor d join voxel v on v.block_id = d.donor
             group by d.block_id, v.pos""",
        body="""select block_id, string_agg(cast((v + s) % 65536 as varchar), ',' order by pos) as v
                from voxel join a using (block_id, pos) group by block_id""",
    ),
)
def multi_increment_blocks(spark, sf_dir):
    added = voxels.multi_increment_blocks(tables.blocks(spark, sf_dir), tables.donors(spark, sf_dir))
    return added.select("block_id", _joined("v").alias("v"))


# --------------------------------------------------------------------- cohort

_VOLUMES = f"select block_id, count(*) filter (where v > {THRESHOLD}) as volume from voxel group by block_id"


@query("site_list", with_views("image", body="select distinct site from image"))
def site_list(spark, sf_dir):
    return listing.site_list(tables.images(spark, sf_dir))


@query("subject_list", with_views("image", body="select distinct site, subject from image"))
def subject_list(spark, sf_dir):
    return listing.subject_list(tables.images(spark, sf_dir))


@query(
    "participant_volume",
    with_views(
        "voxel", "image", vol=_VOLUMES,
        body="select site, subject, image_id, volume from image join vol on image_id = block_id",
    ),
)
def participant_volume(spark, sf_dir):
    counted = cohort.block_volume(tables.voxels(spark, sf_dir), THRESHOLD)
    volumes = cohort.participant_volume(tables.images(spark, sf_dir), counted)
    return volumes.select("site", "subject", "image_id", "volume")


@query(
    "site_mean_volume",
    with_views(
        "voxel", "image", vol=_VOLUMES,
        body="""select site, cast(sum(volume) as double) / count(*) as mean_volume, count(*) as images
                from image join vol on image_id = block_id group by site""",
    ),
)
def site_mean_volume(spark, sf_dir):
    counted = cohort.block_volume(tables.voxels(spark, sf_dir), THRESHOLD)
    return cohort.site_mean_volume(cohort.participant_volume(tables.images(spark, sf_dir), counted))


@query("subject_list_below_root", with_views("image", body="select distinct site, subject from image"))
def subject_list_below_root(spark, sf_dir):
    # A folder above the root looks like a subject too.
    moved = tables.images(spark, sf_dir).withColumn("path", F.concat(F.lit("file:/data/sub-all/x"), "path"))
    return listing.subject_list(moved, "/data/sub-all/x/cohort")


_PARTICIPANTS = """
    select site, cast(image_id // 2 as varchar) as subject, cast(sum(volume) as double) / count(*) as volume, count(*) as images
    from image join vol on image_id = block_id group by 1, 2"""


def _two_images_each(spark, sf_dir):
    images = tables.images(spark, sf_dir).withColumn("subject", F.floor(F.col("image_id") / 2).cast("string"))
    counted = cohort.block_volume(tables.voxels(spark, sf_dir), THRESHOLD)
    return cohort.participant_volume(images, counted)


@query("subject_volume", with_views("voxel", "image", vol=_VOLUMES, body=_PARTICIPANTS))
def subject_volume(spark, sf_dir):
    return cohort.subject_volume(_two_images_each(spark, sf_dir)).drop("unread")


@query(
    "site_mean_of_participants",
    with_views(
        "voxel", "image", vol=_VOLUMES, p=_PARTICIPANTS,
        body="select site, sum(volume) / count(*) as mean_volume, cast(sum(images) as bigint) as images from p group by site",
    ),
)
def site_mean_of_participants(spark, sf_dir):
    return cohort.site_mean_volume(_two_images_each(spark, sf_dir))


@query(
    "slab_volume",
    with_views("plane", body=f"select block_id, count(*) filter (where v > {THRESHOLD}) as volume from plane group by block_id"),
)
def slab_volume(spark, sf_dir):
    return slabs.slab_volume(tables.slabs(spark, sf_dir), THRESHOLD).select("block_id", "volume")


def _sketch():
    """Least and greatest intensity, counts of 256 bins, and which intensities occur: states that don't add up."""

    def zero():
        return 65536, -1, np.zeros(256, np.int64), np.zeros(8192, np.uint8)

    def add(state, batch):
        values = unpack(batch)[0]
        seen = np.zeros(65536, bool)
        seen[values] = True
        one = (int(values.min()), int(values.max()), np.bincount(values >> 8, minlength=256), np.packbits(seen))
        return merge(state, one) if len(values) else state

    def merge(a, b):
        return min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] | b[3]

    def finish(state):
        lo, hi, bins, seen = state
        n = int(bins.sum())
        median = int(np.searchsorted(np.cumsum(bins), (n + 1) // 2))
        return {"lo": lo, "hi": hi, "n": n, "median_bin": median, "distinct": int(np.unpackbits(seen).sum())}

    return zero, add, merge, finish


_SKETCH = "lo bigint, hi bigint, n bigint, median_bin bigint, distinct bigint"
_MEDIAN = """select {0} min(v) as lo, max(v) as hi, count(*) as n,
    cast(list_sort(list(v // 256))[(count(*) + 1) // 2] as bigint) as median_bin, count(distinct v) as distinct from plane {1}"""


@query("fold_per_block", with_views("plane", body=_MEDIAN.format("block_id,", "group by block_id")))
def fold_per_block(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir).select("block_id", "payload")
    return folds.fold(planes, *_sketch(), _SKETCH, by=["block_id"])


@query("fold_all", with_views("plane", body=_MEDIAN.format("", "")))
def fold_all(spark, sf_dir):
    return folds.fold(tables.slabs(spark, sf_dir).select("payload"), *_sketch(), _SKETCH, fan_in=2)


@query("map_blocks", with_views("plane", body="select block_id, (x * 8 + y) * depth + z as pos, x, y, z, 65535 - v as v from plane"))
def map_blocks(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir)
    return slabs.flatten_slabs(chain(planes, planes.schema, slabs.change_step("invert", lambda v: 65535 - v)))


# ----------------------------------------------------------------- filters


@query("suffix_filter", "select url as path from pages where url like '%.html'")
def suffix_filter(spark, sf_dir):
    return listing.suffix_filter(tables.table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ".html")


@query("basename", with_views("block", body="select path, 'block-' || cast(block_id as varchar) || '.nii' as name from block"))
def basename(spark, sf_dir):
    return tables.blocks(spark, sf_dir).select("path", listing.fl.basename(F.col("path")).alias("name"))


# ----------------------------------------------------------------- image files


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark, sf_dir, name, write):
    """Folder of input files that ``write(folder)`` makes the first time an application asks for them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        folder = scratch_path(spark, name).removeprefix("file:")
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def _files(spark, sf_dir):
    """The planes of the table as image files in a shared folder."""
    return written_once(spark, sf_dir, "images", lambda folder: nifti.write_blocks(tables.slabs(spark, sf_dir), folder))


def cohort_files(spark, sf_dir):
    """The same images as a tree of sites and subjects."""
    return written_once(spark, sf_dir, "cohort", lambda folder: nifti.write_blocks(tables.cohort_slabs(spark, sf_dir), folder, below="/data"))


_SIZES = "select name, 352 + 2 * count(*) as length from plane group by name"


@query("list_blocks", with_views("plane", s=_SIZES, body="select name, length from s"))
def list_blocks(spark, sf_dir):
    found = listing.list_blocks(spark, _files(spark, sf_dir))
    return found.select(listing.fl.basename(F.col("path")).alias("name"), "length")


@query("list_blocks_recursive", with_views("plane", s=_SIZES, body="select name, length from s"))
def list_blocks_recursive(spark, sf_dir):
    found = listing.list_blocks(spark, cohort_files(spark, sf_dir), recursive=True)
    return found.select(listing.fl.basename(F.col("path")).alias("name"), "length")


_PLANE_VOXELS = "select block_id, (x * 8 + y) * depth + z as pos, x, y, z, {} as v from plane"


@query("block_scan", with_views("plane", body=_PLANE_VOXELS.format("v")))
def block_scan(spark, sf_dir):
    return slabs.flatten_slabs(nifti.scan_blocks(spark, _files(spark, sf_dir)))


@query("block_scan_filtered", with_views("plane", body=_PLANE_VOXELS.format("v") + " where name like '%1.nii' and z between 1 and 3"))
def block_scan_filtered(spark, sf_dir):
    planes = images.read(spark, _files(spark, sf_dir))
    return slabs.flatten_slabs(planes.where(F.col("path").endswith("1.nii") & F.col("slab").between(1, 3)))


@query("block_write_source", with_views("plane", body=_PLANE_VOXELS.format("v")))
def block_write_source(spark, sf_dir):
    folder = scratch_path(spark, "source").removeprefix("file:")
    images.write(tables.slabs(spark, sf_dir), folder, shared=True)
    return slabs.flatten_slabs(images.read(spark, folder))


@query("write_blocks", with_views("plane", body="select distinct name, 'SUCCESS' as status from plane"))
def write_blocks(spark, sf_dir):
    folder = scratch_path(spark, "out").removeprefix("file:")
    done = nifti.write_blocks(tables.slabs(spark, sf_dir), folder)
    return done.select(listing.fl.basename(F.col("path")).alias("name"), "status")


@query(
    "write_classified",
    with_views("plane", body="select distinct 'classified-' || name as name, 'SUCCESS' as status from plane"),
)
def write_classified(spark, sf_dir):
    planes = tables.slabs(spark, sf_dir)
    centroids = clustering.fit_frequency(slabs.slab_frequency(planes))
    folder = scratch_path(spark, "classified").removeprefix("file:")
    done = nifti.write_classified(slabs.classify_slabs(planes, centroids), folder)
    return done.select(listing.fl.basename(F.col("path")).alias("name"), "status")


@query(
    "write_histogram",
    with_views("flat_voxel", h="select least(v, 65534) as bin, count(*) as n from flat_voxel group by 1", body=_DENSE),
)
def write_histogram(spark, sf_dir):
    folder = scratch_path(spark, "histogram")
    traces.write_histogram(voxels.histogram(tables.flat_voxels(spark, sf_dir)), folder)
    return spark.read.option("sep", ";").schema("bin bigint, n bigint").csv(f"{folder}/histogram.csv")
