"""Image and trace files, and the jobs over them."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.operators import slabs, voxels
from brickwork.plans import jobs
from brickwork.session import ship_package
from brickwork.sources import listing, nifti, traces

S = 1_000_000


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def write_image(path, array, kind="<u2", code=512, slope=0.0, inter=0.0, offset=352, affine=None):
    """Independent writer: public header layout, first axis fastest."""
    order = kind[0] if kind[0] in "<>" else "<"
    header = bytearray(nifti.HEADER_BYTES)
    struct.pack_into(order + "i", header, 0, 348)
    struct.pack_into(order + "8h", header, 40, 3, *array.shape, 1, 1, 1, 1)
    struct.pack_into(order + "2h", header, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into(order + "8f", header, 76, 1, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into(order + "3f", header, 108, offset, slope, inter)
    if affine is not None:
        struct.pack_into(order + "h", header, 254, 1)
        struct.pack_into(order + "12f", header, 280, *np.asarray(affine)[:3].ravel())
    header[148:152] = b"note"
    header[344:348] = b"n+1\0"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(bytes(header) + bytes(offset - 348) + array.astype(kind).ravel(order="F").tobytes())


def read_image(path):
    raw = open(path, "rb").read()
    order = "<" if raw[:4] == struct.pack("<i", 348) else ">"
    shape = struct.unpack_from(order + "3h", raw, 42)
    assert struct.unpack_from(order + "2h", raw, 70) == (512, 16)
    return np.frombuffer(raw, order + "u2", offset=352).reshape(shape, order="F"), raw[:348]


def random_images(folder, n, shape=(3, 5, 4), seed=0):
    rng = np.random.default_rng(seed)
    arrays = [rng.integers(0, 65536, shape).astype(np.uint16) for _ in range(n)]
    for i, a in enumerate(arrays):
        write_image(f"{folder}/b{i:02d}.nii", a)
    return arrays


def as_array(spark, folder, shape):
    out = {}
    for r in slabs.flatten_slabs(nifti.scan_blocks(spark, folder)).collect():
        out.setdefault(r.block_id, np.zeros(shape, np.int64))[r.x, r.y, r.z] = r.v
        assert r.pos == np.ravel_multi_index((r.x, r.y, r.z), shape)
    return out


@pytest.mark.parametrize(
    "kind,code,slope,inter", [("<u2", 512, 0, 0), (">u2", 512, 0, 0), ("<i2", 4, 1, 0), ("<f4", 16, 0, 0), ("u1", 2, 2.5, 1.25), ("<f8", 64, 0.5, 3)]
)
def test_scan(spark, tmp_path, kind, code, slope, inter):
    stored = np.random.default_rng(5).integers(0, 200, (3, 5, 7)).astype(kind)
    if kind.endswith(("f4", "f8")):
        stored = stored + np.array(0.75, kind)
    write_image(f"{tmp_path}/a.nii", stored, kind, code, slope, inter, offset=400)
    expected = (stored * float(slope) + float(inter) if slope not in (0, 1) else stored).astype(np.uint16)
    assert (as_array(spark, str(tmp_path), stored.shape)[0] == expected).all()


def test_scan_splits_files_into_ranges(spark, tmp_path):
    arrays = random_images(tmp_path, 2, (4, 4, 9))
    ranges = nifti.plane_ranges(nifti.block_table(spark, str(tmp_path)), split_bytes=4 * 4 * 2 * 2)
    rows = sorted((r.block_id, r.first, r["count"]) for r in ranges.collect())
    assert rows == [(b, f, min(2, 9 - f)) for b in (0, 1) for f in range(0, 9, 2)]
    assert slabs.range_frequency(ranges).agg(F.sum("n")).first()[0] == sum(a.size for a in arrays)


def test_affines(spark, tmp_path):
    own = [[2, 0, 0, -1], [0, 3, 0, -2], [0, 0, 4, -3], [0, 0, 0, 1]]
    array = np.zeros((3, 5, 7), np.uint16)
    write_image(f"{tmp_path}/a.nii", array, affine=own)
    write_image(f"{tmp_path}/b.nii", array)
    found = [r.affine for r in nifti.block_table(spark, str(tmp_path)).orderBy("path").collect()]
    assert found[0] == own
    assert found[1] == [[-2, 0, 0, 2], [0, 3, 0, -6], [0, 0, 4, -12], [0, 0, 0, 1]]


def test_bad_files_carry_an_error(spark, tmp_path):
    random_images(tmp_path, 1)
    (tmp_path / "short.nii").write_bytes(b"x" * 20)
    write_image(f"{tmp_path}/cut.nii", np.zeros((2, 2, 2), np.uint16))
    with open(tmp_path / "cut.nii", "r+b") as f:
        f.truncate(355)
    write_image(f"{tmp_path}/odd.nii", np.zeros((2, 2, 2), np.uint16), code=999)
    errors = {listing_name(r.path): r.error for r in nifti.block_table(spark, str(tmp_path)).collect()}
    assert errors.pop("b00.nii") is None and len(errors) == 3 and all(errors.values())


def listing_name(path):
    return path.rsplit("/", 1)[-1]


@pytest.mark.parametrize("kind", ["<u2", ">u2"])
def test_write_keeps_header_and_replaces_old_files(spark, tmp_path, kind):
    array = np.random.default_rng(6).integers(0, 65536, (3, 5, 7)).astype(np.uint16)
    write_image(f"{tmp_path}/in/a.nii", array, kind)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.nii").write_bytes(b"old" * 1000)
    for _ in range(2):  # a repeated write stores the same file
        status = nifti.write_blocks(nifti.scan_blocks(spark, f"{tmp_path}/in"), f"{tmp_path}/out").collect()
        assert [tuple(r) for r in status] == [(f"{tmp_path}/out/a.nii", "SUCCESS")]
        found, header = read_image(f"{tmp_path}/out/a.nii")
        assert (found == array).all() and header[148:152] == b"note"


def test_missing_planes_are_reported(spark, tmp_path):
    random_images(f"{tmp_path}/in", 1)
    planes = nifti.scan_blocks(spark, f"{tmp_path}/in").where("slab <> 2")
    assert nifti.write_blocks(planes, f"{tmp_path}/out").first().status == "INCOMPLETE"
    streamed = nifti.write_planes(planes, f"{tmp_path}/out2", in_place=False)
    assert nifti.write_status(streamed).first().status == "INCOMPLETE"
    assert (tmp_path / "out" / "b00.nii").read_bytes() == (tmp_path / "out2" / "b00.nii").read_bytes()


def test_streamed_files_equal_files_written_in_place(spark, tmp_path):
    random_images(f"{tmp_path}/in", 3, (4, 4, 9))
    write_image(f"{tmp_path}/in/big.nii", np.arange(60, dtype=np.uint16).reshape(3, 5, 4), ">u2")
    ranges = nifti.plane_ranges(nifti.block_table(spark, f"{tmp_path}/in"), split_bytes=100)
    for kept, in_place in (("a", True), ("b", False)):
        nifti.rewrite_ranges(ranges, f"{tmp_path}/{kept}", slabs.increment_step(5), in_place=in_place)
        nifti.write_planes(nifti.scan_ranges(ranges), f"{tmp_path}/{kept}2", "x-", in_place=in_place)
    for one, two in (("a", "b"), ("a2", "b2")):
        names = sorted(os.listdir(tmp_path / one))
        assert len(names) == 4 and names == sorted(os.listdir(tmp_path / two))
        assert all((tmp_path / one / n).read_bytes() == (tmp_path / two / n).read_bytes() for n in names)


def test_listing_is_one_level_unless_recursive(spark, tmp_path):
    random_images(tmp_path, 2)
    random_images(tmp_path / "deep" / "er", 1)
    (tmp_path / "c.txt").write_text("x")
    assert listing.list_blocks(spark, str(tmp_path)).count() == 2
    assert listing.list_blocks(spark, str(tmp_path), recursive=True).count() == 3


def test_trees_are_listed_by_tasks_as_the_reader_would(spark, tmp_path, monkeypatch):
    """Before, Spark's reader listed trees, and every file's status went to the driver."""
    kept = ["a.nii", "s 1/sub-1/anat/b.nii", "s 1/sub-2/c%20.nii", "x=1/d.nii", "_x=1/_y=2.nii", "_metadata/e.nii"]
    hidden = ["_f.nii", ".g.nii", "_h/i.nii", "s 1/.j/k.nii", "s 1/l.txt", "_metadata/_metadata.nii", "m._COPYING_/n.nii"]
    for name in [*kept, *hidden]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "s 1" / "empty.nii").write_bytes(b"")
    (tmp_path / "nothing").mkdir()
    os.symlink(tmp_path / "s 1", tmp_path / "linked")
    folders = [str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/s*", f"{tmp_path}/nothing"]
    read = [sorted(listing.list_files(spark, f, "*.nii", recursive=True).collect()) for f in folders]
    assert len(read[0]) == len(kept) + 2
    single = listing.list_blocks(spark, f"{tmp_path}/a.nii", recursive=True).collect()
    assert [r.path for r in single] == [f"file:{tmp_path}/a.nii"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listing.list_blocks(spark, f"{tmp_path}/missing", recursive=True)
    monkeypatch.setattr(listing, "list_files", None)
    monkeypatch.setattr(listing, "FOLDERS", 1, raising=False)
    for folder, rows in zip(folders, read):
        found = listing.list_blocks(spark, folder, recursive=True)
        assert found.columns == ["path", "length"] and sorted(found.collect()) == rows


@pytest.mark.parametrize("traced", [False, True])
def test_increment_job(spark, tmp_path, traced):
    arrays = random_images(f"{tmp_path}/in", 3)
    run = jobs.Run({"n_worker": 2}, f"{tmp_path}/logs" if traced else None)
    jobs.increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", iterations=3, amount=30000, run=run)
    for i, a in enumerate(arrays):
        assert (read_image(f"{tmp_path}/out/b{i:02d}.nii")[0] == (a.astype(int) + 90000) % 65536).all()
    if traced:
        logged = traces.scan_traces(spark, f"{tmp_path}/logs")
        assert {r.label for r in logged.collect()} == {"spark:increment:n_worker=2:iterations=3"}
        count = {r.func: r["count"] for r in logged.groupBy("func").count().collect()}
        assert count == {"load": 3, "increment": 9, "dump": 3}


@pytest.mark.parametrize("policy", ["per_block", "per_iteration"])
def test_multi_increment_job(spark, tmp_path, policy):
    arrays = random_images(f"{tmp_path}/in", 5)
    logs = jobs.Run({}, f"{tmp_path}/logs")
    done = jobs.multi_increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", 3, 7, policy, run=logs)
    assert {r.status for r in done.collect()} == {"SUCCESS"} and done.count() == 5
    ids = spark.range(5).withColumnRenamed("id", "block_id")
    draws = voxels.assign_donors(ids, 3, 7, policy).collect()
    for i, a in enumerate(arrays):
        given = [r.donor for r in draws if policy == "per_iteration" or r.block_id == i]
        expected = sum((arrays[d].astype(int) for d in given), a.astype(int)) % 65536
        assert (read_image(f"{tmp_path}/out/b{i:02d}.nii")[0] == expected).all()
    logged = traces.scan_traces(spark, f"{tmp_path}/logs").where("func = 'increment'").collect()
    assert len(logged) == 15 and all(r.filename.endswith(".nii") and ":" not in r.filename for r in logged)


def test_multi_increment_job_needs_one_shape(spark, tmp_path):
    random_images(f"{tmp_path}/in", 2)
    write_image(f"{tmp_path}/in/z.nii", np.zeros((1, 1, 1), np.uint16))
    with pytest.raises(ValueError):
        jobs.multi_increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1)


def test_multi_increment_job_without_iterations_copies(spark, tmp_path):
    arrays = random_images(f"{tmp_path}/in", 2)
    jobs.multi_increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", 0)
    assert all((read_image(f"{tmp_path}/out/b{i:02d}.nii")[0] == a).all() for i, a in enumerate(arrays))


def test_histogram_job(spark, tmp_path):
    arrays = random_images(f"{tmp_path}/in", 3)
    jobs.histogram_job(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    parts = [p for p in os.listdir(f"{tmp_path}/out/histogram.csv") if p.startswith("part-")]
    assert len(parts) == 1
    lines = open(f"{tmp_path}/out/histogram.csv/{parts[0]}").read().split()
    expected = np.histogram(np.stack(arrays), bins=range(2**16))[0]
    assert lines == [f"{i};{n}" for i, n in enumerate(expected)]


def test_jobs_on_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    total = jobs.histogram_job(spark, f"{tmp_path}/in", f"{tmp_path}/out").agg(F.sum("n"), F.count("bin")).first()
    assert tuple(total) == (0, 65_535)
    with pytest.raises(ValueError):
        jobs.kmeans_job(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert jobs.increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 0


def test_unreadable_images_show_in_the_status(spark, tmp_path):
    random_images(f"{tmp_path}/in", 2)
    (tmp_path / "in" / "x.nii").write_bytes(b"broken")
    for done in (
        jobs.increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/a"),
        jobs.multi_increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/b", 1),
        jobs.kmeans_job(spark, f"{tmp_path}/in", f"{tmp_path}/c")[1],
    ):
        status = {listing_name(r.path): r.status for r in done.collect()}
        assert "shorter" in status.pop("x.nii") and list(status.values()) == ["SUCCESS"] * 2


def test_kmeans_job(spark, tmp_path):
    from test_voxels import numpy_kmeans

    arrays = random_images(f"{tmp_path}/in", 3)
    centroids, status = jobs.kmeans_job(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert centroids == numpy_kmeans(np.stack(arrays).ravel(), 3, 3).tolist()
    assert status.where("status = 'SUCCESS'").count() == 3
    for i, a in enumerate(arrays):
        expected = np.argmin(np.square(np.subtract.outer(a.astype(float), centroids)), axis=3)
        assert (read_image(f"{tmp_path}/out/classified-b{i:02d}.nii")[0] == expected).all()


def test_cohort_job(spark, tmp_path):
    a = random_images(f"{tmp_path}/s1/sub-01-a/anat", 1, seed=1)[0]
    b = random_images(f"{tmp_path}/s1/sub-b/anat", 1, seed=2)[0]
    (tmp_path / "s2" / "sub-c").mkdir(parents=True)
    (tmp_path / "s2" / "sub-c" / "x.nii").write_bytes(b"broken")
    volumes, means = jobs.cohort_job(spark, str(tmp_path), 30000)
    found = {(r.site, r.subject): (r.volume, r.error is None) for r in volumes.collect()}
    expected = {("s1", "a"): (int((a > 30000).sum()), True), ("s1", "b"): (int((b > 30000).sum()), True), ("s2", "c"): (None, False)}
    assert found == expected
    assert [(r.site, r.mean_volume) for r in means.collect()] == [("s1", (found[("s1", "a")][0] + found[("s1", "b")][0]) / 2)]


def test_slab_volume_reports_wrong_sizes(spark, tmp_path):
    random_images(tmp_path, 2)
    planes = nifti.scan_blocks(spark, str(tmp_path))
    cut = F.when((F.col("block_id") == 1) & (F.col("slab") == 0), F.expr("substring(payload, 1, 4)")).otherwise(F.col("payload"))
    rows = {r.block_id: r for r in slabs.slab_volume(planes.withColumn("payload", cut), 0).collect()}
    assert rows[0].error is None and rows[1].volume is None and rows[1].error.startswith("1 planes")


def test_foreign_trace_layout(spark, tmp_path):
    folder = tmp_path / "benchmarks" / "spark:increment:n_worker=4:block_size='5000'"
    folder.mkdir(parents=True)
    (folder / "summary-abc.csv").write_text("load,0.5,1.25,a.nii,h,1,2\ndump,1.5,2,a.nii,h,1,2\n")
    (folder / "summary-def.csv").write_text("load,3,4,b.nii,h,9,2\n")
    found = traces.scan_summaries(spark, str(tmp_path / "benchmarks")).orderBy("seq").collect()
    assert [(r.run_id, r.func, r.start_us, r.end_us) for r in found] == [("abc", "load", S // 2, 5 * S // 4), ("abc", "dump", 3 * S // 2, 2 * S), ("def", "load", 3 * S, 4 * S)]
    assert {r.label for r in found} == {"spark:increment:n_worker=4:block_size='5000'"}
    catalogue = traces.run_catalog(traces.list_trace_files(spark, str(tmp_path / "benchmarks"))).collect()
    assert sorted((r.run_id, r.framework) for r in catalogue) == [("abc", "spark"), ("def", "spark")]


def test_report_prunes_the_folders_of_other_runs(spark, tmp_path):
    names = "func string, start_us bigint, end_us bigint, filename string, worker string, thread bigint, process bigint, label string, run_id string"
    rows = [
        ("load", 0, (n + i) * S, "x", "w", 1, 2, f"{fw}:increment:n_worker={n}:iterations={it}", f"{fw}-{n}-{it}-{i}")
        for fw in ("dask", "spark") for n in (2, 4) for it in (1, 5) for i in range(3)
    ]
    traces.write_trace(spark.createDataFrame(rows, names), f"{tmp_path}/logs")
    logs = traces.scan_traces(spark, f"{tmp_path}/logs")
    catalogue = traces.run_catalog(traces.list_trace_files(spark, f"{tmp_path}/logs"))
    report = jobs.makespan_report(logs, "increment", ["n_worker", "iterations"], {"iterations": 5}, catalogue)
    assert "dynamicpruning" in report._jdf.queryExecution().executedPlan().toString().lower()
    found = sorted((r.framework, r.free, r.mean) for r in report.collect())
    assert found == [("dask", 2.0, 3.0), ("dask", 4.0, 5.0), ("spark", 2.0, 3.0), ("spark", 4.0, 5.0)]


def test_merge_keeps_logs_and_rows(spark, tmp_path):
    rows = [("f", i * S, i * S + 1, "x", "w", 1, 2, "spark:a", "r1" if i % 3 else "r2") for i in range(300)]
    names = "func string, start_us bigint, end_us bigint, filename string, worker string, thread bigint, process bigint, label string, run_id string"
    traces.write_trace(spark.createDataFrame(rows, names).repartition(6), f"{tmp_path}/logs")
    before = listing.list_files(spark, f"{tmp_path}/logs", "*.csv", True).count()
    traces.merge_traces(spark, f"{tmp_path}/logs", f"{tmp_path}/merged")
    after = listing.list_files(spark, f"{tmp_path}/merged", "*.csv", True).count()
    assert after < before and listing.list_files(spark, f"{tmp_path}/logs", "*.csv", True).count() == before
    merged = traces.scan_traces(spark, f"{tmp_path}/merged")
    assert sorted((r.start_us, r.run_id) for r in merged.collect()) == sorted((r[1], r[8]) for r in rows)


def test_more_than_three_dimensions(spark, tmp_path):
    array = np.random.default_rng(5).integers(0, 65536, (3, 5, 4)).astype(np.uint16)
    write_image(f"{tmp_path}/in/b.nii", array)
    raw = bytearray(open(f"{tmp_path}/in/b.nii", "rb").read())
    struct.pack_into("<8h", raw, 40, 4, 3, 5, 2, 2, 1, 1, 1)
    open(f"{tmp_path}/in/b.nii", "wb").write(bytes(raw))
    counts = jobs.histogram_job(spark, f"{tmp_path}/in", f"{tmp_path}/h").where("n > 0").agg(F.sum("n")).first()[0]
    assert counts == array.size
    assert [r.status for r in jobs.increment_job(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect()] == ["SUCCESS"]
    (name,) = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".nii")]
    written = open(f"{tmp_path}/out/{name}", "rb").read()
    assert struct.unpack_from("<8h", written, 40) == (4, 3, 5, 2, 2, 1, 1, 1)
    expected = (array.astype(np.int64) + 1).astype("<u2").ravel(order="F")
    assert np.array_equal(np.frombuffer(written, "<u2", offset=352), expected)


def log_names(spark, folder):
    rows = traces.scan_merged(spark, folder).orderBy("seq").collect()
    return [(r.label, r.run_id, r.func, r.start_us) for r in rows]


@pytest.mark.parametrize("run_id", ["run-1", "run-[1]"])
def test_merging_raw_logs_is_incremental_and_safe(spark, tmp_path, monkeypatch, run_id):
    raw, merged = tmp_path / "benchmarks", f"{tmp_path}/merged"
    run = raw / "spark:increment:n_worker=4:block_size='5000'" / run_id
    run.mkdir(parents=True)
    (run / "a.log").write_text("load,0.5,1.25,x.nii,h,1,2\ndump,1.5,2,x.nii,h,1,2\n")
    (run / "b.log").write_text("")
    label = run.parent.name
    first = [(label, run_id, "load", S // 2), (label, run_id, "dump", 3 * S // 2)]
    assert traces.scan_merged(spark, merged).count() == 0
    assert traces.merge_logs(spark, str(raw), merged) == 1 and log_names(spark, merged) == first
    assert traces.merge_logs(spark, str(raw), merged) == 0 and log_names(spark, merged) == first
    # A log grows, an empty one gets lines, a run is new: three logs are merged, and nothing doubles.
    with open(run / "a.log", "a") as f:
        f.write("dump,3,4,y.nii,h,1,2\n")
    (run / "b.log").write_text("load,5,6,z.nii,h,9,2\n")
    other = raw / "dask:histogram" / "r2"
    other.mkdir(parents=True)
    (other / "w.log").write_text("load,7,8,z.nii,h,9,2\n")
    # The merge fails before the manifest is written: what it wrote is not read.
    with monkeypatch.context() as m:
        m.setattr(traces.time, "time_ns", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            traces.merge_logs(spark, str(raw), merged)
    assert log_names(spark, merged) == first
    assert traces.merge_logs(spark, str(raw), merged) == 3
    want = [("dask:histogram", "r2", "load", 7 * S), *first, (label, run_id, "dump", 3 * S), (label, run_id, "load", 5 * S)]
    assert log_names(spark, merged) == want
    # Logs that are gone stay merged.
    (run / "a.log").unlink()
    assert traces.merge_logs(spark, str(raw), merged) == 0 and log_names(spark, merged) == want


def test_merged_files_are_sized_by_bytes(spark, tmp_path):
    names = "func string, start_us bigint, end_us bigint, filename string, worker string, thread bigint, process bigint, label string, run_id string"
    rows = [("f", i * S, i * S + 1, "x", f"w{i % 30}", 1, 2, "spark:a", "hot" if i % 3 else f"r{i % 5}") for i in range(3000)]
    traces.write_logs(spark.createDataFrame(rows, names), f"{tmp_path}/raw")
    size = traces.list_logs(spark, f"{tmp_path}/raw").agg(F.sum("length")).first()[0]
    traces.merge_logs(spark, f"{tmp_path}/raw", f"{tmp_path}/merged", file_bytes=size // 6)
    files = listing.list_files(spark, f"{tmp_path}/merged", "part-*.parquet", True).where("path like '%batch=%'").count()
    assert 5 <= files <= 7
    found = traces.scan_merged(spark, f"{tmp_path}/merged").groupBy("run_id", "worker").count().collect()
    assert sum(r["count"] for r in found) == 3000 and len(found) == len({(r[8], r[4]) for r in rows})
