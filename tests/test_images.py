"""Image files on other file systems, and the data source: committing writes, pruned reads, header extensions."""

import os
import struct

import numpy as np
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from test_files import random_images, read_image, write_image

from brickwork import session
from brickwork.functions.batches import chain
from brickwork.operators import slabs
from brickwork.plans import jobs
from brickwork.sources import images, nifti, stores


@pytest.fixture
def other(spark, tmp_path, monkeypatch):
    """A second default file system: Spark knows it as a view of a folder, tasks as a registered store without positions."""
    root = tmp_path / "store"
    (tmp_path / "view").mkdir()
    (tmp_path / "view" / "data").symlink_to(root)
    root.mkdir()
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file:{tmp_path}/tables")
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    view = f"viewfs://{tmp_path.name.replace('_', '-')}"
    conf.set(f"fs.viewfs.mounttable.{view[9:]}.link./data", f"file://{root}")
    conf.set("fs.defaultFS", view)
    stores.register(view, pafs.SubTreeFileSystem(str(tmp_path / "view"), pafs.LocalFileSystem()))
    yield root
    conf.set("fs.defaultFS", old)
    stores._REGISTERED.clear()


def test_path_without_scheme_goes_to_the_default_file_system(spark, other):
    arrays = random_images(other / "in", 3, (4, 4, 9))
    done = jobs.increment_job(spark, "/data/in", "/data/out", iterations=2, amount=7)
    assert sorted(tuple(r) for r in done.collect()) == [(f"{stores.qualified(spark, '/data/out')}/b{i:02d}.nii", "SUCCESS") for i in range(3)]
    for i, a in enumerate(arrays):
        assert (read_image(f"{other}/out/b{i:02d}.nii")[0] == (a.astype(int) + 14) % 65536).all()
    assert sorted(os.listdir(other / "out")) == ["b00.nii", "b01.nii", "b02.nii"]
    assert not os.path.exists("/data")


def test_one_image_from_many_tasks(spark, other, monkeypatch):
    array = random_images(other / "wide", 1, (6, 5, 40))[0]
    monkeypatch.setattr(nifti, "PART_BYTES", 6 * 5 * 2 * 4)
    ranges = nifti.plane_ranges(nifti.block_table(spark, "/data/wide"), split_bytes=6 * 5 * 2 * 2)
    written = nifti.rewrite_ranges(ranges, "/data/joined", slabs.increment_step(1))
    assert written.select("part").distinct().count() > 5
    assert (read_image(f"{other}/joined/b00.nii")[0] == (array.astype(int) + 1) % 65536).all()
    planes = nifti.scan_ranges(ranges).where("slab not in (0, 17, 39)")
    status = nifti.write_status(nifti.write_planes(planes, "/data/holes")).first()
    assert status.status == "INCOMPLETE"
    raw = np.frombuffer((other / "holes" / "b00.nii").read_bytes(), "<u2", offset=352).reshape((6, 5, 40), order="F")
    kept = array.copy()
    kept[:, :, [0, 17, 39]] = 0
    assert (raw == kept).all()
    assert os.listdir(other / "joined") == ["b00.nii"] and os.listdir(other / "holes") == ["b00.nii"]


def failing():
    """A step that fails at one plane; made here, so that it travels to the tasks by value."""

    def step(batches):
        for batch in batches:
            if 5 in batch.column(batch.schema.get_field_index("slab")).to_pylist():
                raise RuntimeError("a task fails")
            yield batch

    return step


@pytest.mark.parametrize("in_place", [True, False])
def test_failed_job_leaves_nothing_and_keeps_the_old(spark, tmp_path, in_place):
    random_images(f"{tmp_path}/in", 3, (4, 4, 9))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b01.nii").write_bytes(b"old")
    ranges = nifti.plane_ranges(nifti.block_table(spark, f"{tmp_path}/in"), split_bytes=64)
    with pytest.raises(Exception, match="a task fails"):
        nifti.rewrite_ranges(ranges, f"{tmp_path}/out", failing(), in_place=in_place)
    assert os.listdir(tmp_path / "out") == ["b01.nii"] and (tmp_path / "out" / "b01.nii").read_bytes() == b"old"


@pytest.mark.parametrize("in_place", [True, False])
def test_late_task_does_not_bring_back_what_was_given_up(tmp_path, in_place):
    random_images(tmp_path / "in", 1)
    reader = images.Nifti({"path": f"{tmp_path}/in"}).reader(images.schemas.SLAB)
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    target = nifti.Target(f"{tmp_path}/out", in_place=in_place)
    target.open_staging()
    assert len(list(target.write_step()(batches))) == len(batches)
    target.drop_staging()
    with pytest.raises((OSError, RuntimeError)):
        list(target.write_step()(batches))
    assert os.listdir(tmp_path / "out") == []


def test_publishing_twice_is_safe(tmp_path):
    for name, data in (("a", b"head1"), ("b", b"rest")):
        (tmp_path / name).write_bytes(data)
    stores.register("other:", pafs.LocalFileSystem())
    try:
        parts = [{"at": at, "part": f"other:{tmp_path}/{n}", "size": 14, "planes": 1, "needed": 2} for n, at in (("a", 0), ("b", 7))]
        nifti.publish_image(f"other:{tmp_path}/x/whole.nii", parts, False)
        assert (tmp_path / "x" / "whole.nii").read_bytes() == b"head1\0\0rest\0\0\0"
        (tmp_path / "a").unlink()
        nifti.publish_image(f"other:{tmp_path}/x/whole.nii", parts, False)
        one = [{"at": 0, "part": f"other:{tmp_path}/b", "size": 4, "planes": 2, "needed": 2}]
        for _ in range(2):
            nifti.publish_image(f"other:{tmp_path}/x/one.nii", one, False)
        assert (tmp_path / "x" / "one.nii").read_bytes() == b"rest"
    finally:
        stores._REGISTERED.pop("other:")


def test_cluster_needs_a_shared_mount(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "in_place_allowed", lambda spark, folder: False)
    with pytest.raises(ValueError, match="in_place=True"):
        nifti.target_of(spark, f"{tmp_path}/out")
    assert nifti.target_of(spark, f"{tmp_path}/out", in_place=True).in_place


def test_connector_schemes_share_a_client(monkeypatch):
    asked = []

    def client(scheme, authority):
        asked.append((stores.ALIASES.get(scheme, scheme), authority))
        return pafs.LocalFileSystem(), authority

    monkeypatch.setattr(stores, "_client", client)
    assert stores.system_of("s3a://bucket/a/b.nii")[1] == "bucket/a/b.nii" and asked == [("s3", "bucket")]


# ----------------------------------------------------------------- extensions


def with_extension(path, extension):
    raw = bytearray(open(path, "rb").read())
    offset = 352 + len(extension)
    struct.pack_into("<f", raw, 108, offset)
    open(path, "wb").write(bytes(raw[:348]) + b"\1\0\0\0" + extension + bytes(raw[352:]))


@pytest.mark.parametrize("in_place", [True, False])
def test_header_extensions_are_carried(spark, tmp_path, in_place):
    array = np.random.default_rng(3).integers(0, 65536, (3, 5, 7)).astype(np.uint16)
    for name, kind in (("a", "<u2"), ("b", "<u2")):
        write_image(f"{tmp_path}/in/{name}.nii", array, kind)
    extension = struct.pack("<ii", 4096, 6) + bytes(range(256)) * 15 + bytes(248)
    with_extension(f"{tmp_path}/in/a.nii", extension)
    ranges = nifti.plane_ranges(nifti.block_table(spark, f"{tmp_path}/in"), split_bytes=60)
    nifti.rewrite_ranges(ranges, f"{tmp_path}/out", slabs.increment_step(1), in_place=in_place)
    written = (tmp_path / "out" / "a.nii").read_bytes()
    assert written[348:352] == b"\1\0\0\0" and written[352 : 352 + 4096] == extension
    assert struct.unpack_from("<f", written, 108) == (352 + 4096,)
    assert (np.frombuffer(written, "<u2", offset=352 + 4096).reshape((3, 5, 7), order="F") == array + np.uint16(1)).all()
    assert (read_image(f"{tmp_path}/out/b.nii")[0] == array + np.uint16(1)).all()
    again = nifti.scan_blocks(spark, f"{tmp_path}/out")
    assert again.where("slab > 0").agg(F.max(F.length("header"))).first()[0] == 352
    nifti.write_planes(again.repartition(4), f"{tmp_path}/twice", in_place=in_place)
    assert (tmp_path / "twice" / "a.nii").read_bytes() == written


# ---------------------------------------------------------------- data source


def test_read_equals_scan(spark, tmp_path):
    random_images(tmp_path, 3, (4, 5, 9))
    want = nifti.scan_blocks(spark, str(tmp_path))
    got = images.read(spark, str(tmp_path), splitBytes=300)
    assert got.schema == want.schema and got.rdd.getNumPartitions() > 3
    key = ["block_id", "slab"]
    assert [r.asDict(True) for r in got.orderBy(key).collect()] == [r.asDict(True) for r in want.orderBy(key).collect()]
    narrow = images.read(spark, str(tmp_path), "slab long, block_id long, dims array<long>")
    assert narrow.count() == 27 and narrow.columns == ["slab", "block_id", "dims"]


def test_filters_reach_the_source(spark, tmp_path):
    arrays = random_images(tmp_path, 4, (4, 5, 9))
    (tmp_path / "b04.nii").write_bytes(b"broken")
    table = images.read(spark, str(tmp_path))
    with pytest.raises(Exception, match="b04.nii"):
        table.count()
    # Files that the filter leaves out are not opened, so the broken one is not noticed.
    some = table.where(F.col("path").endswith("b01.nii") & F.col("slab").between(2, 4) & (F.length("payload") > 0))
    rows = some.orderBy("slab").collect()
    assert [(r.block_id, r.slab) for r in rows] == [(1, 2), (1, 3), (1, 4)]
    assert (np.frombuffer(rows[0].payload, "<u2").reshape(5, 4).T == arrays[1][:, :, 2]).all()
    assert table.where("block_id in (0, 3) and slab = 8").count() == 2
    assert table.where("block_id = 77").count() == 0
    assert images.read(spark, str(tmp_path), unreadable="skip").count() == 36
    kept = images.read(spark, str(tmp_path), unreadable="keep").where("error is not null").collect()
    assert [(r.block_id, r.slab) for r in kept] == [(4, None)]


def test_only_chosen_files_and_planes_are_read(tmp_path, monkeypatch):
    random_images(tmp_path, 4, (4, 5, 9))
    source = images.Nifti({"path": str(tmp_path)})
    opened, bytes_read = [], []

    class Counted:
        def __init__(self, path):
            opened.append(os.path.basename(path))
            self.file = stores.open_input(path)

        def read_at(self, count, at):
            bytes_read.append(count)
            return self.file.read_at(count, at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    monkeypatch.setattr(nifti, "open_file", Counted)
    reader = source.reader(source.schema())
    other = images.ds.EqualTo(("error",), "x")
    assert list(reader.pushFilters([images.ds.StringEndsWith(("path",), "2.nii"), images.ds.In(("slab",), (1, 2, 7)), other])) == [other]
    shares = reader.partitions()
    rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert [r["slab"] for r in rows] == [1, 2, 7] and opened == ["b02.nii"] and bytes_read == [352, 80, 40]


def test_small_files_share_a_task(tmp_path, monkeypatch):
    random_images(tmp_path, 30, (4, 5, 9))
    source = images.Nifti({"path": str(tmp_path)})
    monkeypatch.setattr(images, "OPEN_BYTES", 1000)
    for cores, split, tasks in ((1, 10**6, 1), (6, 10**6, 6), (1, 5500, 10), (1, 400, 60)):
        reader = images.Reader(source.folder(), source.schema(), {"splitBytes": split}, source.known, cores)
        shares = reader.partitions()
        assert len(shares) in (tasks, tasks + 1) and sum(len(s.shares) for s in shares) == (60 if split == 400 else 30)
        rows = [(r["block_id"], r["slab"]) for s in shares for b in reader.read(s) for r in b.to_pylist()]
        assert sorted(rows) == [(b, z) for b in range(30) for z in range(9)]


def test_write_commits_all_or_nothing(spark, tmp_path):
    arrays = random_images(f"{tmp_path}/in", 3, (4, 4, 9))
    table = images.read(spark, f"{tmp_path}/in")
    images.write(chain(table.repartition(7), table.schema, slabs.increment_step(3)), f"{tmp_path}/out", prefix="new-")
    for i, a in enumerate(arrays):
        assert (read_image(f"{tmp_path}/out/new-b{i:02d}.nii")[0] == a + np.uint16(3)).all()
    assert len(os.listdir(tmp_path / "out")) == 3
    with pytest.raises(Exception, match="a task fails"):
        images.write(chain(table.repartition(7), table.schema, failing()), f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_write_to_a_store_without_positions(spark, other):
    arrays = random_images(other / "src", 2, (4, 4, 9))
    table = images.read(spark, "/data/src", splitBytes=200)
    assert table.count() == 18
    images.write(table.drop("calls", "error").repartition("path").sortWithinPartitions("path", "slab"), "/data/copy")
    assert all((read_image(f"{other}/copy/b{i:02d}.nii")[0] == a).all() for i, a in enumerate(arrays))
    with pytest.raises(Exception, match="several tasks"):
        images.write(table.repartition(5, "slab"), "/data/refused")
    assert not os.path.exists(other / "refused") or os.listdir(other / "refused") == []


def test_empty_folder_and_wrong_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert images.read(spark, f"{tmp_path}/in").count() == 0
    with pytest.raises(Exception, match="lacks the column"):
        images.write(spark.range(3), f"{tmp_path}/out")
    with pytest.raises(Exception, match="not raise, skip or keep"):
        images.read(spark, f"{tmp_path}/in", unreadable="maybe").count()


# --------------------------------------------------------- shared donor reads


class Counted:
    """A file that notes what is read of it; ``log`` is set by the test."""

    log: list

    def __init__(self, path):
        self.path, self.file = os.path.basename(path), stores.open_input(path)

    def size(self):
        return self.file.size()

    def read_at(self, count, at):
        if at:
            self.log.append((self.path, at))
        return self.file.read_at(count, at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@pytest.mark.parametrize("policy", ["per_iteration", "per_block"])
def test_donor_ranges_are_read_once_for_many_targets(spark, tmp_path, monkeypatch, policy):
    arrays = random_images(tmp_path / "in", 6, (4, 4, 9))
    draws = [(b, it, 2 if policy == "per_iteration" or b % 2 else 4) for b in range(6) for it in range(5)]
    blocks = nifti.block_table(spark, f"{tmp_path}/in")
    names = {r.block_id: r.path for r in blocks.collect()}
    donors = spark.createDataFrame([(b, [(names[d], list(range(5)))]) for b, d in {(b, d) for b, _, d in draws}], "block_id bigint, donors array<struct<path:string,its:array<bigint>>>")
    # Three planes of six images fit: one group per three planes.
    ranges = nifti.shared_ranges(blocks.join(donors, "block_id"), group_bytes=6 * 3 * 4 * 4 * 2)
    rows = ranges.where("first = 0").orderBy("first", "group", "block_id").toArrow().to_batches()
    step = nifti.shared_step(1.0)
    monkeypatch.setattr(nifti, "open_file", Counted)
    Counted.log = []
    out = {}
    for batch in step(rows):
        for r in batch.to_pylist():
            out.setdefault(r["block_id"], []).append(np.frombuffer(r["payload"], "<u2"))
            assert r["slab"] or [c["func"] for c in r["calls"]] == ["load"] + ["increment"] * 5
    own = 6
    assert len(Counted.log) == own + len({d for _, _, d in draws})
    for b, planes in out.items():
        given = arrays[2 if policy == "per_iteration" or b % 2 else 4].astype(int)
        want = ((arrays[b].astype(int) + 5 * given) % 65536)[:, :, : len(planes)]
        assert (np.stack([p.reshape(4, 4).T for p in planes], axis=2) == want).all()


def test_groups_are_bounded(spark, tmp_path):
    random_images(tmp_path / "in", 7, (4, 4, 9))
    blocks = nifti.block_table(spark, f"{tmp_path}/in")
    for size in (1, 4 * 4 * 2 * 3, 10**6):
        ranges = nifti.shared_ranges(blocks, group_bytes=size)
        rows = ranges.groupBy("first", "group").agg(F.sum(F.col("count") * 32).alias("bytes"), F.count("*").alias("n")).collect()
        assert all(r.bytes <= max(size, 32) for r in rows) and sum(r.n for r in rows) == ranges.count()
        assert ranges.agg(F.sum("count")).first()[0] == 63
        if size == 10**6:
            assert {r.n for r in rows} == {7}


def test_multi_increment_on_a_store_without_positions(spark, other):
    arrays = random_images(other / "in", 4, (4, 4, 9))
    draws = spark.createDataFrame([(b, it, (b + 1) % 4) for b in range(4) for it in range(3)], "block_id bigint, it bigint, donor bigint")
    done = jobs.multi_increment_job(spark, "/data/in", "/data/added", 3, draws=draws)
    assert {r.status for r in done.collect()} == {"SUCCESS"}
    for b in range(4):
        assert (read_image(f"{other}/added/b{b:02d}.nii")[0] == (arrays[b].astype(int) + 3 * arrays[(b + 1) % 4]) % 65536).all()
