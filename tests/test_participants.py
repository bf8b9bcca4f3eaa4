"""Functions per participant and site, and the traces of jobs that reduce."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_files import random_images

from brickwork.operators import participants, slabs
from brickwork.plans import jobs
from brickwork.sources import nifti, traces


def cohort(folder):
    made = {}
    for site, subject, count in (("s1", "sub-01", 2), ("s1", "sub-02", 1), ("s2", "sub-03", 1), ("s2", "sub-bad", 1)):
        made[site, subject.split("-")[-1]] = random_images(f"{folder}/{site}/{subject}/anat", count, (4, 5, 9), seed=len(made))
    (folder / "s3" / "sub-04").mkdir(parents=True)
    (folder / "s3" / "sub-04" / "x.nii").write_bytes(b"broken")
    return made


def measuring():
    def measure(person):
        if person.subject == "bad":
            raise RuntimeError("no brain found")
        total = sum(int(p.astype(np.int64).sum()) for image in person.images for p in image.planes(2))
        return {"total": total, "images": len(person.images)}

    return measure


def grouping():
    def group(site, rows):
        first = next(rows)  # leaves the others
        return {"first": first["subject"]} if site != "s3" else {}

    return group


def test_functions_and_their_failures(spark, tmp_path):
    made = cohort(tmp_path / "in")
    run = jobs.Run({"n_worker": 1}, f"{tmp_path}/logs")
    done, sites = jobs.participant_job(spark, f"{tmp_path}/in", measuring(), "total bigint, images int", grouping(), "first string", run)
    found = {(r.site, r.subject): (r.total, r.images, r.error) for r in done.collect()}
    bad = found.pop(("s2", "bad")), found.pop(("s3", "04"))
    assert found == {k: (sum(int(a.astype(np.int64).sum()) for a in v), len(v), None) for k, v in made.items() if k[1] != "bad"}
    assert bad[0] == (None, None, "RuntimeError: no brain found") and bad[1][0] is None and "shorter" in bad[1][2]
    assert {r.site: (r["first"], r.error) for r in sites.collect()} == {"s1": ("01", None), "s2": ("03", None), "s3": (None, None)}
    logged = traces.scan_traces(spark, f"{tmp_path}/logs").groupBy("func", "filename").count().collect()
    assert {(r.func, r.filename): r["count"] for r in logged} == {("run_participant", s): 1 for s in ("01", "02", "03", "bad", "04")} | {("run_group", "all_file"): 3}


def test_planes_are_read_as_asked_for(tmp_path, monkeypatch):
    array = random_images(tmp_path, 1, (4, 5, 9))[0]
    row = nifti._read_header(f"{tmp_path}/b00.nii", 352 + 2 * 180)
    image = participants.Image(*(row[c] for c in ("path", "dims", "affine", "offset", "header")))
    planes = list(image.planes(4))
    assert [len(p) for p in planes] == [4, 4, 1] and (np.concatenate(planes).transpose(2, 1, 0) == array).all()
    monkeypatch.setattr(nifti, "open_file", lambda path: (_ for _ in ()).throw(OSError("passing fault")))
    with pytest.raises(participants.StorageFault):  # fails the task, is no result
        participants._attempt(lambda: next(image.planes()))


def test_result_names_must_be_free(spark):
    with pytest.raises(ValueError, match="subject"):
        participants.per_participant(spark.range(1), measuring(), "subject string")


def test_reducing_jobs_log_every_call_once(spark, tmp_path):
    arrays = random_images(f"{tmp_path}/in", 3)
    for name, job in (("histogram", jobs.histogram_job), ("kmeans", jobs.kmeans_job)):
        job(spark, f"{tmp_path}/in", f"{tmp_path}/{name}", run=jobs.Run({}, f"{tmp_path}/logs"))
    logged = traces.scan_traces(spark, f"{tmp_path}/logs")
    count = {(r.label, r.func): r["count"] for r in logged.groupBy("label", "func").count().collect()}
    histogram = {"load": 3, "flatten": 3, "calculate_histogram": 3, "combine_histogram": 1, "save_histogram": 1}
    kmeans = {"load": 6, "classify_block": 3, "dump": 3, "get_labels": 3, "update_centroids": 3}
    assert count == {("spark:histogram", f): n for f, n in histogram.items()} | {("spark:kmeans:iterations=3", f): n for f, n in kmeans.items()}
    assert logged.where("end_us < start_us").count() == 0
    ranges = nifti.plane_ranges(nifti.block_table(spark, f"{tmp_path}/in"))
    counts, calls = slabs.traced(slabs.range_counts(ranges, 1.0))
    assert counts.agg(F.sum("n")).first()[0] == sum(a.size for a in arrays)
    # The calls are stored with the counts: reading them again runs no task of the scan.
    assert calls.inputFiles() and "MapInArrow" not in calls._jdf.queryExecution().executedPlan().toString()
