"""Voxel operators against NumPy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.operators import clustering, cohort, voxels

EDGE = [0, 65533, 65534, 65535, 65535]


def flat(spark, values, block_id=0):
    rows = [(block_id, i, int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "block_id bigint, pos bigint, v bigint")


def block_rows(spark, arrays):
    rows = [(i, list(a.shape), [int(v) for v in a.ravel()]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "block_id bigint, dims array<bigint>, v array<bigint>")


def random_blocks(n, shape=(3, 5, 2), seed=0):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 65536, shape).astype(np.uint16) for _ in range(n)]


def numpy_kmeans(values, k, iterations):
    centroids = np.linspace(values.min(), values.max(), num=k)
    for _ in range(iterations):
        labels = np.argmin(np.square(np.subtract.outer(values, centroids)), axis=1)
        sums = np.array([values[labels == i].sum(dtype=np.uint64) for i in range(k)])
        centroids = sums / np.maximum([(labels == i).sum() for i in range(k)], 1)
    return centroids


def test_histogram_matches_numpy(spark):
    values = np.concatenate([np.random.default_rng(1).integers(0, 65536, 5000), EDGE])
    expected = np.histogram(values, bins=range(2**16))[0]
    rows = voxels.histogram(flat(spark, values)).orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(65_535))
    assert [r.n for r in rows] == expected.tolist()


def test_histogram_of_nothing_is_all_zero(spark):
    rows = voxels.histogram(flat(spark, [])).agg({"n": "sum", "bin": "count"}).first()
    assert rows["sum(n)"] == 0 and rows["count(bin)"] == 65_535


def test_top_bins_share_one(spark):
    rows = {r.bin: r.n for r in voxels.histogram(flat(spark, EDGE)).where("n > 0").collect()}
    assert rows == {0: 1, 65533: 1, 65534: 3}


def test_merge_order_does_not_matter(spark):
    parts = [voxels.block_histogram(flat(spark, range(i, 500 * (i + 1)), i)) for i in range(3)]
    one = voxels.merge_histograms(parts[0].unionAll(parts[1]).unionAll(parts[2]))
    two = voxels.merge_histograms(voxels.merge_histograms(parts[2].unionAll(parts[1])).unionAll(parts[0].select("bin", "n")))
    assert sorted(one.collect()) == sorted(two.collect())


def test_increment_wraps_and_has_an_inverse(spark):
    start = flat(spark, EDGE)
    assert [r.v for r in voxels.increment(start).orderBy("pos").collect()] == [1, 65534, 65535, 0, 0]
    back = voxels.increment(voxels.increment(start, 7, 3), 65536 - 21)
    assert [r.v for r in back.orderBy("pos").collect()] == EDGE


def test_flatten_and_slabs_follow_row_major_order(spark):
    arrays = random_blocks(2)
    flatten = voxels.flatten(block_rows(spark, arrays)).collect()
    assert len(flatten) == 60
    assert all(arrays[r.block_id][r.x, r.y, r.z] == r.v == arrays[r.block_id].ravel()[r.pos] for r in flatten)
    for r in voxels.slab_split(block_rows(spark, arrays)).collect():
        assert r.v == arrays[r.block_id][r.x].ravel().tolist()


@pytest.mark.parametrize("size,chunk_bytes", [(64, 26), (7, 4), (5, 100), (1, 2), (10, 3)])
def test_rechunk_matches_array_split(spark, size, chunk_bytes):
    data = np.arange(size, dtype=np.uint16).reshape(size, 1, 1)
    expected = np.array_split(data.ravel(), -(-size * 2 // chunk_bytes))
    rows = voxels.rechunk(block_rows(spark, [data]), chunk_bytes).orderBy("chunk").collect()
    assert [r.v for r in rows] == [e.tolist() for e in expected]


@pytest.mark.parametrize("low,high,count", [(0, 10, 3), (3, 65535, 7), (5, 5, 3), (0, 1, 11)])
def test_linspace(spark, low, high, count):
    frame = spark.createDataFrame([(low, high)], "lo bigint, hi bigint")
    found = clustering.centroid_values(clustering.linspace_centroids(frame, count))
    assert found == np.linspace(low, high, num=count).tolist()


@pytest.mark.parametrize("iterations", [0, 1, 3, 6])
def test_kmeans_matches_numpy(spark, iterations):
    values = np.random.default_rng(2).gamma(2.0, 8000.0, 4000).clip(0, 65535).astype(np.uint16)
    assert clustering.fit(flat(spark, values), 3, iterations) == numpy_kmeans(values, 3, iterations).tolist()


def test_kmeans_of_one_value(spark):
    assert clustering.fit(flat(spark, [9] * 20), 3, 1) == [9.0, 0.0, 0.0]
    assert {r.label for r in clustering.classify(flat(spark, [9] * 20), [9.0, 9.0, 9.0]).collect()} == {0}


def test_empty_cluster_goes_to_zero(spark):
    assert clustering.fit(flat(spark, [0, 10]), 3, 1) == [0.0, 0.0, 10.0]
    labels = clustering.classify(flat(spark, [0, 10]), [0.0, 0.0, 10.0]).orderBy("pos").collect()
    assert [r.label for r in labels] == [0, 2]


def test_kmeans_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        clustering.fit(flat(spark, []))


def test_labels_agree_and_ties_go_to_the_lowest(spark):
    values, centroids = list(range(0, 21)), [0.0, 10.0, 20.0]
    expected = np.argmin(np.square(np.subtract.outer(np.array(values, float), centroids)), axis=1).tolist()
    rows = flat(spark, values)
    assert [r.label for r in clustering.classify(rows, centroids).orderBy("pos").collect()] == expected
    table = clustering.centroid_table(spark, centroids)
    assert [r.label for r in clustering.classify_by_table(rows, table).orderBy("pos").collect()] == expected


def test_updates_agree_with_the_loop(spark):
    frequency = clustering.intensity_frequency(flat(spark, [0, 0, 10]))
    new = clustering.update_centroids(clustering.cluster_stats(frequency, [0.0, 5.0, 10.0]), 3)
    assert clustering.centroid_values(new) == clustering.fit(flat(spark, [0, 0, 10]), 3, 1)


def test_nearest_row(spark):
    arrays, centroids = random_blocks(3, (2, 4, 3)), [100.0, 30000.0, 65000.0]
    arrays[0][:, 1] = arrays[0][:, 3]  # ties
    found = clustering.nearest_row_per_centroid(block_rows(spark, arrays), centroids).collect()
    assert len(found) == 3 * 2 * 3 * 3
    for r in found:
        line = arrays[r.block_id][r.x, :, r.z].astype(float)
        assert r.y == np.argmin(np.square(line - centroids[r.k]))


def brute_multi(arrays, draws):
    out = [a.astype(np.int64) for a in arrays]
    for block, donor in draws:
        out[block] = out[block] + arrays[donor]
    return [o % 65536 for o in out]


@pytest.mark.parametrize("small", [True, False])
def test_multi_increment_per_block(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(voxels, "broadcast_if_small", lambda df: df)
    arrays = random_blocks(4)
    # Block 2 gives to all (a hot donor), repeats count, and block 0 also gives to itself.
    draws = [(0, 0), (0, 2), (1, 2), (1, 2), (3, 2), (2, 2)]
    table = spark.createDataFrame([(b, i, d) for i, (b, d) in enumerate(draws)], "block_id bigint, it bigint, donor bigint")
    expected = brute_multi(arrays, draws)
    frame = block_rows(spark, arrays)
    for r in voxels.multi_increment_per_block(voxels.flatten(frame), table, salts=3).collect():
        assert r.v == expected[r.block_id].ravel()[r.pos]
    for r in voxels.multi_increment_blocks(frame, table).collect():
        assert r.v == expected[r.block_id].ravel().tolist()


@pytest.mark.parametrize("small", [True, False])
def test_one_donor_for_all_blocks(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(voxels, "broadcast_if_small", lambda df: df)
    arrays = random_blocks(40, (3, 4, 5))
    draws = [(b, it, 7) for b in range(40) for it in range(2)] + [(3, 2, 4)]
    table = spark.createDataFrame(draws, "block_id bigint, it bigint, donor bigint")
    frame, expected = block_rows(spark, arrays), brute_multi(arrays, [(b, d) for b, _, d in draws])
    planes = voxels.multi_increment_planes(voxels.slab_split(frame), table, fan_out=4)
    found = {(r.block_id, r.x): r.v for r in planes.collect()}
    assert found == {(b, x): expected[b][x].ravel().tolist() for b in range(40) for x in range(3)}
    # The hot donor's planes are handed out in copies of their own, for four blocks each.
    given = voxels._given(voxels.slab_split(frame), table.groupBy(F.col("block_id").alias("_to"), "donor").agg(F.count("*").alias("_times")), 4)
    assert given.where("donor = 7").count() == 40 * 3
    whole = voxels.multi_increment_blocks(frame, table, fan_out=4)
    assert {r.block_id: r.v for r in whole.collect()} == {b: e.ravel().tolist() for b, e in enumerate(expected)}
    pairs = spark.createDataFrame([(b, 7) for b in range(40)] + [(0, 1), (0, 1)], "block_id bigint, donor bigint")
    added = {(r.block_id, r.donor): (r.dims, r.v) for r in voxels.add_blocks(frame, pairs, fan_out=4).collect()}
    assert added == {(b, d): ([3, 4, 5], ((arrays[b].astype(int) + arrays[d]) % 65536).ravel().tolist()) for b, d in [*((b, 7) for b in range(40)), (0, 1)]}


def test_blocks_must_be_numbered_without_gaps(spark):
    frame = block_rows(spark, random_blocks(3))
    for shifted in (F.col("block_id") + 1, F.col("block_id") * 2, F.least("block_id", F.lit(1))):
        with pytest.raises(ValueError):
            voxels.stack_blocks(frame.withColumn("block_id", shifted.cast("bigint")))


@pytest.mark.parametrize("small", [True, False])
def test_multi_increment_per_iteration(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(voxels, "broadcast_if_small", lambda df: df)
    arrays, donors = random_blocks(4), [1, 3, 1]
    table = spark.createDataFrame(list(enumerate(donors)), "it bigint, donor bigint")
    expected = brute_multi(arrays, [(b, d) for b in range(4) for d in donors])
    rows = voxels.multi_increment_per_iteration(voxels.flatten(block_rows(spark, arrays)), table).collect()
    assert len(rows) == 120
    assert all(r.v == expected[r.block_id].ravel()[r.pos] for r in rows)


def test_donor_draws_are_seeded_and_cover_all_blocks(spark):
    ids = spark.range(50).withColumnRenamed("id", "block_id")
    draws = sorted(voxels.assign_donors(ids, 4, 1).collect())
    assert draws == sorted(voxels.assign_donors(ids.repartition(7), 4, 1).collect())
    assert draws != sorted(voxels.assign_donors(ids, 4, 2).collect())
    assert len(draws) == 200 and {0 <= r.donor < 50 for r in draws} == {True}
    assert len({r.donor for r in draws}) > 30
    assert voxels.assign_donors(ids, 4, 1, "per_iteration").count() == 4
    assert voxels.assign_donors(ids, 0, 1).count() == 0
    with pytest.raises(ValueError):
        voxels.assign_donors(ids, 1, 1, "other")


def test_stack_needs_one_shape(spark):
    same = random_blocks(3)
    rows = voxels.stack_blocks(block_rows(spark, same)).orderBy("pos").collect()
    assert [r.v for r in rows] == np.stack(same).reshape(-1).tolist()
    with pytest.raises(ValueError):
        voxels.stack_blocks(block_rows(spark, [*same, np.zeros((1, 2, 3), np.uint16)]))


def test_site_mean_leaves_out_errors(spark):
    images = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("b", "4", 3)], "site string, subject string, image_id bigint")
    volumes = spark.createDataFrame([(0, 10, None), (1, None, "broken"), (2, 20, None)], "block_id bigint, volume bigint, error string")
    joined = cohort.participant_volume(images, volumes)
    assert {r.subject: r.error for r in joined.collect()} == {"1": None, "2": "broken", "3": None, "4": "no voxels"}
    assert [tuple(r) for r in cohort.site_mean_volume(joined).collect()] == [("a", 15.0, 2)]


def test_participants_weigh_the_same(spark):
    rows = [("s", "a", 0, 10, None), ("s", "a", 1, 30, None), ("s", "b", 2, 100, None), ("s", "c", 3, None, "broken")]
    volumes = spark.createDataFrame(rows, "site string, subject string, image_id bigint, volume bigint, error string")
    found = {r.subject: (r.volume, r.images, r.unread) for r in cohort.subject_volume(volumes).collect()}
    assert found == {"a": (20.0, 2, 0), "b": (100.0, 1, 0), "c": (None, 0, 1)}
    assert [tuple(r) for r in cohort.site_mean_volume(volumes).collect()] == [("s", 60.0, 3)]
