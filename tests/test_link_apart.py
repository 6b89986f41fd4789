"""Linking by components against one pass over each block, region modes and tracks cut at a mask."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import link as K
from tracklore.operators import morphology as M

SCHEMA = "block_name long, time int, object_label long, centroid_z double, centroid_y double, centroid_x double, volume_voxels double, mean_intensity double"


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(12)
    rows = []
    for b in range(3):
        place, speed = rng.uniform(0, 400, (30, 2)), rng.uniform(-5, 5, (30, 2))
        for t in (0, 1, 2, 4, 5, 7, 8, 9):
            for o in range(30):
                if rng.random() > 0.15:
                    y, x = place[o] + speed[o] * t + rng.normal(0, 1, 2)
                    rows.append((b, t, o + 1, float(o % 3), float(y), float(x), float(rng.uniform(50, 150)), 5.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("rules", [
    K.LinkRules(max_distance=12.0, max_gap=2), K.LinkRules(max_distance=25.0, max_gap=0), K.LinkRules("lap", 20.0, 2.0, 1, volume_weight=0.5),
    K.LinkRules("keyhole", 15.0, 2.0, 2, forward_distance=14.0, back_radius=8.0, cone_degrees=45.0), K.LinkRules("keyhole", 15.0, 2.0, 1, cone_degrees=90.0),
], ids=str)
def test_components_give_the_tracks_of_one_pass(crowd, rules):
    key = lambda r: (r.block_name, r.time, r.object_label, r.track_id)
    assert sorted(map(key, K.link_apart(crowd, rules).collect())) == sorted(map(key, K.link_tracks(crowd, rules).collect()))


def test_modes_and_the_default(spark, crowd):
    mask = spark.createDataFrame([(b, t, y, -1000, 1000) for b in range(3) for t in range(10) for y in range(198, 203)], "block_name long, time int, y int, x0 int, x1 int")
    rules = [K.LinkRules(max_distance=40.0), K.LinkRules("keyhole", 40.0)]
    every = K.link_by_mode(crowd, rules)
    assert every.count() == 2 * crowd.count() and {r.tracking_method for r in every.where("is_default").collect()} == {"keyhole"}
    assert {r.tracking_method for r in K.link_by_mode(crowd, rules[:1]).where("is_default").collect()} == {"nearest"}
    free = K.link_by_mode(crowd, rules[:1], "outside_only", mask).join(crowd, ["block_name", "time", "object_label"])
    outside = crowd.where(~F.rint("centroid_y").between(198, 202))
    assert free.count() == outside.count()
    sides = free.groupBy("block_name", "track_id").agg(F.min("centroid_y").alias("a"), F.max("centroid_y").alias("b"))
    assert sides.where("a < 198 AND b > 202").count() == 0
    assert K.link_tracks(outside, rules[0]).join(crowd, ["block_name", "time", "object_label"]).groupBy("block_name", "track_id").agg(F.min("centroid_y").alias("a"), F.max("centroid_y").alias("b")).where("a < 198 AND b > 202").count() > 0


@pytest.mark.parametrize("aged", [False, True])
@pytest.mark.parametrize("rules", [
    K.LinkRules(max_distance=12.0, max_gap=2), K.LinkRules(max_distance=1000.0, max_z_step=9.0, max_gap=1), K.LinkRules("lap", 40.0, 2.0, 1, volume_weight=0.5, cost_cutoff=30.0),
    K.LinkRules("keyhole", 35.0, 2.0, 2, forward_distance=44.0, back_radius=8.0, cone_degrees=45.0),
], ids=str)
def test_blocks_stepped_together_are_a_tracker_each(rules, aged, monkeypatch):
    monkeypatch.setattr(K, "TOGETHER", 4)
    rng, rows = np.random.default_rng(3), []
    for b in range(40):
        most = rng.integers(1, 8)
        for t in np.sort(rng.choice(12, rng.integers(1, 10), replace=False)):
            rows += [(b, t, rng.integers(0, 3), *rng.integers(0, 60, 2), rng.integers(1, 9), 5.0 if rng.random() < 0.9 else np.nan) for _ in range(rng.integers(1, most + 1))]
    rows = np.array(rows, float)
    block, time, place = rows[:, 0].astype(int), rows[:, 1].astype(int), rows[:, 2:]
    want = []
    for b in range(40):
        tracker, last = K.Tracker(rules), None
        for t in np.unique(time[block == b]):
            if aged and last is not None:
                tracker.wait(int(t - last - 1))
            want += tracker.step(place[(block == b) & (time == t)])
            last = t
    assert K.link_many(place, block, time, rules, aged).tolist() == want


def test_blocks_over_batches_and_a_null_block(spark, crowd, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rules = K.LinkRules(max_distance=12.0, max_gap=2)
    none = crowd.where("block_name = 1").withColumn("block_name", F.lit(None).cast("long"))
    key = lambda r: (r.time, r.object_label, r.track_id)
    try:
        own = K.link_tracks(crowd.unionAll(none), rules).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(own) == crowd.count() + none.count()
    assert sorted(key(r) for r in own if r.block_name is None) == sorted(key(r) for r in own if r.block_name == 1)


def test_links_meet_masks_without_rows_of_samples(spark):
    rng = np.random.default_rng(5)
    runs = [(b, t, int(y), int(x), int(x + n)) for b in "pq" for t in range(4) for y, x, n in zip(rng.integers(-3, 12, 9), rng.integers(-5, 12, 9), rng.integers(0, 9, 9), strict=True)]
    links = [(rng.choice(list("pqr")), k, int(t), int(t + rng.integers(0, 3)), *map(float, rng.uniform(-6, 16, 4))) for k, t in enumerate(rng.integers(0, 4, 200))] + [("p", 200, None, 1, 0.0, 0.0, 1.0, 1.0), ("p", 201, 0, 1, None, 0.0, 1.0, 1.0)]
    want = {}
    for b, k, t0, t1, y0, x0, y1, x1 in links:
        at = [] if t0 is None or y0 is None else {(round(y0 + (y1 - y0) * (s / 6)), round(x0 + (x1 - x0) * (s / 6))) for s in range(7)}
        want[k] = any(c == b and t0 <= t <= t1 and any(y == py and a <= px <= z for py, px in at) for c, t, y, a, z in runs if t0 is not None)
    own = M.links_across(spark.createDataFrame(links, "block string, link_id long, t0 int, t1 int, y0 double, x0 double, y1 double, x1 double"), spark.createDataFrame(runs, "block string, time int, y int, x0 int, x1 int"), ["block"], "time", 7)
    assert {r.link_id: r.crosses for r in own.collect()} == want and any(want.values())
    assert "CoGroup" in own._jdf.queryExecution().toString()
