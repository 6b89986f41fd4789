"""Small cases by hand and properties of the operators that SQL does not check."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.functions import scalar as X
from tracklore.operators import cohort as C
from tracklore.operators import learn as L
from tracklore.operators import link as K
from tracklore.operators import series as R
from tracklore.operators import tracks as T
from tracklore.operators import voxels as V
from tracklore.sources import tables as S
from tracklore.streaming import link_stream as Q

DET = "block_name long, track_id long, time int, object_label long, centroid_z double, centroid_y double, centroid_x double, volume_voxels double, mean_intensity double"


def moving(blocks=3, objects=6, frames=12, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(blocks):
        place = rng.uniform(0, 300, (objects, 2))
        speed = rng.uniform(-4, 4, (objects, 2))
        for t in range(frames):
            for o in range(objects):
                if rng.random() > 0.08:
                    y, x = place[o] + speed[o] * t
                    out.append((b, o, t, o + 1, 1.0, float(y), float(x), 100.0, 5.0))
    return out


def test_number_flags_and_ids(spark):
    df = spark.createDataFrame([("91.0", "True"), (" a ", "0"), ("NaN", "yes"), ("inf", "t"), (None, None)], "id string, flag string")
    got = df.select(X.normalise_id(F.col("id")).alias("i"), X.number(F.col("id")).alias("n"), X.parse_bool(F.col("flag")).alias("f"), X.parse_bool(F.col("flag"), "with_t").alias("t")).collect()
    assert [r.i for r in got][:2] == ["91", "a"]
    assert [r.n for r in got] == [91.0, None, None, None, None]
    assert [r.f for r in got] == [True, False, True, False, False]
    assert [r.t for r in got] == [True, False, True, True, False]


def test_single_detection_and_zero_path(spark):
    rows = [(1, 1, 0, 1, 0.0, 0.0, 0.0, 5.0, 1.0), (1, 2, 0, 1, 0.0, 0.0, 0.0, 5.0, 1.0), (1, 2, 1, 1, 0.0, 0.0, 0.0, 5.0, 1.0)]
    got = {r.track_id: r for r in T.graded(spark.createDataFrame(rows, DET)).collect()}
    assert got[1].directionality_3d is None and got[2].directionality_3d is None
    assert got[1].track_length == 1 and "short_track" in got[2].filter_reason
    assert got[2].split_merge_reason == ""


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DET)
    assert T.graded(empty).count() == 0 and T.lag_msd(empty, 3).count() == 0
    assert K.link_tracks(empty, K.LinkRules()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = (int(v) for v in rng.integers(1, 6, 2))
    cost = rng.uniform(0, 9, (n, m))
    got = K.assign(cost, np.inf)
    k = min(n, m)
    best = min(sum(cost[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert len(got) == k and abs(sum(cost[r, c] for r, c in got) - best) < 1e-9


def test_assignment_skips_what_is_not_finite():
    assert K.assign(np.array([[np.inf, np.inf], [1.0, np.inf]]), np.inf) == [(1, 0)]
    assert K.assign(np.array([[3.0]]), 2.0) == []


@pytest.mark.parametrize("method", ["nearest", "lap", "keyhole"])
def test_links_partition_detections(spark, method):
    df = spark.createDataFrame(moving(), DET)
    got = K.link_tracks(df, K.LinkRules(method, max_distance=12.0, volume_weight=0.1)).toPandas()
    assert len(got) == df.count()
    assert not got.duplicated(["block_name", "time", "track_id"]).any()
    for _, g in got.sort_values("time").groupby(["block_name", "track_id"]):
        assert (g.time.diff().dropna() <= 3).all()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(moving(2, 4, 8), DET)
    for lo in (0, 4):
        df.where((F.col("time") >= lo) & (F.col("time") < lo + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = K.LinkRules(max_distance=12.0)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = Q.link_stream(source, rules, delay=0).writeStream.format("memory").queryName("linked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = ["block_name", "time", "object_label"]
    got = spark.table("linked").toPandas().sort_values(key, ignore_index=True)
    want = K.link_tracks(df, rules).toPandas().sort_values(key, ignore_index=True)
    got_sets = {tuple(sorted(map(tuple, g[key].values.tolist()))) for _, g in got.groupby(["block_name", "track_id"])}
    want_sets = {tuple(sorted(map(tuple, g[key].values.tolist()))) for _, g in want.groupby(["block_name", "track_id"])}
    assert len(got) == len(want) and got_sets == want_sets


def test_crossing_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, t, t % 4 >= 2) for t in range(8)], "block_name long, track_id long, time int, inside boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = Q.crossing_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("crossed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.time, r.event) for r in spark.table("crossed").orderBy("time").collect()] == [(2, "entry"), (4, "exit"), (6, "entry")]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = rng.integers(0, 60, (45, 2))
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = spark.range(60).select(F.col("id").alias("node"))
    got = V.components(nodes, spark.createDataFrame(edges.tolist(), "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {k: root(k) for k in range(60)}


def test_censored_points_avoid_the_mask(spark):
    points = spark.createDataFrame([(1, 2.4, 3.6), (1, 9.0, 9.0)], "block int, y double, x double")
    mask = spark.createDataFrame([(1, 2, 4)], "block int, y int, x int")
    got = V.inside_mask(points, mask, ["block"])
    assert got.where("inside").count() == 1
    assert V.inside_mask(got.where("NOT inside").drop("inside"), mask, ["block"]).where("inside").count() == 0


def test_constrained_union_respects_span(spark):
    edges = spark.createDataFrame([(0, 0, z, 1, 1500, 1500) for z in range(5)], "block long, t int, z int, gap int, la long, lb long")
    got = K.constrained_union(edges, 3).toPandas()
    assert (got.groupby(["component_z", "component_label"]).z.agg(lambda n: n.max() - n.min() + 1) <= 3).all()
    assert got.label.tolist() == [1500] * 6 and sorted(got.component_z) == [0, 0, 0, 3, 3, 3]


def test_validation_errors(spark):
    bad = spark.createDataFrame([("a", "300"), ("a", "-1")], "block string, s string")
    with pytest.raises(ValueError):
        S.validated_metadata(bad, "block", "s")
    assert S.validated_metadata(bad, "block", "s", strict=False).count() == 1
    with pytest.raises(ValueError):
        C.must_be_unique(bad, "block")
    with pytest.raises(ValueError):
        S.resolve_columns(bad, {}, required=["time"])
    assert S.resolve_columns(bad.withColumnRenamed("s", "Frame"), {"time": ["t", "frame"]}, required=["time"]).columns == ["block", "time"]


def test_approach_rejects_frames_that_do_not_advance(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5.0, 0.0), (1, 1, 1, 4.0, 0.0)], "block_name int, track_id int, time int, distance double, minutes double")
    with pytest.raises(Exception, match="advance"):
        R.approach(rows, ["block_name", "track_id"], "distance", "minutes").collect()


def test_nested_fold_learns_a_clear_difference():
    rng = np.random.default_rng(0)
    y = np.arange(24) % 2
    x = rng.normal(0, 1, (24, 3)) + 4 * y[:, None]
    said = [L.nested_fold(x, y, i, [0.1, 1.0])[0] >= 0.5 for i in range(24)]
    assert L.balanced_accuracy(y, np.array(said)) > 0.9


def test_file_tools(spark):
    files = spark.createDataFrame([("b1", "x/a_lap.csv"), ("b1", "x/y/a_key.csv"), ("b2", "z.csv")], "block string, path string")
    got = S.best_file(files, "block", ["key", "lap"]).collect()
    assert [(r.block, r.path) for r in got] == [("b1", "x/y/a_key.csv")]
    status = {r.block: r.status for r in S.completeness(files, files.where("path <> 'x/a_lap.csv' AND block = 'b1'"), "block").collect()}
    assert status == {"b1": "INCOMPLETE", "b2": "SKIPPED"}
    parts = S.split_files(spark.range(40).select(F.col("id").cast("string").alias("path")), (0.7, 0.15), 1)
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 28, "validation": 6, "test": 6}


def keyhole_cost(track, found, r):
    """Plain version of one cell: track is (last, velocity or None, gap), both places (z, y, x, volume, intensity)."""
    last, velocity, gap = track
    n = gap + 1
    if abs(found[0] - last[0]) > r.max_z_step * n:
        return math.inf
    vec = [(found[0] - last[0]) * r.z_weight, found[1] - last[1], found[2] - last[2]]
    far = math.hypot(*vec)
    size = math.hypot(*velocity)
    if r.method == "keyhole" and size > r.least_speed:
        ahead = sum(a * b for a, b in zip(vec, velocity)) / size
        aside = math.hypot(*[a - ahead * b / size for a, b in zip(vec, velocity)])
        cone = 0 <= ahead <= r.forward_distance * n and math.atan2(aside, ahead + 1e-6) <= math.radians(r.cone_degrees)
        if not (cone or far <= r.back_radius):
            return math.inf
        cost = math.hypot(*[a - b * n for a, b in zip(vec, velocity)])
    else:
        if far > r.max_distance * n:
            return math.inf
        cost = far
    if r.method != "nearest":
        for k, w in ((3, r.volume_weight), (4, r.intensity_weight)):
            a, b = last[k], found[k]
            if math.isfinite(a) and math.isfinite(b):
                cost += w * r.max_distance * abs(a - b) / max(abs(a), abs(b), 1e-6)
    return cost


@pytest.mark.parametrize("method", ["nearest", "lap", "keyhole"])
def test_costs_against_plain_python(method):
    rng = np.random.default_rng(8)
    r = K.LinkRules(method, 30.0, 3.0, 2, z_weight=2.0, volume_weight=0.3, intensity_weight=0.2, forward_distance=25.0, back_radius=6.0)
    places = np.column_stack((rng.integers(0, 8, 40), rng.uniform(0, 60, (40, 2)), rng.uniform(1, 9, (40, 2))))
    places[::7, 3] = np.nan
    active = [{"last": p.tolist(), "speed": ([0.0] * 3 if k % 3 == 0 else rng.normal(0, 6, 3).tolist()), "gap": k % 3} for k, p in enumerate(places)]
    now = places[rng.permutation(40)] + np.array([0, 3, -2, 0, 0])
    now[3, 4] = np.nan
    got = K.costs(active, now, r)
    want = np.array([[keyhole_cost((t["last"], t["speed"], t["gap"]), p, r) for p in now.tolist()] for t in active])
    assert np.isfinite(want).sum() > 100 and np.array_equal(np.isfinite(got), np.isfinite(want))
    assert np.allclose(got[np.isfinite(want)], want[np.isfinite(want)])


@pytest.mark.parametrize("method", ["nearest", "lap", "keyhole"])
def test_linking_against_plain_python(spark, method):
    rng = np.random.default_rng(2)
    rows = [(b, t, k, float(rng.integers(0, 3)), 10.0 * k + 3 * t + rng.normal(), 5.0 * k + rng.normal(), float(rng.integers(1, 50)), None if k == 2 else 1.0) for b in range(3) for t in range(8) for k in range(6) if rng.random() > 0.15]
    r = K.LinkRules(method, 12.0, 2.0, 1, volume_weight=0.1, cost_cutoff=11.0)
    want = {}
    for b in range(3):
        active, next_id = [], 1
        for t in range(8):
            now = [x for x in rows if x[0] == b and x[1] == t]
            if not now:
                continue
            place = [[x if x is not None else math.nan for x in row[3:]] for row in now]
            best = (math.inf, ())
            def search(i, used, cost, pairs):
                nonlocal best
                if i == len(active):
                    key = (-len(pairs), cost)
                    if best[0] == math.inf or key < best[0]:
                        best = (key, tuple(pairs))
                    return
                for j, p in enumerate(place):
                    c = keyhole_cost((active[i][1], active[i][2], active[i][3]), p, r)
                    if j not in used and math.isfinite(c):
                        search(i + 1, used | {j}, cost + c, [*pairs, (i, j, c)])
                search(i + 1, used, cost, pairs)
            search(0, frozenset(), 0.0, [])
            ids = {}
            for i, j, c in best[1]:
                if c <= r.cost_cutoff:
                    active[i] = [active[i][0], place[j], [place[j][0] - active[i][1][0], place[j][1] - active[i][1][1], place[j][2] - active[i][1][2]], -1]
                    ids[j] = active[i][0]
            active = [[a[0], a[1], a[2], a[3] + 1] for a in active]
            active = [a for a in active if a[3] <= r.max_gap]
            for j in range(len(now)):
                if j not in ids:
                    ids[j] = next_id
                    active.append([next_id, place[j], [0.0] * 3, 0])
                    next_id += 1
                want[(b, t, now[j][2])] = ids[j]
    df = spark.createDataFrame(rows, "block_name long, time int, object_label long, centroid_z double, centroid_y double, centroid_x double, volume_voxels double, mean_intensity double")
    got = {(x.block_name, x.time, x.object_label): x.track_id for x in K.link_tracks(df, r).collect()}
    assert got == want


def test_stream_gives_last_frames_and_tells_late_ones(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "block_name long, time int, object_label long, centroid_z double, centroid_y double, centroid_x double, volume_voxels double, mean_intensity double, at timestamp"
    at = datetime(2024, 1, 1)
    row = lambda b, t, k=1: (b, t, k, 0.0, float(t), 0.0, 1.0, 1.0, at + timedelta(minutes=t))
    folder = str(tmp_path / "in")
    for part in ([row(1, t) for t in range(4)], [row(1, 1, 2), row(2, 30)], [row(2, 60)], [row(2, 90)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = Q.link_stream(stream, K.LinkRules(max_distance=5.0), delay=1, acquired="at").writeStream.format("memory").queryName("linked_late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("linked_late").where("block_name = 1").collect()), key=str)
    assert [(r[1], r[2], r[3]) for r in got] == [(0, 1, 1), (1, 1, 1), (1, 2, None), (2, 1, 1), (3, 1, 1)]
