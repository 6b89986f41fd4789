"""Operators at the bounds that large tables reach: calls for state, ties of sums, memory of a task, rounds over a graph."""

import pandas as pd
from pyspark.sql import functions as F

from tracklore.operators import lineage
from tracklore.operators import link as K
from tracklore.operators import morphology as M
from tracklore.operators import reports as P
from tracklore.operators import voxels as V
from tracklore.plans import series_queries, track_queries, views, voxel_queries
from tracklore.streaming import link_stream as L

SF = "/root/testdata/sf0.001"


class _State:
    def __init__(self):
        self.now, self.calls = None, 0

    def exists(self):
        return self.now is not None

    def get(self):
        self.calls += 1
        return iter(self.now or []) if isinstance(self.now, list) else self.now

    def put(self, rows):
        self.now = list(rows)

    def appendList(self, rows):
        self.now = [*(self.now or []), *rows]

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None


class _Map:
    def __init__(self):
        self.of = {}

    def iterator(self):
        return iter(list(self.of.items()))

    def updateValue(self, key, value):
        self.of[key] = value


class _Handle:
    def __init__(self):
        self.timers, self.set = set(), 0
        self.list, self.map, self.value = _State(), _Map(), _State()

    def getListState(self, *_):
        return self.list

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, ms):
        self.timers.add(ms)
        self.set += 1

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_crossings_set_one_timer_of_a_bucket():
    handle, made = _Handle(), L.Crossings(0)
    made.init(handle)
    rows = pd.DataFrame([(track, 1000 * (10 * k + track), k, (k + track) % 2 == 0) for track in range(5) for k in range(40)], columns=["track_id", "us", "number", "inside"])
    list(made.handleInputRows((1,), iter([rows]), _Clock(0)))
    assert len(handle.timers) == handle.set == 1
    handle.timers.clear()
    half = pd.concat(made.handleExpiredTimer((1,), _Clock(200), None))
    assert handle.list.calls == 1 and handle.timers == {min(r[1] for r in handle.list.now) // 1000 + 1}
    handle.timers.clear()
    rest = pd.concat(made.handleExpiredTimer((1,), _Clock(10**6), None))
    found = pd.concat([half, rest])
    assert len(found) == 5 * 39 and handle.list.now is None and not handle.timers
    for _, of in found.groupby(["track_id", "event"]):
        assert of.sort_values("number")["total"].tolist() == list(range(1, len(of) + 1))


def test_step_angles_do_not_follow_the_order_of_sums(spark):
    # headings of 90, -90 and 180 degrees: the mean sine is zero but for noise, whose sign the order of its terms decides
    found = set()
    for steps in ((90, 270, 180, 180), (270, 90, 180, 180), (180, 90, 270, 180), (180, 180, 270, 90), (180,), (180, 180, 180)):
        at, rows = {"x": 0.0, "y": 0.0}, [(1, 1, 0, 0.0, 0.0, 0.0)]
        for k, turn in enumerate(steps):
            at = {"x": at["x"] + {90: 0.0, 270: 0.0, 180: -1.0}[turn], "y": at["y"] + {90: 1.0, 270: -1.0, 180: -0.0}[turn]}
            rows.append((1, 1, k + 1, 0.0, at["y"], at["x"]))
        tracks = spark.createDataFrame(rows, "block_name long, track_id long, time int, centroid_z double, centroid_y double, centroid_x double")
        found.add(round(P.step_angles(tracks).first()["xy_mean_deg"], 9))
    assert found == {180.0}
    noise = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0), (1, 1, 1, 0.0, -1e-17, -1.0)], "block_name long, track_id long, time int, centroid_z double, centroid_y double, centroid_x double")
    assert P.step_angles(noise).first()["xy_mean_deg"] == 180.0


def test_dense_region_keeps_densities_that_tie(spark, monkeypatch):
    # sums in other orders differ by noise, which must not part equal densities at the quantile
    exact = V.density
    noise = (F.pmod(F.xxhash64("f", "y", "x"), F.lit(5)) - 2) * 1e-16
    monkeypatch.setattr(V, "density", lambda *a: exact(*a).withColumn("density", F.col("density") + noise))
    pattern = [(0, 0), (0, 5), (5, 0), (5, 5), (9, 9), (9, 14)]
    rows = [(f, y, x) for f in range(20) for y, x in pattern]
    found = V.dense_region(spark.createDataFrame(rows, "f int, y int, x int"), ["f"], 1.0, 2, 0.5, 0.01, 1)
    assert found.groupBy("y", "x").count().where("count <> 20").isEmpty()
    assert found.join(spark.createDataFrame(rows, "f int, y int, x int"), ["f", "y", "x"]).count() == len(rows)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_views_deal_their_table_once_to_tasks_that_follow_it(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS", 500, raising=False)
    for view in (views.big_detections, views.voxels):
        assert view(spark, SF).rdd.getNumPartitions() >= 10
    for name in ("eroded_mask", "pixel_density", "slice_nodes"):
        assert _exchanges(voxel_queries.QUERIES[name](spark, SF)) == 1
    assert _exchanges(track_queries.QUERIES["track_quality"](spark, SF)) == 1
    assert series_queries.QUERIES["interpolated_shifts"](spark, SF).count() > 0


def test_signed_distances_deal_their_inputs_only(spark):
    assert _exchanges(voxel_queries.QUERIES["signed_distances"](spark, SF)) <= 3


def test_lags_are_looked_up_in_one_window(spark):
    assert _exchanges(track_queries.QUERIES["msd_log_fit"](spark, SF)) == 1


def test_nearest_other_asks_in_few_cells(spark):
    points = spark.range(400).select(F.col("id").alias("gt_id"), F.lit(1).alias("block_name"), F.lit(0).alias("time"), (F.col("id") * 7.3 % 97).alias("y"), (F.col("id") * 3.1 % 89).alias("x"))
    found = {r["gt_id"]: (r["other"], r["distance"]) for r in P.nearest_other(points, 6.0).collect()}
    at = [(r["gt_id"], r["y"], r["x"]) for r in points.collect()]
    for i, y, x in at:
        near = min((((y - b) ** 2 + (x - c) ** 2) ** 0.5, j) for j, b, c in at if j != i)
        assert found[i] == ((near[1], near[0]) if near[0] <= 6 else (None, None))
    assert "Generate explode(array" not in P.nearest_other(points, 6.0)._jdf.queryExecution().optimizedPlan().toString()


def test_parts_take_no_rounds_over_the_graph(spark, monkeypatch):
    snake = [(b, y, x) for b in range(3) for y in range(0, 21) for x in range(12) if y % 2 == 0 or x == (11 if y % 4 == 1 else 0)]
    runs = M.runs_of(spark.createDataFrame([*snake, (1, 30, 0), (2, 31, 5), (2, 31, 6)], "block long, y int, x int"), ["block"])
    found = lambda: sorted(M.parts(runs, ["block"], corners=False).groupBy("block", "part").agg(F.first("area").alias("area"), F.count("*").alias("runs")).select("block", "area", "runs").collect())
    monkeypatch.setattr(lineage, "LARGE", 0)
    rounds = found()
    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(lineage, "components", lambda *a: calls.append(a))
    assert found() == rounds == [(0, 142, 21), (1, 1, 1), (1, 142, 21), (2, 2, 1), (2, 142, 21)]
    assert not calls


def test_small_frames_share_a_group(spark):
    edges = spark.createDataFrame([(b, 1, z, 1, 1 + b % 2, 1) for b in range(300) for z in range(6)], "block long, t int, z int, gap int, la int, lb int")
    found = K.constrained_union(edges, 4)
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["block"], r["z"], r["label"]): (r["component_z"], r["component_label"]) for r in found.collect()}
    assert len(got) == 150 * 7 + 150 * 12
    assert [got[(0, z, 1)][0] for z in range(7)] == [0, 0, 0, 0, 4, 4, 4] and all(got[(b, z, 1)] == got[(0, z, 1)] for b in range(0, 300, 2) for z in range(7))
