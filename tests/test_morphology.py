"""Masks as runs against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import morphology as M
from tracklore.plans import mask_queries

SF = "/root/testdata/sf0.001"
H, WIDTH = 9, 11


def frame(spark, masks):
    rows = [(k, int(y), int(x)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "block int, y int, x int"), spark.range(len(masks)).select(F.col("id").cast("int").alias("block"))


def back(runs, n):
    out = np.zeros((n, H, WIDTH), bool)
    for r in M.pixels_of(runs, ["block"]).collect():
        assert not out[r.block, r.y, r.x]
        out[r.block, r.y, r.x] = True
    return out


def disks(m, r):
    """For each pixel, those of its disk that lie in the image."""
    for y in range(H):
        for x in range(WIDTH):
            yield y, x, [m[b, a] for b in range(max(0, y - r), min(H, y + r + 1)) for a in range(max(0, x - r), min(WIDTH, x + r + 1)) if (b - y) ** 2 + (a - x) ** 2 <= r * r]


def disk_op(m, r, op):
    out = np.zeros_like(m)
    for y, x, near in disks(m, r):
        out[y, x] = op(near)
    return out


def flood(m, corners):
    seen, found = np.zeros(m.shape, int), []
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            todo, part = [(y, x)], []
            seen[y, x] = 1
            while todo:
                b, a = todo.pop()
                part.append((b, a))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        u, v = b + dy, a + dx
                        if (corners or not dy or not dx) and 0 <= u < H and 0 <= v < WIDTH and m[u, v] and not seen[u, v]:
                            seen[u, v] = 1
                            todo.append((u, v))
            found.append(part)
    return found


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(6)
    out = [rng.random((H, WIDTH)) < p for p in (0.05, 0.3, 0.5, 0.8)]
    spiral = np.zeros((H, WIDTH), bool)
    spiral[0], spiral[:, -1], spiral[-1], spiral[2:, 0], spiral[2, :-2], spiral[2:7, -3] = [True] * 6
    return [*out, spiral, np.ones((H, WIDTH), bool)]


def test_disks_and_their_borders(spark, masks):
    px, images = frame(spark, masks)
    runs = M.runs_of(px.unionAll(px), ["block"])
    assert (back(runs, len(masks)) == np.array(masks)).all()
    for r in (1, 2):
        grown = [disk_op(m, r, any) for m in masks]
        assert (back(M.dilated_runs(runs, ["block"], r, H, WIDTH), len(masks)) == np.array(grown)).all()
        assert (back(M.eroded_runs(runs, images, ["block"], r, H, WIDTH), len(masks)) == np.array([disk_op(m, r, all) for m in masks])).all()
        assert (back(M.closed_runs(runs, images, ["block"], r, H, WIDTH), len(masks)) == np.array([disk_op(g, r, all) for g in grown])).all()


def test_parts_holes_and_ranks(spark, masks):
    px, images = frame(spark, masks)
    runs = M.runs_of(px, ["block"])
    for corners in (False, True):
        got = M.parts(runs, ["block"], corners).groupBy("block", "part").agg(F.first("area").alias("area"), F.first("first").alias("first"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()
        assert sorted((r.block, *r.first, r.area, r.n) for r in got) == sorted((k, *min(p), len(p), len(p)) for k, m in enumerate(masks) for p in flood(m, corners))
    whole = []
    for m in masks:
        m = m.copy()
        for part in flood(~m, False):
            if len(part) < 4:
                m[tuple(np.transpose(part))] = True
        whole.append(m)
    assert (back(M.filled(runs, images, ["block"], 4, H, WIDTH), len(masks)) == np.array(whole)).all()
    best = M.ranked_parts(runs, ["block"], 2).where("rank = 1").groupBy("block").agg(F.first("area").alias("area"), F.first("part_id").alias("id")).collect()
    for r in best:
        ordered = [p for p in sorted(flood(masks[r.block], True), key=min) if len(p) > 1]
        assert r.area == max(map(len, ordered)) and len(ordered[r.id - 1]) == r.area


def test_no_pixel_at_all(spark, masks):
    px, images = frame(spark, [np.zeros((H, WIDTH), bool)])
    runs = M.runs_of(px, ["block"])
    assert M.parts(runs, ["block"], True).count() == 0 and M.complement(runs, images, ["block"], H, WIDTH).count() == H
    assert M.filled(runs, images, ["block"], 10, H, WIDTH).count() == 0
    assert M.dense_outline(px, ["block"], H, WIDTH).count() == 0


def written(spark):
    """Rows that the session's stages have shuffled so far."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_outlines_shuffle_runs_and_not_pixels(spark):
    n, size = 30, 24
    px = spark.range(n).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y")).select("block", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    px = px.withColumn("v", F.when((F.col("y") - 11) ** 2 + (F.col("x") - 12) ** 2 < 60, F.lit(50.0)).otherwise(F.lit(1.0)) + F.pmod(F.xxhash64("block", "y", "x"), F.lit(9)))
    px = M.kept(px).repartition(5, "block")
    before = written(spark)
    body = M.body_outline(px, ["block"], "v", size, size, sigma=1.2, closing=2, hole=12, least=20, dilation=1)
    after = written(spark)
    # the table is dealt for the quantiles and for the values; all else is runs, of which an image has about three a row
    assert sum(after[k] for k in after.keys() - before.keys()) < 4 * n * size * size
    cluster = M.dense_outline(px.where("v > 52"), ["block"], size, size, body, sigma=1.5, closing=1, least=6, dilation=1)
    assert cluster.select("block").distinct().count() == n
    assert sum(s for k, s in written(spark).items() if k not in after) < 3 * n * size * size


def test_parts_of_null_and_several_keys(spark):
    rows = [(None, "a", 0, 0), (None, "a", 1, 0), (None, "b", 1, 0), (2**60 + 1, "a", 0, 3), (2**60 + 1, "a", 1, 4), (2**60, "a", 0, 3), (2**60, "a", -1, 3)]
    runs = M.runs_of(spark.createDataFrame(rows, "block long, channel string, y int, x int"), ["block", "channel"])
    for corners in (False, True):
        got = M.parts(runs, ["block", "channel"], corners).groupBy("block", "channel", "part").agg(F.first("area").alias("area"), F.first("first").alias("first")).collect()
        diagonal = [(2**60 + 1, "a", 2, (0, 3))] if corners else [(2**60 + 1, "a", 1, (0, 3)), (2**60 + 1, "a", 1, (1, 4))]
        assert sorted((r.block or 0, r.channel, r.area, tuple(r.first)) for r in got) == sorted([(0, "a", 2, (0, 0)), (0, "b", 1, (1, 0)), (2**60, "a", 2, (-1, 3)), *diagonal])


def test_the_parting_value_of_a_histogram(spark):
    rng = np.random.default_rng(3)
    images = [rng.normal(0, 1, 400), np.concatenate([rng.normal(0, 1, 200), rng.normal(9, 2, 150)]), np.array([1.0, 2.0]), np.full(5, 3.0)]
    px = spark.createDataFrame([(k, 0, i, float(v)) for k, a in enumerate(images) for i, v in enumerate(a)], "block int, y int, x int, v double")
    found = {r.block: r.threshold for r in M.parting_value(px, ["block"], "v").select("block", "threshold").distinct().collect()}
    assert sorted(found) == [0, 1, 2]
    for k, threshold in found.items():
        a, b = images[k].min(), images[k].max()
        n = np.bincount(np.minimum(((images[k] - a) / (b - a) * M.BINS).astype(int), M.BINS - 1), minlength=M.BINS)
        w, m = np.cumsum(n), np.cumsum(n * np.arange(M.BINS))
        at = [(-round(w[i] * (w[-1] - w[i]) * (m[i] / w[i] - (m[-1] - m[i]) / (w[-1] - w[i])) ** 2, 6), i) for i in range(M.BINS) if n[i] and w[i] < w[-1]]
        assert threshold == pytest.approx(a + (min(at)[1] + 0.5) * (b - a) / M.BINS)


def test_plates_and_what_is_kept_off_deal_their_table_once_a_pass(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    start = written(spark)
    assert mask_queries.plates(spark, SF).agg(F.sum("v")).first()[0] > 0
    once = written(spark)
    assert n <= sum(s for k, s in once.items() if k not in start) < 1.2 * n
    assert mask_queries.QUERIES["exclusion_outline"](spark, SF).count() > 0
    # three passes: quantiles, values, bright pixels; images have 1024 pixels each, and a few hundred runs over all steps
    assert sum(s for k, s in written(spark).items() if k not in once) < 5 * n
