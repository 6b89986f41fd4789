"""Masks as runs of pixels in rows: union, complement, disks, connected parts, holes, outlines of bodies and of dense regions.

A mask is (key, y, x0, x1): pixels x0 to x1 of row y, both included, runs of a row apart from each other. Work on runs is by
(key, row), and only the graph of touching runs crosses rows. Tables of pixels are the large ones: outlines deal them once by
image and keep what follows in its task, so that only runs are shuffled or stored; such a task holds an image's sums, and its
sorts may spill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.operators import lineage
from tracklore.operators.lineage import apart, components_within, freed, kept, least_reached

#: Bins of the histogram that the threshold between dark and light comes from.
BINS = 256

#: Rows of images that one task holds, about.
ROWS = 10_000


def _stored(df: DataFrame) -> DataFrame:
    """df kept, once the disk of the step before is freed."""
    freed(df.sparkSession)
    return kept(df)


def _tasks(images: DataFrame, height: int) -> int:
    """How many tasks to deal images (key) to by their key: masks of the same images, dealt alike, meet without a shuffle."""
    return max(-(-images.count() * height // ROWS), images.sparkSession.sparkContext.defaultParallelism)


def merged(runs: DataFrame, key: list[str]) -> DataFrame:
    """Runs that overlap or touch within a row, as one."""
    before = W.partitionBy(*key, "y").orderBy("x0", "x1")
    new = F.coalesce(F.col("x0") > F.max("x1").over(before.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    of = runs.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(before.rowsBetween(W.unboundedPreceding, 0)))
    return of.groupBy(*key, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def runs_of(pixels: DataFrame, key: list[str]) -> DataFrame:
    """The mask of some pixels (key, y, x), which may repeat."""
    return merged(pixels.select(*key, "y", F.col("x").alias("x0"), F.col("x").alias("x1")).distinct(), key)


def pixels_of(runs: DataFrame, key: list[str], *more: str) -> DataFrame:
    return runs.select(*key, *more, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def complement(runs: DataFrame, images: DataFrame, key: list[str], height: int, width: int) -> DataFrame:
    """What the mask leaves of each image (key): the gaps between its runs, and rows without one."""
    rows = images.select(*key, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    edges = rows.select(*key, "y", F.explode(F.array(F.lit(-1), F.lit(width))).alias("x0")).withColumn("x1", F.col("x0"))
    every = runs.select(*key, "y", "x0", "x1").unionAll(edges.select(*key, "y", "x0", "x1"))
    after = F.lead("x0").over(W.partitionBy(*key, "y").orderBy("x0"))
    return every.select(*key, "y", (F.col("x1") + 1).alias("x0"), (after - 1).alias("x1")).where("x0 <= x1")


def dilated_runs(runs: DataFrame, key: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Pixels of the image within radius of the mask: a disk is one run a row, so a run grows to one run for each of its rows."""
    disk = F.explode(F.array(*[F.struct(F.lit(d).alias("dy"), F.lit(math.isqrt(radius * radius - d * d)).alias("dx")) for d in range(-radius, radius + 1)]))
    grown = runs.select(*key, "y", "x0", "x1", disk.alias("o")).select(*key, (F.col("y") + F.col("o.dy")).alias("y"), F.greatest(F.col("x0") - F.col("o.dx"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("o.dx"), F.lit(width - 1)).alias("x1"))
    return merged(grown.where((F.col("y") >= 0) & (F.col("y") < height)), key)


def eroded_runs(runs: DataFrame, images: DataFrame, key: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Pixels whose disk, as far as the image goes, is in the mask."""
    outside = complement(runs, images, key, height, width)
    return complement(dilated_runs(outside, key, radius, height, width), images, key, height, width)


def closed_runs(runs: DataFrame, images: DataFrame, key: list[str], radius: int, height: int, width: int) -> DataFrame:
    return eroded_runs(dilated_runs(runs, key, radius, height, width), images, key, radius, height, width)


def crossed(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Pixels of both masks."""
    other = b.select(*key, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    both = a.join(other.hint("merge"), [*key, "y"]).where("x0 <= _b AND _a <= x1")
    return both.select(*key, "y", F.greatest("x0", "_a").alias("x0"), F.least("x1", "_b").alias("x1"))


def _tied(key: list[str], reach: int):
    """Runs of whole images with part, area, _y and _x: the number of the part's first run in the task, its pixels, its first pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        runs = pa.Table.from_batches(batches)
        image = np.zeros(len(runs), np.int64)
        for c in key:
            code = runs[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            image = np.unique(image * (int(code.max()) + 1) + code, return_inverse=True)[1]
        y, x0, x1 = (runs[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        order = np.lexsort((x0, y, image))
        runs, image, y, x0, x1 = runs.take(order), image[order], y[order], x0[order], x1[order]
        line, left = image * (y.max() - y.min() + 2) + y, x0.min() - reach
        wide = x1.max() + reach - left + 1
        at = lambda line, x: line * wide + x - left
        first = np.searchsorted(at(line, x1), at(line + 1, x0 - reach))
        near = np.maximum(np.searchsorted(at(line, x0), at(line + 1, x1 + reach), side="right") - first, 0)
        u = np.repeat(np.arange(len(y)), near)
        v = np.arange(len(u)) + np.repeat(first - (np.cumsum(near) - near), near)
        part = least_reached(u, v, len(y))
        area = np.zeros(len(y), np.int64)
        np.add.at(area, part, x1 - x0 + 1)
        more = {"part": part, "area": area[part], "_y": y[part], "_x": x0[part]}
        for name, values in more.items():
            runs = runs.append_column(name, pa.array(values.astype(np.int64)))
        yield from runs.to_batches(max_chunksize=10_000)

    return run


def _parts_of_large(own: DataFrame, key: list[str], reach: int) -> DataFrame:
    """What _tied gives, for images whose runs are many tasks' work: their graph is settled in rounds."""
    own = kept(own.withColumn("run", F.monotonically_increasing_id()))
    below = own.select(*[F.col(k).alias(f"_{k}") for k in key], (F.col("y") - 1).alias("_line"), F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("run").alias("v"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    ties = own.join(below.hint("merge"), [*same, F.col("y") == F.col("_line")]).where((F.col("x0") <= F.col("_b") + reach) & (F.col("_a") <= F.col("x1") + reach))
    found = components_within(ties.select(*key, F.col("run").alias("u"), "v"), key).select(F.col("u").alias("run"), F.col("component").alias("part"))
    of = own.join(found.hint("merge"), "run", "left").withColumn("part", F.coalesce("part", "run")).drop("run")
    sizes = of.groupBy("part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min(F.struct("y", "x0")).alias("_f"))
    sizes = sizes.select("part", "area", F.col("_f.y").cast("long").alias("_y"), F.col("_f.x0").cast("long").alias("_x"))
    return of.join(sizes.hint("merge"), "part").select(*own.drop("run").columns, "part", "area", "_y", "_x")


def parts(runs: DataFrame, key: list[str], corners: bool) -> DataFrame:
    """Runs with part, area and first: the connected part that each belongs to, its pixels, and its first one by row and column.

    Runs of neighbouring rows are tied where they share a column, or touch at a corner if corners count. part is a number
    of its image. Images are dealt to tasks that tie and settle their runs; those of very many runs are settled over all tasks.
    """
    reach = 1 if corners else 0
    own = _stored(runs.select(*key, "y", "x0", "x1"))
    light, rest = apart(own, key, lineage.LARGE // 2)
    types = dict(own.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + ", part long, area long, _y long, _x long"
    tasks = max(-(-own.count() // (lineage.EDGES // 2)), own.sparkSession.sparkContext.defaultParallelism)
    found = light.repartition(tasks, *key).mapInArrow(_tied(key, reach), schema)
    if rest is not None:
        found = found.unionAll(_parts_of_large(rest, key, reach))
    number = F.col("_y") * F.lit(1 << 32) + F.col("_x")
    return found.select(*key, "y", "x0", "x1", number.alias("part"), "area", F.struct(F.col("_y").cast(types["y"]).alias("y"), F.col("_x").cast(types["x0"]).alias("x")).alias("first"))


def without_small(runs: DataFrame, key: list[str], least: int) -> DataFrame:
    """The mask without parts of fewer than least pixels, tied by sides."""
    return parts(runs, key, corners=False).where(F.col("area") >= least).select(*key, "y", "x0", "x1")


def filled(runs: DataFrame, images: DataFrame, key: list[str], most: int, height: int, width: int) -> DataFrame:
    """The mask with parts of what it leaves that have fewer than most pixels: a flood of the background's runs."""
    gaps = parts(complement(runs, images, key, height, width), key, corners=False).where(F.col("area") < most)
    return merged(runs.select(*key, "y", "x0", "x1").unionAll(gaps.select(*key, "y", "x0", "x1")), key)


def ranked_parts(runs: DataFrame, key: list[str], least: int = 1) -> DataFrame:
    """Runs with part_id and rank: each image's parts of at least least pixels, numbered by their first pixel, and ranked
    by area, the first of equals first. Corners count."""
    found = parts(runs, key, corners=True).where(F.col("area") >= least)
    of = W.partitionBy(*key)
    found = found.withColumns({"part_id": F.dense_rank().over(of.orderBy("first")), "rank": F.dense_rank().over(of.orderBy(F.desc("area"), "first"))})
    return found.drop("first", "part")


def smoothed(pixels: DataFrame, key: list[str], value: str, sigma: float, height: int, width: int, digits: int = 9) -> DataFrame:
    """Gaussian mean of value around every pixel that one is near, images mirrored at their borders; absent pixels are 0."""
    reach = int(4 * sigma + 0.5)
    weights = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)}
    total = sum(weights.values())
    offsets = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w")) for d, w in weights.items()])).alias("o")
    out = pixels.select(*key, "y", "x", F.col(value).alias("_v"))
    for axis, other, size in (("y", "x", height), ("x", "y", width)):
        to = F.pmod(F.col(axis) + F.col("o.d"), F.lit(2 * size))
        out = out.select(*key, "y", "x", "_v", offsets).groupBy(*key, other, F.least(to, 2 * size - 1 - to).alias(axis)).agg(F.sum(F.col("_v") * F.col("o.w")).alias("_v"))
    return out.select(*key, "y", "x", F.round("_v", digits).alias(value))


def parting_value(pixels: DataFrame, key: list[str], value: str) -> DataFrame:
    """pixels with threshold: of their image's histogram in BINS bins between its least and largest value, the middle of the bin
    that parts it with the largest variance between both sides, the first of equals. Images of one value are left out."""
    every = W.partitionBy(*key)
    upto = every.orderBy("_level")  # with equal levels, so what a pixel sees are the sums of its bin
    span = pixels.withColumns({"_a": F.min(value).over(every), "_b": F.max(value).over(every)}).where("_b > _a")
    h = span.withColumn("_level", F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * BINS), F.lit(BINS - 1)))
    h = h.withColumns({"_w": F.count("*").over(upto), "_m": F.sum("_level").over(upto), "_ww": F.count("*").over(every), "_mm": F.sum("_level").over(every)})
    above = F.when(F.col("_ww") > F.col("_w"), F.col("_ww") - F.col("_w"))
    between = F.col("_m") / F.col("_w") - (F.col("_mm") - F.col("_m")) / above
    h = h.withColumn("_between", F.round(F.col("_w") * above * between * between, 6))
    best = F.min_by("_level", F.when(F.col("_between").isNotNull(), F.struct(-F.col("_between"), F.col("_level")))).over(every)
    return h.select(*pixels.columns, (F.col("_a") + (best + 0.5) * (F.col("_b") - F.col("_a")) / BINS).alias("threshold"))


def body_outline(pixels: DataFrame, key: list[str], value: str, height: int, width: int, sigma: float = 2.0, relaxed: float = 0.6, floor: float = 0.03, closing: int = 10, hole: int = 5000, least: int = 15_000, dilation: int = 3) -> DataFrame:
    """The largest light part of each image, as runs. pixels has every pixel of an image, (key, y, x, value).

    Values are scaled between two quantiles and smoothed; what is over a relaxed threshold and a floor is closed by a
    disk, holes of fewer than hole pixels are filled, parts of fewer than least go, and the largest one that is left is
    dilated. An image of one value has no outline.
    """
    q = pixels.groupBy(*key).agg(F.percentile(value, F.lit(0.01)).alias("_a"), F.percentile(value, F.lit(0.998)).alias("_b")).where("_b > _a")
    share = F.least(F.greatest((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")), F.lit(0.0)), F.lit(1.0))
    q = _stored(q)
    tasks = _tasks(q, height)
    images = q.select(*key).repartition(tasks, *key)
    soft = smoothed(pixels.join(q.hint("merge"), key).withColumn("_s", share), key, "_s", sigma, height, width)
    light = parting_value(soft, key, "_s").where(F.col("_s") > F.greatest(F.round(relaxed * F.col("threshold"), 9), F.lit(floor)))
    light = runs_of(light, key).repartition(tasks, *key)
    mask = _stored(closed_runs(light, images, key, closing, height, width)).repartition(tasks, *key)
    mask = filled(mask, images, key, hole, height, width)
    body = ranked_parts(without_small(mask, key, least), key).where("rank = 1")
    return _stored(dilated_runs(body, key, dilation, height, width))


def dense_outline(pixels: DataFrame, key: list[str], height: int, width: int, body: DataFrame | None = None, sigma: float = 8.0, quantile: float = 0.7, floor: float = 0.08, closing: int = 4, least: int = 1500, only_largest: bool = True, dilation: int = 4) -> DataFrame:
    """Where occupied pixels (key, y, x) are dense, as runs with cluster_id; body, a mask, bounds pixels, cores and result.

    Smoothed occupancy over a quantile of its values at occupied pixels, and a floor, is closed by a disk; parts of fewer
    than least pixels go, of the others only the largest stays if asked, and the rest is dilated: then all of it is
    cluster 1. Without dilation, clusters are numbered by their first pixel.
    """
    own = runs_of(pixels, key)
    own = _stored(crossed(own, body, key) if body is not None else own)
    images = kept(own.select(*key).distinct())
    tasks = _tasks(images, height)
    images, own = images.repartition(tasks, *key), pixels_of(own.repartition(tasks, *key), key)
    soft = smoothed(own.withColumn("_d", F.lit(1.0)), key, "_d", sigma, height, width)
    soft = soft.withColumn("_own", F.lit(False)).unionAll(own.select(*key, "y", "x", F.lit(0.0).alias("_d"), F.lit(True).alias("_own")))
    soft = soft.groupBy(*key, "y", "x").agg(F.max("_d").alias("_d"), F.max("_own").alias("_own"))
    share = F.percentile(F.when(F.col("_own"), F.col("_d")), F.lit(quantile)).over(W.partitionBy(*key))
    core = soft.withColumn("_cut", F.greatest(F.round(share, 9), F.lit(floor))).where("_d >= _cut")
    core = runs_of(core, key)
    core = (crossed(core, body, key) if body is not None else core).repartition(tasks, *key)
    core = without_small(closed_runs(core, images, key, closing, height, width), key, least)
    found = ranked_parts(core, key, least)
    found = found.where("rank = 1") if only_largest else found
    if not dilation:
        return found.select(*key, (F.lit(1) if only_largest else F.col("part_id")).alias("cluster_id"), "y", "x0", "x1")
    grown = dilated_runs(found, key, dilation, height, width)
    return _stored((crossed(grown, body, key) if body is not None else grown).select(*key, F.lit(1).alias("cluster_id"), "y", "x0", "x1"))


def exclusion_outline(cluster: DataFrame, key: list[str], height: int, width: int, body: DataFrame | None = None, dilation: int = 25) -> DataFrame:
    """Runs around a cluster's mask in which single cells are not tracked, never outside the body."""
    grown = dilated_runs(cluster, key, dilation, height, width)
    return crossed(grown, body, key) if body is not None else grown


def carried(runs: DataFrame, frames: DataFrame, key: list[str], time: str, least: int = 1) -> DataFrame:
    """Each frame's mask (key, time), or, where it has fewer than least pixels, the last one that has enough.

    frames has all frames; one with no such mask before it keeps its own. carried_from tells the frame a mask is from.
    """
    area = runs.groupBy(*key, time).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    of = frames.select(*key, time).distinct().join(area.hint("merge"), [*key, time], "left")
    last = F.last(F.when(F.col("_n") >= least, F.col(time)), ignorenulls=True).over(W.partitionBy(*key).orderBy(time))
    of = of.select(*key, F.col(time).alias("_to"), F.coalesce(last, F.col(time)).alias(time))
    return runs.join(of.hint("merge"), [*key, time]).withColumnRenamed(time, "carried_from").withColumnRenamed("_to", time)


#: Links that one group meets with the masks of their frames, about, and samples of links looked up at a time.
LINKS, SAMPLES = 20_000, 1_000_000


def _crossing(images: list[str], samples: int):
    """The links of a bucket of images that a run of their image covers a sample of."""

    def run(links: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(len(links) + len(runs), np.int64)
        for c in images:
            code = pd.factorize(pd.concat([links[c], runs[c]]))[0].astype(np.int64)
            image = pd.factorize(image * (code.max(initial=0) + 1) + code)[0].astype(np.int64)
        of, image = image[: len(links)], image[len(links) :]
        y, x0, x1 = (runs[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        hit = np.zeros(len(links), bool)
        if len(runs) and len(links):
            low, left = y.min(), x0.min()
            high, wide = y.max() - low + 1, max(x1.max(), x0.max()) - left + 2
            rows, row = np.unique(image * high + y - low, return_inverse=True)
            order = np.argsort(row * wide + x0 - left, kind="stable")
            start, end = (row * wide + x0 - left)[order], np.maximum.accumulate((row * wide + x1 - left)[order])
            f = np.arange(samples) / float(samples - 1)
            ends = links[["y0", "x0", "y1", "x1"]].to_numpy(float)
            each = max(1, SAMPLES // samples)
            for k in range(0, len(links), each):
                a, b, c, d = (v[:, None] for v in ends[k : k + each].T)
                py, px = np.rint(a + (c - a) * f), np.rint(b + (d - b) * f)
                good = (py >= low) & (py < low + high) & (px >= left) & (px < left + wide - 1)
                which, sample = np.nonzero(good)
                key = of[k : k + each][which] * high + py[which, sample].astype(np.int64) - low
                at = np.minimum(np.searchsorted(rows, key), len(rows) - 1)
                place = at * wide + px[which, sample].astype(np.int64) - left
                before = np.searchsorted(start, place, side="right") - 1
                hit[k + which[(rows[at] == key) & (before >= 0) & (end[before] >= place)]] = True
        return pd.DataFrame({"link_id": links["link_id"].to_numpy()[hit]})

    return run


def links_across(links: DataFrame, runs: DataFrame, key: list[str], time: str, samples: int) -> DataFrame:
    """(link_id, crosses): whether a link (key, link_id, t0, t1, y0, x0, y1, x1) meets the mask in any frame from t0 to t1.

    Its pixels are those of samples places from one end to the other. Links and runs are dealt to buckets of images by their
    frame, where samples are made and looked up, so that only links move.
    """
    links = kept(links.select(*key, "link_id", "t0", "t1", "y0", "x0", "y1", "x1"))
    at = links.select(*key, "link_id", F.explode(F.sequence("t0", "t1")).alias(time), *[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "y1", "x1")])
    at = at.dropna(subset=[*key, time, "y0", "x0", "y1", "x1"])
    masks = runs.select(*[F.col(c).cast(t).alias(c) for c, t in at.dtypes if c in (*key, time)], "y", "x0", "x1").dropna()
    buckets = max(1, -(-links.count() // LINKS), links.sparkSession.sparkContext.defaultParallelism)
    bucket = F.pmod(F.xxhash64(*key, time), F.lit(buckets)).alias("_bucket")
    kind = dict(links.dtypes)["link_id"]
    hit = at.withColumn("_bucket", bucket).groupBy("_bucket").cogroup(masks.withColumn("_bucket", bucket).groupBy("_bucket")).applyInPandas(_crossing([*key, time], samples), f"link_id {kind}")
    return links.select("link_id").join(hit.distinct().withColumn("crosses", F.lit(True)).hint("merge"), "link_id", "left").select("link_id", F.coalesce("crosses", F.lit(False)).alias("crosses"))
