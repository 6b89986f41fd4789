"""Labelled voxels as rows: objects, overlaps, components, shapes, regions and their borders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.operators import lineage
from tracklore.operators.lineage import kept

NODE = ["block", "t", "z", "label"]


def slice_nodes(voxels: DataFrame, least: int) -> DataFrame:
    """2D masks of a slice with area, centre and box, from an area of least on."""
    g = voxels.groupBy(*NODE).agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_max"), F.min("x").alias("x_min"), (F.max("x") + 1).alias("x_max"))
    return g.where(F.col("area") >= least)


def slice_overlaps(voxels: DataFrame, nodes: DataFrame, max_gap: int) -> DataFrame:
    """Pairs of masks up to max_gap slices apart that share pixels: overlap fraction of the smaller, IoU and distance.

    The gap is exploded, so pixels meet by equality; overlaps are summed before the few pairs meet their nodes.
    """
    v = voxels.join(nodes.select(*NODE), NODE, "left_semi").select("block", "t", "y", "x", "z", "label")
    up = v.select("block", "t", "y", "x", F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap"), F.col("z").alias("za"), F.col("label").alias("la")).withColumn("z", F.col("za") + F.col("gap"))
    pairs = up.join(v.withColumnRenamed("label", "lb").hint("merge"), ["block", "t", "z", "y", "x"]).groupBy("block", "t", "za", "la", F.col("z").alias("zb"), "lb").agg(F.count("*").alias("overlap"))
    for s in "ab":
        own = nodes.select("block", "t", F.col("z").alias(f"z{s}"), F.col("label").alias(f"l{s}"), F.col("area").alias(f"area_{s}"), F.col("cy").alias(f"cy_{s}"), F.col("cx").alias(f"cx_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in nodes.columns if c == "node"])
        pairs = pairs.join(own.hint("merge"), ["block", "t", f"z{s}", f"l{s}"])
    dy, dx = F.col("cy_a") - F.col("cy_b"), F.col("cx_a") - F.col("cx_b")
    ids = ["node_a", "node_b"] if "node" in nodes.columns else []
    more = {"fraction": F.col("overlap") / F.least("area_a", "area_b"), "iou": F.col("overlap") / (F.col("area_a") + F.col("area_b") - F.col("overlap")), "distance": F.sqrt(dy * dy + dx * dx)}
    return pairs.withColumns(more).select("block", "t", "za", "la", "zb", "lb", "overlap", *more, *ids)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each reaches over edges (a, b); least labels spread, and jump ahead.

    Every round is one join and two aggregations, cut by a checkpoint; only a count of changes reaches the driver.
    """
    both = edges.select("a", "b").unionAll(edges.select("b", "a")).distinct()
    both = kept(both)
    now = kept(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        told = both.join(now.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(told, "node", "left").select("node", F.least("component", "c").alias("n"), F.col("component").alias("old"))
        ahead = step.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        step = kept(step.join(ahead, "n", "left").select("node", F.least("n", F.coalesce("nn", "n")).alias("component"), "old"))
        changed = step.where("component <> old").isEmpty()
        now = step.select("node", "component")
        if changed:
            return now
    raise RuntimeError("components did not settle")


def reconstruct(voxels: DataFrame, least_area: int, max_gap: int, max_distance: float, least_fraction: float, least_iou: float, least_slices: int) -> DataFrame:
    """Voxels with their 3D object: masks tied by overlaps, components of enough slices, numbered in each frame."""
    nodes = kept(slice_nodes(voxels, least_area).withColumn("node", F.monotonically_increasing_id()))
    good = slice_overlaps(voxels, nodes, max_gap).where((F.col("distance") <= max_distance) & ((F.col("fraction") >= least_fraction) | (F.col("iou") >= least_iou)))
    found = lineage.components(good.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))).select(F.col("u").alias("node"), "component")
    found = kept(nodes.select(*NODE, "node").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    spans = found.groupBy("block", "t", "component").agg(F.count_distinct("z").alias("slices"), F.min(F.struct("z", "label")).alias("first")).where(F.col("slices") >= least_slices)
    ids = spans.select("component", F.row_number().over(W.partitionBy("block", "t").orderBy("first")).alias("object_id"))
    at = found.join(ids.hint("merge"), "component").select(*NODE, "object_id")
    return voxels.join(at.hint("merge"), NODE)


def object_features(voxels: DataFrame, key: list[str]) -> DataFrame:
    """Centre, size, box (ends exclusive), slices and intensity of each object."""
    boxes = [x for c in "zyx" for x in (F.min(c).alias(f"bbox_{c}_min"), (F.max(c) + 1).alias(f"bbox_{c}_max"))]
    i = F.col("intensity")
    return voxels.groupBy(*key).agg(
        *[F.avg(c).alias(f"centroid_{c}") for c in "zyx"], F.count("*").alias("volume_voxels"), *boxes, F.count_distinct("z").alias("detected_z_slices"), F.avg(i).alias("mean_intensity"), F.median(i).alias("median_intensity"),
        F.max(i).alias("max_intensity"), F.sum(i).alias("sum_intensity"), F.stddev_pop(i).alias("intensity_sd"), F.count_distinct(F.struct("y", "x")).alias("projected_area"),
    )


def largest_slice(voxels: DataFrame, key: list[str]) -> DataFrame:
    return voxels.groupBy(*key, "z").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("max_cross_section"))


def principal_axes(voxels: DataFrame, key: list[str], xy_um: float, z_um: float) -> DataFrame:
    """Axis lengths 4 sqrt(eigenvalue) of each object's coordinates, and shape ratios; closed form for a 3x3 matrix."""
    x, y, z = (F.col(c) * s for c, s in (("x", xy_um), ("y", xy_um), ("z", z_um)))
    g = voxels.groupBy(*key).agg(
        F.count("*").alias("n"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.var_samp(z).alias("c"), F.covar_samp(x, y).alias("d"), F.covar_samp(y, z).alias("e"), F.covar_samp(x, z).alias("f")
    ).where("n >= 4")
    q = (F.col("a") + F.col("b") + F.col("c")) / 3
    off = F.col("d") * F.col("d") + F.col("e") * F.col("e") + F.col("f") * F.col("f")
    g = g.withColumns({"q": q, "off": off}).withColumn("p", F.sqrt(((F.col("a") - F.col("q")) ** 2 + (F.col("b") - F.col("q")) ** 2 + (F.col("c") - F.col("q")) ** 2 + 2 * F.col("off")) / 6))
    a, b, c = ((F.col(v) - F.col("q")) / F.col("p") for v in "abc")
    d, e, f = (F.col(v) / F.col("p") for v in "def")
    half = (a * (b * c - e * e) - d * (d * c - e * f) + f * (d * e - b * f)) / 2
    phi = F.when(F.col("p") > 0, F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3).otherwise(0.0)
    g = g.withColumn("phi", phi)
    g = g.withColumns({"e1": F.col("q") + 2 * F.col("p") * F.cos("phi"), "e3": F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)}).withColumn("e2", 3 * F.col("q") - F.col("e1") - F.col("e3"))
    l1, l2, l3 = (4 * F.sqrt(F.greatest(F.col(v), F.lit(0.0))) for v in ("e1", "e2", "e3"))
    out = g.select(*key, l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))
    tiny = 1e-9
    more = {"aspect_ratio": F.col("l1") / (F.col("l3") + tiny), "elongation": 1 - F.col("l2") / (F.col("l1") + tiny), "flatness": 1 - F.col("l3") / (F.col("l2") + tiny)}
    return out.withColumns(more)


def face_area(voxels: DataFrame, key: list[str], xy_um: float, z_um: float) -> DataFrame:
    """Area of the faces that each object shows outward, its volume, and sphericity from both.

    Faces of voxels, not a mesh: the area is larger than a smooth surface's, the formulas are the usual ones.
    """
    v = voxels.select(*key, "z", "y", "x")
    sides = [(d, c, xy_um * xy_um if c == "z" else xy_um * z_um) for c in "zyx" for d in (-1, 1)]
    near = F.explode(F.array(*[F.struct(*[F.lit(d if c == a else 0).alias(a) for a in "zyx"], F.lit(area).alias("area")) for d, c, area in sides])).alias("o")
    faces = v.select(*key, "z", "y", "x", near).select(*key, *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "zyx"], "o.area")
    shown = faces.join(v.hint("merge"), [*key, "z", "y", "x"], "left_anti").groupBy(*key).agg(F.sum("area").alias("surface_area"))
    size = v.groupBy(*key).agg((F.count("*") * (xy_um * xy_um * z_um)).alias("volume"))
    s = size.join(shown.hint("merge"), key)
    ball = F.pow(F.lit(math.pi), F.lit(1 / 3)) * F.pow(6 * F.col("volume"), F.lit(2 / 3))
    return s.withColumns({"sphericity": ball / F.col("surface_area"), "area_to_volume": F.col("surface_area") / F.col("volume"), "compactness": 36 * math.pi * F.col("volume") * F.col("volume") / F.pow("surface_area", F.lit(3.0))})


def disk(r: int) -> Column:
    """Offsets (dy, dx) of a disk, as an array."""
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r])


def dilated(pixels: DataFrame, key: list[str], r: int) -> DataFrame:
    """Pixels within r of a pixel of the mask."""
    s = pixels.select(*key, "y", "x", F.explode(disk(r)).alias("o"))
    return s.select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()


def eroded(pixels: DataFrame, key: list[str], r: int) -> DataFrame:
    """Pixels whose whole disk is in the mask: a pixel that as many shifted ones hit as the disk has."""
    n = sum(a * a + b * b <= r * r for a in range(-r, r + 1) for b in range(-r, r + 1))
    s = pixels.select(*key, "y", "x", F.explode(disk(r)).alias("o"))
    s = s.select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return s.groupBy(*key, "y", "x").agg(F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def density(pixels: DataFrame, key: list[str], sigma: float, r: int) -> DataFrame:
    """Gaussian density of the occupied pixels: two one-dimensional convolutions, each a few offsets and a sum."""
    weights = {a: math.exp(-(a * a) / (2 * sigma * sigma)) for a in range(-r, r + 1)}
    total = sum(weights.values())
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("d"), F.lit(w / total).alias("w")) for a, w in weights.items()])).alias("o")
    rows = pixels.select(*key, "y", "x", offsets).groupBy(*key, (F.col("y") + F.col("o.d")).alias("y"), "x").agg(F.sum("o.w").alias("w"))
    return rows.select(*key, "y", "x", "w", offsets).groupBy(*key, "y", (F.col("x") + F.col("o.d")).alias("x")).agg(F.sum(F.col("w") * F.col("o.w")).alias("density"))


def dense_region(pixels: DataFrame, key: list[str], sigma: float, r: int, quantile: float, floor: float, closing: int) -> DataFrame:
    """Where pixels are dense: over a quantile of the density at occupied pixels and a floor, closed by a disk.

    Densities and the quantile count to nine digits, so that equal ones tie in whatever order they are summed.
    """
    d = kept(density(pixels, key, sigma, r).withColumn("density", F.round("density", 9)))
    at = d.join(pixels.hint("merge"), [*key, "y", "x"], "left_semi").groupBy(*key).agg(F.greatest(F.round(F.percentile("density", F.lit(quantile)), 9), F.lit(floor)).alias("cut"))
    mask = d.join(at.hint("merge"), key).where(F.col("density") >= F.col("cut")).select(*key, "y", "x")
    return eroded(dilated(mask, key, closing), key, closing)


def inside_mask(points: DataFrame, mask: DataFrame, key: list[str]) -> DataFrame:
    """Points with whether their rounded pixel is in the mask."""
    at = points.withColumns({"_y": F.rint("y").cast("int"), "_x": F.rint("x").cast("int")})
    m = mask.select(*key, F.col("y").alias("_y"), F.col("x").alias("_x")).distinct().withColumn("inside", F.lit(True))
    return at.join(m, [*key, "_y", "_x"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))).drop("_y", "_x")


def segment_crossings(links: DataFrame, mask: DataFrame, key: list[str], samples: int) -> DataFrame:
    """Links (y0, x0 to y1, x1) of which a sampled point lies in the mask."""
    f = F.col("k") / float(samples - 1)
    s = links.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    s = s.withColumns({"y": F.rint(F.col("y0") + (F.col("y1") - F.col("y0")) * f).cast("int"), "x": F.rint(F.col("x0") + (F.col("x1") - F.col("x0")) * f).cast("int")})
    hit = s.join(mask.select(*key, "y", "x").hint("merge"), [*key, "y", "x"], "left_semi").select("link_id").distinct().withColumn("crosses", F.lit(True))
    return links.join(hit.hint("merge"), "link_id", "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))


def signed_distance(pixels: DataFrame, mask: DataFrame, key: list[str], reach: int) -> DataFrame:
    """Distance of each pixel to the mask's other side, negative inside, null beyond reach; cells of that size meet.

    Only pixels at the mask's edge, on either side, can be nearest, so only they are met.
    """
    places = lambda d, p, m: d.select(*key, "y", "x", F.lit(p).alias("_p"), F.lit(m).alias("_in"), F.lit(not p).alias("_hit"))
    mask = mask.select(*key, "y", "x").distinct()
    near = mask.select(*key, "y", "x", F.explode(disk(1)).alias("o")).where("o.dy <> 0 OR o.dx <> 0").select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    at = places(pixels, 1, False).unionAll(places(mask, 0, True)).unionAll(places(near, 0, False))
    at = at.groupBy(*key, "y", "x").agg(F.sum("_p").alias("_n"), F.bool_or("_in").alias("_in"), F.count_if("_hit").alias("_hits")).withColumn("_edge", F.when(F.col("_in"), F.col("_hits") < 5).otherwise(F.col("_hits") > 0))
    # a place looks for edges of the other side in its own cell and those around; an edge offers itself in its cell
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((F.floor(k / 3) - 1).cast("int").alias("a"), (k % 3 - 1).cast("int").alias("b"), F.lit(True).alias("asks")))
    own = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("asks")))
    asked = F.explode(F.concat(F.when(F.col("_n") > 0, around).otherwise(F.slice(around, 1, 0)), F.when(F.col("_edge"), own).otherwise(F.slice(own, 1, 0)))).alias("o")
    met = at.select(*key, "y", "x", "_in", "_n", asked).select(*key, "y", "x", "_n", "o.asks", F.when(F.col("o.asks"), ~F.col("_in")).otherwise(F.col("_in")).alias("_side"), (cell("y") + F.col("o.a")).alias("_cy"), (cell("x") + F.col("o.b")).alias("_cx"))
    cells = met.groupBy(*key, "_side", "_cy", "_cx").agg(F.collect_list(F.when(F.col("asks"), F.struct("y", "x", "_n"))).alias("_asking"), F.collect_list(F.when(~F.col("asks"), F.struct("y", "x"))).alias("_edges"))
    found = cells.select(*key, (~F.col("_side")).alias("_in"), F.explode("_asking").alias("q"), "_edges")
    square = F.array_min(F.transform("_edges", lambda e: (F.col("q.y") - e.y) * (F.col("q.y") - e.y) + (F.col("q.x") - e.x) * (F.col("q.x") - e.x)))
    best = found.select(*key, "_in", "q.y", "q.x", F.col("q._n").alias("_n"), F.sqrt(square).alias("d")).groupBy(*key, "y", "x").agg(F.first("_in").alias("_in"), F.first("_n").alias("_n"), F.min("d").alias("d"))
    d = F.when(F.col("d") <= reach, F.col("d"))
    signed = best.select(*key, "y", "x", F.when(F.col("_in"), -d).otherwise(d).alias("distance"), "_n")
    return signed.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def object_overlap(voxels: DataFrame, mask: DataFrame, key: list[str]) -> DataFrame:
    """Projected pixels of each object, those in the mask, the share, and the region most of them are in (least id on ties)."""
    p = voxels.select("block", "t", *key, "y", "x").distinct().join(mask.select("block", "t", "y", "x", "cluster_id"), ["block", "t", "y", "x"], "left")
    n = p.groupBy("block", "t", *key, "cluster_id").agg(F.count("*").alias("n"))
    g = n.groupBy("block", "t", *key).agg(F.sum("n").alias("pixels"), F.coalesce(F.sum(F.when(F.col("cluster_id").isNotNull(), F.col("n"))), F.lit(0)).alias("overlap"), F.max(F.when(F.col("cluster_id").isNotNull(), F.struct("n", (-F.col("cluster_id")).alias("c")))).alias("m"))
    kind = F.when(F.col("overlap") == F.col("pixels"), "inside").when(F.col("overlap") > 0, "boundary").otherwise("outside")
    return g.select("block", "t", *key, "pixels", "overlap", (F.col("overlap") / F.col("pixels")).alias("fraction"), (-F.col("m.c")).alias("cluster"), kind.alias("region_class"))


def best_shift(mask: DataFrame, intensity: DataFrame, key: list[str], reach: int) -> DataFrame:
    """The shift of a mask, up to reach on each axis, under which it covers the largest mean intensity."""
    span = range(-reach, reach + 1)
    offsets = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in span for b in span])
    s = mask.select(*key, "y", "x", F.explode(offsets).alias("o"))
    s = s.select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "o.dy", "o.dx").join(intensity.hint("merge"), [*key, "y", "x"])
    g = s.groupBy(*key, "dy", "dx").agg(F.avg("intensity").alias("score"))
    return g.groupBy(*key).agg(F.max_by(F.struct("dy", "dx", "score"), F.struct("score", (-F.abs("dy") - F.abs("dx")), "dy", "dx")).alias("b")).select(*key, "b.*")


def retained_by_slice(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects and pixels of each slice before and after a filter, and the share of pixels kept."""
    count = lambda d, n: d.groupBy("block", "t", "z").agg(F.count_distinct("label").alias(f"objects_{n}"), F.count("*").alias(f"pixels_{n}"))
    j = count(before, "before").join(count(after, "after"), ["block", "t", "z"], "left").fillna(0)
    return j.withColumn("kept", F.col("pixels_after") / F.col("pixels_before"))


def segmentation_scores(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Pixel IoU and Dice of each image, and the overlap table's matched objects at IoU over 0.5, where matches are unique."""
    t, f = truth.select(*key, "z", "y", "x", F.col("label").alias("lt")), found.select(*key, "z", "y", "x", F.col("label").alias("lf"))
    j = t.join(f, [*key, "z", "y", "x"], "full_outer")
    n = j.groupBy(*key, "lt", "lf").agg(F.count("*").alias("n"))
    n = n.withColumns({"nt": F.sum("n").over(W.partitionBy(*key, "lt")), "nf": F.sum("n").over(W.partitionBy(*key, "lf"))})
    both = F.col("lt").isNotNull() & F.col("lf").isNotNull()
    iou = F.when(both, F.col("n") / (F.col("nt") + F.col("nf") - F.col("n")))
    g = n.withColumn("iou", iou).groupBy(*key).agg(
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("both"), F.sum("n").alias("either"), F.count_distinct("lt").alias("n_truth"), F.count_distinct("lf").alias("n_found"), F.count_if(F.col("iou") > 0.5).alias("tp"), F.avg(F.when(F.col("iou") > 0.5, F.col("iou"))).alias("mean_iou")
    )
    return g.withColumns({"pixel_iou": F.col("both") / F.col("either"), "dice": 2 * F.col("both") / (F.col("either") + F.col("both")), "precision": F.try_divide("tp", "n_found"), "recall": F.try_divide("tp", "n_truth")}).drop("both", "either")


def polygon_pixels(polygons: DataFrame, key: list[str], height: int, width: int) -> DataFrame:
    """Pixels inside polygons of vertices (key, i, y, x): those whose ray to the right crosses an odd number of edges.

    Each edge meets only the rows that it spans, so the work follows the pixels left of the edges, not the image.
    """
    w = W.partitionBy(*key).orderBy("i")
    first = lambda c: F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = polygons.select(*key, F.col("y").alias("y0"), F.col("x").alias("x0"), F.coalesce(F.lead("y").over(w), first("y")).alias("y1"), F.coalesce(F.lead("x").over(w), first("x")).alias("x1")).where("y0 <> y1")
    low, high = F.greatest(F.ceil(F.least("y0", "y1")), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest("y0", "y1")) - 1, F.lit(height - 1)).cast("int")
    e = e.where(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    last = F.least(F.ceil(at) - 1, F.lit(width - 1)).cast("int")
    e = e.where(last >= 0).withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    return e.groupBy(*key, "y", "x").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def shifted(pixels: DataFrame, shifts: DataFrame, key: list[str], height: int, width: int) -> DataFrame:
    """Pixels moved by their frame's shift, those that leave the image dropped."""
    s = pixels.join(shifts, key).withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")}).drop("dy", "dx")
    return s.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
