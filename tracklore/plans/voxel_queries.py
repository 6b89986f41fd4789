"""Queries over voxels and regions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import voxels as V
from tracklore.plans.views import VOX, voxels

OBJ = ["block", "t", "label"]
FRAME = ["block", "t"]


def _pixels(spark, sf):
    return voxels(spark, sf).where("intensity > 75000").select("block", "t", "y", "x").distinct()


def _places(spark, sf):
    return voxels(spark, sf).select("block", "t", "y", "x").distinct()


_PIX = VOX + ", px AS (SELECT DISTINCT block, t, y, x FROM vox WHERE intensity > 75000), pl AS (SELECT DISTINCT block, t, y, x FROM vox)"


def _objects(spark, sf):
    return V.reconstruct(voxels(spark, sf).where("intensity > 40000"), 2, 2, 6.0, 0.3, 0.2, 2)


_GRAPH = VOX + """, v AS (SELECT * FROM vox WHERE intensity > 40000), nd AS (SELECT block, t, z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM v GROUP BY ALL HAVING count(*) >= 2),
vv AS (SELECT v.* FROM v SEMI JOIN nd USING (block, t, z, label)),
ov AS (SELECT a.block, a.t, a.z AS za, a.label AS la, b.z AS zb, b.label AS lb, count(*) AS overlap FROM vv a JOIN vv b ON a.block = b.block AND a.t = b.t AND a.y = b.y AND a.x = b.x AND b.z - a.z BETWEEN 1 AND 2 GROUP BY ALL),
oe AS (SELECT ov.*, overlap / least(a.area, b.area) AS fraction, overlap / (a.area + b.area - overlap) AS iou, sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) AS distance FROM ov
  JOIN nd a ON a.block = ov.block AND a.t = ov.t AND a.z = za AND a.label = la JOIN nd b ON b.block = ov.block AND b.t = ov.t AND b.z = zb AND b.label = lb)"""  # fmt: skip

QUERIES = {
    "slice_nodes": lambda spark, sf: rounded(V.slice_nodes(voxels(spark, sf), 3)),
    "slice_overlaps": lambda spark, sf: rounded(V.slice_overlaps(voxels(spark, sf).where("intensity > 40000"), V.slice_nodes(voxels(spark, sf).where("intensity > 40000"), 2), 2)),
    "reconstructed_objects": lambda spark, sf: _objects(spark, sf).groupBy("block", "t", "object_id").agg(F.count("*").alias("n"), F.count_distinct("z").alias("slices"), F.min("z").alias("z_min")),
    "object_features": lambda spark, sf: rounded(V.object_features(voxels(spark, sf), OBJ), 4, 1.3e-7),
    "largest_slices": lambda spark, sf: V.largest_slice(voxels(spark, sf), OBJ),
    "principal_axes": lambda spark, sf: rounded(V.principal_axes(voxels(spark, sf), OBJ, 0.5, 2.0).select(*OBJ, "l1", "l2", "l3", "elongation"), 4),
    "face_areas": lambda spark, sf: rounded(V.face_area(voxels(spark, sf), OBJ, 0.5, 2.0)),
    "dilated_mask": lambda spark, sf: V.dilated(_pixels(spark, sf), FRAME, 2),
    "eroded_mask": lambda spark, sf: V.eroded(V.dilated(_pixels(spark, sf), FRAME, 3), FRAME, 2),
    "pixel_density": lambda spark, sf: rounded(V.density(_pixels(spark, sf), FRAME, 1.5, 3)),
    "dense_region": lambda spark, sf: V.dense_region(_pixels(spark, sf), FRAME, 1.5, 3, 0.7, 0.08, 1),
    "points_in_mask": lambda spark, sf: V.inside_mask(_places(spark, sf).select("block", "t", (F.col("y") + 0.5).alias("y"), (F.col("x") + 0.25).alias("x")), _pixels(spark, sf), FRAME),
    "segments_across_mask": lambda spark, sf: V.segment_crossings(_places(spark, sf).select("block", "t", ((F.col("block") * 8 + F.col("t")) * 64 + F.col("y") * 8 + F.col("x")).alias("link_id"), F.col("y").alias("y0"), F.col("x").alias("x0"), (7 - F.col("x")).alias("y1"), F.col("y").alias("x1")), _pixels(spark, sf), FRAME, 9).select("link_id", "crosses"),
    "signed_distances": lambda spark, sf: rounded(V.signed_distance(_places(spark, sf), V.dilated(_pixels(spark, sf), FRAME, 1), FRAME, 8)),
    "object_region_overlap": lambda spark, sf: rounded(V.object_overlap(voxels(spark, sf), _pixels(spark, sf).withColumn("cluster_id", (F.col("y") / 4).cast("int") + 1), ["label"])),
    "best_mask_shift": lambda spark, sf: rounded(V.best_shift(_pixels(spark, sf), voxels(spark, sf).groupBy("block", "t", "y", "x").agg(F.max("intensity").alias("intensity")), FRAME, 2)),
    "retained_by_slice": lambda spark, sf: rounded(V.retained_by_slice(voxels(spark, sf), voxels(spark, sf).where("intensity > 30000"))),
    "segmentation_scores": lambda spark, sf: rounded(V.segmentation_scores(voxels(spark, sf).where("intensity > 25000"), voxels(spark, sf).where("(y + x) % 5 <> 0"), FRAME)),
    "shifted_pixels": lambda spark, sf: V.shifted(_pixels(spark, sf), _pixels(spark, sf).select(*FRAME).distinct().select(*FRAME, (F.col("t") - 3).alias("dy"), (F.col("block") % 3 - 1).cast("int").alias("dx")), FRAME, 8, 8),
    "polygon_pixels": lambda spark, sf: V.polygon_pixels(_pixels(spark, sf).groupBy("block").agg(F.max("y").cast("double").alias("a"), F.max("x").cast("double").alias("b")).select("block", F.posexplode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in ((0.1, 0.1), (0.2, 0.9), (0.9, 0.8), (0.5, 0.4))])).alias("i", "p"), "a", "b").select("block", "i", (F.col("p.u") * F.col("a")).alias("y"), (F.col("p.v") * F.col("b")).alias("x")), ["block"], 8, 8),
}

_DISK = lambda r: f"(SELECT dy, dx FROM (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest(range(-{r}, {r + 1})) AS dx) WHERE dy * dy + dx * dx <= {r * r})"
_DIL = lambda src, r: f"SELECT DISTINCT block, t, (y + dy)::INT AS y, (x + dx)::INT AS x FROM {src}, {_DISK(r)}"
_ERO = lambda src, r: f"SELECT block, t, (y + dy)::INT AS y, (x + dx)::INT AS x FROM {src}, {_DISK(r)} GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {_DISK(r)})"
_DENS = _PIX + """, o AS (SELECT dy, dx, exp(-(dy * dy + dx * dx) / 4.5) AS w FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
de AS (SELECT block, t, (y + dy)::INT AS y, (x + dx)::INT AS x, sum(w / (SELECT sum(w) FROM o)) AS density FROM px, o GROUP BY ALL)"""  # fmt: skip

ORACLE_SQL = {
    "slice_nodes": f"WITH {VOX} SELECT block, t, z, label, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(y) AS y_min, max(y) + 1 AS y_max, min(x) AS x_min, max(x) + 1 AS x_max FROM vox GROUP BY block, t, z, label HAVING count(*) >= 3",
    "slice_overlaps": f"WITH {_GRAPH} SELECT block, t, za, la, zb, lb, overlap, round(fraction, 6) AS fraction, round(iou, 6) AS iou, round(distance, 6) AS distance FROM oe",
    "reconstructed_objects": f"""WITH RECURSIVE {_GRAPH}, ge AS (SELECT * FROM oe WHERE distance <= 6 AND (fraction >= 0.3 OR iou >= 0.2)),
ed AS (SELECT block, t, za * 100 + la AS a, zb * 100 + lb AS b FROM ge UNION ALL SELECT block, t, zb * 100 + lb, za * 100 + la FROM ge),
re AS (SELECT block, t, z * 100 + label AS n, z * 100 + label AS m FROM nd UNION SELECT re.block, re.t, re.n, ed.b FROM re JOIN ed ON ed.block = re.block AND ed.t = re.t AND ed.a = re.m),
co AS (SELECT block, t, n, min(m) AS c FROM re GROUP BY ALL),
sp AS (SELECT block, t, c, dense_rank() OVER (PARTITION BY block, t ORDER BY c) AS object_id FROM co GROUP BY block, t, c HAVING count(DISTINCT n // 100) >= 2)
SELECT v.block, v.t, object_id, count(*) AS n, count(DISTINCT z) AS slices, min(z) AS z_min FROM v JOIN co ON co.block = v.block AND co.t = v.t AND co.n = v.z * 100 + v.label JOIN sp ON sp.block = co.block AND sp.t = co.t AND sp.c = co.c GROUP BY ALL""",
    "object_features": f"""WITH {VOX} SELECT block, t, label, round(avg(z) + 1.3e-7, 4) AS centroid_z, round(avg(y) + 1.3e-7, 4) AS centroid_y, round(avg(x) + 1.3e-7, 4) AS centroid_x, count(*) AS volume_voxels, min(z) AS bbox_z_min, max(z) + 1 AS bbox_z_max, min(y) AS bbox_y_min, max(y) + 1 AS bbox_y_max, min(x) AS bbox_x_min, max(x) + 1 AS bbox_x_max,
  count(DISTINCT z) AS detected_z_slices, round(avg(intensity) + 1.3e-7, 4) AS mean_intensity, round(median(intensity) + 1.3e-7, 4) AS median_intensity, round(max(intensity) + 1.3e-7, 4) AS max_intensity, round(sum(intensity) + 1.3e-7, 4) AS sum_intensity, round(stddev_pop(intensity) + 1.3e-7, 4) AS intensity_sd, count(DISTINCT (y, x)) AS projected_area FROM vox GROUP BY block, t, label""",
    "largest_slices": f"WITH {VOX} SELECT block, t, label, max(n) AS max_cross_section FROM (SELECT block, t, label, z, count(*) AS n FROM vox GROUP BY ALL) GROUP BY block, t, label",
    "face_areas": f"""WITH {VOX}, s(dz, dy, dx, area) AS (VALUES (1, 0, 0, 0.25::DOUBLE), (-1, 0, 0, 0.25), (0, 1, 0, 1.0), (0, -1, 0, 1.0), (0, 0, 1, 1.0), (0, 0, -1, 1.0)),
f AS (SELECT block, t, label, z + dz AS z, y + dy AS y, x + dx AS x, area FROM vox, s), a AS (SELECT block, t, label, sum(area) AS sa FROM f ANTI JOIN vox USING (block, t, label, z, y, x) GROUP BY ALL), v AS (SELECT block, t, label, count(*) * 0.5 AS vol FROM vox GROUP BY ALL)
SELECT block, t, label, round(vol, 6) AS volume, round(sa, 6) AS surface_area, round(pi() ** (1.0::DOUBLE / 3) * (6 * vol::DOUBLE) ** (2.0::DOUBLE / 3) / sa, 6) AS sphericity, round(sa / vol, 6) AS area_to_volume, round(36 * pi() * vol * vol / sa ** 3, 6) AS compactness FROM a JOIN v USING (block, t, label)""",
    "dilated_mask": f"WITH {_PIX} {_DIL('px', 2)}",
    "eroded_mask": f"WITH {_PIX}, d AS ({_DIL('px', 3)}) {_ERO('d', 2)}",
    "pixel_density": f"WITH {_DENS} SELECT block, t, y, x, round(density, 6) AS density FROM de",
    "dense_region": f"""WITH {_DENS}, dr AS (SELECT * REPLACE (round(density, 9) AS density) FROM de), c AS (SELECT block, t, greatest(round(quantile_cont(density, 0.7), 9), 0.08) AS cut FROM dr SEMI JOIN px USING (block, t, y, x) GROUP BY ALL), m AS (SELECT block, t, y, x FROM dr JOIN c USING (block, t) WHERE density >= cut), d AS ({_DIL('m', 1)}) {_ERO('d', 1)}""",
    "points_in_mask": f"WITH {_PIX}, p AS (SELECT block, t, y + 0.5 AS y, x + 0.25 AS x, y + y % 2 AS ry, x AS rx FROM pl) SELECT p.block, p.t, p.y, p.x, px.y IS NOT NULL AS inside FROM p LEFT JOIN px ON px.block = p.block AND px.t = p.t AND px.y = ry AND px.x = rx",
    "object_region_overlap": f"""WITH {_PIX}, ms AS (SELECT *, y // 4 + 1 AS cid FROM px), p AS (SELECT DISTINCT block, t, label, y, x FROM vox), j AS (SELECT p.block, p.t, p.label, cid, count(*) AS n FROM p LEFT JOIN ms USING (block, t, y, x) GROUP BY ALL),
g AS (SELECT block, t, label, sum(n)::BIGINT AS pixels, coalesce(sum(n) FILTER (cid IS NOT NULL), 0)::BIGINT AS overlap FROM j GROUP BY ALL), b AS (SELECT block, t, label, cid FROM j WHERE cid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block, t, label ORDER BY n DESC, cid) = 1)
SELECT block, t, label, pixels, overlap, round(overlap / pixels, 6) AS fraction, cid AS cluster, CASE WHEN overlap = pixels THEN 'inside' WHEN overlap > 0 THEN 'boundary' ELSE 'outside' END AS region_class FROM g LEFT JOIN b USING (block, t, label)""",
    "retained_by_slice": f"WITH {VOX} SELECT block, t, z, count(DISTINCT label) AS objects_before, count(*) AS pixels_before, count(DISTINCT label) FILTER (intensity > 30000) AS objects_after, count(*) FILTER (intensity > 30000) AS pixels_after, round(count(*) FILTER (intensity > 30000) / count(*), 6) AS kept FROM vox GROUP BY ALL",
    "segmentation_scores": f"""WITH {VOX}, j AS (SELECT block, t, CASE WHEN intensity > 25000 THEN label END AS lt, CASE WHEN (y + x) % 5 <> 0 THEN label END AS lf FROM vox WHERE intensity > 25000 OR (y + x) % 5 <> 0),
n AS (SELECT block, t, lt, lf, count(*) AS n FROM j GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY block, t, lt) AS nt, sum(n) OVER (PARTITION BY block, t, lf) AS nf FROM n), i AS (SELECT *, CASE WHEN lt IS NOT NULL AND lf IS NOT NULL THEN n / (nt + nf - n) END AS iou FROM m)
SELECT block, t, count(DISTINCT lt) AS n_truth, count(DISTINCT lf) AS n_found, count(*) FILTER (iou > 0.5) AS tp, round(avg(iou) FILTER (iou > 0.5), 6) AS mean_iou, round(coalesce(sum(n) FILTER (iou IS NOT NULL), 0) / sum(n), 6) AS pixel_iou,
  round(2 * coalesce(sum(n) FILTER (iou IS NOT NULL), 0) / (sum(n) + coalesce(sum(n) FILTER (iou IS NOT NULL), 0)), 6) AS dice, round(count(*) FILTER (iou > 0.5) / count(DISTINCT lf), 6) AS precision, round(count(*) FILTER (iou > 0.5) / count(DISTINCT lt), 6) AS recall FROM i GROUP BY block, t""",
    "shifted_pixels": f"WITH {_PIX} SELECT block, t, (y + t - 3)::INT AS y, (x + block % 3 - 1)::INT AS x FROM px WHERE y + t - 3 BETWEEN 0 AND 7 AND x + block % 3 - 1 BETWEEN 0 AND 7",
    "signed_distances": f"""WITH {_PIX}, m AS ({_DIL('px', 1)}), ed AS ({_DIL('m', 1)}), o AS (SELECT * FROM ed ANTI JOIN m USING (block, t, y, x)), q AS (SELECT v.block, v.t, v.y, v.x, m.y IS NOT NULL AS i FROM pl v LEFT JOIN m ON m.block = v.block AND m.t = v.t AND m.y = v.y AND m.x = v.x),
s AS (SELECT *, false AS i FROM m UNION ALL SELECT *, true FROM o), d AS (SELECT q.block, q.t, q.y, q.x, q.i, min(sqrt((q.y - s.y) ** 2 + (q.x - s.x) ** 2)) AS d FROM q JOIN s ON s.block = q.block AND s.t = q.t AND s.i = q.i GROUP BY ALL)
SELECT q.block, q.t, q.y, q.x, round(CASE WHEN d <= 8 THEN CASE WHEN q.i THEN -d ELSE d END END, 6) AS distance FROM q LEFT JOIN d ON d.block = q.block AND d.t = q.t AND d.y = q.y AND d.x = q.x""",
    "principal_axes": f"""WITH {VOX}, c AS (SELECT block, t, label, var_samp(x * 0.5) AS a, var_samp(y * 0.5) AS b, var_samp(z * 2.0) AS c, covar_samp(x * 0.5, y * 0.5) AS d, covar_samp(y * 0.5, z * 2.0) AS e, covar_samp(x * 0.5, z * 2.0) AS f FROM vox GROUP BY ALL HAVING count(*) >= 4),
m AS (SELECT *, (a + b + c) / 3 AS q, a * b + a * c + b * c - d * d - e * e - f * f AS s, a * b * c + 2 * d * e * f - a * e * e - b * f * f - c * d * d AS det FROM c),
r AS (SELECT *, sqrt(greatest(q * q - s / 3, 0)) AS p, (2 * q ** 3 - q * s + det) / 2 AS h FROM m),
g AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(least(h / p ** 3, 1), -1)) / 3 ELSE 0 END AS phi FROM r),
l AS (SELECT block, t, label, 4 * sqrt(greatest(q + 2 * p * cos(phi), 0)) AS l1, 4 * sqrt(greatest(q + 2 * p * cos(phi + 4 * pi() / 3), 0)) AS l2, 4 * sqrt(greatest(q + 2 * p * cos(phi + 2 * pi() / 3), 0)) AS l3 FROM g)
SELECT block, t, label, round(l1, 4) AS l1, round(l2, 4) AS l2, round(l3, 4) AS l3, round(1 - l2 / (l1 + 1e-9), 4) + 0 AS elongation FROM l""",
    "segments_across_mask": f"""WITH {_PIX}, l AS (SELECT block, t, (block * 8 + t) * 64 + y * 8 + x AS link_id, y AS y0, x AS x0, 7 - x AS y1, y AS x1 FROM pl), k AS (SELECT unnest(range(0, 9)) AS k),
s AS (SELECT block, t, link_id, y0 + (y1 - y0) * (k / 8.0::DOUBLE) AS y, x0 + (x1 - x0) * (k / 8.0::DOUBLE) AS x FROM l, k),
e AS (SELECT block, t, link_id, (CASE WHEN y - floor(y) = 0.5 THEN 2 * floor((floor(y) + 1) / 2) ELSE floor(y + 0.5) END)::INT AS y, (CASE WHEN x - floor(x) = 0.5 THEN 2 * floor((floor(x) + 1) / 2) ELSE floor(x + 0.5) END)::INT AS x FROM s)
SELECT link_id, max((px.y IS NOT NULL)::INT) = 1 AS crosses FROM e LEFT JOIN px ON px.block = e.block AND px.t = e.t AND px.y = e.y AND px.x = e.x GROUP BY link_id""",
    "best_mask_shift": f"""WITH {_PIX}, i AS (SELECT block, t, y, x, max(intensity) AS v FROM vox GROUP BY ALL), o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3))::INT AS dy), (SELECT unnest(range(-2, 3))::INT AS dx)),
s AS (SELECT px.block, px.t, dy, dx, avg(v) AS score FROM px, o JOIN i ON i.block = px.block AND i.t = px.t AND i.y = px.y + dy AND i.x = px.x + dx GROUP BY ALL)
SELECT block, t, dy, dx, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY block, t ORDER BY score DESC, abs(dy) + abs(dx), dy DESC, dx DESC) = 1""",
    "polygon_pixels": f"""WITH {_PIX}, b AS (SELECT block, max(y)::DOUBLE AS a, max(x)::DOUBLE AS b FROM px GROUP BY block), v(i, u, w) AS (VALUES (0, 0.1::DOUBLE, 0.1::DOUBLE), (1, 0.2, 0.9), (2, 0.9, 0.8), (3, 0.5, 0.4)),
e AS (SELECT block, p.u * a AS y0, p.w * b AS x0, q.u * a AS y1, q.w * b AS x1 FROM b, v p JOIN v q ON q.i = (p.i + 1) % 4), g AS (SELECT gy AS y, gx AS x FROM (SELECT unnest(range(0, 8))::INT AS gy), (SELECT unnest(range(0, 8))::INT AS gx))
SELECT block, y, x FROM e, g WHERE y >= least(y0, y1) AND y < greatest(y0, y1) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY ALL HAVING count(*) % 2 = 1""",
}
