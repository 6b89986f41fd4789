"""Queries of linking, learning and source operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import group_name, normalise_id, number, parse_bool, rounded, track_key
from tracklore.operators import learn as L
from tracklore.operators import link as K
from tracklore.operators import morphology as M
from tracklore.operators import voxels as V
from tracklore.plans.views import DET, VOX, detections, table, voxels
from tracklore.sources import tables as S

RULES = K.LinkRules(max_distance=400.0, max_z_step=20.0, max_gap=1)


def _det(spark, sf):
    # frames of a block hold one detection of each event type
    return detections(spark, sf)


def _edges(spark, sf):
    v = voxels(spark, sf).where("intensity > 40000")
    e = V.slice_overlaps(v, V.slice_nodes(v, 2), 2).where("fraction >= 0.3")
    return e.select("block", "t", F.col("za").alias("z"), (F.col("zb") - F.col("za")).alias("gap"), "la", "lb")


def _features(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label"), F.col("embedding").alias("x"))


def _files(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("block"), F.concat_ws("/", F.lit("run"), F.col("p_brand"), F.concat(F.col("p_type"), F.lit("_"), F.col("p_partkey").cast("string"))).alias("path"))


def _strip(spark, sf):
    """A mask over the first days of each block: rows 600 to 700, all columns."""
    rows = F.explode(F.sequence(F.lit(600), F.lit(700)))
    return _det(spark, sf).select("block_name", "time").distinct().where("time < 5").select("block_name", "time", rows.alias("y"), F.lit(-1000).alias("x0"), F.lit(100_000).alias("x1"))


def _label_tracks(spark, sf):
    """Centres of labels as tracks over frames, and masks of bright pixels."""
    v = voxels(spark, sf).withColumnsRenamed({"block": "block_name", "t": "time"})
    tracks = v.groupBy("block_name", "time", F.col("label").cast("long").alias("track_id")).agg((F.avg("y") + 0.01).alias("y"), (F.avg("x") + 0.01).alias("x"))
    return tracks, M.runs_of(v.where("intensity > 80000").select("block_name", "time", "y", "x"), ["block_name", "time"])


QUERIES = {
    "candidate_links": lambda spark, sf: rounded(K.candidate_links(_det(spark, sf), RULES)),
    "linked_nearest": lambda spark, sf: K.link_tracks(_det(spark, sf), RULES),
    "linked_lap": lambda spark, sf: K.link_tracks(_det(spark, sf), K.LinkRules("lap", 400.0, 20.0, 1, volume_weight=0.5, intensity_weight=0.5)),
    "linked_apart": lambda spark, sf: K.link_apart(_det(spark, sf), K.LinkRules(max_distance=60.0, max_z_step=12.0, max_gap=1)),
    "linked_by_mode": lambda spark, sf: K.link_by_mode(_det(spark, sf), [K.LinkRules(max_distance=200.0, max_z_step=20.0, max_gap=1), K.LinkRules("keyhole", 200.0, 20.0, 1, forward_distance=200.0)], "outside_only", _strip(spark, sf)),
    "tracks_stopped_at_mask": lambda spark, sf: rounded(K.stopped_at_mask(*_label_tracks(spark, sf), samples=9), 5),
    "linked_keyhole": lambda spark, sf: K.link_tracks(_det(spark, sf), K.LinkRules("keyhole", 400.0, 20.0, 1, volume_weight=0.5, forward_distance=500.0, back_radius=100.0)),
    "constrained_objects": lambda spark, sf: K.constrained_union(_edges(spark, sf), 4),
    "normalised_scalars": lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey", normalise_id(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("id"), parse_bool(F.col("o_orderstatus")).alias("flag"), parse_bool((F.col("o_custkey") % 3 - 1).cast("string"), positive_only=True).alias("positive"),
        track_key(F.col("o_custkey"), F.col("o_orderkey")).alias("track"), group_name(F.substring("o_orderpriority", 3, 20)).alias("group"), number(F.col("o_orderstatus")).alias("number"),
    ),
    "best_files": lambda spark, sf: S.best_file(_files(spark, sf), "block", ["PROMO", "SMALL", "LARGE"]),
    "file_completeness": lambda spark, sf: S.completeness(_files(spark, sf), _files(spark, sf).where("block % 3 <> 0 AND length(path) % 5 <> 0"), "block").select("block", "expected", "present", "status", F.concat_ws(";", "missing").alias("missing")),
    "frame_intervals": lambda spark, sf: rounded(S.frame_intervals(table(spark, sf, "events").groupBy("user_id", "ts").count().select(F.col("user_id").alias("block"), F.col("ts").alias("t"), F.col("ts").alias("acquired_at"))), 4, 1.3e-7),
    "pixel_sizes": lambda spark, sf: S.pixel_sizes(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("block")), table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("block"), F.lit(0.25).alias("xy_um")), table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("block"), F.lit(0.5).alias("xy_um")), 1.0),
    "pca_projection": lambda spark, sf: L.pca_scores(_features(spark, sf), 2),
    "kmeans_groups": lambda spark, sf: L.kmeans(_features(spark, sf), 10).groupBy("label", "cluster").agg(F.count("*").alias("n")),
    "leave_one_out": lambda spark, sf: L.leave_one_out(L.subject_matrix(spark, sf), [0.1, 1.0, 10.0]),
    "label_permutation": lambda spark, sf: L.permutation_test(L.subject_matrix(spark, sf), [1.0], 20, 42),
    "bootstrap_delta": lambda spark, sf: L.bootstrap_delta(L.two_groups(spark, sf), 200, 42),
    "two_way_factorial": lambda spark, sf: rounded(L.factorial(L.factor_rows(spark, sf)), 3),
    "cell_forest_split": lambda spark, sf: L.group_split_check(_features(spark, sf)),
}

ORACLE_SQL = {
    "tracks_stopped_at_mask": f"""WITH {VOX}, mk AS (SELECT DISTINCT block, t, y, x FROM vox WHERE intensity > 80000), tr AS (SELECT block, t, label AS k, avg(y) + 0.01 AS y, avg(x) + 0.01 AS x FROM vox GROUP BY ALL),
fr AS (SELECT tr.* FROM tr ANTI JOIN mk ON mk.block = tr.block AND mk.t = tr.t AND mk.y = round_even(tr.y, 0)::INT AND mk.x = round_even(tr.x, 0)::INT),
ln AS (SELECT *, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lag(x) OVER w AS x0 FROM fr WINDOW w AS (PARTITION BY block, k ORDER BY t)),
pt AS (SELECT block, k, t AS t1, unnest(range(t0, t + 1)) AS t, y0, x0, y AS y1, x AS x1 FROM ln WHERE t0 IS NOT NULL), ri AS (SELECT DISTINCT block, k, t1, t, round_even(y0 + (y1 - y0) * s / 8.0, 0)::INT AS y, round_even(x0 + (x1 - x0) * s / 8.0, 0)::INT AS x FROM pt, (SELECT unnest(range(9)) AS s)),
h AS (SELECT DISTINCT block, k, t1 AS t, 1 AS c FROM ri SEMI JOIN mk USING (block, t, y, x)),
pc AS (SELECT fr.*, sum(coalesce(c, 0)) OVER (PARTITION BY fr.block, fr.k ORDER BY fr.t) AS p FROM fr LEFT JOIN h ON h.block = fr.block AND h.k = fr.k AND h.t = fr.t)
SELECT block AS block_name, t AS time, k AS uncut_track_id, round(y, 5) AS y, round(x, 5) AS x, dense_rank() OVER (PARTITION BY block ORDER BY k, p) AS track_id FROM pc""",
    "candidate_links": f"""WITH {DET} SELECT a.block_name, a.time AS time_a, a.object_label AS label_a, b.time, b.object_label AS label_b, b.time - a.time AS frames,
  round(sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2 + (a.centroid_z - b.centroid_z) ** 2), 6) AS distance FROM det a JOIN det b ON a.block_name = b.block_name AND b.time - a.time IN (1, 2)
WHERE sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2 + (a.centroid_z - b.centroid_z) ** 2) <= 400 * (b.time - a.time) AND abs(a.centroid_z - b.centroid_z) <= 20 * (b.time - a.time)""",
    "normalised_scalars": "SELECT o_orderkey, o_custkey::VARCHAR AS id, false AS flag, o_custkey % 3 - 1 > 0 AS positive, o_custkey || '::' || o_orderkey AS track, upper(trim(substring(o_orderpriority, 3, 20))) AS \"group\", NULL::DOUBLE AS number FROM orders",
    "best_files": """WITH f AS (SELECT p_partkey % 40 AS block, 'run/' || p_brand || '/' || p_type || '_' || p_partkey AS path FROM part), r AS (SELECT *, CASE WHEN path LIKE '%PROMO%' THEN 0 WHEN path LIKE '%SMALL%' THEN 1 WHEN path LIKE '%LARGE%' THEN 2 END AS rank, len(string_split(path, '/')) AS depth FROM f)
SELECT block, path, rank, depth FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block ORDER BY rank, depth, path) = 1""",
    "file_completeness": """WITH f AS (SELECT p_partkey % 40 AS block, 'run/' || p_brand || '/' || p_type || '_' || p_partkey AS path FROM part), g AS (SELECT block, path, block % 3 <> 0 AND length(path) % 5 <> 0 AS p FROM f)
SELECT block, count(*) AS expected, count(*) FILTER (p) AS present, CASE WHEN count(*) FILTER (p) = count(*) THEN 'DONE' WHEN count(*) FILTER (p) = 0 THEN 'SKIPPED' ELSE 'INCOMPLETE' END AS status, coalesce(string_agg(path, ';' ORDER BY path) FILTER (NOT p), '') AS missing FROM g GROUP BY block""",
    "frame_intervals": """WITH d AS (SELECT user_id AS block, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM (SELECT DISTINCT user_id, ts FROM events))
SELECT block, count(*) AS n, round(avg(d) + 1.3e-7, 4) AS mean, round(median(d) + 1.3e-7, 4) AS median, round(stddev_samp(d) + 1.3e-7, 4) AS sd, round(min(d) + 1.3e-7, 4) AS min, round(max(d) + 1.3e-7, 4) AS max FROM d GROUP BY block""",
    "pixel_sizes": "SELECT s_suppkey AS block, CASE WHEN s_suppkey % 5 = 0 THEN 0.25 WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS xy_um FROM supplier",
    "two_way_factorial": """WITH r AS (SELECT (o_custkey % 3 = 0)::INT AS a, (o_orderkey % 2 = 0)::INT AS b, unnest(['total', 'priority']) AS feature, unnest([o_totalprice, length(o_orderpriority)::DOUBLE]) AS v FROM orders),
c AS (SELECT feature, a, b, count(*) AS n, avg(v) AS m, greatest(sum(v * v) - count(*) * avg(v) ** 2, 0) / (1 - 1 / count(*)) ** 2 / count(*) ** 2 AS s FROM r GROUP BY ALL),
w AS (SELECT feature, max(m) FILTER (a = 0 AND b = 0) AS m00, max(m) FILTER (a = 1 AND b = 0) AS m10, max(m) FILTER (a = 0 AND b = 1) AS m01, max(m) FILTER (a = 1 AND b = 1) AS m11, max(s) FILTER (a = 0 AND b = 0) AS s00, max(s) FILTER (a = 1 AND b = 0) AS s10, max(s) FILTER (a = 0 AND b = 1) AS s01, max(s) FILTER (a = 1 AND b = 1) AS s11 FROM c GROUP BY feature),
t AS (SELECT feature, unnest(['constant', 'a', 'b', 'a:b']) AS term, unnest([m00, m10 - m00, m01 - m00, m11 - m10 - m01 + m00]) AS e, unnest([s00, s10 + s00, s01 + s00, s11 + s10 + s01 + s00]) AS v FROM w)
SELECT feature, term, round(e, 3) + 0 AS estimate, round(e * e / v, 3) AS f FROM t""",
}
