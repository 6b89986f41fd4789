"""Queries over frame series, regions and ground truth, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import series as R
from tracklore.plans.views import BIG, FRM, big_detections, block_frames

KEY = ["block_name", "track_id"]


def _frames(spark, sf):
    """A block's days as frames; days without an event are at zero."""
    d = block_frames(spark, sf).withColumn("time", F.datediff("day", F.lit("2024-01-01")))
    return R.frame_series(d, "block_name", {"n": F.count("*"), "volume": F.sum("volume_voxels"), "n_low": F.count_if(F.col("centroid_z") < 10)})


_FRAMES = (
    FRM
    + """, dd AS (SELECT * REPLACE (datediff('day', DATE '2024-01-01', day)::INT AS time) FROM frm),
sp AS (SELECT block_name, unnest(range(a, b + 1))::INT AS time FROM (SELECT block_name, min(time) AS a, max(time) AS b FROM dd GROUP BY block_name)),
ag AS (SELECT block_name, time, count(*) AS n, sum(volume_voxels) AS volume, count(*) FILTER (centroid_z < 10) AS n_low FROM dd GROUP BY block_name, time),
fr AS (SELECT sp.block_name, sp.time, coalesce(n, 0) AS n, coalesce(volume, 0) AS volume, coalesce(n_low, 0) AS n_low FROM sp LEFT JOIN ag USING (block_name, time))"""
)


def _distance(spark, sf):
    b = big_detections(spark, sf)
    return b.select(*KEY, "time", (F.col("centroid_y") - 20).alias("distance"), (F.col("time") * 4.5).alias("minutes"))


_DIST = BIG + ", di AS (SELECT block_name, track_id, time, centroid_y - 20 AS distance, time * 4.5 AS minutes FROM big)"


def _points(spark, sf):
    d = big_detections(spark, sf).withColumn("row_id", F.col("track_id"))
    p = d.where("track_id % 7 = 0").select(F.col("track_id").alias("gt_id"), "block_name", "time", (F.col("centroid_y") + F.col("track_id") % 3).alias("y"), (F.col("centroid_x") + 1.5).alias("x"))
    return p, d.select("block_name", "time", "row_id", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))


_POINTS = BIG.replace("big AS (", "big AS MATERIALIZED (") + """, pt AS (SELECT track_id AS gt_id, block_name, time, centroid_y + track_id % 3 AS y, centroid_x + 1.5 AS x FROM big WHERE track_id % 7 = 0),
pc AS MATERIALIZED (SELECT *, floor(y / 6) + a AS cy, floor(x / 6) + b AS cx FROM pt, (VALUES (-1), (0), (1)) u(a), (VALUES (-1), (0), (1)) v(b)),
dc AS MATERIALIZED (SELECT track_id AS row_id, block_name, time, centroid_y, centroid_x, floor(centroid_y / 6) AS cy, floor(centroid_x / 6) AS cx FROM big),
ds AS (SELECT gt_id, block_name, time, row_id, sqrt((centroid_y - y) ** 2 + (centroid_x - x) ** 2) AS d FROM pc JOIN dc USING (block_name, time, cy, cx)),
al AS (SELECT gt_id, block_name, time, list_sort(list({'d': d, 'row_id': row_id}) FILTER (d IS NOT NULL)) AS l
  FROM (SELECT gt_id, block_name, time, d, row_id FROM ds WHERE d <= 6 UNION ALL SELECT gt_id, block_name, time, NULL, NULL FROM pt) GROUP BY gt_id, block_name, time),
mt AS MATERIALIZED (SELECT gt_id, block_name, time, l[1].row_id AS row_id, l[1].d AS distance, l[2].d AS second_distance, l[2].d - l[1].d AS margin,
  CASE WHEN l[1].row_id IS NOT NULL THEN count(*) OVER (PARTITION BY block_name, time, l[1].row_id) > 1 END AS ambiguous FROM al)"""  # fmt: skip


def _scores(spark, sf):
    return R.link_scores(R.nearest_in_frame(*_points(spark, sf), 6.0).withColumn("auto_track", F.col("row_id") % 5))


_LINKS = _POINTS + """, ln AS (SELECT block_name, gt_id, time, row_id % 5 AS a, lead(time) OVER w AS next_time, lead(row_id % 5) OVER w AS b FROM mt WINDOW w AS (PARTITION BY block_name, gt_id ORDER BY time)),
lk AS (SELECT *, CASE WHEN next_time - time > 1 THEN 'skipped' WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN a IS NULL OR b IS NULL THEN 'broken_missing' WHEN a = b THEN 'correct' ELSE 'wrong_link' END AS link_type FROM ln WHERE next_time IS NOT NULL),
ls AS (SELECT block_name, gt_id, time, next_time, link_type, CASE link_type WHEN 'correct' THEN 1 WHEN 'wrong_link' THEN -2 WHEN 'skipped' THEN NULL ELSE -1 END AS score FROM lk)"""  # fmt: skip


def _shifts(spark, sf):
    return block_frames(spark, sf).select("block_name", "time", (F.col("volume_voxels") % 9 - 4).alias("dy"), (F.col("centroid_z") % 7 - 3).alias("dx"))


QUERIES = {
    "frame_series": lambda spark, sf: rounded(_frames(spark, sf)),
    "frame_deltas": lambda spark, sf: rounded(R.deltas(_frames(spark, sf), "block_name", "n", "volume")),
    "rolling_series": lambda spark, sf: rounded(R.rolling(_frames(spark, sf), "block_name", "volume", 5).select("block_name", "time", "slope_volume", "sum_volume")),
    "series_summary": lambda spark, sf: rounded(R.series_summary(_frames(spark, sf), "block_name", "volume")),
    "region_crossings": lambda spark, sf: R.crossings(_distance(spark, sf), KEY, F.col("distance") <= 0).select(*KEY, "time", "inside", "entry", "exit"),
    "longest_runs": lambda spark, sf: R.longest_runs(_distance(spark, sf), KEY, F.col("distance") <= 0),
    "approach_steps": lambda spark, sf: rounded(R.approach(_distance(spark, sf), KEY, "distance", "minutes").select(*KEY, "time", "moved", "toward", "away", "approach_per_min")),
    "approach_summary": lambda spark, sf: rounded(R.approach_summary(_distance(spark, sf), KEY)),
    "region_exposure": lambda spark, sf: rounded(R.exposure(_distance(spark, sf), KEY, F.col("distance") <= 0, F.col("distance") <= 5, F.greatest(-F.col("distance") / 20, F.lit(0.0)), F.abs("distance"))),
    "mask_forward_fill": lambda spark, sf: R.forward_fill(_frames(spark, sf), "block_name", F.col("volume") >= 150).select("block_name", "time", "source_time"),
    "cumulative_drift": lambda spark, sf: rounded(R.drift(_shifts(spark, sf), "block_name", 3.0)),
    "interpolated_shifts": lambda spark, sf: R.interpolated(_shifts(spark, sf).where("time % 4 = 1"), "block_name", "dy", 100),
    "ground_truth_matches": lambda spark, sf: rounded(R.nearest_in_frame(*_points(spark, sf), 6.0)),
    "ground_truth_links": lambda spark, sf: _scores(spark, sf),
    "ground_truth_summary": lambda spark, sf: rounded(R.link_summary(_scores(spark, sf), "block_name", "gt_id")),
}

ORACLE_SQL = {
    "frame_series": f"WITH {_FRAMES} SELECT * FROM fr",
    "frame_deltas": f"WITH {_FRAMES} SELECT *, n - lag(n) OVER w AS delta_n, volume - lag(volume) OVER w AS delta_volume FROM fr WINDOW w AS (PARTITION BY block_name ORDER BY time)",
    "rolling_series": f"""WITH {_FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY block_name ORDER BY time) AS rn FROM fr)
SELECT block_name, time, round(CASE WHEN count(*) OVER w = 5 THEN regr_slope(volume, rn) OVER w END, 6) + 0 AS slope_volume, sum(volume) OVER w AS sum_volume FROM r WINDOW w AS (PARTITION BY block_name ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "series_summary": f"""WITH {_FRAMES}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY block_name) AS c, lag(volume) OVER w AS p FROM fr WINDOW w AS (PARTITION BY block_name ORDER BY time))
SELECT block_name, round(avg(volume), 6) AS mean, max(volume) AS max, min(volume) AS min, arg_max(volume, time) - arg_min(volume, time) AS net, sum((volume + p) / 2) AS area, round(regr_slope(volume, rn), 6) + 0 AS slope,
  round(regr_slope(volume, rn) FILTER (rn <= ceil(c / 2)), 6) + 0 AS early_slope, round(regr_slope(volume, rn) FILTER (rn > ceil(c / 2)), 6) + 0 AS late_slope, greatest(max(volume - p), 0) AS max_growth, greatest(max(p - volume), 0) AS max_shrink FROM r GROUP BY block_name""",
    "region_crossings": f"WITH {_DIST}, w AS (SELECT *, distance <= 0 AS inside, lag(distance <= 0) OVER (PARTITION BY block_name, track_id ORDER BY time) AS was FROM di) SELECT block_name, track_id, time, inside, coalesce(inside AND NOT was, false) AS entry, coalesce(NOT inside AND was, false) AS exit FROM w",
    "longest_runs": f"""WITH {_DIST}, i AS (SELECT *, distance <= 0 AS f, row_number() OVER (PARTITION BY block_name, track_id ORDER BY time) - row_number() OVER (PARTITION BY block_name, track_id, distance <= 0 ORDER BY time) AS i FROM di),
u AS (SELECT block_name, track_id, count(*) AS n, max(time) - min(time) AS d FROM i WHERE f GROUP BY block_name, track_id, i),
b AS (SELECT block_name, track_id, max(n) AS n, max(d) AS d FROM u GROUP BY ALL)
SELECT DISTINCT di.block_name, di.track_id, coalesce(n, 0) AS longest_rows, coalesce(d, 0) AS longest_time FROM di LEFT JOIN b USING (block_name, track_id)""",
    "approach_steps": f"""WITH {_DIST}, a AS (SELECT *, lag(distance) OVER w - distance AS moved, minutes - lag(minutes) OVER w AS dt FROM di WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time))
SELECT block_name, track_id, time, round(moved, 6) + 0 AS moved, coalesce(moved > 0, false) AS toward, coalesce(moved < 0, false) AS away, round(moved / dt, 6) + 0 AS approach_per_min FROM a""",
    "approach_summary": f"""WITH {_DIST}, a AS (SELECT *, distance <= 0 AS f, lag(distance <= 0) OVER w AS was, lag(distance) OVER w - distance AS moved, minutes - lag(minutes) OVER w AS dt,
  row_number() OVER w - row_number() OVER (PARTITION BY block_name, track_id, distance <= 0 ORDER BY time) AS i FROM di WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
u AS (SELECT block_name, track_id, max(n) AS n, max(d) AS d FROM (SELECT block_name, track_id, count(*) AS n, max(time) - min(time) AS d FROM a WHERE f GROUP BY block_name, track_id, i) GROUP BY ALL),
g AS (SELECT block_name, track_id, count(*) AS n, arg_min(distance, time) - arg_max(distance, time) AS net_approach, min(abs(distance)) AS min_abs_distance, avg(f::INT) AS fraction_inside, avg((moved > 0)::INT) AS fraction_toward,
  count(*) FILTER (f AND NOT was) AS entries, count(*) FILTER (NOT f AND was) AS exits, min(minutes) FILTER (f AND NOT was) AS first_entry, min(minutes) FILTER (NOT f AND was) AS first_exit,
  avg(moved / dt) FILTER (moved > 0) AS toward_per_min, avg(-moved / dt) FILTER (moved < 0) AS away_per_min FROM a GROUP BY ALL)
SELECT g.block_name, g.track_id, g.n, round(net_approach, 6) + 0 AS net_approach, min_abs_distance, round(fraction_inside, 6) AS fraction_inside, round(fraction_toward, 6) AS fraction_toward, entries, exits, first_entry, first_exit,
  round(toward_per_min, 6) AS toward_per_min, round(away_per_min, 6) AS away_per_min, coalesce(u.n, 0) AS longest_rows, coalesce(u.d, 0) AS longest_time FROM g LEFT JOIN u USING (block_name, track_id)""",
    "region_exposure": f"""WITH {_DIST}, g AS (SELECT block_name, track_id, avg((distance <= 0)::INT) AS i, avg((distance <= 5)::INT) AS n, bool_or(distance <= 0) AS e, avg(greatest(-distance / 20, 0)) AS mo, max(greatest(-distance / 20, 0)) AS xo, avg(abs(distance)) AS md, min(abs(distance)) AS nd FROM di GROUP BY ALL)
SELECT block_name, track_id, round(i, 6) AS inside_fraction, round(n, 6) AS near_fraction, e AS ever_inside, round(mo, 6) AS mean_overlap, round(xo, 6) + 0 AS max_overlap, round(md, 6) AS mean_distance, nd AS min_distance, CASE WHEN i = 1 THEN 'inside' WHEN e THEN 'mixed' WHEN n > 0 THEN 'boundary' ELSE 'outside' END AS region_type FROM g""",
    "mask_forward_fill": f"WITH {_FRAMES} SELECT block_name, time, last_value(CASE WHEN volume >= 150 THEN time END IGNORE NULLS) OVER (PARTITION BY block_name ORDER BY time ROWS UNBOUNDED PRECEDING) AS source_time FROM fr",
    "cumulative_drift": f"""WITH {FRM}, s AS (SELECT block_name, time, volume_voxels % 9 - 4 AS dy, centroid_z % 7 - 3 AS dx FROM frm)
SELECT *, sum(CASE WHEN abs(dy) <= 3 AND abs(dx) <= 3 THEN dy ELSE 0 END) OVER w AS drift_dy, sum(CASE WHEN abs(dy) <= 3 AND abs(dx) <= 3 THEN dx ELSE 0 END) OVER w AS drift_dx FROM s WINDOW w AS (PARTITION BY block_name ORDER BY time ROWS UNBOUNDED PRECEDING)""",
    "interpolated_shifts": f"""WITH {FRM}, s AS (SELECT block_name, time, volume_voxels % 9 - 4 AS v FROM frm WHERE time % 4 = 1),
sp AS (SELECT block_name, unnest(range(0, 100)) AS time FROM (SELECT DISTINCT block_name FROM s)),
j AS (SELECT sp.block_name, sp.time, (SELECT max(time) FROM s WHERE s.block_name = sp.block_name AND s.time <= sp.time) AS ta, (SELECT min(time) FROM s WHERE s.block_name = sp.block_name AND s.time >= sp.time) AS tb FROM sp)
SELECT block_name, time, (CASE WHEN x - floor(x) = 0.5 THEN 2 * floor((floor(x) + 1) / 2) ELSE floor(x + 0.5) END)::INT AS dy FROM (
  SELECT j.block_name, j.time, CASE WHEN tb > ta THEN a.v + (b.v - a.v) * (j.time - ta) / (tb - ta) ELSE coalesce(a.v, b.v) END AS x
  FROM j LEFT JOIN s a ON a.block_name = j.block_name AND a.time = ta LEFT JOIN s b ON b.block_name = j.block_name AND b.time = tb)""",
    "ground_truth_matches": f"WITH {_POINTS} SELECT gt_id, block_name, time, row_id, round(distance, 6) AS distance, round(second_distance, 6) AS second_distance, round(margin, 6) + 0 AS margin, ambiguous FROM mt",
    "ground_truth_links": f"WITH {_LINKS} SELECT * FROM ls",
    "ground_truth_summary": f"""WITH {_LINKS}, g AS (SELECT block_name, gt_id, count(*) FILTER (link_type = 'correct') AS n_correct, count(*) FILTER (link_type = 'wrong_link') AS n_wrong, count(*) FILTER (link_type IN ('both_missing', 'broken_missing')) AS n_broken, sum(score)::BIGINT AS total, count(score) AS n_scored, grouping(block_name, gt_id) AS level FROM ls GROUP BY ROLLUP (block_name, gt_id))
SELECT *, round(CASE WHEN n_scored > 0 THEN n_correct / n_scored END, 6) AS accuracy FROM g""",
}
