"""Queries over tracks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import tracks as T
from tracklore.plans.views import BIG, DET, FRM, META, big_detections, block_frames, detections, subjects

#: Added before rounding where values are short decimals, so that none lies between two results.
NUDGE = 1.3e-9
RULES = T.QualityRules(max_step=900.0, max_z_range=36.0)

STEP = """st AS (
  SELECT *, centroid_x - lag(centroid_x) OVER w AS dx, centroid_y - lag(centroid_y) OVER w AS dy, centroid_z - lag(centroid_z) OVER w AS dz, time - lag(time) OVER w AS time_gap,
    lag(volume_voxels) OVER w AS pv, lag(mean_intensity) OVER w AS pi
  FROM {src} WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
s AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d3, sqrt(dx * dx + dy * dy) AS d2,
  CASE WHEN volume_voxels > 1e-6 AND pv > 1e-6 THEN greatest(volume_voxels / pv, pv / volume_voxels) END AS vf,
  CASE WHEN mean_intensity > 1e-6 AND pi > 1e-6 THEN greatest(mean_intensity / pi, pi / mean_intensity) END AS itf FROM st)"""
DET_STEP = DET + ",\n" + STEP.format(src="det")
BIG_STEP = BIG + ",\n" + STEP.format(src="big")

QUALITY = """q AS (
  SELECT block_name, track_id, count(DISTINCT time) AS track_length, min(time) AS start_time, max(time) AS end_time, coalesce(sum(d3), 0) AS path_length_3d, coalesce(sum(d2), 0) AS path_length_xy,
    avg(d3) AS mean_step_distance_3d, max(d3) AS max_step_distance_3d, avg(d2) AS mean_step_distance_xy, max(d2) AS max_step_distance_xy, avg(abs(dz)) AS mean_abs_z_step, max(abs(dz)) AS max_abs_z_step,
    max(centroid_z) - min(centroid_z) AS z_range, max(centroid_y) - min(centroid_y) AS y_range, max(centroid_x) - min(centroid_x) AS x_range, avg(centroid_z) AS mean_z, avg(centroid_y) AS mean_y, avg(centroid_x) AS mean_x,
    avg(volume_voxels) AS mean_volume, min(volume_voxels) AS min_volume, max(volume_voxels) AS max_volume, stddev_samp(volume_voxels) AS vsd, avg(mean_intensity) AS mean_intensity,
    arg_max(centroid_x, time) - arg_min(centroid_x, time) AS nx, arg_max(centroid_y, time) - arg_min(centroid_y, time) AS ny, arg_max(centroid_z, time) - arg_min(centroid_z, time) AS nz,
    median(d3) AS ms, stddev_pop(volume_voxels) AS vsp, max(vf) AS max_volume_fold, max(itf) AS max_intensity_fold
  FROM s GROUP BY block_name, track_id),
qq AS (SELECT *, end_time - start_time + 1 AS duration, sqrt(nx * nx + ny * ny + nz * nz) AS n3, sqrt(nx * nx + ny * ny) AS n2 FROM q),
f AS (SELECT *, coalesce(max_step_distance_3d, 0) AS max_step, coalesce(ms, 0) AS median_step,
    CASE WHEN track_length >= 2 AND mean_volume > 1e-6 THEN vsp / (mean_volume + 1e-6) END AS volume_cv_pop FROM qq),
g AS (SELECT *, CASE WHEN median_step > 1e-6 THEN max_step / median_step END AS step_to_median FROM f),
h AS (SELECT *, coalesce(step_to_median > 8 AND max_step > 10, false) AS step_spike, coalesce(max_volume_fold > 4, false) AS volume_jump,
    coalesce(volume_cv_pop > 1, false) AS high_volume_cv, coalesce(max_intensity_fold > 4, false) AS intensity_jump FROM g)"""

QUERIES = {
    "clean_tracks": lambda spark, sf: rounded(T.graded(detections(spark, sf), RULES).select("block_name", "track_id", "track_length", "path_length_3d", "net_displacement_3d", "split_merge_reason", "filter_reason", "good", "clean")),
    "track_quality": lambda spark, sf: rounded(T.quality(big_detections(spark, sf)), nudge=NUDGE),
    "track_summary": lambda spark, sf: rounded(T.summary(big_detections(spark, sf))),
    "split_merge_flags": lambda spark, sf: rounded(T.split_merge(big_detections(spark, sf))),
    "track_steps": lambda spark, sf: rounded(T.steps(detections(spark, sf)).select("block_name", "track_id", "time", "time_gap", "step_distance_3d", "step_distance_xy", "step_z_slices")),
    "long_tracks": lambda spark, sf: T.keep_long(detections(spark, sf), 14).select("block_name", "track_id", "time"),
    "jump_checks": lambda spark, sf: rounded(T.jumps(block_frames(spark, sf), 20, 2)),
    "track_motion": lambda spark, sf: rounded(T.motion(big_detections(spark, sf), 0.5, 2.0)),
    "running_metrics": lambda spark, sf: rounded(T.running(detections(spark, sf))),
    "directionality_by_relative_time": lambda spark, sf: rounded(T.relative_bins(big_detections(spark, sf), 10)),
    "turning_angles": lambda spark, sf: rounded(T.turning_histogram(big_detections(spark, sf), 24)),
    "msd_by_lag": lambda spark, sf: rounded(T.lag_msd(big_detections(spark, sf), 5), 4),
    "msd_log_fit": lambda spark, sf: rounded(T.log_fit(T.lag_msd(big_detections(spark, sf), 6), "lag", "msd", "block_name", "track_id"), 5),
    "renumbered_tracks": lambda spark, sf: T.renumber(T.steps(detections(spark, sf)), F.coalesce(F.col("step_distance_3d") > 700, F.lit(False))).select("block_name", "track_id", "time", "part", "new_track_id"),
    "time_corrected_tracks": lambda spark, sf: rounded(T.time_corrected(big_detections(spark, sf), subjects(spark, sf))),
    "time_capped_tracks": lambda spark, sf: rounded(T.time_corrected(big_detections(spark, sf), subjects(spark, sf), cap_minutes=30.0)),
    "volume_over_time": lambda spark, sf: rounded(T.value_summary(big_detections(spark, sf), "volume_voxels")),
    "intensity_over_time": lambda spark, sf: rounded(T.value_summary(detections(spark, sf), "mean_intensity")),
}

_R = lambda *c: ", ".join(f"round({x}, 6) + 0 AS {x}" for x in c)
_RN = lambda *c: ", ".join(f"round({x} + 1.3e-9, 6) + 0 AS {x}" for x in c)
_RUN = """r AS (SELECT block_name, track_id, time, d3, first_value(centroid_x) OVER w AS x0, first_value(centroid_y) OVER w AS y0, first_value(centroid_z) OVER w AS z0, centroid_x, centroid_y, centroid_z,
    coalesce(sum(d3) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS path, min(time) OVER p AS t0, max(time) OVER p AS t1 FROM s
  WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time), p AS (PARTITION BY block_name, track_id)),
rr AS (SELECT block_name, track_id, time, sqrt((centroid_x - x0) ** 2 + (centroid_y - y0) ** 2 + (centroid_z - z0) ** 2) AS from_start, path, CASE WHEN t1 > t0 THEN (time - t0) / (t1 - t0) END AS relative_time FROM r),
rd AS (SELECT *, CASE WHEN path > 0 THEN from_start / path END AS running_directionality FROM rr)"""
_MSD = """n AS (SELECT *, row_number() OVER (PARTITION BY block_name, track_id ORDER BY time) AS rn FROM big),
m AS (SELECT a.block_name, a.track_id, b.rn - a.rn AS lag, avg((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2 + (a.centroid_z - b.centroid_z) ** 2) AS msd, count(*) AS n_pairs
  FROM n a JOIN n b ON a.block_name = b.block_name AND a.track_id = b.track_id AND b.rn BETWEEN a.rn + 1 AND a.rn + {most} GROUP BY ALL)"""
_TIMED = (
    BIG
    + ",\n"
    + META
    + """,
t0 AS (SELECT big.*, time_interval_seconds AS dt0, (time - min(time) OVER (PARTITION BY block_name, track_id)) * time_interval_seconds / 60.0 AS minutes FROM big JOIN meta USING (block_name)),
t1 AS (SELECT * FROM t0 {where}),
t2 AS (SELECT *, sqrt((centroid_x - lag(centroid_x) OVER w) ** 2 + (centroid_y - lag(centroid_y) OVER w) ** 2 + (centroid_z - lag(centroid_z) OVER w) ** 2) AS d3,
  (minutes - lag(minutes) OVER w) * 60.0 AS dt, abs(volume_voxels - lag(volume_voxels) OVER w) AS dv FROM t1 WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
g AS (SELECT block_name, track_id, count(*) AS n_timepoints, max(minutes) AS track_duration_minutes,
  sqrt((arg_max(centroid_x, time) - arg_min(centroid_x, time)) ** 2 + (arg_max(centroid_y, time) - arg_min(centroid_y, time)) ** 2 + (arg_max(centroid_z, time) - arg_min(centroid_z, time)) ** 2) AS net_displacement,
  coalesce(sum(d3), 0) AS path_length, avg(d3 / dt) AS mean_speed_per_second, median(d3 / dt) AS median_speed_per_second, avg(d3 * d3) AS mean_squared_step, avg(volume_voxels) AS mean_volume, median(volume_voxels) AS median_volume,
  stddev_samp(volume_voxels) / avg(volume_voxels) AS volume_cv, median(dv) AS median_absolute_volume_change, regr_slope(volume_voxels, minutes) AS volume_slope_per_min FROM t2 GROUP BY block_name, track_id)
SELECT block_name, track_id, n_timepoints, """
    + _R("track_duration_minutes", "net_displacement", "path_length", "mean_speed_per_second", "median_speed_per_second", "mean_squared_step", "mean_volume", "median_volume", "volume_cv", "median_absolute_volume_change", "volume_slope_per_min")
    + """, round(CASE WHEN path_length > 0 THEN net_displacement / path_length END, 6) AS directionality, round(CASE WHEN net_displacement > 0 THEN path_length / net_displacement END, 6) AS tortuosity,
  round(mean_speed_per_second * 60, 6) AS mean_speed_per_minute, round(median_speed_per_second * 60, 6) AS median_speed_per_minute FROM g"""
)
_VALUE = """SELECT block_name, track_id, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_pop({v}), 6) AS sd, round(CASE WHEN avg({v}) <> 0 THEN stddev_pop({v}) / avg({v}) END, 6) + 0 AS cv,
  round(arg_max({v}, time) - arg_min({v}, time), 6) + 0 AS change, round(CASE WHEN count(*) > 1 THEN regr_slope({v}, time) END, 6) + 0 AS slope, round(CASE WHEN count({v}) >= 2 AND min({v}) > 0 THEN max({v}) / min({v}) END, 6) AS fold FROM {t} GROUP BY block_name, track_id"""

ORACLE_SQL = {
    "clean_tracks": f"""WITH {DET_STEP}, {QUALITY},
k AS (SELECT *, concat_ws(';', CASE WHEN step_spike THEN 'step_spike' END, CASE WHEN volume_jump THEN 'volume_jump' END, CASE WHEN high_volume_cv THEN 'high_volume_cv' END, CASE WHEN intensity_jump THEN 'intensity_jump' END) AS split_merge_reason,
  concat_ws(';', CASE WHEN track_length < 5 THEN 'short_track' END, CASE WHEN max_step_distance_3d > 900 THEN 'high_step_distance' END, CASE WHEN z_range > 36 THEN 'high_z_range' END, CASE WHEN n3 < 10 AND track_length >= 10 THEN 'possibly_static' END) AS filter_reason FROM h)
SELECT block_name, track_id, track_length, round(path_length_3d, 6) AS path_length_3d, round(n3, 6) AS net_displacement_3d, split_merge_reason, filter_reason, filter_reason = '' AS good,
  filter_reason = '' AND NOT (volume_jump AND step_spike OR high_volume_cv OR intensity_jump AND step_spike) AS clean FROM k""",
    "track_quality": f"""WITH {BIG_STEP}, {QUALITY}
SELECT block_name, track_id, track_length, start_time, end_time, duration, round(track_length / greatest(duration, 1) + 1.3e-9, 6) AS completeness, round(n3 + 1.3e-9, 6) AS net_displacement_3d, round(n2 + 1.3e-9, 6) AS net_displacement_xy, round(nz + 1.3e-9, 6) + 0 AS net_z_displacement_slices,
  {_RN("path_length_3d", "path_length_xy", "mean_step_distance_3d", "max_step_distance_3d", "mean_step_distance_xy", "max_step_distance_xy", "mean_abs_z_step", "max_abs_z_step", "z_range", "y_range", "x_range", "mean_z", "mean_y", "mean_x", "mean_volume", "min_volume", "max_volume", "mean_intensity")},
  round(CASE WHEN path_length_3d > 0 THEN n3 / path_length_3d END + 1.3e-9, 6) AS directionality_3d, round(CASE WHEN path_length_xy > 0 THEN n2 / path_length_xy END + 1.3e-9, 6) AS directionality_xy, round(CASE WHEN mean_volume > 0 THEN vsd / mean_volume END + 1.3e-9, 6) AS volume_cv,
  track_length >= 10 AS long_track, track_length >= 20 AS very_long_track, coalesce(max_step_distance_3d > 600, false) AS suspicious_jump, n3 < 10 AND track_length >= 10 AS possibly_static FROM h""",
    "track_summary": f"""WITH {BIG}
SELECT block_name, track_id, min(time) AS start_time, max(time) AS end_time, count(DISTINCT time) AS n_timepoints, round(avg(volume_voxels), 6) AS mean_volume, max(centroid_z) - min(centroid_z) AS z_range,
  max(time) - min(time) + 1 AS duration, round(count(DISTINCT time) / (max(time) - min(time) + 1), 6) AS completeness FROM big GROUP BY block_name, track_id""",
    "split_merge_flags": f"""WITH {BIG_STEP}, {QUALITY},
k AS (SELECT *, concat_ws(';', CASE WHEN step_spike THEN 'step_spike' END, CASE WHEN volume_jump THEN 'volume_jump' END, CASE WHEN high_volume_cv THEN 'high_volume_cv' END, CASE WHEN intensity_jump THEN 'intensity_jump' END) AS split_merge_reason FROM h)
SELECT block_name, track_id, {_R("max_step", "median_step", "volume_cv_pop", "max_volume_fold", "max_intensity_fold", "step_to_median")}, step_spike, volume_jump, high_volume_cv, intensity_jump, split_merge_reason, split_merge_reason <> '' AS split_merge_warning FROM k""",
    "track_steps": f"WITH {DET_STEP} SELECT block_name, track_id, time, time_gap, round(d3, 6) AS step_distance_3d, round(d2, 6) AS step_distance_xy, round(dz, 6) + 0 AS step_z_slices FROM s",
    "long_tracks": f"WITH {DET} SELECT block_name, track_id, time FROM det WHERE (block_name, track_id) IN (SELECT (block_name, track_id) FROM det GROUP BY block_name, track_id HAVING count(DISTINCT time) >= 14)",
    "jump_checks": f"""WITH {FRM},
{STEP.format(src="frm")}
SELECT block_name, track_id, time, dz AS step_z_slices, time_gap, CASE WHEN time_gap = 1 THEN 'consecutive' WHEN time_gap <= 2 THEN 'gap_closing' ELSE 'beyond_gap' END AS kind FROM s WHERE abs(dz) > 20""",
    "track_motion": f"""WITH {BIG},
u AS (SELECT block_name, track_id, time, centroid_x * 0.5 AS x, centroid_y * 0.5 AS y, centroid_z * 2.0 AS z FROM big),
v AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, time - lag(time) OVER w AS dt, x - first_value(x) OVER w AS ax, y - first_value(y) OVER w AS ay, z - first_value(z) OVER w AS az FROM u WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
p AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS step, sqrt(dx * dx + dy * dy + dz * dz) / dt AS speed, sqrt(ax * ax + ay * ay + az * az) AS fs, CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(dy, dx) END AS a FROM v),
c AS (SELECT *, (speed - lag(speed) OVER (PARTITION BY block_name, track_id ORDER BY time)) / dt AS accel FROM p),
g AS (SELECT block_name, track_id, count(*) AS n, coalesce(sum(step), 0) AS total_path_um, arg_max(fs, time) AS net_um, max(fs) AS max_from_start_um, avg(fs * fs) AS mean_squared_from_start_um2, avg(step * step) AS mean_squared_step_um2,
  avg(speed) AS mean_speed, median(speed) AS median_speed, max(speed) AS max_speed, stddev_pop(speed) AS speed_sd, avg(abs(accel)) AS mean_abs_accel, avg((dz > 0)::INT) AS up_fraction, avg((step > 1)::INT) AS moving_fraction,
  sqrt(avg(sin(a)) ** 2 + avg(cos(a)) ** 2) AS angle_resultant FROM c GROUP BY block_name, track_id)
SELECT block_name, track_id, n, {_R("total_path_um", "net_um", "max_from_start_um", "mean_squared_from_start_um2", "mean_squared_step_um2", "mean_speed", "median_speed", "max_speed", "speed_sd", "mean_abs_accel", "up_fraction", "moving_fraction", "angle_resultant")},
  round(CASE WHEN total_path_um > 0 THEN net_um / total_path_um END, 6) AS directionality, round(CASE WHEN net_um > 0 THEN total_path_um / net_um END, 6) AS tortuosity FROM g""",
    "running_metrics": f"WITH {DET_STEP}, {_RUN} SELECT block_name, track_id, time, round(from_start, 6) AS from_start, round(path, 6) AS path, round(running_directionality, 6) AS running_directionality, round(relative_time, 6) AS relative_time FROM rd",
    "directionality_by_relative_time": f"""WITH {BIG_STEP}, {_RUN}
SELECT greatest(ceil(relative_time * 10), 1)::INT AS bin, round(quantile_cont(running_directionality, 0.25), 6) AS q25, round(quantile_cont(running_directionality, 0.5), 6) AS q50, round(quantile_cont(running_directionality, 0.75), 6) AS q75,
  count(*) AS n, count(DISTINCT (block_name, track_id)) AS n_tracks FROM rd WHERE relative_time IS NOT NULL AND running_directionality IS NOT NULL GROUP BY bin""",
    "turning_angles": f"""WITH {BIG_STEP},
a AS (SELECT *, atan2(dy, dx) AS a FROM s WHERE dx <> 0 OR dy <> 0),
b AS (SELECT *, a - first_value(a) OVER (PARTITION BY block_name, track_id ORDER BY time) AS d FROM a),
c AS (SELECT *, (d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) AS p FROM b)
SELECT least(greatest(floor(p / (2 * pi() / 24)), 0), 23)::INT AS bin, count(*) AS n, count(DISTINCT (block_name, track_id)) AS n_tracks, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY bin""",
    "msd_by_lag": f"WITH {BIG}, {_MSD.format(most=5)} SELECT block_name, track_id, lag, round(msd, 4) AS msd, n_pairs FROM m",
    "msd_log_fit": f"""WITH {BIG}, {_MSD.format(most=6)}, l AS (SELECT *, log10(lag) AS lx, log10(msd) AS ly FROM m WHERE msd > 0)
SELECT block_name, track_id, count(*) AS n, round(regr_slope(ly, lx), 5) + 0 AS alpha, round(regr_intercept(ly, lx), 5) + 0 AS intercept, round(regr_r2(ly, lx), 5) AS r2 FROM l GROUP BY block_name, track_id HAVING count(*) >= 3""",
    "renumbered_tracks": f"""WITH {DET_STEP}, p AS (SELECT *, sum(coalesce(d3 > 700, false)::INT) OVER (PARTITION BY block_name, track_id ORDER BY time ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM s)
SELECT block_name, track_id, time, part, dense_rank() OVER (PARTITION BY block_name ORDER BY track_id, part) AS new_track_id FROM p""",
    "time_corrected_tracks": "WITH " + _TIMED.format(where=""),
    "time_capped_tracks": "WITH " + _TIMED.format(where="WHERE minutes <= 30"),
    "volume_over_time": f"WITH {BIG} " + _VALUE.format(v="volume_voxels", t="big"),
    "intensity_over_time": f"WITH {DET} " + _VALUE.format(v="mean_intensity", t="det"),
}
