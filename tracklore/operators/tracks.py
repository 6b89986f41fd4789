"""Steps, quality, censoring and motion of tracks; a track is (block_name, track_id), ordered by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.functions.scalar import norm, ratio, wrap_angle
from tracklore.operators.lineage import kept, quantiles

KEY = ["block_name", "track_id"]


def by_time() -> W:
    return W.partitionBy(*KEY).orderBy("time")


def steps(tracks: DataFrame, z_weight: float = 1.0) -> DataFrame:
    """Each detection with its step from the one before: distances, slices and frames."""
    w = by_time()
    d = {c: F.col(f"centroid_{c}") - F.lag(f"centroid_{c}").over(w) for c in "zyx"}
    out = tracks.withColumns({f"d{c}": v for c, v in d.items()} | {"time_gap": F.col("time") - F.lag("time").over(w)})
    out = out.withColumns({"step_distance_3d": norm(F.col("dx"), F.col("dy"), F.col("dz") * z_weight), "step_distance_xy": norm(F.col("dx"), F.col("dy"))})
    return out.withColumnRenamed("dz", "step_z_slices")


def summary(tracks: DataFrame) -> DataFrame:
    """Extent of each track in time, and its completeness."""
    g = tracks.groupBy(*KEY).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count_distinct("time").alias("n_timepoints"), F.avg("volume_voxels").alias("mean_volume"), (F.max("centroid_z") - F.min("centroid_z")).alias("z_range"))
    span = F.col("end_time") - F.col("start_time") + 1
    return g.withColumn("duration", span).withColumn("completeness", F.col("n_timepoints") / span)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the quality flags and of the good and clean filters."""

    z_weight: float = 1.0
    long_track: int = 10
    very_long_track: int = 20
    static_displacement: float = 10.0
    suspicious_jump: float = 600.0
    max_volume_fold: float = 4.0
    max_intensity_fold: float = 4.0
    max_volume_cv: float = 1.0
    max_step_ratio: float = 8.0
    min_step: float = 10.0
    min_length: int = 5
    max_step: float = 1000.0
    max_z_range: float = 38.0
    remove_static: bool = True


def _ends() -> dict[str, Column]:
    return {f"{c}{k}": f(f"centroid_{c}", "time") for c in "zyx" for k, f in ((0, F.min_by), (1, F.max_by))}


def _quality_sums() -> list[Column]:
    aggs = [v.alias(k) for k, v in _ends().items()]
    aggs += [F.count_distinct("time").alias("track_length"), F.min("time").alias("start_time"), F.max("time").alias("end_time")]
    for d in ("3d", "xy"):
        c = f"step_distance_{d}"
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"path_length_{d}"), F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    aggs += [F.avg(F.abs("step_z_slices")).alias("mean_abs_z_step"), F.max(F.abs("step_z_slices")).alias("max_abs_z_step")]
    for c in "zyx":
        aggs += [(F.max(f"centroid_{c}") - F.min(f"centroid_{c}")).alias(f"{c}_range"), F.avg(f"centroid_{c}").alias(f"mean_{c}")]
    aggs += [F.avg("volume_voxels").alias("mean_volume"), F.min("volume_voxels").alias("min_volume"), F.max("volume_voxels").alias("max_volume"), F.stddev_samp("volume_voxels").alias("volume_sd"), F.avg("mean_intensity").alias("mean_intensity")]
    return aggs


def _with_quality(q: DataFrame, rules: QualityRules) -> DataFrame:
    dx, dy, dz = (F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")
    q = q.withColumns({"duration": F.col("end_time") - F.col("start_time") + 1, "net_displacement_3d": norm(dx, dy, dz * rules.z_weight), "net_displacement_xy": norm(dx, dy), "net_z_displacement_slices": dz})
    q = q.withColumns(
        {
            "completeness": F.col("track_length") / F.greatest("duration", F.lit(1)),
            "directionality_3d": ratio(F.col("net_displacement_3d"), F.col("path_length_3d")),
            "directionality_xy": ratio(F.col("net_displacement_xy"), F.col("path_length_xy")),
            "volume_cv": ratio(F.col("volume_sd"), F.col("mean_volume")),
            "long_track": F.col("track_length") >= rules.long_track,
            "very_long_track": F.col("track_length") >= rules.very_long_track,
            "suspicious_jump": F.coalesce(F.col("max_step_distance_3d") > rules.suspicious_jump, F.lit(False)),
            "possibly_static": (F.col("net_displacement_3d") < rules.static_displacement) & (F.col("track_length") >= rules.long_track),
        }
    )
    return q.drop("volume_sd", *_ends())


def quality(tracks: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """One row of movement, volume and intensity features per track, with its flags."""
    return _with_quality(steps(tracks, rules.z_weight).groupBy(*KEY).agg(*_quality_sums()), rules)


def _fold(value: str) -> Column:
    """The larger ratio of a value to the one before, where both are positive."""
    now, before = F.col(value), F.lag(value).over(by_time())
    return F.when((now > 1e-6) & (before > 1e-6), F.greatest(now / before, before / now))


def _with_folds(s: DataFrame) -> DataFrame:
    return s.withColumns({"volume_fold": _fold("volume_voxels"), "intensity_fold": _fold("mean_intensity")})


def _split_sums() -> list[Column]:
    return [
        F.coalesce(F.max("step_distance_3d"), F.lit(0.0)).alias("max_step"),
        F.coalesce(F.median("step_distance_3d"), F.lit(0.0)).alias("median_step"),
        F.when((F.count("volume_voxels") >= 2) & (F.avg("volume_voxels") > 1e-6), F.stddev_pop("volume_voxels") / (F.avg("volume_voxels") + 1e-6)).alias("volume_cv_pop"),
        F.max("volume_fold").alias("max_volume_fold"),
        F.max("intensity_fold").alias("max_intensity_fold"),
    ]


def split_merge(tracks: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """Flags of tracks that seem to join or split objects, with the reasons."""
    return _with_split(_with_folds(steps(tracks, rules.z_weight)).groupBy(*KEY).agg(*_split_sums()), rules)


def _with_split(g: DataFrame, rules: QualityRules) -> DataFrame:
    g = g.withColumn("step_to_median", F.when(F.col("median_step") > 1e-6, F.col("max_step") / F.col("median_step")))
    flags = {
        "step_spike": (F.col("step_to_median") > rules.max_step_ratio) & (F.col("max_step") > rules.min_step),
        "volume_jump": F.col("max_volume_fold") > rules.max_volume_fold,
        "high_volume_cv": F.col("volume_cv_pop") > rules.max_volume_cv,
        "intensity_jump": F.col("max_intensity_fold") > rules.max_intensity_fold,
    }
    g = g.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return g.withColumn("split_merge_reason", reasons({k: F.col(k) for k in flags})).withColumn("split_merge_warning", F.col("split_merge_reason") != "")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def graded(tracks: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """Quality with split and merge flags, the reasons against each track, and whether it is good and clean.

    A step spike alone does not exclude a good track from the clean ones.
    """
    g = _with_folds(steps(tracks, rules.z_weight)).groupBy(*KEY).agg(*_quality_sums(), *_split_sums())
    q = _with_split(_with_quality(g, rules), rules)
    against = {"short_track": F.col("track_length") < rules.min_length, "high_step_distance": F.col("max_step_distance_3d") > rules.max_step, "high_z_range": F.col("z_range") > rules.max_z_range}
    if rules.remove_static:
        against["possibly_static"] = F.col("possibly_static")
    strong = F.col("volume_jump") & F.col("step_spike") | F.col("high_volume_cv") | F.col("intensity_jump") & F.col("step_spike")
    q = q.withColumn("filter_reason", reasons(against)).withColumn("good", F.col("filter_reason") == "")
    return q.withColumn("clean", F.col("good") & ~F.coalesce(strong, F.lit(False)))


def keep_long(tracks: DataFrame, least: int) -> DataFrame:
    """Detections of tracks seen in at least so many frames."""
    n = tracks.groupBy(*KEY).agg(F.count_distinct("time").alias("n")).where(F.col("n") >= least)
    return tracks.join(n, KEY, "left_semi")


def jumps(tracks: DataFrame, limit: float, gap: int) -> DataFrame:
    """Steps over the limit, by whether the frames are consecutive, within the gap, or beyond it."""
    kind = F.when(F.col("time_gap") == 1, "consecutive").when(F.col("time_gap") <= gap, "gap_closing").otherwise("beyond_gap")
    return steps(tracks).where(F.abs("step_z_slices") > limit).select(*KEY, "time", "step_z_slices", "time_gap", kind.alias("kind"))


def motion(tracks: DataFrame, xy_um: float, z_um: float) -> DataFrame:
    """Movement of each track in micrometres: path, net, speeds, accelerations, and distance from its start."""
    w = by_time()
    um = tracks.select(*KEY, "time", *[(F.col(f"centroid_{c}") * s).alias(c) for c, s in (("x", xy_um), ("y", xy_um), ("z", z_um))])
    um = um.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in "xyz"} | {"dt": F.col("time") - F.lag("time").over(w)} | {f"{c}0": F.first(c).over(w) for c in "xyz"})
    step = norm(F.col("dx"), F.col("dy"), F.col("dz"))
    um = um.withColumn("step", F.when(F.col("dt") > 0, step)).withColumn("speed", F.col("step") / F.col("dt"))
    um = um.withColumn("accel", (F.col("speed") - F.lag("speed").over(w)) / F.col("dt"))
    um = um.withColumn("from_start", norm(*[F.col(c) - F.col(f"{c}0") for c in "xyz"]))
    angle = F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.atan2("dy", "dx"))
    g = um.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_path_um"), F.max_by("from_start", "time").alias("net_um"), F.max("from_start").alias("max_from_start_um"),
        F.avg(F.col("from_start") * F.col("from_start")).alias("mean_squared_from_start_um2"), F.avg(F.col("step") * F.col("step")).alias("mean_squared_step_um2"),
        F.avg("speed").alias("mean_speed"), F.median("speed").alias("median_speed"), F.max("speed").alias("max_speed"), F.stddev_pop("speed").alias("speed_sd"), F.avg(F.abs("accel")).alias("mean_abs_accel"),
        F.avg((F.col("dz") > 0).cast("int")).alias("up_fraction"), F.avg((F.col("step") > 1.0).cast("int")).alias("moving_fraction"), F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"),
    )
    r = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    g = g.withColumns({"directionality": ratio(F.col("net_um"), F.col("total_path_um")), "tortuosity": ratio(F.col("total_path_um"), F.col("net_um")), "angle_resultant": r})
    return g.drop("s", "c")


def running(tracks: DataFrame) -> DataFrame:
    """Distance from start, cumulative path, running directionality and relative time at each detection."""
    w = by_time()
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(*KEY)
    s = steps(tracks).withColumns({f"first_{c}": F.first(f"centroid_{c}").over(w) for c in "zyx"})
    s = s.withColumns({"from_start": norm(*[F.col(f"centroid_{c}") - F.col(f"first_{c}") for c in "zyx"]), "path": F.coalesce(F.sum("step_distance_3d").over(upto), F.lit(0.0))})
    span = F.max("time").over(every) - F.min("time").over(every)
    s = s.withColumns({"running_directionality": ratio(F.col("from_start"), F.col("path")), "relative_time": F.when(span > 0, (F.col("time") - F.min("time").over(every)) / span)})
    return s.select(*KEY, "time", "from_start", "path", "running_directionality", "relative_time")


def relative_bins(tracks: DataFrame, bins: int, value: str = "running_directionality") -> DataFrame:
    """Median, quartiles and counts of a running value by bin of relative time, right-closed, the lowest included."""
    r = running(tracks).where(F.col("relative_time").isNotNull() & F.col(value).isNotNull())
    r = r.withColumn("bin", F.greatest(F.ceil(F.col("relative_time") * bins), F.lit(1)).cast("int"))
    r = kept(r.select(*KEY, "bin", value))
    q = quantiles(r, ["bin"], value, {f"q{int(100 * p)}": p for p in (0.25, 0.5, 0.75)})
    return q.join(r.groupBy("bin").agg(F.count_distinct(F.struct(*KEY)).alias("n_tracks")).hint("merge"), "bin").select("bin", "q25", "q50", "q75", "n", "n_tracks")


def turning_histogram(tracks: DataFrame, bins: int = 24) -> DataFrame:
    """Share of steps by their angle to the track's first step, in equal bins of [-pi, pi)."""
    pi = 3.141592653589793
    s = steps(tracks).where("dx <> 0 OR dy <> 0").withColumn("angle", F.atan2("dy", "dx"))
    s = s.withColumn("turn", wrap_angle(F.col("angle") - F.first("angle").over(by_time())))
    s = s.withColumn("bin", F.least(F.greatest(F.floor((F.col("turn") + pi) / (2 * pi / bins)), F.lit(0)), F.lit(bins - 1)).cast("int"))
    return s.groupBy("bin").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*KEY)).alias("n_tracks")).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def lag_msd(tracks: DataFrame, most: int) -> DataFrame:
    """Mean squared displacement of each track by row lag: all pairs of detections lag rows apart, looked up ahead in its window."""
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), *[F.lead(f"centroid_{c}", k).over(by_time()).alias(c) for c in "zyx"], F.lead("time", k).over(by_time()).isNotNull().alias("there")) for k in range(1, most + 1)])
    pairs = tracks.withColumn("ahead", ahead).select(*KEY, *[F.col(f"centroid_{c}").alias(f"{c}0") for c in "zyx"], F.explode("ahead").alias("p")).where("p.there").select(*KEY, "p.lag", *[f"{c}0" for c in "zyx"], *[f"p.{c}" for c in "zyx"])
    d2 = sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "zyx"), F.lit(0.0))
    return pairs.groupBy(*KEY, "lag").agg(F.avg(d2).alias("msd"), F.count("*").alias("n_pairs"))


def log_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope, intercept and R2 of log10 y on log10 x, with three points at least."""
    p = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return p.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("alpha"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2")).where("n >= 3")


def renumber(tracks: DataFrame, broken: Column) -> DataFrame:
    """New track ids after breaks: a broken detection starts a new part; parts are numbered in order of track and time."""
    parts = tracks.withColumn("part", F.sum(broken.cast("int")).over(by_time().rowsBetween(W.unboundedPreceding, W.currentRow)))
    order = W.partitionBy("block_name").orderBy("track_id", "part")
    return parts.withColumn("new_track_id", F.dense_rank().over(order))


def time_corrected(tracks: DataFrame, intervals: DataFrame, cap_minutes: float | None = None) -> DataFrame:
    """Speeds, spread and shape changes of each track in real time; intervals (block_name, time_interval_seconds).

    intervals is a cohort table with one row per block, joined by hash. cap_minutes drops what is later in a track.
    """
    t = tracks.join(intervals.select("block_name", "time_interval_seconds"), "block_name")
    first = F.min("time").over(W.partitionBy(*KEY))
    t = t.withColumn("minutes", (F.col("time") - first) * F.col("time_interval_seconds") / 60.0)
    if cap_minutes is not None:
        t = t.where(F.col("minutes") <= cap_minutes)
    w = by_time()
    s = steps(t).withColumn("dt", (F.col("minutes") - F.lag("minutes").over(w)) * 60.0)
    s = s.withColumns({"speed": F.when(F.col("dt") > 0, F.col("step_distance_3d") / F.col("dt")), "dv": F.abs(F.col("volume_voxels") - F.lag("volume_voxels").over(w))})
    ends = [f(f"centroid_{c}", "time") for c in "zyx" for f in (F.max_by, F.min_by)]
    net = norm(ends[0] - ends[1], ends[2] - ends[3], ends[4] - ends[5])
    g = s.groupBy(*KEY).agg(
        F.count("*").alias("n_timepoints"), F.max("minutes").alias("track_duration_minutes"), net.alias("net_displacement"), F.coalesce(F.sum("step_distance_3d"), F.lit(0.0)).alias("path_length"),
        F.avg("speed").alias("mean_speed_per_second"), F.median("speed").alias("median_speed_per_second"), F.avg(F.col("step_distance_3d") * F.col("step_distance_3d")).alias("mean_squared_step"),
        F.avg("volume_voxels").alias("mean_volume"), F.median("volume_voxels").alias("median_volume"), ratio(F.stddev_samp("volume_voxels"), F.avg("volume_voxels")).alias("volume_cv"),
        F.median("dv").alias("median_absolute_volume_change"), F.regr_slope("volume_voxels", "minutes").alias("volume_slope_per_min"),
    )
    return g.withColumns({"directionality": ratio(F.col("net_displacement"), F.col("path_length")), "tortuosity": ratio(F.col("path_length"), F.col("net_displacement")), "mean_speed_per_minute": F.col("mean_speed_per_second") * 60.0, "median_speed_per_minute": F.col("median_speed_per_second") * 60.0})


def value_summary(tracks: DataFrame, value: str) -> DataFrame:
    """Mean, median, spread, change, slope and fold of a feature over each track."""
    v = F.col(value)
    return tracks.groupBy(*KEY).agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), F.when(F.avg(v) != 0, F.stddev_pop(v) / F.avg(v)).alias("cv"), (F.max_by(v, "time") - F.min_by(v, "time")).alias("change"),
        F.regr_slope(v, F.col("time").cast("double")).alias("slope"), F.when((F.count(v) >= 2) & (F.min(v) > 0), F.max(v) / F.min(v)).alias("fold"),
    )
