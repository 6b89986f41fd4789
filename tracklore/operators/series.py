"""Per-frame series of a block, regions, approach to a mask, runs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.functions.scalar import norm


def frame_series(rows: DataFrame, block: str, values: dict[str, Column]) -> DataFrame:
    """Aggregates of each frame between a block's first and last, frames without rows at zero."""
    spine = rows.groupBy(block).agg(F.explode(F.sequence(F.min("time"), F.max("time"))).alias("time"))
    found = rows.groupBy(block, "time").agg(*[v.alias(k) for k, v in values.items()])
    out = spine.join(found.hint("merge"), [block, "time"], "left")
    return out.fillna(0, subset=[k for k in values])


def deltas(series: DataFrame, block: str, *columns: str) -> DataFrame:
    w = W.partitionBy(block).orderBy("time")
    return series.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def rolling(series: DataFrame, block: str, column: str, k: int) -> DataFrame:
    """Slope over the last k frames, whole windows of two values at least, and their sum."""
    w = W.partitionBy(block).orderBy("time")
    last = w.rowsBetween(-(k - 1), 0)
    s = series.withColumn("_rn", F.row_number().over(w).cast("double"))
    full = (F.count(F.lit(1)).over(last) == k) & (F.count(column).over(last) >= 2)
    return s.withColumns({f"slope_{column}": F.when(full, F.regr_slope(F.col(column), F.col("_rn")).over(last)), f"sum_{column}": F.sum(column).over(last)}).drop("_rn")


def crossings(rows: DataFrame, key: list[str], inside: Column) -> DataFrame:
    """Each row's entry into and exit from a region, from the state of the row before."""
    w = W.partitionBy(*key).orderBy("time")
    s = rows.withColumn("inside", inside).withColumn("was_inside", F.lag("inside").over(w))
    return s.withColumns({"entry": F.coalesce(F.col("inside") & ~F.col("was_inside"), F.lit(False)), "exit": F.coalesce(~F.col("inside") & F.col("was_inside"), F.lit(False))})


def longest_runs(rows: DataFrame, key: list[str], flag: Column) -> DataFrame:
    """Longest run of consecutive true rows of each key: in rows, and from its first to its last time."""
    w = W.partitionBy(*key).orderBy("time")
    s = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy(*key, "_f").orderBy("time"))
    s = s.withColumn("_i", island)
    runs = s.where("_f").groupBy(*key, "_i").agg(F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("d"))
    best = runs.groupBy(*key).agg(F.max("n").alias("longest_rows"), F.max("d").alias("longest_time"))
    return rows.select(*key).distinct().join(best, key, "left").fillna(0)


def approach(rows: DataFrame, key: list[str], distance: str, minutes: str) -> DataFrame:
    """Steps towards a region and away from it, with velocities per minute; a step that takes no time is an error."""
    w = W.partitionBy(*key).orderBy("time")
    s = rows.withColumns({"dt": F.col(minutes) - F.lag(minutes).over(w), "moved": F.lag(distance).over(w) - F.col(distance)})
    s = s.withColumn("dt", F.when(F.col("dt") <= 0, F.raise_error(F.lit("frames must advance"))).otherwise(F.col("dt")))
    return s.withColumns({"toward": F.coalesce(F.col("moved") > 0, F.lit(False)), "away": F.coalesce(F.col("moved") < 0, F.lit(False)), "approach_per_min": F.col("moved") / F.col("dt")})


def approach_summary(rows: DataFrame, key: list[str], distance: str = "distance", minutes: str = "minutes") -> DataFrame:
    """Each track's net approach, closest distance, time inside (distance <= 0), entries, exits and longest stay."""
    s = crossings(approach(rows, key, distance, minutes), key, F.col(distance) <= 0)
    g = s.groupBy(*key).agg(
        F.count("*").alias("n"), (F.min_by(distance, "time") - F.max_by(distance, "time")).alias("net_approach"), F.min(F.abs(distance)).alias("min_abs_distance"), F.avg(F.col("inside").cast("int")).alias("fraction_inside"),
        F.avg(F.when(F.col("moved").isNotNull(), F.col("toward").cast("int"))).alias("fraction_toward"), F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"),
        F.min(F.when(F.col("entry"), F.col(minutes))).alias("first_entry"), F.min(F.when(F.col("exit"), F.col(minutes))).alias("first_exit"),
        F.avg(F.when(F.col("toward"), F.col("approach_per_min"))).alias("toward_per_min"), F.avg(F.when(F.col("away"), -F.col("approach_per_min"))).alias("away_per_min"),
    )
    return g.join(longest_runs(rows, key, F.col(distance) <= 0), key)


def forward_fill(frames: DataFrame, block: str, valid: Column) -> DataFrame:
    """For each frame the last frame up to it whose mask is valid; a mask is then joined on that frame."""
    upto = W.partitionBy(block).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("source_time", F.last(F.when(valid, F.col("time")), ignorenulls=True).over(upto))


def drift(shifts: DataFrame, block: str, limit: float) -> DataFrame:
    """Cumulative drift of frame shifts (dy, dx); a shift beyond the limit on either axis counts as none."""
    ok = (F.abs("dy") <= limit) & (F.abs("dx") <= limit)
    upto = W.partitionBy(block).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    return shifts.withColumns({f"drift_{c}": F.sum(F.when(ok, F.col(c)).otherwise(0.0)).over(upto) for c in ("dy", "dx")})


def interpolated(samples: DataFrame, block: str, value: str, frames: int) -> DataFrame:
    """A value at every frame between samples, linear between neighbours, held at the edges, rounded half to even."""
    spine = samples.select(block).distinct().select(block, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("time"))
    spine = spine.unionAll(samples.select(block, F.col("time").cast("int"))).distinct()
    s = spine.join(samples.select(block, "time", F.col(value).cast("double").alias("v")).hint("merge"), [block, "time"], "left")
    w = W.partitionBy(block).orderBy("time")
    at = F.when(F.col("v").isNotNull(), F.struct(F.col("time").alias("t"), "v"))
    s = s.withColumns({"a": F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first(at, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    gap = F.col("b.t") - F.col("a.t")
    mixed = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("time") - F.col("a.t")) / gap
    return s.where(F.col("time") < frames).select(block, "time", F.rint(F.when(gap > 0, mixed).otherwise(F.coalesce("a.v", "b.v"))).cast("int").alias(value))


def series_summary(series: DataFrame, block: str, value: str, minutes: Column | None = None) -> DataFrame:
    """Mean, extremes, net change, trapezoid area by frame, slopes of all and of each half, and the largest rates."""
    w = W.partitionBy(block).orderBy("time")
    s = series.withColumns({"rn": F.row_number().over(w).cast("double"), "n": F.count(F.lit(1)).over(W.partitionBy(block)), "before": F.lag(value).over(w)})
    early, v, rate = F.col("rn") <= F.ceil(F.col("n") / 2), F.col(value).cast("double"), F.col(value) - F.col("before")
    return s.groupBy(block).agg(
        F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), (F.max_by(v, "time") - F.min_by(v, "time")).alias("net"), F.sum((v + F.col("before")) / 2).alias("area"), F.regr_slope(v, F.col("rn")).alias("slope"),
        F.regr_slope(F.when(early, v), F.col("rn")).alias("early_slope"), F.regr_slope(F.when(~early, v), F.col("rn")).alias("late_slope"),
        F.greatest(F.max(rate), F.lit(0)).cast("double").alias("max_growth"), F.greatest(F.max(-rate), F.lit(0)).cast("double").alias("max_shrink"),
    )


def exposure(rows: DataFrame, key: list[str], inside: Column, near: Column, overlap: Column, distance: Column) -> DataFrame:
    """How much of each track is in or near a region, with overlap and distance."""
    g = rows.withColumns({"_i": inside, "_n": near, "_o": overlap, "_d": distance}).groupBy(*key)
    out = g.agg(F.avg(F.col("_i").cast("int")).alias("inside_fraction"), F.avg(F.col("_n").cast("int")).alias("near_fraction"), F.bool_or("_i").alias("ever_inside"), F.avg("_o").alias("mean_overlap"), F.max("_o").alias("max_overlap"), F.avg("_d").alias("mean_distance"), F.min("_d").alias("min_distance"))
    kind = F.when(F.col("inside_fraction") == 1, "inside").when(F.col("ever_inside"), "mixed").when(F.col("near_fraction") > 0, "boundary").otherwise("outside")
    return out.withColumn("region_type", kind)


def nearest_in_frame(points: DataFrame, detections: DataFrame, limit: float) -> DataFrame:
    """For each point (gt_id, block_name, time, y, x) its nearest detection (row_id, ...) of the frame within the limit.

    Frames are joined by equality and cells of the limit's size, so only near detections meet a point; ties go to the
    smaller row_id. The second best, the margin, and whether the detection is matched by several points follow.
    """
    cell = lambda c: F.floor(F.col(c) / limit)
    p = points.withColumns({"cy": cell("y"), "cx": cell("x")})
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    p = p.select("gt_id", "block_name", "time", F.col("y").alias("py"), F.col("x").alias("px"), "cy", "cx", near).withColumns({"cy": F.col("cy") + F.col("o.a"), "cx": F.col("cx") + F.col("o.b")}).drop("o")
    d = detections.select("block_name", "time", "row_id", "y", "x").withColumns({"cy": cell("y"), "cx": cell("x")})
    m = p.join(d.hint("merge"), ["block_name", "time", "cy", "cx"]).withColumn("distance", norm(F.col("y") - F.col("py"), F.col("x") - F.col("px"))).where(F.col("distance") <= limit)
    w = W.partitionBy("gt_id", "block_name", "time").orderBy("distance", "row_id")
    m = m.withColumns({"k": F.row_number().over(w), "second": F.lead("distance").over(w)}).where("k = 1")
    best = m.select("gt_id", "block_name", "time", "row_id", "distance", F.col("second").alias("second_distance"), (F.col("second") - F.col("distance")).alias("margin"))
    best = best.withColumn("ambiguous", F.size(F.collect_set("gt_id").over(W.partitionBy("block_name", "time", "row_id"))) > 1)
    return points.select("gt_id", "block_name", "time").join(best.hint("merge"), ["gt_id", "block_name", "time"], "left")


def link_scores(matches: DataFrame) -> DataFrame:
    """Links of each true track's successive points, by the automatic tracks of their detections: +1, -1 or -2.

    matches has (gt_id, block_name, time, auto_track). Frames apart are skipped with a null score.
    """
    w = W.partitionBy("block_name", "gt_id").orderBy("time")
    m = matches.withColumns({"next_time": F.lead("time").over(w), "next_track": F.lead("auto_track").over(w)}).where("next_time IS NOT NULL")
    a, b = F.col("auto_track"), F.col("next_track")
    kind = F.when(F.col("next_time") - F.col("time") > 1, "skipped").when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "broken_missing").when(a == b, "correct").otherwise("wrong_link")
    m = m.withColumn("link_type", kind)
    score = F.when(F.col("link_type") == "correct", 1).when(F.col("link_type") == "wrong_link", -2).when(F.col("link_type") != "skipped", -1)
    return m.select("block_name", "gt_id", "time", "next_time", "link_type", score.alias("score"))


def link_summary(scores: DataFrame, *key: str) -> DataFrame:
    """Counts and score of links by grouping sets: all of each key prefix, and each of its members."""
    g = scores.rollup(*key).agg(F.count_if(F.col("link_type") == "correct").alias("n_correct"), F.count_if(F.col("link_type") == "wrong_link").alias("n_wrong"), F.count_if(F.col("link_type").isin("both_missing", "broken_missing")).alias("n_broken"), F.sum("score").alias("total"), F.count("score").alias("n_scored"), F.grouping_id().alias("level"))
    return g.withColumn("accuracy", F.when(F.col("n_scored") > 0, F.col("n_correct") / F.col("n_scored")))
