"""Regions: censoring before tracking, states and core events, region tables, per-subject summaries, thresholds, flips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.operators.voxels import inside_mask

#: Bins of the grey-level histogram, and the quantiles between which levels are scaled: fixed values.
LEVELS, LOW, HIGH = 256, 0.01, 0.998


def censored(rows: DataFrame, mask: DataFrame, key: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Rows outside a region: no flag is set, and the pixel of (y, x) is not in the mask."""
    free = reduce(lambda a, b: a & b, [~F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags], F.lit(True))
    return inside_mask(rows.where(free), mask, list(key)).where("NOT inside").drop("inside")


def must_be_outside(rows: DataFrame, mask: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, after a check that none of their pixels is in the mask."""
    if not inside_mask(rows, mask, list(key)).where("inside").isEmpty():
        raise ValueError("a row that should be outside the region is in its mask")
    return rows


def region_state(text: Column | None = None, inside: Sequence[Column] = (), near: Sequence[Column] = (), distance: Column | None = None, reach: float = 0.0) -> Column:
    """2 inside, 1 at the boundary, 0 outside, from a class text, flags, and a distance within reach."""
    no = F.lit(False)
    within = [F.coalesce(c.cast("boolean"), no) for c in inside]
    beside = [F.coalesce(c.cast("boolean"), no) for c in near]
    if text is not None:
        within.append(F.coalesce(F.lower(text).contains("inside"), no))
        beside.append(F.coalesce(F.lower(text).rlike("boundary|near"), no))
    if distance is not None:
        beside.append(F.coalesce(F.abs(distance) <= reach, no))
    any_ = lambda cs: reduce(lambda a, b: a | b, cs, no)
    return F.when(any_(within), 2).when(any_(beside), 1).otherwise(0)


def core_events(rows: DataFrame, key: Sequence[str], state: str) -> DataFrame:
    """Entries, exits, core entries and core exits of all tracks at each (block, time), where there are any."""
    before, now = F.lag(state).over(W.partitionBy(*key).orderBy("time")), F.col(state)
    kinds = {"entries": (before == 0) & (now >= 1), "exits": (before >= 1) & (now == 0), "core_entries": (before < 2) & (now == 2), "core_exits": (before == 2) & (now < 2)}
    e = rows.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in kinds.items()})
    g = e.groupBy(key[0], "time").agg(*[F.sum(k).alias(k) for k in kinds])
    return g.where("entries + exits + core_entries + core_exits > 0")


def region_tables(rows: DataFrame, state: str) -> dict[str, DataFrame]:
    """The three tables of flagged rows: all, those not inside, those outside only."""
    return {"all": rows, "outside_and_boundary": rows.where(F.col(state) < 2), "outside_only": rows.where(F.col(state) == 0)}


def subject_regions(tracks: DataFrame, subject: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Each subject's tracks, share ever inside, entries, exits, net flux, and mean and median of features."""
    aggs = [x for f in features for x in (F.avg(f).alias(f"mean_{f}"), F.median(f).alias(f"median_{f}"))]
    return tracks.groupBy(*subject).agg(
        F.count("*").alias("n_tracks"), F.avg((F.col("fraction_inside") > 0).cast("int")).alias("ever_inside_fraction"), F.sum("entries").alias("total_entries"), F.sum("exits").alias("total_exits"), (F.sum("entries") - F.sum("exits")).alias("net_flux"), *aggs
    )


def area_audit(mask: DataFrame, key: Sequence[str], height: int, width: int, xy_um: float) -> DataFrame:
    """Area of each mask in pixels, in square micrometres and as a share of the image, and where its centre lies."""
    n = F.count("*")
    return mask.groupBy(*key).agg(n.alias("area"), (n * (xy_um * xy_um)).alias("area_um2"), (n / float(height * width)).alias("share"), ((F.avg("y") + 0.5) / height).alias("centre_y"), ((F.avg("x") + 0.5) / width).alias("centre_x"))


def grouped_audit(audit: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return audit.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def scaled_levels(pixels: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Pixels with their level: the value between two quantiles of its image, in LEVELS steps."""
    q = pixels.groupBy(*key).agg(F.percentile(value, F.lit(LOW)).alias("_a"), F.percentile(value, F.lit(HIGH)).alias("_b"))
    share = F.when(F.col("_b") > F.col("_a"), F.least(F.greatest((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return pixels.join(q.hint("merge"), list(key)).withColumn("scaled", share).withColumn("level", F.least(F.floor(F.col("scaled") * LEVELS), F.lit(LEVELS - 1)).cast("int")).drop("_a", "_b")


def otsu(levels: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, threshold): the level that parts each image's histogram with the largest variance between both sides."""
    h = levels.groupBy(*key, "level").agg(F.count("*").alias("n"))
    upto, every = W.partitionBy(*key).orderBy("level").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*key)
    h = h.withColumns({"w": F.sum("n").over(upto), "m": F.sum(F.col("n") * F.col("level")).over(upto), "ww": F.sum("n").over(every), "mm": F.sum(F.col("n") * F.col("level")).over(every)})
    apart = F.col("m") / F.col("w") - (F.col("mm") - F.col("m")) / (F.col("ww") - F.col("w"))
    h = h.withColumn("between", F.when(F.col("ww") > F.col("w"), F.col("w") * (F.col("ww") - F.col("w")) * apart * apart).otherwise(-1.0))
    return h.groupBy(*key).agg(F.min_by("level", F.struct(-F.round("between", 6), "level")).alias("threshold"))


def body_mask(pixels: DataFrame, key: Sequence[str], value: str, share: float = 0.6) -> DataFrame:
    """Pixels whose scaled value is over a share of the image's threshold."""
    levels = scaled_levels(pixels, key, value)
    return levels.join(otsu(levels, key).hint("merge"), list(key)).where((F.col("level") + 0.5) > share * (F.col("threshold") + 0.5)).select(*key, "y", "x")


def flipped(pixels: DataFrame, flags: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Pixels turned in y and x where their block's flag says so; read from the source each time, so never twice."""
    p = pixels.join(flags.select(key, "flip").hint("merge"), key, "left").withColumn("flip", F.coalesce("flip", F.lit(False)))
    return p.withColumns({"y": F.when(F.col("flip"), height - 1 - F.col("y")).otherwise(F.col("y")), "x": F.when(F.col("flip"), width - 1 - F.col("x")).otherwise(F.col("x"))}).drop("flip")
