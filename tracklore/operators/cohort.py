"""Outlier limits, subject tables, cohort checks and merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.functions.scalar import MAD_SCALE
from tracklore.operators.lineage import kept

#: Features that get a limit per subject; fixed values.
LIMITED = ["max_step", "max_speed", "total_path", "net_displacement", "max_volume_fold", "max_intensity_fold"]


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value) of wide features."""
    return df.unpivot(list(ids), list(features), "feature", "value")


def robust_limits(long: DataFrame, group: str, least: int = 8, times: float = 6.0) -> DataFrame:
    """Upper limit of each group and feature: median and times the scaled MAD; where that is 0, Q3 and 3 IQR; else none."""
    v = long.where(F.col("value").isNotNull())
    middle = v.groupBy(group, "feature").agg(F.median("value").alias("med"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"), F.count("*").alias("n")).where(F.col("n") >= least)
    spread = v.join(middle.hint("merge"), [group, "feature"]).groupBy(group, "feature").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.first("med").alias("med"), F.first("q1").alias("q1"), F.first("q3").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    limit = F.when(F.col("mad") > 0, F.col("med") + times * MAD_SCALE * F.col("mad")).when(iqr > 0, F.col("q3") + 3.0 * iqr)
    return spread.select(group, "feature", limit.alias("robust_upper_threshold")).where("robust_upper_threshold IS NOT NULL")


def outlier_flags(tracks: DataFrame, group: str, features: Sequence[str] = LIMITED, min_length: int = 5, hard_step: float | None = None, volume_fold: float | None = None) -> DataFrame:
    """Tracks with qc_exclude, qc_keep, warnings and reasons, from hard caps and each subject's robust limits.

    Steps and speeds over the limit exclude; paths and displacements only with a short track or a straight one; folds
    only warn. Limits are one row per subject, joined by hash on the subject.
    """
    tracks = kept(tracks)  # limits, and the tracks that meet them, are of one computation
    limits = robust_limits(unpivot(tracks, [group], features), group)
    wide = limits.groupBy(group).pivot("feature", list(features)).agg(F.first("robust_upper_threshold"))
    t = tracks.join(wide.hint("merge").select(group, *[F.col(f).alias(f"limit_{f}") for f in features]), group, "left")
    over = {f: F.coalesce((F.col(f) > F.col(f"limit_{f}")) & (F.col("track_length") >= min_length), F.lit(False)) for f in features}
    strong = F.coalesce((F.col("track_length") < 10) | (F.col("directionality") > 0.85), F.lit(False))
    no = F.lit(False)
    exclude: list[tuple[Column, str]] = []
    warn: list[tuple[Column, str]] = []
    if hard_step is not None:
        exclude.append((F.coalesce(F.col("max_step") > hard_step, no), "hard_max_step"))
    if volume_fold is not None:
        warn.append((F.coalesce(F.col("max_volume_fold") > volume_fold, no), "volume_fold_change"))
    for f in features:
        if f in ("total_path", "net_displacement"):
            exclude.append((over[f] & strong, f"{f}>limit_short_or_direct"))
        elif f.endswith("_fold"):
            warn.append((over[f], f"{f}>limit_warning"))
        else:
            exclude.append((over[f], f"{f}>limit"))
    bad = reduce(lambda a, b: a | b, [c for c, _ in exclude])
    why = F.concat_ws("; ", *[F.when(c, F.lit(r)) for c, r in exclude + warn])
    flagged = {"qc_exclude": bad, "qc_keep": ~bad, "qc_reason": why, "qc_warning_volume": over.get("max_volume_fold", no), "qc_warning_intensity": over.get("max_intensity_fold", no)}
    return t.withColumns(flagged).drop(*[f"limit_{f}" for f in features])


def without_tracks(detections: DataFrame, flagged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Detections of tracks that are not excluded."""
    return detections.join(flagged.where("qc_exclude").select(*key), list(key), "left_anti")


def subject_table(long: DataFrame, *ids: str) -> DataFrame:
    """Distribution of each feature in each subject, in one aggregation."""
    v = F.col("value")
    q = [F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    g = long.groupBy(*ids, "feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_pop"), *q)
    return g.withColumns(
        {
            "iqr": F.col("q75") - F.col("q25"),
            "cv_sample": F.when((F.col("n") >= 2) & (F.col("mean") != 0), F.col("sd") / F.abs("mean")),
            "cv_population": F.when(F.col("mean") != 0, F.col("sd_pop") / F.col("mean")),
        }
    )


def wide_subjects(long: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per subject with fish_mean__f, fish_median__f and n_nonmissing__f: one wide aggregation."""
    aggs = []
    for f in features:
        own = F.when(F.col("feature") == f, F.col("value"))
        aggs += [F.avg(own).alias(f"fish_mean__{f}"), F.median(own).alias(f"fish_median__{f}"), F.count(own).alias(f"n_nonmissing__{f}")]
    return long.groupBy(*ids).agg(*aggs)


def cohort_report(table: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Each id with the side that has it: both, only the table, only the metadata."""
    a = table.select(key).distinct().withColumn("in_table", F.lit(True))
    b = metadata.select(key).distinct().withColumn("in_metadata", F.lit(True))
    status = F.when(F.col("in_table") & F.col("in_metadata"), "retained").when(F.col("in_table"), "not_in_metadata").otherwise("missing_from_table")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def eligible(subjects: DataFrame, group: str, least: int) -> DataFrame:
    """Subjects with whether their group and feature have enough of them."""
    return subjects.withColumn("n_group", F.count("*").over(W.partitionBy(group, "feature"))).withColumn("included", F.col("n_group") >= least)


def usable_features(long: DataFrame, least: int) -> DataFrame:
    """Features with how many values and how many different ones, and whether that suffices."""
    g = long.groupBy("feature").agg(F.count("value").alias("n_nonmissing"), F.count_distinct("value").alias("n_unique"), F.count("*").alias("n"))
    return g.withColumn("usable", (F.col("n_nonmissing") >= least) & (F.col("n_unique") >= 2))


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key: an upsert of appended rows."""
    w = W.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def must_be_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, after a check that no key repeats."""
    twice = df.groupBy(*key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys repeat: {[tuple(r)[:-1] for r in twice]}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """A left join on a right side checked to have each key once."""
    return left.join(must_be_unique(right, *key), list(key), "left")


def join_one_to_one(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """An inner join of two checked sides; columns of the right replace those of the left."""
    same = [c for c in right.columns if c in left.columns and c not in key]
    return must_be_unique(left, *key).drop(*same).join(must_be_unique(right, *key), list(key))


def outer_with_side(left: DataFrame, right: DataFrame, key: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """A full outer join with suffixes and the side each row comes from."""
    l = left.select(*key, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in key], F.lit(1).alias("_l"))
    r = right.select(*key, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in key], F.lit(1).alias("_r"))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return l.join(r, list(key), "full_outer").withColumn("side", side).drop("_l", "_r")


def common_features(tables: DataFrame, source: str, n: int) -> DataFrame:
    """Features that all n sources have."""
    return tables.groupBy("feature").agg(F.count_distinct(source).alias("n")).where(F.col("n") == n).select("feature")


#: Conditions whose sets are compared with each other, at most.
CONDITIONS = 1_000


def jaccard_sets(sets: DataFrame) -> DataFrame:
    """Overlap of each two conditions' feature sets (condition, features), which are few: over CONDITIONS are refused."""
    if sets.count() > CONDITIONS:
        raise ValueError(f"more than {CONDITIONS} conditions")
    a, b = sets.toDF("a", "fa"), sets.toDF("b", "fb")
    both, any_ = F.array_intersect("fa", "fb"), F.array_union("fa", "fb")
    pairs = a.join(b.hint("broadcast"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.concat_ws("|", F.array_sort(both)).alias("shared"), F.concat_ws("|", F.array_sort(F.array_except("fa", "fb"))).alias("only_a"), F.concat_ws("|", F.array_sort(F.array_except("fb", "fa"))).alias("only_b"), (F.size(both) / F.size(any_)).alias("jaccard"))
