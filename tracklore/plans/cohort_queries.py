"""Queries over cohorts and statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import cohort as C
from tracklore.operators import stats as S
from tracklore.operators import tracks as T
from tracklore.plans.views import BIG, FISH, META, big_detections, fish_features, subjects, table


def _motion(spark, sf):
    m = T.motion(big_detections(spark, sf), 1.0, 1.0).select("block_name", "track_id", F.col("total_path_um").alias("total_path"), F.col("net_um").alias("net_displacement"), "max_speed", "directionality", F.col("n").alias("track_length"))
    v = T.value_summary(big_detections(spark, sf), "volume_voxels").select("block_name", "track_id", F.col("fold").alias("max_volume_fold"))
    return m.join(v, ["block_name", "track_id"]).withColumns({"max_step": F.col("max_speed"), "max_intensity_fold": F.col("max_volume_fold") / 2})


_MOTION = (
    BIG
    + """,
st AS (SELECT *, sqrt((centroid_x - lag(centroid_x) OVER w) ** 2 + (centroid_y - lag(centroid_y) OVER w) ** 2 + (centroid_z - lag(centroid_z) OVER w) ** 2) AS d3 FROM big WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
mo AS (SELECT block_name, track_id, coalesce(sum(d3), 0) AS total_path, max(d3) AS max_speed, max(d3) AS max_step, count(*) AS track_length,
  sqrt((arg_max(centroid_x, time) - arg_min(centroid_x, time)) ** 2 + (arg_max(centroid_y, time) - arg_min(centroid_y, time)) ** 2 + (arg_max(centroid_z, time) - arg_min(centroid_z, time)) ** 2) AS net_displacement,
  CASE WHEN count(*) >= 2 AND min(volume_voxels) > 0 THEN max(volume_voxels) / min(volume_voxels) END AS max_volume_fold FROM st GROUP BY block_name, track_id),
m AS (SELECT *, max_volume_fold / 2 AS max_intensity_fold, CASE WHEN total_path > 0 THEN net_displacement / total_path END AS directionality FROM mo),
lg AS (SELECT block_name, feature, value FROM m UNPIVOT (value FOR feature IN (max_step, max_speed, total_path, net_displacement, max_volume_fold, max_intensity_fold))),
lm AS (SELECT *, median(value) OVER (PARTITION BY block_name, feature) AS med FROM lg),
lt AS (SELECT block_name, feature, any_value(med) AS med, median(abs(value - med)) AS mad, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lm GROUP BY block_name, feature HAVING count(*) >= 8),
li AS (SELECT block_name, feature, CASE WHEN mad > 0 THEN med + 3 * 1.4826 * mad WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) END AS lim FROM lt)"""
)


def _tracks_long(spark, sf):
    m = _motion(spark, sf).join(subjects(spark, sf).select("block_name", "fish_id", "genotype"), "block_name")
    return C.unpivot(m, ["fish_id", "genotype"], ["total_path", "net_displacement", "directionality", "max_speed"])


_LONG = _MOTION + ",\n" + META + ",\nfl AS (SELECT fish_id, genotype, feature, value FROM (SELECT m.*, fish_id, genotype FROM m JOIN meta USING (block_name)) UNPIVOT INCLUDE NULLS (value FOR feature IN (total_path, net_displacement, directionality, max_speed)))"


def _flags(spark, sf):
    # a limit of 3 scaled deviations, as these tracks are short
    t = _motion(spark, sf)
    limits = C.robust_limits(C.unpivot(t, ["block_name"], C.LIMITED), "block_name", times=3.0)
    return t, limits


def _scored(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("source", "lang", F.col("quality").alias("truth"), ((F.col("n_chars") % 997) / 997.0).alias("score"))


_SCORED = "sc AS (SELECT source, lang, quality AS truth, (n_chars % 997) / 997.0 AS score FROM documents JOIN labels USING (doc_id))"


def _pairs(spark, sf):
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_acctbal").alias("value"), "c_mktsegment")
    b = c.where("c_custkey % 4 <> 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("value"))
    return a, b


def _model(spark):
    return spark.createDataFrame([("balance", 4000.0, 4500.0, 3000.0, 0.8), ("scaled", 9000.0, 12000.0, 9000.0, -0.3), ("rank_like", 50.0, 50.0, 29.0, 0.5), ("coarse", 3.0, 3.0, 2.0, -0.2)], "feature string, imputer_median double, scaler_mean double, scaler_scale double, coefficient double")


_MODEL = "mdl(feature, imputer_median, scaler_mean, scaler_scale, coefficient) AS (VALUES ('balance', 4000.0::DOUBLE, 4500.0::DOUBLE, 3000.0::DOUBLE, 0.8::DOUBLE), ('scaled', 9000.0, 12000.0, 9000.0, -0.3), ('rank_like', 50.0, 50.0, 29.0, 0.5), ('coarse', 3.0, 3.0, 2.0, -0.2))"


def _gappy(spark, sf):
    f = fish_features(spark, sf)
    return f.withColumn("value", F.when((F.col("subject") % 11 == 0) & (F.col("feature") == "scaled"), None).otherwise(F.col("value")))


_GAPPY = FISH + ", gap AS (SELECT subject, fish, genotype, feature, CASE WHEN subject % 11 = 0 AND feature = 'scaled' THEN NULL ELSE value END AS value FROM feat)"
_PARTS = _GAPPY + ", " + _MODEL + ", pt AS (SELECT subject, feature, value IS NULL AS missing, (coalesce(value, imputer_median) - scaler_mean) / scaler_scale AS z, (coalesce(value, imputer_median) - scaler_mean) / scaler_scale * coefficient AS contribution FROM gap JOIN mdl USING (feature))"


def _cohort_sets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("condition"), F.substring("p_type", 1, 12).alias("f"))
    return C.jaccard_sets(p.groupBy("condition").agg(F.collect_set("f").alias("features")))


def _selection(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.select((F.col("l_linenumber") % 5).alias("fold"), F.concat(F.lit("f"), (F.col("l_partkey") % 12).cast("string")).alias("feature"), (F.col("l_discount") - 0.05).alias("coefficient"))


QUERIES = {
    "robust_limits": lambda spark, sf: rounded(_flags(spark, sf)[1]),
    "outlier_flags": lambda spark, sf: rounded(C.outlier_flags(_motion(spark, sf), "block_name", volume_fold=30.0).select("block_name", "track_id", "qc_exclude", "qc_keep", "qc_reason", "qc_warning_volume", "qc_warning_intensity")),
    "tracks_after_qc": lambda spark, sf: C.without_tracks(big_detections(spark, sf), C.outlier_flags(_motion(spark, sf), "block_name"), ["block_name", "track_id"]).groupBy("block_name").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("n_tracks")),
    "subject_table": lambda spark, sf: rounded(C.subject_table(_tracks_long(spark, sf), "fish_id", "genotype"), 5),
    "subject_wide": lambda spark, sf: rounded(C.wide_subjects(_tracks_long(spark, sf), ["fish_id", "genotype"], ["total_path", "directionality"]), 5),
    "cohort_report": lambda spark, sf: C.cohort_report(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), "id"),
    "eligible_subjects": lambda spark, sf: rounded(C.eligible(fish_features(spark, sf), "fish", 240).select("subject", "fish", "feature", "value", "n_group", "included")),
    "usable_features": lambda spark, sf: C.usable_features(_gappy(spark, sf), 100),
    "upsert_last": lambda spark, sf: rounded(C.keep_last(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")),
    "joined_one_to_one": lambda spark, sf: rounded(C.join_one_to_one(*_pairs(spark, sf), "c_custkey")),
    "joined_many_to_one": lambda spark, sf: C.join_many_to_one(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, sf, "nation").select("n_nationkey", "n_name").where("n_nationkey % 4 <> 0"), "n_nationkey"),
    "outer_with_side": lambda spark, sf: rounded(C.outer_with_side(*[x.select("c_custkey", "value") for x in _pairs(spark, sf)], ["c_custkey"], ("_normal", "_strict"))),
    "common_features": lambda spark, sf: C.common_features(table(spark, sf, "part").select(F.col("p_brand").alias("source"), (F.col("p_size") % 20).cast("string").alias("feature")), "source", table(spark, sf, "part").select("p_brand").distinct().count()),
    "jaccard_of_sets": lambda spark, sf: rounded(_cohort_sets(spark, sf)),
    "effect_sizes": lambda spark, sf: rounded(S.effect_sizes(fish_features(spark, sf), "WT", "MUT"), 4),
    "top_effects": lambda spark, sf: S.top_features(S.effect_sizes(fish_features(spark, sf), "WT", "MUT"), 3).select("feature", "rank"),
    "benjamini_hochberg": lambda spark, sf: rounded(S.benjamini_hochberg(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 13 == 0, None).otherwise((F.col("c_custkey") * 7919 % 10007) / 10007.0).alias("p")), "p", "q", "c_mktsegment").select("c_custkey", "c_mktsegment", "q")),
    "spearman_matrix": lambda spark, sf: rounded(S.spearman(_gappy(spark, sf))),
    "variance_shares": lambda spark, sf: rounded(S.variance_shares(fish_features(spark, sf), "fish").select("feature", "k", "n_total", "icc", "eta_squared", "subject_effect")),
    "robust_z": lambda spark, sf: rounded(S.robust_z(fish_features(spark, sf)).select("subject", "feature", "z", "state")),
    "standardised": lambda spark, sf: rounded(S.standardised(_gappy(spark, sf)).select("subject", "feature", "z")),
    "classification_by_source": lambda spark, sf: rounded(S.classification(_scored(spark, sf), "source")),
    "roc_points": lambda spark, sf: rounded(S.roc(_scored(spark, sf))),
    "frozen_scores": lambda spark, sf: rounded(S.frozen_scores(_gappy(spark, sf), _model(spark), 0.1)[0]),
    "frozen_contributions": lambda spark, sf: rounded(S.frozen_scores(_gappy(spark, sf), _model(spark), 0.1)[1]),
    "frozen_compatibility": lambda spark, sf: rounded(S.compatibility(S.frozen_scores(_gappy(spark, sf), _model(spark), 0.1)[1])),
    "brown_forsythe": lambda spark, sf: rounded(S.brown_forsythe(fish_features(spark, sf), "genotype"), 4),
    "ellipses": lambda spark, sf: rounded(S.ellipses(table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y")), "p_brand", "x", "y"), 4),
    "subject_distances": lambda spark, sf: rounded(S.subject_distances(S.standardised(fish_features(spark, sf).groupBy(F.col("fish").alias("subject"), "feature").agg(F.avg("value").alias("value")))), 5),
    "exact_mean_difference": lambda spark, sf: rounded(S.exact_mean_difference(table(spark, sf, "customer").groupBy(F.concat_ws(" ", "c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("subject")).agg(F.avg("c_acctbal").alias("value")).withColumn("in_a", F.col("subject") < "F"), 6)),
    "feature_stability": lambda spark, sf: rounded(S.stable_features(_selection(spark, sf), 0.8, 12), nudge=1.3e-9),
}

ORACLE_SQL = {
    "robust_limits": f"WITH {_MOTION} SELECT block_name, feature, round(lim, 6) AS robust_upper_threshold FROM li WHERE lim IS NOT NULL",
    "outlier_flags": f"""WITH {_MOTION.replace("3 * 1.4826", "6 * 1.4826")},
w AS (SELECT block_name, {", ".join(f"max(CASE WHEN feature = '{f}' THEN lim END) AS l_{f}" for f in C.LIMITED)} FROM li GROUP BY block_name),
o AS (SELECT m.*, coalesce(track_length < 10 OR directionality > 0.85, false) AS strong, {", ".join(f"coalesce({f} > l_{f} AND track_length >= 5, false) AS o_{f}" for f in C.LIMITED)} FROM m LEFT JOIN w USING (block_name)),
e AS (SELECT *, o_max_step OR o_max_speed OR o_total_path AND strong OR o_net_displacement AND strong AS bad FROM o)
SELECT block_name, track_id, bad AS qc_exclude, NOT bad AS qc_keep, concat_ws('; ', CASE WHEN o_max_step THEN 'max_step>limit' END, CASE WHEN o_max_speed THEN 'max_speed>limit' END, CASE WHEN o_total_path AND strong THEN 'total_path>limit_short_or_direct' END,
  CASE WHEN o_net_displacement AND strong THEN 'net_displacement>limit_short_or_direct' END, CASE WHEN max_volume_fold > 30 THEN 'volume_fold_change' END, CASE WHEN o_max_volume_fold THEN 'max_volume_fold>limit_warning' END,
  CASE WHEN o_max_intensity_fold THEN 'max_intensity_fold>limit_warning' END) AS qc_reason, o_max_volume_fold AS qc_warning_volume, o_max_intensity_fold AS qc_warning_intensity FROM e""",
    "tracks_after_qc": f"""WITH {_MOTION.replace("3 * 1.4826", "6 * 1.4826")},
x AS (SELECT m.block_name, m.track_id FROM m JOIN li USING (block_name) WHERE track_length >= 5 AND (feature = 'max_step' AND max_step > lim OR feature = 'max_speed' AND max_speed > lim OR (track_length < 10 OR directionality > 0.85) AND (feature = 'total_path' AND total_path > lim OR feature = 'net_displacement' AND net_displacement > lim)))
SELECT block_name, count(*) AS n, count(DISTINCT track_id) AS n_tracks FROM big ANTI JOIN x USING (block_name, track_id) GROUP BY block_name""",
    "subject_table": f"""WITH {_LONG}, g AS (SELECT fish_id, genotype, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_pop(value) AS sd_pop, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM fl GROUP BY ALL)
SELECT fish_id, genotype, feature, n, {", ".join(f"round({c}, 5) + 0 AS {c}" for c in ("mean", "sd", "sd_pop", "q25", "median", "q75"))}, round(q75 - q25, 5) AS iqr, round(CASE WHEN n >= 2 AND mean <> 0 THEN sd / abs(mean) END, 5) AS cv_sample, round(CASE WHEN mean <> 0 THEN sd_pop / mean END, 5) AS cv_population FROM g""",
    "subject_wide": f"""WITH {_LONG} SELECT fish_id, genotype, {", ".join(f"round(avg(value) FILTER (feature = '{f}'), 5) AS fish_mean__{f}, round(median(value) FILTER (feature = '{f}'), 5) AS fish_median__{f}, count(value) FILTER (feature = '{f}') AS n_nonmissing__{f}" for f in ("total_path", "directionality"))} FROM fl GROUP BY fish_id, genotype""",
    "cohort_report": "SELECT coalesce(a, b) AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'retained' WHEN a IS NOT NULL THEN 'not_in_metadata' ELSE 'missing_from_table' END AS status FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_custkey % 2 = 0) ON a = b",
    "eligible_subjects": f"WITH {FISH} SELECT subject, fish, feature, round(value, 6) AS value, count(*) OVER (PARTITION BY fish, feature) AS n_group, count(*) OVER (PARTITION BY fish, feature) >= 240 AS included FROM feat",
    "usable_features": f"WITH {_GAPPY} SELECT feature, count(value) AS n_nonmissing, count(DISTINCT value) AS n_unique, count(*) AS n, count(value) >= 100 AND count(DISTINCT value) >= 2 AS usable FROM gap GROUP BY feature",
    "upsert_last": "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "joined_one_to_one": "SELECT c_custkey, c_mktsegment, round(c_acctbal * 2, 6) AS value FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0",
    "joined_many_to_one": "SELECT c_custkey, c_nationkey AS n_nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey",
    "outer_with_side": "SELECT c_custkey, round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 6) AS value_normal, round(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal * 2 END, 6) AS value_strict, CASE WHEN c_custkey % 3 = 0 THEN 'right_only' WHEN c_custkey % 4 = 0 THEN 'left_only' ELSE 'both' END AS side FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0",
    "common_features": "SELECT (p_size % 20)::VARCHAR AS feature FROM part GROUP BY p_size % 20 HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)",
    "jaccard_of_sets": """WITH s AS (SELECT DISTINCT p_brand AS c, substring(p_type, 1, 12) AS f FROM part), l AS (SELECT c, list(f) AS fs FROM s GROUP BY c),
p AS (SELECT x.c AS a, y.c AS b, list_sort(list_intersect(x.fs, y.fs)) AS i, list_sort(list_filter(x.fs, lambda v: NOT list_contains(y.fs, v))) AS oa, list_sort(list_filter(y.fs, lambda v: NOT list_contains(x.fs, v))) AS ob FROM l x JOIN l y ON x.c < y.c)
SELECT a, b, array_to_string(i, '|') AS shared, array_to_string(oa, '|') AS only_a, array_to_string(ob, '|') AS only_b, round(len(i) / (len(i) + len(oa) + len(ob)), 6) AS jaccard FROM p""",
    "benjamini_hochberg": """WITH p AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey * 7919 % 10007) / 10007.0 END AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT c_custkey, least(1, min(p * m / k) OVER (PARTITION BY c_mktsegment ORDER BY k DESC)) AS q FROM r)
SELECT p.c_custkey, c_mktsegment, round(q, 6) AS q FROM p LEFT JOIN q ON q.c_custkey = p.c_custkey""",
    "spearman_matrix": f"""WITH {_GAPPY}, p AS (SELECT a.feature AS fa, b.feature AS fb, a.value AS va, b.value AS vb FROM gap a JOIN gap b ON a.subject = b.subject AND a.feature < b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
r AS (SELECT fa, fb, rank() OVER (PARTITION BY fa, fb ORDER BY va) + (count(*) OVER (PARTITION BY fa, fb, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY fa, fb ORDER BY vb) + (count(*) OVER (PARTITION BY fa, fb, vb) - 1) / 2.0 AS rb FROM p)
SELECT fa AS feature_a, fb AS feature_b, count(*) AS n, round(corr(ra, rb), 6) + 0 AS rho FROM r GROUP BY fa, fb""",
    "variance_shares": f"""WITH {FISH}, g AS (SELECT feature, fish, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM feat GROUP BY ALL), t AS (SELECT feature, avg(value) AS gm FROM feat GROUP BY feature),
u AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n_total, sum(n * (m - gm) ** 2) AS b, sum(n * s) AS w FROM g JOIN t USING (feature) GROUP BY feature),
i AS (SELECT *, (b / (k - 1) - w / (n_total - k)) / (b / (k - 1) + (n_total / k - 1) * w / (n_total - k)) AS icc FROM u)
SELECT feature, k, n_total, round(icc, 6) + 0 AS icc, round(b / (b + w), 6) AS eta_squared, CASE WHEN icc >= 0.5 THEN 'strong' WHEN icc >= 0.1 THEN 'moderate' ELSE 'weak' END AS subject_effect FROM i""",
    "robust_z": f"""WITH {FISH}, s AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.333) AS t1, quantile_cont(value, 0.667) AS t2, stddev_samp(value) AS sd FROM feat GROUP BY feature)
SELECT subject, feature, round((value - med) / CASE WHEN q3 > q1 THEN q3 - q1 WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0 AS z, CASE WHEN value <= t1 THEN 'low' WHEN value <= t2 THEN 'middle' ELSE 'high' END AS state FROM feat JOIN s USING (feature)""",
    "standardised": f"""WITH {_GAPPY}, m AS (SELECT feature, median(value) AS med FROM gap GROUP BY feature), v AS (SELECT subject, feature, coalesce(value, med) AS value FROM gap JOIN m USING (feature)), s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM v GROUP BY feature)
SELECT subject, feature, round(CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END, 6) + 0 AS z FROM v JOIN s USING (feature)""",
    "classification_by_source": f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM sc),
g AS (SELECT source, count(*) FILTER (truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (truth = 1 AND score < 0.5) AS fn, count(*) FILTER (truth = 0 AND score >= 0.5) AS fp, count(*) FILTER (truth = 0 AND score < 0.5) AS tn, sum(r) FILTER (truth = 1) AS s FROM r GROUP BY source)
SELECT source, tp, fn, fp, tn, round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (tp / (tp + fn) + tn / (fp + tn)) / 2 END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (s - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)) END, 6) AS auc FROM g""",
    "roc_points": f"""WITH {_SCORED}, g AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM sc GROUP BY score)
SELECT round(score, 6) AS threshold, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) AS fpr FROM g""",
    "frozen_scores": f"WITH {_PARTS}, s AS (SELECT subject, sum(contribution) + 0.1 AS margin FROM pt GROUP BY subject) SELECT subject, round(margin, 6) + 0 AS margin, round(1 / (1 + exp(-margin)), 6) AS probability, (margin >= 0)::INT AS predicted FROM s",
    "frozen_contributions": f"WITH {_PARTS} SELECT subject, feature, missing, round(z, 6) + 0 AS z, round(contribution, 6) + 0 AS contribution FROM pt",
    "frozen_compatibility": f"WITH {_PARTS} SELECT feature, count(*) FILTER (missing) AS n_missing, round(avg(missing::INT), 6) AS share_missing, round(min(z), 6) + 0 AS min_z, round(max(z), 6) + 0 AS max_z, count(*) FILTER (abs(z) > 3) AS n_far FROM pt GROUP BY feature",
    "brown_forsythe": f"""WITH {FISH}, d AS (SELECT feature, genotype, abs(value - median(value) OVER (PARTITION BY feature, genotype)) AS d FROM feat), g AS (SELECT feature, genotype, count(*) AS n, avg(d) AS m, var_pop(d) AS s FROM d GROUP BY ALL), t AS (SELECT feature, avg(d) AS gm FROM d GROUP BY feature)
SELECT feature, count(*) AS k, sum(n)::BIGINT AS n_total, round(sum(n * (m - gm) ** 2) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))), 4) AS f FROM g JOIN t USING (feature) GROUP BY feature""",
    "ellipses": """WITH g AS (SELECT p_brand, avg(p_size) AS mx, avg(p_retailprice / 100) AS my, var_samp(p_size) AS a, var_samp(p_retailprice / 100) AS c, covar_samp(p_size, p_retailprice / 100) AS b FROM part GROUP BY p_brand)
SELECT p_brand, round(mx, 4) AS mx, round(my, 4) AS my, round(sqrt(5.991464547107979 * ((a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b))), 4) AS major, round(sqrt(5.991464547107979 * greatest((a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b), 0)), 4) AS minor, round(atan2(2 * b, a - c) / 2, 4) + 0 AS angle FROM g""",
    "subject_distances": f"""WITH {FISH}, v AS (SELECT fish AS subject, feature, avg(value) AS value FROM feat GROUP BY ALL), s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM v GROUP BY feature), z AS (SELECT subject, feature, CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END AS z FROM v JOIN s USING (feature))
SELECT x.subject AS a, y.subject AS b, round(sqrt(sum((x.z - y.z) ** 2)), 5) AS distance FROM z x JOIN z y ON x.feature = y.feature AND x.subject < y.subject GROUP BY ALL""",
    "exact_mean_difference": """WITH g AS (SELECT c_mktsegment || ' ' || c_nationkey % 3 AS k, avg(c_acctbal) AS v FROM customer GROUP BY ALL), s AS (SELECT k, k < 'F' AS in_a, v, (row_number() OVER (ORDER BY k) - 1)::INT AS bit FROM g),
e AS (SELECT id, avg(v) FILTER ((id >> bit) & 1 = 1) - avg(v) FILTER ((id >> bit) & 1 = 0) AS d FROM (SELECT unnest(range(0, 32768)) AS id) JOIN s ON true WHERE bit_count(id) = 6 GROUP BY id),
o AS (SELECT avg(v) FILTER (in_a) - avg(v) FILTER (NOT in_a) AS observed FROM s)
SELECT round(any_value(observed), 6) + 0 AS observed, count(*) AS n_assignments, round(count(*) FILTER (abs(d) >= abs(observed) - 1e-12) / count(*), 6) AS p FROM e, o""",
    "feature_stability": """WITH x AS (SELECT l_linenumber % 5 AS fold, 'f' || l_partkey % 12 AS feature, l_discount - 0.05 AS c FROM lineitem),
g AS (SELECT feature, count(DISTINCT fold) / (SELECT count(DISTINCT fold) FROM x) AS frequency, avg(abs(c)) AS ma, avg(c) AS mean_signed FROM x GROUP BY feature),
r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, round(ma, 9) DESC, feature) AS rank FROM g), h AS (SELECT max((frequency >= 0.8)::INT) AS any_one FROM g)
SELECT feature, round(frequency, 6) AS frequency, round(ma + 1.3e-9, 6) AS mean_absolute, round(mean_signed + 1.3e-9, 6) + 0 AS mean_signed, rank, CASE WHEN any_one = 1 THEN frequency >= 0.8 ELSE rank <= 2 END AS selected FROM r, h WHERE rank <= 12""",
}

_EFFECT = """r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM feat),
g AS (SELECT feature, count(*) FILTER (genotype = 'WT') AS n_a, count(*) FILTER (genotype = 'MUT') AS n_b, median(value) FILTER (genotype = 'WT') AS median_a, median(value) FILTER (genotype = 'MUT') AS median_b, sum(r) FILTER (genotype = 'MUT') AS s, sum(t * t - 1)::DOUBLE AS ts FROM r GROUP BY feature),
u AS (SELECT *, s - n_b * (n_b + 1) / 2 AS u, sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ts / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS sd FROM g),
x AS (SELECT *, 2 * u / (n_a * n_b) - 1 AS cliffs_delta, abs((abs(u - n_a * n_b / 2) - 0.5) / sd) / sqrt(2.0) AS x FROM u),
y AS (SELECT *, 1 / (1 + 0.3275911 * x) AS k FROM x),
z AS (SELECT *, least(1, ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-x * x)) AS p FROM y),
w AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM z)"""
ORACLE_SQL["effect_sizes"] = f"""WITH {FISH}, {_EFFECT}
SELECT feature, n_a, n_b, round(median_a, 4) AS median_a, round(median_b, 4) AS median_b, round(median_b - median_a, 4) + 0 AS difference, round(u, 4) AS u, round(cliffs_delta, 4) + 0 AS cliffs_delta, round(p, 4) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i DESC)), 4) AS q FROM w"""
ORACLE_SQL["top_effects"] = f"WITH {FISH}, {_EFFECT}, t AS (SELECT feature, row_number() OVER (ORDER BY abs(cliffs_delta) DESC, feature) AS rank FROM w) SELECT feature, rank FROM t WHERE rank <= 3"
