"""Queries over regions and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import column_flags, group_in_name, group_name, normalise_id, number, parse_bool, rounded, safe_name
from tracklore.operators import regions as G
from tracklore.operators import reports as P
from tracklore.operators import tracks as T
from tracklore.plans import cohort_queries as CQ
from tracklore.plans import track_queries as TQ
from tracklore.plans.views import BIG, DET, FISH, FRM, META, VOX, big_detections, block_frames, detections, fish_features, subjects, table, voxels

KEY = ["block_name", "track_id"]
FRAME = ["block", "t"]


def _objects(spark, sf):
    g = voxels(spark, sf).groupBy("block", "t", "label").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("n"), (F.max("intensity") > 100_000).alias("overlapping"))
    return g


def _mask(spark, sf):
    return voxels(spark, sf).where("intensity > 75000").select(*FRAME, "y", "x").distinct()


_OBJ = VOX + """, px AS (SELECT DISTINCT block, t, y, x FROM vox WHERE intensity > 75000), ob AS (SELECT block, t, label, avg(y) AS y, avg(x) AS x, count(*) AS n, max(intensity) > 100000 AS overlapping FROM vox GROUP BY ALL),
rd AS (SELECT *, (CASE WHEN y - floor(y) = 0.5 THEN 2 * floor((floor(y) + 1) / 2) ELSE floor(y + 0.5) END)::INT AS ry, (CASE WHEN x - floor(x) = 0.5 THEN 2 * floor((floor(x) + 1) / 2) ELSE floor(x + 0.5) END)::INT AS rx FROM ob)"""  # fmt: skip


def _states(spark, sf):
    b = big_detections(spark, sf)
    text = F.when(F.col("centroid_z") == 7, "Inside core").when(F.col("centroid_z") == 6, "near it").when(F.col("centroid_z") == 5, "boundary")
    state = G.region_state(text, inside=[F.col("mean_intensity") > 9], near=[F.col("mean_intensity").cast("string") == "1"], distance=F.col("centroid_y") - 25, reach=4.0)
    return b.withColumn("state", state)


_STATES = BIG + """, st AS (SELECT *, CASE WHEN centroid_z = 7 OR mean_intensity > 9 THEN 2 WHEN centroid_z IN (5, 6) OR abs(centroid_y - 25) <= 4 THEN 1 ELSE 0 END AS state FROM big)"""


def _regions(spark, sf):
    s = _states(spark, sf).withColumn("block", F.col("block_name"))
    from tracklore.operators.series import crossings

    c = crossings(s, KEY, F.col("state") == 2).groupBy(*KEY).agg(F.avg(F.col("inside").cast("int")).alias("fraction_inside"), F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"), F.avg("volume_voxels").alias("volume"))
    return c


def _elapsed(spark, sf):
    b = big_detections(spark, sf).join(F.broadcast(subjects(spark, sf).select("block_name", "fish_id", "genotype", "time_interval_seconds")), "block_name")
    return b.select(*KEY, "fish_id", "genotype", (F.col("time") * F.col("time_interval_seconds") / 60.0).alias("elapsed"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("centroid_z").alias("z"))


_ELAPSED = BIG + ",\n" + META + """, el AS (SELECT block_name, track_id, fish_id, genotype, time * time_interval_seconds / 60.0 AS elapsed, centroid_x AS x, centroid_y AS y, centroid_z AS z FROM big JOIN meta USING (block_name)),
sq AS (SELECT *, (x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2 + (z - first_value(z) OVER w) ** 2 AS squared, elapsed / 30.0 AS q, count(*) OVER (PARTITION BY block_name, track_id) AS c FROM el WINDOW w AS (PARTITION BY block_name, track_id ORDER BY elapsed)),
mb AS (SELECT *, (CASE WHEN q - floor(q) = 0.5 THEN 2 * floor((floor(q) + 1) / 2) ELSE floor(q + 0.5) END) * 30.0 AS minutes FROM sq WHERE c >= 2)"""  # fmt: skip


def _strict(spark, sf):
    f = fish_features(spark, sf).select("subject", "genotype", "feature", "value")
    return f, f.withColumn("value", F.when(F.col("subject") % 9 == 0, None).otherwise(F.col("value") * (1 + (F.col("subject") % 5) / 50)))


_STRICT = FISH + ", sf AS (SELECT subject, genotype, feature, value, CASE WHEN subject % 9 = 0 THEN NULL ELSE value * (1 + (subject % 5) / 50) END AS strict FROM feat)"


def _morph(spark, sf):
    return big_detections(spark, sf).join(F.broadcast(subjects(spark, sf).select("block_name", "genotype", "condition")), "block_name")


_MORPH = BIG + ",\n" + META + ", mo AS (SELECT big.*, genotype, condition FROM big JOIN meta USING (block_name))"


def _tertiles(spark, sf):
    e = _morph(spark, sf).groupBy(*KEY, "genotype").agg(F.min_by("volume_voxels", "time").alias("a"), F.max_by("volume_voxels", "time").alias("b"))
    name = lambda c: F.when(F.col(c) <= 17, "small").when(F.col(c) >= 34, "large").otherwise("middle")
    return e.select("genotype", name("a").alias("start_state"), name("b").alias("end_state"))


def _folds(spark, sf):
    """Five folds of customers, each feature a row, one feature a near copy of another and one constant."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("fold"), "c_acctbal", "c_nationkey").where("subject % 3 <> fold")
    v = {"balance": F.col("c_acctbal"), "balance_again": F.when(F.col("subject") % 10 != 1, F.col("c_acctbal") * 2 + 1), "nation": F.col("c_nationkey").cast("double"), "same": F.lit(4.0), "sparse": F.when(F.col("subject") % 5 == 0, F.col("c_acctbal"))}
    return c.select("fold", "subject", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), x.cast("double").alias("value")) for k, x in v.items()])).alias("p")).select("fold", "subject", "p.*")


def _contributions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("feature"), F.when(F.col("o_custkey") % 2 == 0, "treated").otherwise("untreated").alias("condition"), F.when(F.col("o_custkey") % 3 == 0, "MUT").otherwise("WT").alias("genotype"), (F.col("o_totalprice") / 1000).alias("value"))


_CONTR = "co AS (SELECT o_orderpriority AS feature, CASE WHEN o_custkey % 2 = 0 THEN 'treated' ELSE 'untreated' END AS condition, CASE WHEN o_custkey % 3 = 0 THEN 'MUT' ELSE 'WT' END AS genotype, o_totalprice / 1000 AS value FROM orders)"


def _paths(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(F.lit("data/"), F.element_at(F.array(F.lit("WT"), F.lit("mut"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("/Fish_"), F.col("p_size").cast("string"), F.lit(" 2024"), F.format_string("%02d%02d", (F.col("p_partkey") % 12 + 1).cast("int"), (F.col("p_partkey") % 28 + 1).cast("int")), F.lit("_block"), (F.col("p_partkey") % 9).cast("string"), F.lit(".tif")).alias("path"))


def _odd_scalars(spark, sf):
    """Texts that reach every branch of the readers, one for each order."""
    o = table(spark, sf, "orders")
    pick = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    flag, num = pick(["True", " yes ", "Y", "0", "1.0", "-2", "t", "no", "", "2", "1", "NaN"]), pick(["12.5", "abc", "NaN", "inf", "-3", " 7 ", ""])
    group, id_ = pick(["WT", "wild type 2", "Mutant", "growth", "control", "TERT", "Unknown", " het ", "tert-/-", "wild-type", "Line WT-MUT", "wt_1 wildtype"]), pick(["91", "91.0", " 91 ", "a7", "0.5", "-3.0"])
    o = column_flags(column_flags(o.withColumns({"_n": flag, "_w": pick(["True", " yes ", "Y", "t", "no"])}), "_n", "by_numbers"), "_w", "by_words")
    flags = {"flag": parse_bool(flag), "words_only": parse_bool(flag, numbers=False), "words_t": parse_bool(flag, "with_t", numbers=False), "flag_t": parse_bool(flag, "with_t"), "positive": parse_bool(flag, positive_only=True)}
    groups = {"group": group_name(group), "group_m": group_name(group, "mutant_first"), "group_e": group_name(group, "exact"), "group_in_name": group_in_name(group), "safe_name": safe_name(F.concat(F.lit("  "), group, F.lit("&& x.1_")))}
    return o.select("o_orderkey", "by_numbers", "by_words", number(num).alias("number"), normalise_id(id_).alias("id"), *[c.alias(n) for n, c in (flags | groups).items()])


QUERIES = {
    "censored_objects": lambda spark, sf: rounded(G.must_be_outside(G.censored(_objects(spark, sf), _mask(spark, sf), FRAME, ["overlapping"]), _mask(spark, sf), FRAME)),
    "region_states": lambda spark, sf: _states(spark, sf).select(*KEY, "time", "state"),
    "core_events": lambda spark, sf: G.core_events(_states(spark, sf), KEY, "state"),
    "region_table_counts": lambda spark, sf: _union([t.groupBy(F.lit(n).alias("name"), "block_name").agg(F.count("*").alias("n")) for n, t in G.region_tables(_states(spark, sf), "state").items()]),
    "subject_regions": lambda spark, sf: rounded(G.subject_regions(_regions(spark, sf), ["block_name"], ["volume", "fraction_inside"])),
    "mask_areas": lambda spark, sf: rounded(G.area_audit(_mask(spark, sf), FRAME, 8, 8, 0.5)),
    "mask_areas_by_block": lambda spark, sf: rounded(G.grouped_audit(G.area_audit(_mask(spark, sf), FRAME, 8, 8, 0.5), ["block"], "share")),
    "grey_thresholds": lambda spark, sf: G.otsu(G.scaled_levels(voxels(spark, sf), ["block"], "intensity"), ["block"]),
    "body_mask": lambda spark, sf: G.body_mask(voxels(spark, sf).groupBy("block", "y", "x").agg(F.max("intensity").alias("intensity")), ["block"], "intensity", 0.9),
    "flipped_pixels": lambda spark, sf: G.flipped(_mask(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("block"), (F.col("s_suppkey") % 2 == 0).alias("flip")).where("block % 5 <> 0"), "block", 8, 8),
    "motility_classes": lambda spark, sf: P.motility(T.motion(detections(spark, sf), 0.004, 0.05), "n", "total_path_um", "net_um", "moving_fraction").select(*KEY, "motility_class", "static_exclude", "static_reason"),
    "clean_exclusions": lambda spark, sf: P.exclusion(T.split_merge(big_detections(spark, sf)), strict=False).select(*KEY, "step_spike_only", "exclusion_reason", "excluded"),
    "strict_exclusions": lambda spark, sf: P.exclusion(T.split_merge(big_detections(spark, sf)), strict=True).select(*KEY, "exclusion_reason", "excluded"),
    "reason_counts": lambda spark, sf: P.reason_counts(T.split_merge(big_detections(spark, sf)), "split_merge_reason"),
    "features_over_time": lambda spark, sf: rounded(P.features_over_time(big_detections(spark, sf), ["volume_voxels", "mean_intensity", "centroid_z"]), 5),
    "step_angles": lambda spark, sf: rounded(P.step_angles(big_detections(spark, sf)), 4),
    "elapsed_msd": lambda spark, sf: rounded(P.elapsed_msd(_elapsed(spark, sf), 30.0, "genotype"), 4),
    "elapsed_msd_by_subject": lambda spark, sf: rounded(P.by_subject(P.elapsed_msd(_elapsed(spark, sf), 30.0, "genotype", "fish_id"), "genotype"), 4),
    "track_durations": lambda spark, sf: rounded(P.durations(_elapsed(spark, sf), [15, 60], "genotype")),
    "variance_partition": lambda spark, sf: rounded(P.variance_partition(fish_features(spark, sf), "genotype", "fish")),
    "qc_sensitivity": lambda spark, sf: rounded(P.qc_sensitivity(*_strict(spark, sf), "WT", "MUT"), 5),
    "removal_fractions": lambda spark, sf: rounded(P.removal_fractions(P.exclusion(T.split_merge(big_detections(spark, sf)), True).join(F.broadcast(subjects(spark, sf).select("block_name", "genotype")), "block_name"), "excluded", "genotype")),
    "shape_transitions": lambda spark, sf: rounded(P.transitions(_tertiles(spark, sf), "start_state", "end_state", "genotype")),
    "contribution_change": lambda spark, sf: rounded(P.condition_change(_contributions(spark, sf), "condition", "untreated", "treated", "feature"), 5),
    "signal_change": lambda spark, sf: rounded(P.signal_change(_contributions(spark, sf), "condition", "untreated", "treated", "genotype", "WT", "MUT", "feature"), 5),
    "nearest_other": lambda spark, sf: rounded(P.nearest_other(big_detections(spark, sf).select(F.col("track_id").alias("gt_id"), "block_name", "time", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x")), 6.0)),
    "feature_availability": lambda spark, sf: P.availability(table(spark, sf, "customer").withColumn("gappy", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal"))), {"c_acctbal": None, "gappy": None, "balance": "c_acctbal", "speed": "no_such"}),
    "block_audit": lambda spark, sf: P.block_audit(table(spark, sf, "supplier"), "s_suppkey", {"balance is negative": F.col("s_acctbal") >= 0, "nation is missing": F.col("s_nationkey") > 2}, F.col("s_suppkey") % 7 == 0),
    "first_ground_truth": lambda spark, sf: rounded(P.first_of_each(table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("y"), "event_id"), ["user_id", "event_type"], [F.col("event_id")], ["y"])),
    "fold_filter": lambda spark, sf: P.fold_filter(_folds(spark, sf), "fold", 0.3, 0.85, ["balance", "balance_again", "nation", "same", "sparse"]),
    "z_range_summary": lambda spark, sf: rounded(P.distribution(T.summary(big_detections(spark, sf)).withColumn("z_range", F.col("z_range") + F.col("mean_volume") / 100), "z_range"), 7),
    "group_distributions": lambda spark, sf: rounded(P.distribution(_morph(spark, sf), "centroid_x", "condition", "genotype"), 7),
    "volume_histogram": lambda spark, sf: rounded(P.histogram(T.summary(big_detections(spark, sf)), "duration", 10, 0.995)),
    "start_and_end_shapes": lambda spark, sf: rounded(P.start_and_end(_morph(spark, sf), ["volume_voxels", "centroid_x"], "genotype"), 7),
    "retained_tracks": lambda spark, sf: P.retained(big_detections(spark, sf).where("track_id % 2 = 0 AND block_name % 4 <> 1"), subjects(spark, sf)),
    "top_variance": lambda spark, sf: rounded(P.top_variance(fish_features(spark, sf), 2, fish_features(spark, sf).where("feature = 'scaled'").select("feature").distinct()), 4),
    "spread_frames": lambda spark, sf: P.spread(block_frames(spark, sf).select("block_name", "time"), ["block_name"], "time", 2, 1),
    "worklist": lambda spark, sf: P.worklist(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), "id"),
    "chosen_union": lambda spark, sf: P.chosen_union(CQ._selection(spark, sf).withColumn("coefficient", F.when((F.col("coefficient") > 0) & (F.length("feature") + F.col("fold") > 4), F.col("coefficient")).otherwise(0.0))),
    "without_subjects": lambda spark, sf: P.without_subjects(table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")).alias("segment")), "segment", ["BUILDING", "MACHINERY"]),
    "outer_chain": lambda spark, sf: rounded(P.outer_chain([table(spark, sf, "customer").where(f"c_custkey % {k} <> 0").select("c_custkey", F.col("c_acctbal").alias(f"v{k}")) for k in (2, 3, 5)], "c_custkey")),
    "replaced_columns": lambda spark, sf: rounded(P.replaced(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")), ["c_custkey"])),
    "label_columns": lambda spark, sf: rounded(P.label_column(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier")), ["part", "line", "supplier"], table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber"), ["frame"], "l_linenumber")),
    "share_texts": lambda spark, sf: table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 5000).alias("a"), F.count("*").alias("b")).select("c_mktsegment", P.share_text(F.col("a"), F.col("b")).alias("text")),
    "file_name_parts": lambda spark, sf: _paths(spark, sf).select("p_partkey", *[c.alias(n) for n, c in P.name_parts(F.col("path")).items()]),
    "metadata_template": lambda spark, sf: P.metadata_template(table(spark, sf, "part"), "p_brand"),
    "odd_scalars": lambda spark, sf: rounded(_odd_scalars(spark, sf)),
    "chosen_values": lambda spark, sf: rounded(table(spark, sf, "lineitem").agg(*[F.avg(c).alias(c) for c in P.choose_features(table(spark, sf, "lineitem"), ["l_tax", "l_nothing", "l_discount"], ["l_orderkey", "l_partkey", "l_suppkey"], 4)])),
    "file_inventory": lambda spark, sf: P.inventory(_paths(spark, sf).withColumn("path", F.when(F.col("p_partkey") % 10 == 0, "data/x.tif").otherwise(F.col("path"))), "path", table(spark, sf, "nation").select(F.format_string("2024%02d%02d", (F.col("n_nationkey") % 12 + 1).cast("int"), (F.col("n_nationkey") % 28 + 1).cast("int")).alias("date"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 9).cast("int").alias("acquisition"))),
    "feret_summary": lambda spark, sf: rounded(P.track_lengths(P.feret_proxies(voxels(spark, sf).groupBy("block", F.col("t").alias("time"), "label").agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in "zyx"]), "z", "y", "x"), ["block", "label"], ["feret_max", "feret_min"])),
    "subject_medians": lambda spark, sf: rounded(P.subject_medians(fish_features(spark, sf), "fish", 0.01, 0.99), 5),
    "group_separation": lambda spark, sf: rounded(P.separation(_nations(spark, sf), "subject", "genotype", "x", "y"), 5),
    "frozen_projection": lambda spark, sf: rounded(P.frozen_projection(CQ._gappy(spark, sf).select("subject", "feature", "value"), F.col("subject") % 2 == 0, _loadings(spark, sf)), 5),
}


def _nations(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("subject")).agg((F.avg("c_acctbal") / 1000).alias("x"), (F.stddev_pop("c_acctbal") / 1000).alias("y"))
    return c.withColumn("genotype", F.when(F.col("subject") % 3 == 0, "MUT").otherwise("WT"))


def _loadings(spark, sf):
    f = fish_features(spark, sf).select("feature").distinct()
    return f.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("axis"), "feature").withColumn("loading", (F.length("feature") % 5 - 2) / (F.col("axis") * 2.0))


def _union(tables):
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


_SM = TQ.BIG_STEP + ", " + TQ.QUALITY
_EXC = _SM + """, ex AS (SELECT block_name, track_id, step_spike AND NOT volume_jump AND NOT high_volume_cv AND NOT intensity_jump AS step_spike_only,
  concat_ws(';', CASE WHEN high_volume_cv THEN 'high_volume_cv' END, CASE WHEN intensity_jump THEN 'intensity_jump' END, CASE WHEN volume_jump AND step_spike THEN 'volume_jump_with_step_spike' END) AS exclusion_reason,
  concat_ws(';', CASE WHEN volume_jump THEN 'volume_jump' END, CASE WHEN high_volume_cv THEN 'high_volume_cv' END, CASE WHEN intensity_jump THEN 'intensity_jump' END) AS strict_reason FROM h)"""  # fmt: skip
_MEAN = lambda f, a, b: f"avg({f}(CASE WHEN d{a} <> 0 OR d{b} <> 0 THEN atan2(d{b}, d{a}) END))"
_NONZERO = lambda v: f"CASE WHEN abs({v}) < 1e-12 THEN 0 ELSE {v} END"
_ANG = lambda a, b: f"sqrt(({_NONZERO(_MEAN('sin', a, b))}) ** 2 + ({_NONZERO(_MEAN('cos', a, b))}) ** 2) AS {a}{b}, atan2({_NONZERO(_MEAN('sin', a, b))}, {_NONZERO(_MEAN('cos', a, b))}) AS m{a}{b}"
_DIST = lambda v, t, *g: f"SELECT {''.join(c + ', ' for c in g)}count({v}) AS n, round(avg({v}), 7) AS mean, round(quantile_cont({v}, 0.25), 7) AS q25, round(median({v}), 7) AS median, round(quantile_cont({v}, 0.75), 7) AS q75, round(quantile_cont({v}, 0.9), 7) AS q90 FROM {t}{' GROUP BY ALL' if g else ''}"
_OVER = lambda v: f"round(avg({v}), 5) AS {v}_mean, round(median({v}), 5) AS {v}_median, round(stddev_pop({v}), 5) AS {v}_sd, round(CASE WHEN avg({v}) <> 0 THEN stddev_pop({v}) / avg({v}) END, 5) + 0 AS {v}_cv, round(arg_max({v}, time) - arg_min({v}, time), 5) + 0 AS {v}_change, round(CASE WHEN count(*) > 1 THEN regr_slope({v}, time) END, 5) + 0 AS {v}_slope"
_PICK = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + f"][o_orderkey % {len(texts)} + 1]"
_EFF = lambda v, n: f"(SELECT feature, 2 * (sum(r) FILTER (genotype = 'MUT') - count(*) FILTER (genotype = 'MUT') * (count(*) FILTER (genotype = 'MUT') + 1) / 2) / (count(*) FILTER (genotype = 'MUT') * count(*) FILTER (genotype = 'WT')) - 1 AS {n} FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY {v}) + (count(*) OVER (PARTITION BY feature, {v}) - 1) / 2.0 AS r FROM sf WHERE {v} IS NOT NULL) GROUP BY feature)"

_OTSU = """q AS (SELECT block, quantile_cont(intensity, 0.01) AS a, quantile_cont(intensity, 0.998) AS b FROM {src} GROUP BY block),
lv AS (SELECT s.*, least(floor(CASE WHEN b > a THEN least(greatest((intensity - a) / (b - a), 0), 1) ELSE 0 END * 256), 255)::INT AS level FROM {src} s JOIN q USING (block)), h AS (SELECT block, level, count(*) AS n FROM lv GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cw, sum(n * level) OVER w AS cm, sum(n) OVER p AS tw, sum(n * level) OVER p AS tm FROM h WINDOW w AS (PARTITION BY block ORDER BY level ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY block)),
bv AS (SELECT block, level, CASE WHEN tw > cw THEN (cw * (tw - cw))::DOUBLE * (cm / cw - (tm - cm) / (tw - cw)) ** 2 ELSE -1 END AS bt FROM c),
ot AS (SELECT block, level AS threshold FROM bv QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(bt, 6) DESC, level) = 1)"""

_FLAGS = lambda told: f"[{', '.join('true' if x == 'T' else 'false' for x in told)}][o_orderkey % {len(told)} + 1]"

ORACLE_SQL = {
    "censored_objects": f"WITH {_OBJ} SELECT block, t, label, round(rd.y, 6) AS y, round(rd.x, 6) AS x, n, overlapping FROM rd WHERE NOT overlapping AND NOT EXISTS (SELECT 1 FROM px WHERE px.block = rd.block AND px.t = rd.t AND px.y = ry AND px.x = rx)",
    "region_states": f"WITH {_STATES} SELECT block_name, track_id, time, state FROM st",
    "core_events": f"""WITH {_STATES}, l AS (SELECT *, lag(state) OVER (PARTITION BY block_name, track_id ORDER BY time) AS p FROM st),
g AS (SELECT block_name, time, count(*) FILTER (p = 0 AND state >= 1) AS entries, count(*) FILTER (p >= 1 AND state = 0) AS exits, count(*) FILTER (p < 2 AND state = 2) AS core_entries, count(*) FILTER (p = 2 AND state < 2) AS core_exits FROM l GROUP BY ALL)
SELECT * FROM g WHERE entries + exits + core_entries + core_exits > 0""",
    "region_table_counts": f"WITH {_STATES} SELECT 'all' AS name, block_name, count(*) AS n FROM st GROUP BY ALL UNION ALL SELECT 'outside_and_boundary', block_name, count(*) FROM st WHERE state < 2 GROUP BY ALL UNION ALL SELECT 'outside_only', block_name, count(*) FROM st WHERE state = 0 GROUP BY ALL",
    "subject_regions": f"""WITH {_STATES}, l AS (SELECT *, state = 2 AS i, lag(state = 2) OVER (PARTITION BY block_name, track_id ORDER BY time) AS p FROM st),
g AS (SELECT block_name, track_id, avg(i::INT) AS f, count(*) FILTER (i AND NOT p) AS e, count(*) FILTER (NOT i AND p) AS o, avg(volume_voxels) AS v FROM l GROUP BY ALL)
SELECT block_name, count(*) AS n_tracks, round(avg((f > 0)::INT), 6) AS ever_inside_fraction, sum(e)::BIGINT AS total_entries, sum(o)::BIGINT AS total_exits, (sum(e) - sum(o))::BIGINT AS net_flux, round(avg(v), 6) AS mean_volume, round(median(v), 6) AS median_volume, round(avg(f), 6) AS mean_fraction_inside, round(median(f), 6) AS median_fraction_inside FROM g GROUP BY block_name""",
    "mask_areas": f"WITH {_OBJ} SELECT block, t, count(*) AS area, count(*) * 0.25::DOUBLE AS area_um2, count(*) / 64 AS share, round((avg(y) + 0.5) / 8, 6) AS centre_y, round((avg(x) + 0.5) / 8, 6) AS centre_x FROM px GROUP BY ALL",
    "mask_areas_by_block": f"WITH {_OBJ}, a AS (SELECT block, t, count(*) / 64 AS s FROM px GROUP BY ALL) SELECT block, count(s) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(min(s), 6) AS min, round(max(s), 6) AS max FROM a GROUP BY block",
    "grey_thresholds": f"WITH {VOX}, {_OTSU.format(src='vox')} SELECT block, threshold FROM ot",
    "body_mask": f"WITH {VOX}, pj AS (SELECT block, y, x, max(intensity) AS intensity FROM vox GROUP BY ALL), {_OTSU.format(src='pj')} SELECT block, y, x FROM lv JOIN ot USING (block) WHERE level + 0.5 > 0.9 * (threshold + 0.5)",
    "flipped_pixels": f"WITH {_OBJ} SELECT block, t, (CASE WHEN block % 5 <> 0 AND block % 2 = 0 THEN 7 - y ELSE y END)::INT AS y, (CASE WHEN block % 5 <> 0 AND block % 2 = 0 THEN 7 - x ELSE x END)::INT AS x FROM px",
    "motility_classes": f"""WITH {DET}, u AS (SELECT block_name, track_id, time, centroid_x * 0.004 AS x, centroid_y * 0.004 AS y, centroid_z * 0.05 AS z FROM det),
v AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d, sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2 + (z - first_value(z) OVER w) ** 2) AS f FROM u WINDOW w AS (PARTITION BY block_name, track_id ORDER BY time)),
g AS (SELECT block_name, track_id, count(*) AS n, coalesce(sum(d), 0) AS path, arg_max(f, time) AS net, avg((d > 1)::INT) AS moving FROM v GROUP BY ALL),
k AS (SELECT *, CASE WHEN n < 5 THEN 'too_short_to_classify' WHEN coalesce(path < 5 AND net < 3 AND moving < 0.2, false) THEN 'static_candidate' WHEN coalesce(path >= 10 OR moving >= 0.3, false) THEN 'motile' ELSE 'low_motility' END AS motility_class FROM g)
SELECT block_name, track_id, motility_class, motility_class = 'static_candidate' AS static_exclude, CASE WHEN motility_class = 'static_candidate' THEN 'path<5.0um; net<3.0um; moving_fraction<0.2' ELSE '' END AS static_reason FROM k""",
    "clean_exclusions": f"WITH {_EXC} SELECT block_name, track_id, step_spike_only, exclusion_reason, exclusion_reason <> '' AS excluded FROM ex",
    "strict_exclusions": f"WITH {_EXC} SELECT block_name, track_id, strict_reason AS exclusion_reason, strict_reason <> '' AS excluded FROM ex",
    "reason_counts": f"WITH {_SM}, r AS (SELECT unnest([CASE WHEN step_spike THEN 'step_spike' END, CASE WHEN volume_jump THEN 'volume_jump' END, CASE WHEN high_volume_cv THEN 'high_volume_cv' END, CASE WHEN intensity_jump THEN 'intensity_jump' END]) AS reason FROM h) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason",
    "features_over_time": f"WITH {BIG} SELECT block_name, track_id, {_OVER('volume_voxels')}, {_OVER('mean_intensity')}, {_OVER('centroid_z')} FROM big GROUP BY block_name, track_id",
    "step_angles": f"""WITH {TQ.BIG_STEP}, g AS (SELECT block_name, track_id, {_ANG('x', 'y')}, {_ANG('x', 'z')}, {_ANG('y', 'z')} FROM s GROUP BY ALL)
SELECT block_name, track_id, {", ".join(f"round({n}, 4) AS {n}_resultant, round(CASE WHEN {n} > 1e-9 THEN degrees(m{n}) END, 4) + 0 AS {n}_mean_deg, round(CASE WHEN {n} > 1e-9 THEN degrees(sqrt(-2 * ln(least({n}, 1)))) END, 4) + 0 AS {n}_sd_deg" for n in ("xy", "xz", "yz"))} FROM g""",
    "elapsed_msd": f"WITH {_ELAPSED} SELECT genotype, minutes, round(avg(squared), 4) AS mean, round(quantile_cont(squared, 0.25), 4) AS q25, round(median(squared), 4) AS median, round(quantile_cont(squared, 0.75), 4) AS q75, count(*) AS n, count(DISTINCT (block_name, track_id)) AS n_tracks, round(coalesce(stddev_samp(squared), 0) / sqrt(count(*)), 4) AS sem FROM mb GROUP BY genotype, minutes",
    "elapsed_msd_by_subject": f"WITH {_ELAPSED}, f AS (SELECT genotype, fish_id, minutes, avg(squared) AS m FROM mb GROUP BY ALL) SELECT genotype, minutes, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m), 0) / sqrt(count(*)), 4) AS sem, count(*) AS n_subjects FROM f GROUP BY genotype, minutes",
    "track_durations": f"WITH {_ELAPSED}, d AS (SELECT genotype, block_name, track_id, max(elapsed) - min(elapsed) AS d FROM el GROUP BY ALL) SELECT genotype, count(*) AS n_tracks, round(median(d), 6) AS median, round(max(d), 6) AS longest, count(*) FILTER (d >= 15) AS n_15, count(*) FILTER (d >= 60) AS n_60 FROM d GROUP BY genotype",
    "variance_partition": f"""WITH {FISH}, c AS (SELECT feature, genotype, fish, avg(value) AS m FROM feat GROUP BY ALL), g AS (SELECT feature, var_samp(g) AS b FROM (SELECT feature, genotype, avg(value) AS g FROM feat GROUP BY ALL) GROUP BY feature), f AS (SELECT feature, var_samp(m) AS s FROM c GROUP BY feature),
r AS (SELECT feature, var_samp(value - m) AS r FROM feat JOIN c USING (feature, genotype, fish) GROUP BY feature), j AS (SELECT feature, b, greatest(s - b, 0) AS w, r FROM g JOIN f USING (feature) JOIN r USING (feature))
SELECT feature, round(b / (b + w + r), 6) AS group_fraction, round(w / (b + w + r), 6) + 0 AS subject_fraction, round(r / (b + w + r), 6) AS cell_fraction FROM j""",
    "qc_sensitivity": f"""WITH {_STRICT}, v AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rn, rank() OVER (PARTITION BY feature ORDER BY strict) + (count(*) OVER (PARTITION BY feature, strict) - 1) / 2.0 AS rs FROM sf WHERE value IS NOT NULL AND strict IS NOT NULL),
g AS (SELECT feature, count(*) AS n_shared, corr(rn, rs) AS spearman, median(abs(strict - value)) AS a, median(abs(strict - value) / abs(value) * 100) FILTER (value <> 0) AS r FROM v GROUP BY feature)
SELECT g.feature, n_shared, round(spearman, 5) AS spearman, round(a, 5) AS median_absolute_change, round(r, 5) AS median_relative_change_pct, round(normal_delta, 5) + 0 AS normal_delta, round(strict_delta, 5) + 0 AS strict_delta, round(abs(strict_delta - normal_delta), 5) AS delta_change, sign(strict_delta) = sign(normal_delta) AS same_direction
FROM g JOIN {_EFF('value', 'normal_delta')} x ON x.feature = g.feature JOIN {_EFF('strict', 'strict_delta')} y ON y.feature = g.feature""",
    "removal_fractions": f"WITH {_EXC}, {META} SELECT genotype, count(*) AS n, count(*) FILTER (strict_reason <> '') AS n_removed, round(avg((strict_reason <> '')::INT), 6) AS fraction_removed FROM ex JOIN meta USING (block_name) GROUP BY genotype",
    "shape_transitions": f"""WITH {_MORPH}, e AS (SELECT genotype, block_name, track_id, arg_min(volume_voxels, time) AS a, arg_max(volume_voxels, time) AS b FROM mo GROUP BY ALL),
s AS (SELECT genotype, CASE WHEN a <= 17 THEN 'small' WHEN a >= 34 THEN 'large' ELSE 'middle' END AS start_state, CASE WHEN b <= 17 THEN 'small' WHEN b >= 34 THEN 'large' ELSE 'middle' END AS end_state FROM e)
SELECT genotype, start_state, end_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY genotype, start_state), 6) AS share FROM s GROUP BY genotype, start_state, end_state""",
    "contribution_change": f"WITH {_CONTR}, g AS (SELECT feature, avg(value) FILTER (condition = 'untreated') AS b, avg(value) FILTER (condition = 'treated') AS a FROM co GROUP BY feature) SELECT feature, round(b, 5) AS before, round(a, 5) AS after, round(a - b, 5) + 0 AS change FROM g",
    "signal_change": f"""WITH {_CONTR}, g AS (SELECT feature, avg(value) FILTER (condition = 'untreated' AND genotype = 'MUT') - avg(value) FILTER (condition = 'untreated' AND genotype = 'WT') AS b, avg(value) FILTER (condition = 'treated' AND genotype = 'MUT') - avg(value) FILTER (condition = 'treated' AND genotype = 'WT') AS a FROM co GROUP BY feature)
SELECT feature, round(b, 5) + 0 AS before, round(a, 5) + 0 AS after, round(abs(a) - abs(b), 5) + 0 AS change, CASE WHEN abs(a) > abs(b) THEN 'clearer' WHEN abs(a) < abs(b) THEN 'fuzzier' ELSE 'unchanged' END AS signal FROM g""",
    "nearest_other": f"""WITH {BIG.replace("big AS (", "big AS MATERIALIZED (")},
p AS MATERIALIZED (SELECT *, floor(centroid_y / 6) + a AS cy, floor(centroid_x / 6) + b AS cx FROM big, (VALUES (-1), (0), (1)) u(a), (VALUES (-1), (0), (1)) v(b)),
q AS MATERIALIZED (SELECT block_name, time, track_id AS other, centroid_y AS oy, centroid_x AS ox, floor(centroid_y / 6) AS cy, floor(centroid_x / 6) AS cx FROM big),
d AS (SELECT track_id, block_name, time, other, sqrt((centroid_y - oy) ** 2 + (centroid_x - ox) ** 2) AS d FROM p JOIN q USING (block_name, time, cy, cx) WHERE track_id <> other),
m AS (SELECT track_id, block_name, time, min({{'d': d, 'other': other}}) FILTER (d IS NOT NULL) AS m FROM (SELECT * FROM d WHERE d <= 6 UNION ALL SELECT track_id, block_name, time, NULL, NULL FROM big) GROUP BY track_id, block_name, time)
SELECT track_id AS gt_id, block_name, time, m.other AS other, round(m.d, 6) AS distance FROM m""",
    "feature_availability": """SELECT 'c_acctbal' AS feature, 'present' AS status, count(c_acctbal) AS n_nonmissing, count(DISTINCT c_acctbal) AS n_unique FROM customer UNION ALL SELECT 'gappy', 'present', count(c_acctbal) FILTER (c_custkey % 4 <> 0), count(DISTINCT c_acctbal) FILTER (c_custkey % 4 <> 0) FROM customer
UNION ALL SELECT 'balance', 'derived', count(c_acctbal), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'speed', 'missing', 0, 0""",
    "block_audit": """WITH e AS (SELECT s_suppkey, s_suppkey % 7 = 0 AS s, CASE WHEN s_acctbal < 0 THEN 'balance is negative' WHEN s_nationkey <= 2 THEN 'nation is missing' END AS e FROM supplier)
SELECT s_suppkey, CASE WHEN s THEN 'skipped' WHEN e IS NOT NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN NOT s THEN e END AS error FROM e""",
    "first_ground_truth": "SELECT user_id, event_type, round(value, 6) AS y, event_id FROM events WHERE event_id % 6 <> 0 AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "fold_filter": "SELECT unnest(range(0, 3))::INT AS fold, f.* FROM (VALUES ('balance', true, NULL), ('balance_again', false, 'follows balance'), ('nation', true, NULL), ('same', false, 'constant'), ('sparse', false, 'missing')) f(feature, kept, reason)",
    "z_range_summary": f"WITH {BIG}, z AS (SELECT max(centroid_z) - min(centroid_z) + avg(volume_voxels) / 100 AS z_range FROM big GROUP BY block_name, track_id) " + _DIST("z_range", "z"),
    "group_distributions": f"WITH {_MORPH} " + _DIST("centroid_x", "mo", "condition", "genotype"),
    "volume_histogram": f"""WITH {BIG}, d AS (SELECT max(time) - min(time) + 1 AS d FROM big GROUP BY block_name, track_id), l AS (SELECT min(d) AS lo, quantile_cont(d, 0.995) AS hi FROM d),
b AS (SELECT least(floor((d - lo) / ((hi - lo) / 10)), 9)::INT AS bin, (hi - lo) / 10 AS w FROM d, l WHERE d BETWEEN lo AND hi) SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER () / any_value(w), 6) AS density FROM b GROUP BY bin""",
    "start_and_end_shapes": f"""WITH {_MORPH}, e AS (SELECT genotype, block_name, track_id, arg_min(volume_voxels, time) AS a, arg_max(volume_voxels, time) AS b, arg_min(centroid_x, time) AS c, arg_max(centroid_x, time) AS d FROM mo GROUP BY ALL)
SELECT genotype, count(*) AS n_tracks, round(median(a), 7) AS start_volume_voxels, round(median(b), 7) AS end_volume_voxels, round(median(c), 7) AS start_centroid_x, round(median(d), 7) AS end_centroid_x FROM e GROUP BY genotype""",
    "retained_tracks": f"WITH {BIG}, {META}, n AS (SELECT block_name, count(DISTINCT track_id) AS n FROM big WHERE track_id % 2 = 0 AND block_name % 4 <> 1 GROUP BY block_name) SELECT block_name, time_interval_seconds, coalesce(n, 0) AS n_tracks FROM meta LEFT JOIN n USING (block_name)",
    "top_variance": f"WITH {FISH} SELECT feature, round(var_samp(value), 4) AS variance FROM feat WHERE feature <> 'scaled' GROUP BY feature ORDER BY variance DESC, feature LIMIT 2",
    "spread_frames": f"""WITH {FRM}, i AS (SELECT block_name, time, row_number() OVER (PARTITION BY block_name ORDER BY time) - 2 AS i, count(*) OVER (PARTITION BY block_name) - 2 AS n FROM frm), j AS (SELECT *, CASE WHEN i < floor(n / 3) THEN 0 WHEN i < floor(n * 2 / 3) THEN 1 ELSE 2 END AS third FROM i WHERE i >= 0 AND i < n)
SELECT block_name, time, third FROM j WHERE i = floor(n * third / 3) OR i = floor(n * (third + 1) / 3) - 1""",
    "worklist": "SELECT id FROM (SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0) WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "chosen_union": """WITH x AS (SELECT l_linenumber % 5 AS fold, 'f' || l_partkey % 12 AS feature, l_discount - 0.05 AS c FROM lineitem), g AS (SELECT feature, count(DISTINCT fold) AS n_folds FROM x WHERE c > 0 AND length(feature) + fold > 4 GROUP BY feature) SELECT feature, n_folds, row_number() OVER (ORDER BY n_folds DESC, feature) AS rank FROM g""",
    "without_subjects": "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 8 <> 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "outer_chain": "SELECT c_custkey, round(CASE WHEN c_custkey % 2 <> 0 THEN c_acctbal END, 6) AS v2, round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 6) AS v3, round(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, 6) AS v5 FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 <> 0 OR c_custkey % 5 <> 0",
    "replaced_columns": "SELECT c_custkey, round(m, 6) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "label_columns": """WITH k AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS l FROM lineitem), c AS (SELECT l_orderkey AS f, unnest(['part', 'line', 'supplier']) AS "column", unnest([l_partkey::BIGINT, l_linenumber::BIGINT, l_suppkey::BIGINT]) AS l FROM lineitem)
SELECT "column", count(*) AS n, count(k.l) AS matched, round(count(k.l) / count(*), 6) AS share FROM c LEFT JOIN k ON k.f = c.f AND k.l = c.l GROUP BY "column\"""",
    "share_texts": "SELECT c_mktsegment, format('{} / {} ({:.1f} %)', count(*) FILTER (c_acctbal > 5000), count(*), round(100.0 * count(*) FILTER (c_acctbal > 5000) / count(*), 1)) AS text FROM customer GROUP BY c_mktsegment",
    "file_name_parts": """SELECT p_partkey, 'Fish_' || p_size AS subject, 'Fish_' || p_size || '_2024' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '_block' || p_partkey % 9 AS safe_name,
  '2024' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS date, (p_partkey % 9)::INT AS acquisition, CASE p_partkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'MUT' END AS genotype FROM part""",
    "metadata_template": "SELECT DISTINCT p_brand, NULL::VARCHAR AS genotype, NULL::VARCHAR AS fish_id FROM part",
    "odd_scalars": f"""SELECT o_orderkey, {_FLAGS("TTTFTTFFFTTF")} AS flag, {_FLAGS("TTTFFFFFFFTF")} AS words_only, {_FLAGS("TTTFFFTFFFTF")} AS words_t, {_FLAGS("TTTFTTTFFTTF")} AS flag_t, {_FLAGS("TTTFTFFFFTTF")} AS positive, {_FLAGS("FFFFTFFFFTTF")} AS by_numbers, {_FLAGS("TFTFF")} AS by_words,
  [12.5, NULL, NULL, NULL, -3, 7, NULL][o_orderkey % 7 + 1]::DOUBLE AS number, {_PICK(["91", "91", "91", "a7", "0.5", "-3"])} AS id, {_PICK(["WT", "WT", "MUT", "growth", "control", "TERT", "Unknown", "het", "tert-/-", "wild-type", "WT", "WT"])} AS "group",
  {_PICK(["WT", "WT", "MUT", "growth", "control", "TERT", "Unknown", " het ", "tert-/-", "wild-type", "MUT", "WT"])} AS group_m, {_PICK(["WT", "wild type 2", "MUT", "growth", "WT", "MUT", "Unknown", "het", "MUT", "wild-type", "Line WT-MUT", "wt_1 wildtype"])} AS group_e,
  list_extract(['WT', NULL, 'MUT', NULL, NULL, 'MUT', NULL, NULL, 'MUT', NULL, 'WT', 'WT'], (o_orderkey % 12 + 1)::INT) AS group_in_name,
  {_PICK(["WT_x.1", "wild_type_2_x.1", "Mutant_x.1", "growth_x.1", "control_x.1", "TERT_x.1", "Unknown_x.1", "het_x.1", "tert-_-_x.1", "wild-type_x.1", "Line_WT-MUT_x.1", "wt_1_wildtype_x.1"])} AS safe_name FROM orders""",
    "chosen_values": "SELECT round(avg(l_tax), 6) AS l_tax, round(avg(l_discount), 6) AS l_discount, round(avg(l_linenumber), 6) AS l_linenumber, round(avg(l_quantity), 6) AS l_quantity FROM lineitem",
    "file_inventory": """WITH f AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'data/x.tif' ELSE 'data/' || ['WT', 'mut', 'other'][p_partkey % 3 + 1] || '/Fish_' || p_size || ' 2024' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '_block' || p_partkey % 9 || '.tif' END AS path,
  CASE WHEN p_partkey % 10 > 0 THEN '2024' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS date, CASE WHEN p_partkey % 10 > 0 THEN (p_partkey % 9)::INT END AS acquisition FROM part),
x AS (SELECT '2024' || lpad((n_nationkey % 12 + 1)::VARCHAR, 2, '0') || lpad((n_nationkey % 28 + 1)::VARCHAR, 2, '0') AS date, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 9 END AS acquisition FROM nation)
SELECT path, date, acquisition, CASE WHEN date IS NULL THEN 'no date' END AS error, coalesce(EXISTS (SELECT 1 FROM x WHERE x.date = f.date AND (x.acquisition IS NULL OR x.acquisition = f.acquisition)), false) AS excluded FROM f""",
    "feret_summary": f"""WITH {VOX}, o AS (SELECT block, t AS time, label, max(z) - min(z) + 1 AS z, max(y) - min(y) + 1 AS y, max(x) - min(x) + 1 AS x FROM vox GROUP BY ALL), p AS (SELECT *, greatest(z, y, x) AS a, least(z, y, x) AS b FROM o)
SELECT block, label, count(*) AS n, round(avg(a), 6) AS feret_max_mean, median(a)::DOUBLE AS feret_max_median, max(a) AS feret_max_max, arg_max(a, time) - arg_min(a, time) AS feret_max_change, round(avg(b), 6) AS feret_min_mean, median(b)::DOUBLE AS feret_min_median, max(b) AS feret_min_max, arg_max(b, time) - arg_min(b, time) AS feret_min_change FROM p GROUP BY block, label""",
    "subject_medians": f"""WITH {FISH}, l AS (SELECT feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM feat GROUP BY feature), m AS (SELECT fish, feature, count(value) AS n, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM feat GROUP BY ALL)
SELECT fish, feature, n, round(median, 5) AS median, round(iqr, 5) AS iqr, round(low, 5) AS low, round(high, 5) AS high FROM m JOIN l USING (feature)""",
    "group_separation": """WITH p AS (SELECT c_nationkey AS k, CASE WHEN c_nationkey % 3 = 0 THEN 'MUT' ELSE 'WT' END AS g, avg(c_acctbal) / 1000 AS x, stddev_pop(c_acctbal) / 1000 AS y FROM customer GROUP BY c_nationkey), c AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM p GROUP BY g),
w AS (SELECT avg(s) AS within FROM (SELECT g, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s FROM p JOIN c USING (g) GROUP BY g)), b AS (SELECT sqrt((m.mx - n.mx) ** 2 + (m.my - n.my) ** 2) AS between FROM c m JOIN c n ON m.g = 'MUT' AND n.g = 'WT'),
d AS (SELECT a.k, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FILTER (a.g = b.g) AS own, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FILTER (a.g <> b.g) AS other FROM p a JOIN p b ON a.k <> b.k GROUP BY a.k)
SELECT round(any_value(between), 5) AS between, round(any_value(within), 5) AS within, round(any_value(between / within), 5) AS ratio, round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 5) AS silhouette FROM d, w, b""".replace(" AS between", ' AS "between"').replace("(between", '("between"').replace("any_value(between", 'any_value("between"'),
    "frozen_projection": f"""WITH {CQ._GAPPY}, m AS (SELECT feature, median(value) AS med FROM gap WHERE subject % 2 = 0 GROUP BY feature), f AS (SELECT subject, feature, coalesce(value, med) AS v FROM gap JOIN m USING (feature)), s AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS sd FROM f WHERE subject % 2 = 0 GROUP BY feature),
l AS (SELECT axis, feature, (length(feature) % 5 - 2) / (axis * 2.0::DOUBLE) AS w FROM (SELECT DISTINCT feature FROM gap), (SELECT unnest([1, 2]) AS axis))
SELECT subject, axis, round(sum(CASE WHEN sd > 0 THEN (v - mean) / sd ELSE 0 END * w), 5) + 0 AS score FROM f JOIN s USING (feature) JOIN l USING (feature) GROUP BY subject, axis""",
}
