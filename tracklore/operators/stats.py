"""Group statistics as grouped aggregations and windows: effects, ranks, corrections, variance, scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.operators.lineage import kept, quantiles, running, sized


#: Distinct p values that windows of whole families run over, at most.
FEW = 50_000


def average_ranks(rows: DataFrame, keys: list[str], by: str, name: str = "rank") -> DataFrame:
    """(keys, by, rank): the rank of each distinct value within its keys, ties at their mean, from counts of values."""
    counts = rows.groupBy(*keys, by).agg(F.count("*").alias("_c"))
    return running(counts, keys, by, {"_up": (F.sum, F.col("_c"))}).select(*keys, by, (F.col("_up") - (F.col("_c") - 1) / 2.0).alias(name))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal, by the rational approximation of the error function.

    Its absolute error is under 2e-7, so smaller tails, and q values from them, only tell that they are small.

    Fixed values: the five coefficients and the scale of the approximation.
    """
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def effect_sizes(long: DataFrame, a: str, b: str, group: str = "genotype") -> DataFrame:
    """Medians, Cliff's delta, U and its normal p of each feature between groups a and b, and q within all features.

    Delta comes from rank sums over counts of distinct values, so no pair of rows is formed and no feature is one task's
    work; U's variance is corrected for ties.
    """
    v = long.where(F.col("value").isNotNull() & F.col(group).isin(a, b))
    counts = v.groupBy("feature", "value").agg(F.count(F.when(F.col(group) == a, 1)).alias("a"), F.count(F.when(F.col(group) == b, 1)).alias("b"))
    up = running(counts, ["feature"], "value", {"up_a": (F.sum, F.col("a")), "up_b": (F.sum, F.col("b"))})
    totals = counts.groupBy("feature").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    ties = F.col("a") + F.col("b")
    rank = F.col("up_a") + F.col("up_b") - (ties - 1) / 2.0

    def middle(side: str) -> Column:
        n, up_to = F.col(f"n_{side}"), F.col(f"up_{side}")
        return (F.min(F.when(up_to > F.floor((n - 1) / 2), F.col("value"))) + F.min(F.when(up_to > F.floor(n / 2), F.col("value")))) / 2

    g = up.join(totals.hint("merge"), "feature").groupBy("feature").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), middle("a").alias("median_a"), middle("b").alias("median_b"),
        F.sum(F.col("b") * rank).alias("rank_sum"), F.sum((ties * ties - 1).cast("double") * ties).alias("tie_sum"),
    )
    n, m = F.col("n_b").cast("double"), F.col("n_a").cast("double")
    total = n + m
    u = F.col("rank_sum") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * (total + 1 - F.col("tie_sum") / (total * (total - 1))))
    g = g.where("n_a > 0 AND n_b > 0").withColumns({"difference": F.col("median_b") - F.col("median_a"), "u": u, "cliffs_delta": 2 * u / (n * m) - 1})
    g = g.withColumn("p", F.when(sd > 0, normal_tail((F.abs(F.col("u") - n * m / 2) - 0.5) / sd)).otherwise(1.0)).withColumn("p", F.least("p", F.lit(1.0)))
    return benjamini_hochberg(g.drop("rank_sum", "tie_sum"), "p", "q")


def benjamini_hochberg(df: DataFrame, p: str, q: str, *family: str) -> DataFrame:
    """Step-up q values within each family; a null p has a null q.

    Distinct values of p are counted: a few run over windows of their families, more over ranges.
    """
    keys = list(family)
    df = kept(df)
    counts = kept(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c")))
    if counts.count() <= FEW:
        every, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(p).rowsBetween(W.unboundedPreceding, 0)
        raw = F.col(p) * F.sum("_c").over(every) / F.sum("_c").over(upto)
        down = W.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
        found = counts.withColumn("_raw", raw).select(*keys, p, F.least(F.min("_raw").over(down), F.lit(1.0)).alias(q))
        return df.join(found.hint("merge"), [*keys, p], "left").select(*df.columns, q)
    up = running(counts, keys, p, {"_up": (F.sum, F.col("_c"))})
    m = counts.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    up = up.join(m.hint("merge"), keys) if keys else up.withColumn("_m", F.lit(m.first()[0]))
    back = running(up.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_up")), keys, p, {"_q": (F.min, F.col("_raw"))}, down=True)
    found = back.select(*keys, p, F.least("_q", F.lit(1.0)).alias(q))
    return df.join(found.hint("merge"), [*keys, p], "left").select(*df.columns, q)


def spearman(long: DataFrame, subject: str = "subject") -> DataFrame:
    """(feature_a, feature_b, n, rho): ranks within the pairwise complete subjects, then their correlation."""
    v = long.where("value IS NOT NULL").select(subject, "feature", "value")
    a, b = v.toDF(subject, "feature_a", "va"), v.toDF(subject, "feature_b", "vb")
    p = a.join(b.hint("merge"), subject).where("feature_a < feature_b")
    p = kept(p)
    for by, name in (("va", "ra"), ("vb", "rb")):
        p = p.join(average_ranks(p, ["feature_a", "feature_b"], by, name).hint("merge"), ["feature_a", "feature_b", by])
    return p.groupBy("feature_a", "feature_b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def variance_shares(long: DataFrame, group: str) -> DataFrame:
    """One-way ICC with the mean group size, and eta squared, of each feature."""
    v = long.where("value IS NOT NULL")
    g = v.groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s"))
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(W.partitionBy("feature")) / F.sum("n").over(W.partitionBy("feature")))
    t = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n_total"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    msb, msw, size = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n_total") - F.col("k")), F.col("n_total") / F.col("k")
    t = t.where("k > 1 AND n_total > k").withColumns({"icc": (msb - msw) / (msb + (size - 1) * msw), "eta_squared": F.col("between") / (F.col("between") + F.col("within"))})
    level = F.when(F.col("icc") >= 0.5, "strong").when(F.col("icc") >= 0.1, "moderate").otherwise("weak")
    return t.withColumn("subject_effect", level)


def robust_z(long: DataFrame) -> DataFrame:
    """(x - median) / IQR of each feature, by its standard deviation where the IQR is 0, and the tertile of x."""
    s = quantiles(long, ["feature"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75, "t1": 0.333, "t2": 0.667}).drop("n")
    s = long.groupBy("feature").agg(F.stddev_samp("value").alias("sd")).join(s.hint("merge"), "feature", "left")
    iqr = F.col("q3") - F.col("q1")
    scale = F.when(iqr > 0, iqr).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    state = F.when(F.col("value") <= F.col("t1"), "low").when(F.col("value") <= F.col("t2"), "middle").otherwise("high")
    return long.join(sized(s), "feature").withColumns({"z": (F.col("value") - F.col("med")) / scale, "state": state}).drop("q1", "med", "q3", "t1", "t2", "sd")


def standardised(long: DataFrame) -> DataFrame:
    """Values less their feature's mean over its population deviation, missing ones at the median first."""
    m = quantiles(long, ["feature"], "value", {"med": 0.5}).drop("n")
    v = long.join(sized(m), "feature", "left").withColumn("value", F.coalesce("value", "med")).drop("med")
    s = v.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return v.join(sized(s), "feature").withColumn("z", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "sd")


def classification(rows: DataFrame, *keys: str, score: str = "score", truth: str = "truth") -> DataFrame:
    """Confusion counts, balanced accuracy and rank-based AUC of (truth 0/1, score) in each group of keys."""
    r = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(truth) == 1).alias("yes"), F.count_if(F.col(truth) == 0).alias("no"))
    r = running(r, list(keys), score, {"up": (F.sum, F.col("yes") + F.col("no"))})
    said, rank = F.col(score) >= 0.5, F.col("up") - (F.col("yes") + F.col("no") - 1) / 2.0
    of = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    g = r.groupBy(*keys).agg(of("yes", said).alias("tp"), of("yes", ~said).alias("fn"), of("no", said).alias("fp"), of("no", ~said).alias("tn"), F.sum(F.col("yes") * rank).alias("rank_sum"))
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    both = (p > 0) & (n > 0)
    return g.withColumns({"balanced_accuracy": F.when(both, (F.col("tp") / p + F.col("tn") / n) / 2), "auc": F.when(both, (F.col("rank_sum") - p * (p + 1) / 2) / (p * n))}).drop("rank_sum")


def roc(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score; scores are grouped first, and only those are put in order."""
    g = rows.groupBy(score).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    every = g.agg(F.sum("p"), F.sum("n")).first()
    up = running(g, [], score, {"up_p": (F.sum, F.col("p")), "up_n": (F.sum, F.col("n"))}, down=True)
    return up.select(F.col(score).alias("threshold"), F.try_divide("up_p", F.lit(every[0])).alias("tpr"), F.try_divide("up_n", F.lit(every[1])).alias("fpr"))


def top_features(effects: DataFrame, k: int, *family: str) -> DataFrame:
    """The k features of largest absolute effect in each family, ties by name."""
    w = W.partitionBy(*family).orderBy(F.desc(F.abs("cliffs_delta")), "feature")
    return effects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stable_features(selection: DataFrame, least: float, most: int, fallback: int = 2) -> DataFrame:
    """Features by how often folds chose them (fold, feature, coefficient): those often enough, or the first few."""
    folds = selection.select("fold").distinct().count()
    g = selection.groupBy("feature").agg((F.count_distinct("fold") / F.lit(folds)).alias("frequency"), F.avg(F.abs("coefficient")).alias("mean_absolute"), F.avg("coefficient").alias("mean_signed"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("frequency"), F.desc(F.round("mean_absolute", 9)), "feature")))
    any_ = F.max((F.col("frequency") >= least).cast("int")).over(W.partitionBy()) == 1
    return g.where(F.col("rank") <= most).withColumn("selected", F.when(any_, F.col("frequency") >= least).otherwise(F.col("rank") <= fallback))


def frozen_scores(long: DataFrame, model: DataFrame, intercept: float) -> tuple[DataFrame, DataFrame]:
    """Margins and probabilities of subjects under frozen coefficients, and each feature's contribution.

    model is (feature, imputer_median, scaler_mean, scaler_scale, coefficient), of any number of features: its rows are
    counted, and dealt to parts of about a thousand that each subject meets.
    """
    parts = max(1, -(-model.count() // 1_000))
    subjects = long.select("subject").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    grid = subjects.join(model.withColumn("_part", F.pmod(F.xxhash64("feature"), F.lit(parts)).cast("int")).hint("broadcast" if parts <= 100 else "merge"), "_part").drop("_part")
    v = grid.join(long.select("subject", "feature", "value").hint("merge"), ["subject", "feature"], "left")
    z = (F.coalesce("value", "imputer_median") - F.col("scaler_mean")) / F.col("scaler_scale")
    parts = v.withColumns({"missing": F.col("value").isNull(), "z": z}).withColumn("contribution", F.col("z") * F.col("coefficient"))
    parts = parts.select("subject", "feature", "missing", "z", "contribution")
    score = parts.groupBy("subject").agg((F.sum("contribution") + intercept).alias("margin"))
    return score.withColumns({"probability": 1 / (1 + F.exp(-F.col("margin"))), "predicted": (F.col("margin") >= 0).cast("int")}), parts


def compatibility(parts: DataFrame) -> DataFrame:
    """For each feature of scored subjects: what is missing and how far its scaled values reach."""
    return parts.groupBy("feature").agg(F.count_if("missing").alias("n_missing"), F.avg(F.col("missing").cast("int")).alias("share_missing"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count_if(F.abs("z") > 3).alias("n_far"))


def brown_forsythe(long: DataFrame, group: str) -> DataFrame:
    """F of a one-way analysis of absolute distances from group medians, for each feature."""
    m = quantiles(long, ["feature", group], "value", {"med": 0.5}).drop("n")
    d = long.join(sized(m), ["feature", group]).select("feature", F.col(group).alias("g"), F.abs(F.col("value") - F.col("med")).alias("value"))
    v = variance_shares(d, "g")
    return v.select("feature", "k", "n_total", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n_total") - F.col("k")))).alias("f"))


def ellipses(points: DataFrame, group: str, x: str, y: str, quantile: float = 5.991464547107979) -> DataFrame:
    """Centre, axes and angle of each group's confidence ellipse, from its covariance; quantile is chi-squared's at 2 degrees."""
    g = points.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    return g.select(group, "mx", "my", F.sqrt(quantile * (half + root)).alias("major"), F.sqrt(quantile * F.greatest(half - root, F.lit(0.0))).alias("minor"), (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("angle"))


def subject_distances(z: DataFrame) -> DataFrame:
    """Distance of each two subjects of a cohort in scaled features (subject, feature, z), block by block of subjects."""
    blocks = max(1, -(-z.select("subject").distinct().count() // 500))
    block, every = F.pmod(F.xxhash64("subject"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = z.select(F.col("subject").alias("a"), "feature", F.col("z").alias("za"), block.alias("i"), every.alias("j"))
    b = z.select(F.col("subject").alias("b"), "feature", F.col("z").alias("zb"), every.alias("i"), block.alias("j"))
    d = F.col("za") - F.col("zb")
    return a.join(b.hint("merge"), ["i", "j", "feature"]).where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum(d * d)).alias("distance"))


def exact_mean_difference(values: DataFrame, n_a: int) -> DataFrame:
    """Exact two-sided test of (subject, in_a, value): all ways to choose n_a of the subjects, as joined rows.

    The table must be that of a cohort's subjects, 20 at most; larger ones are refused.
    """
    rows = values.select("subject", "in_a", "value").withColumn("bit", F.row_number().over(W.partitionBy().orderBy("subject")) - 1)
    n = values.count()
    if n > 20:
        raise ValueError(f"{n} subjects are too many to enumerate")
    codes = values.sparkSession.range(1 << n).where(F.bit_count("id") == n_a)
    chosen = F.getbit(F.col("id"), F.col("bit")) == 1
    each = codes.hint("broadcast").join(rows, F.lit(True)).groupBy("id").agg((F.avg(F.when(chosen, F.col("value"))) - F.avg(F.when(~chosen, F.col("value")))).alias("d"))
    seen = rows.agg((F.avg(F.when(F.col("in_a"), F.col("value"))) - F.avg(F.when(~F.col("in_a"), F.col("value")))).alias("observed"))
    return each.join(F.broadcast(seen), F.lit(True)).agg(F.first("observed").alias("observed"), F.count("*").alias("n_assignments"), (F.count_if(F.abs("d") >= F.abs("observed") - 1e-12) / F.count("*")).alias("p"))
