"""Spectrum of features with loadings and contributions, number of clusters by silhouette, and effects with resampled intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.operators.lineage import kept, running

#: Features whose square of sums goes to the driver, at most; replicates of a feature drawn in one row.
WIDTH, AT_ONCE = 1_000, 500


def moments(df: DataFrame, column: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """(count, means, covariances) of an array column whose values are all finite, from sums of each partition.

    Sums are about the first partitions' own means and put together pair by pair, so that large means cost no digits.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, gram = 0, None, None
        for batch in batches:
            x = np.stack(batch["x"]).astype(float)
            m = x.mean(0)
            own = (x - m).T @ (x - m)
            if mean is None:
                n, mean, gram = len(x), m, own
            else:
                apart = m - mean
                gram = gram + own + np.outer(apart, apart) * n * len(x) / (n + len(x))
                mean, n = mean + apart * len(x) / (n + len(x)), n + len(x)
        if mean is not None:
            yield pd.DataFrame({"n": [n], "mean": [mean], "gram": [gram.ravel()]})

    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    if width > WIDTH:
        raise ValueError(f"more than {WIDTH} features")
    n, mean, gram = 0, np.zeros(width), np.zeros((width, width))
    for r in rows.mapInPandas(run, "n long, mean array<double>, gram array<double>").toLocalIterator():
        m, own = np.array(r["mean"]), np.array(r["gram"]).reshape(width, width)
        apart = m - mean
        gram = gram + own + np.outer(apart, apart) * n * r["n"] / (n + r["n"])
        mean, n = mean + apart * r["n"] / (n + r["n"]), n + r["n"]
    return n, mean, gram / max(n - 1, 1)


def spectrum(df: DataFrame, features: Sequence[str], most: int, scaled: bool = True) -> DataFrame:
    """(component, feature, loading, contribution, variance, share, cumulative) of the first principal axes of x.

    With scaled, of the correlations. A loading is the axis's coefficient times the root of its variance, a contribution
    the share of the axis's length in per cent; signs make each axis's largest coefficient, of equals the first, positive. All comes from one
    matrix of sums; a constant feature has no loading.
    """
    _, _, cov = moments(df)
    if scaled:
        size = np.sqrt(np.diag(cov))
        size = np.where(size > 1e-12, size, np.inf)
        cov = cov / np.outer(size, size)
    value, axes = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:most]
    value_of, total = np.maximum(value[order], 0), max(float(value.sum()), 1e-300)
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.round(np.abs(axes), 9).argmax(0), np.arange(len(order))])
    up = np.cumsum(value_of) / total
    rows = [(k + 1, f, float(axes[i, k] * np.sqrt(value_of[k])), float(100 * axes[i, k] ** 2), float(value_of[k]), float(value_of[k] / total), float(up[k])) for k in range(len(order)) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, contribution double, variance double, share double, cumulative double")


def choose_clusters(df: DataFrame, counts: Sequence[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((k, silhouette, chosen), df with cluster) over several numbers of clusters: the best silhouette, the fewest of equals.

    Silhouettes are of squared distances, which need only sums of each cluster: a pass for each k, linear in the rows.
    """
    rows = kept(df.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))))
    judge, found = ClusteringEvaluator(featuresCol="features", predictionCol="cluster"), []
    for k in counts:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
        told = model.transform(rows)
        several = told.select("cluster").distinct().limit(2).count() > 1
        found.append((k, round(float(judge.evaluate(told)), 9) if several else -1.0, model))
    best = max(found, key=lambda f: (f[1], -f[0]))
    table = df.sparkSession.createDataFrame([(k, s, k == best[0]) for k, s, _ in found], "k int, silhouette double, chosen boolean")
    return table, best[2].transform(rows).drop("features")


def cluster_shares(assigned: DataFrame, *group: str) -> DataFrame:
    """How many rows of each group each cluster has, and their share of the group."""
    n = assigned.groupBy(*group, "cluster").agg(F.count("*").alias("n"))
    total = assigned.groupBy(*group).agg(F.count("*").alias("_total"))
    return n.join(total.hint("merge"), list(group)).select(*group, "cluster", "n", (F.col("n") / F.col("_total")).alias("share"))


def effect_intervals(long: DataFrame, a: str, b: str, replicates: int = 20_000, seed: int = 42, group: str = "genotype") -> DataFrame:
    """(feature, n_a, n_b, delta, low, high): Cliff's delta of b against a with a resampled 95 % interval.

    A replicate weighs every row by a Poisson draw of mean one, so a distinct value by one of its count; a draw comes
    from the feature, value and replicates alone, so the result does not depend on partitions. Values are dealt to ranges
    of their order, each range gives its sums for AT_ONCE replicates in a row of arrays, and ranges are put together in
    order: a feature of any number of values is many tasks' work.
    """
    spark = long.sparkSession
    v = long.where(F.col("value").isNotNull() & F.col(group).isin(a, b))
    counts = v.groupBy("feature", "value").agg(F.count(F.when(F.col(group) == a, 1)).alias("a"), F.count(F.when(F.col(group) == b, 1)).alias("b"))
    counts = kept(counts)
    up = running(counts, ["feature"], "value", {"up": (F.sum, F.col("a"))})
    real = up.groupBy("feature").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), (F.sum(F.col("b") * (2 * F.col("up") - F.col("a"))) / (F.sum("a") * F.sum("b")) - 1).alias("delta"))
    blocks = -(-replicates // AT_ONCE)
    ranged = kept(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "feature", "value").withColumn("range", F.spark_partition_id()))
    dealt = ranged.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    size = lambda block: min(AT_ONCE, replicates - block * AT_ONCE)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        feature, block = pdf["feature"].iloc[0], int(pdf["block"].iloc[0])
        n = size(block)
        below, others, won = np.zeros(n), np.zeros(n), np.zeros(n)
        for value, x, y in zip(pdf["value"].to_numpy(float), pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            rng = np.random.default_rng([seed, block, int(value.view(np.uint64)), *feature.encode()])
            p, q = rng.poisson(x, n), rng.poisson(y, n)
            won += q * (2 * below + p)
            below += p
            others += q
        return pd.DataFrame({"feature": [feature], "block": [block], "range": [int(pdf["range"].iloc[0])], "won": [won], "a": [below], "b": [others]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        won, below, others = 0.0, 0.0, 0.0
        for w, x, y in pdf.sort_values("range")[["won", "a", "b"]].itertuples(index=False):
            won, below, others = won + w + 2 * below * y, below + x, others + y
        pairs = below * others
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "delta": np.where(pairs > 0, won / np.maximum(pairs, 1) - 1, np.nan)})

    parts = dealt.groupBy("feature", "range", "block").applyInPandas(part, "feature string, block int, range int, won array<double>, a array<double>, b array<double>")
    each = parts.groupBy("feature", "block").applyInPandas(whole, "feature string, delta double").where("NOT isnan(delta)")
    ends = each.groupBy("feature").agg(F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"))
    return real.where("n_a > 0 AND n_b > 0").join(ends.hint("merge"), "feature").select("feature", "n_a", "n_b", "delta", "low", "high")
