"""Learning on subjects and cells: projections, nested leave-one-out, permutations, resampling, factorial tests.

A subject table is a cohort's, at most SUBJECTS rows; it goes whole to tasks that each fit one fold or permutation.
Tables of cells are learnt from with Spark's own estimators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a subject table, at most.
SUBJECTS = 5_000


def pca_scores(df: DataFrame, k: int) -> DataFrame:
    """Scores of x, of any width, on its first k principal axes, signs set so that each axis's largest loading is positive."""
    rows = df.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    axes = PCA(k=k, inputCol="features", outputCol="pc").fit(rows).pc.toArray()
    mean = rows.agg(Summarizer.mean(F.col("features"))).first()[0].toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(k)])

    def score(j: int) -> Column:
        products = F.zip_with(F.col("x").cast("array<double>"), F.array(*map(F.lit, axes[:, j].tolist())), lambda a, b: a * b)
        return F.aggregate(products, F.lit(-float(mean @ axes[:, j])), lambda s, v: s + v)

    return df.select(*[c for c in df.columns if c != "x"], *[score(j).alias(f"pc{j + 1}") for j in range(k)])


def kmeans(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The cluster of each row's x."""
    rows = df.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("features", "x")


def group_split_check(df: DataFrame, seed: int = 42, trees: int = 300) -> DataFrame:
    """Accuracy of a forest with rows split at random and with whole groups held out: a gap shows leakage between groups.

    The class is the parity of the label; a group is the row id modulo 20.
    """
    rows = df.select("vec_id", (F.col("label") % 2).cast("double").alias("y"), (F.col("vec_id") % 20).alias("g"), array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    out = None
    for name, part in (("random", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(5)) == 0), ("group", F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(5)) == 0)):
        forest = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="y", featuresCol="features").fit(rows.where(~part))
        found = forest.transform(rows.where(part)).agg(F.lit(name).alias("split"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"))
        out = found if out is None else out.unionAll(found)
    return out


def subject_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, y, x) of nations as subjects, from their customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("subject"))
    g = c.agg(F.avg("c_acctbal").alias("a"), F.median("c_acctbal").alias("b"), F.stddev_samp("c_acctbal").alias("c"), F.count("*").cast("double").alias("d"))
    return g.select("subject", (F.col("subject") % 3 == 0).cast("int").alias("y"), F.array("a", "b", "c", "d").alias("x"))


def _bounded(df: DataFrame, *columns: str) -> pd.DataFrame:
    rows = df.select(*columns).limit(SUBJECTS + 1).toPandas()
    if len(rows) > SUBJECTS:
        raise ValueError(f"a subject table has at most {SUBJECTS} rows")
    return rows


def fit(x: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Median, mean, scale and weights (constant last) of an L2 logistic model on these rows alone; balanced classes."""
    median = np.nanmedian(x, axis=0)
    filled = np.where(np.isnan(x), median, x)
    mean, scale = filled.mean(0), filled.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack(((filled - mean) / scale, np.ones(len(x))))
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1 / c), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return median, mean, scale, w


def score(model: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    median, mean, scale, w = model
    z = (np.where(np.isnan(x), median, x) - mean) / scale
    return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def balanced_accuracy(y: np.ndarray, said: np.ndarray) -> float:
    return float(np.mean([np.mean(said[y == k] == k) for k in (0, 1) if (y == k).any()]))


def nested_fold(x: np.ndarray, y: np.ndarray, i: int, grid: Sequence[float]) -> tuple[float, float]:
    """(probability of subject i, chosen C) with everything, the choice too, fitted on the other subjects."""
    keep = np.arange(len(y)) != i
    x0, y0 = x[keep], y[keep]
    part = np.empty(len(y0), int)
    for k in (0, 1):
        part[y0 == k] = np.arange((y0 == k).sum()) % 3
    best = (-1.0, 0.0)
    for c in grid if len(grid) > 1 else ():
        said = np.empty(len(y0))
        for f in range(3):
            if len(set(y0[part != f])) == 2:
                said[part == f] = score(fit(x0[part != f], y0[part != f], c), x0[part == f]) >= 0.5
        best = max(best, (balanced_accuracy(y0, said), -c))
    c = -best[1] if len(grid) > 1 else grid[0]
    return float(score(fit(x0, y0, c), x[i : i + 1])[0]), c


def leave_one_out(subjects: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(subject, y, probability, predicted, c) of every subject, one task row each, by nested leave-one-out."""
    rows = _bounded(subjects, "subject", "y", "x").sort_values("subject", ignore_index=True)
    x, y = np.stack(rows["x"]).astype(float), rows["y"].to_numpy(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [nested_fold(x, y, i, grid) for i in batch["id"]]
            yield pd.DataFrame({"subject": rows["subject"].to_numpy()[batch["id"]], "y": y[batch["id"]], "probability": [p for p, _ in found], "predicted": [int(p >= 0.5) for p, _ in found], "c": [c for _, c in found]})

    return subjects.sparkSession.range(len(rows)).mapInPandas(run, "subject long, y int, probability double, predicted int, c double")


def permutation_test(subjects: DataFrame, grid: Sequence[float], times: int, seed: int) -> DataFrame:
    """Balanced accuracy of leave-one-out against its values with permuted labels: p = (1 + at least as good) / (n + 1)."""
    rows = _bounded(subjects, "subject", "y", "x").sort_values("subject", ignore_index=True)
    x, y = np.stack(rows["x"]).astype(float), rows["y"].to_numpy(int)
    rng = np.random.default_rng(seed)
    labels = np.stack([y, *[rng.permutation(y) for _ in range(times)]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [balanced_accuracy(labels[k], np.array([nested_fold(x, labels[k], i, grid)[0] >= 0.5 for i in range(len(y))])) for k in batch["id"]]
            yield pd.DataFrame({"permutation": batch["id"], "accuracy": out})

    each = subjects.sparkSession.range(times + 1).mapInPandas(run, "permutation long, accuracy double")
    observed, null = F.max(F.when(F.col("permutation") == 0, F.col("accuracy"))), F.when(F.col("permutation") > 0, F.col("accuracy"))
    g = each.agg(observed.alias("observed"), F.count(null).alias("n_permutations"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("sd"), F.collect_list(null).alias("all"))
    return g.select("observed", "n_permutations", "mean", "sd", ((1 + F.size(F.filter("all", lambda v: v >= F.col("observed")))) / (F.col("n_permutations") + 1)).alias("p"))


def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(in_b, value): median balances of nations, by group."""
    return subject_matrix(spark, sf_dir).select((F.col("y") == 1).alias("in_b"), F.col("x")[1].alias("value"))


def bootstrap_delta(rows: DataFrame, times: int, seed: int) -> DataFrame:
    """Cliff's delta of two groups of subjects with the 95 % range of its resampled values, each with its own seed."""
    data = _bounded(rows, "in_b", "value")
    a, b = (np.sort(data.loc[data["in_b"] == k, "value"].to_numpy(float)) for k in (False, True))

    def delta(u: np.ndarray, v: np.ndarray) -> float:
        u = np.sort(u)
        return float((np.searchsorted(u, v, "left") - (len(u) - np.searchsorted(u, v, "right"))).sum() / (len(u) * len(v)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                out.append(delta(rng.choice(a, len(a)), rng.choice(b, len(b))))
            yield pd.DataFrame({"delta": out})

    each = rows.sparkSession.range(times).mapInPandas(run, "delta double")
    return each.agg(F.lit(delta(a, b)).alias("delta"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"))


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, a, b, value): order totals and line prices by two two-level factors."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 3 == 0).cast("double").alias("a"), (F.col("o_orderkey") % 2 == 0).cast("double").alias("b"), F.col("o_totalprice").alias("total"), F.length("o_orderpriority").cast("double").alias("priority"))
    return rows.unpivot(["a", "b"], ["total", "priority"], "feature", "value")


def factorial(rows: DataFrame) -> DataFrame:
    """Two-way least squares with interaction for each feature: HC3 errors and Wald F of each term.

    The design has four cells, so counts, sums and sums of squares by cell are all that a fit needs; leverage is the
    same within a cell. Groups meet the driver's code as four rows of sums.
    """
    cells = rows.where("value IS NOT NULL").groupBy("feature", "a", "b").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("ss"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4 or (pdf["n"] < 2).any():
            return pd.DataFrame({"feature": [], "term": [], "estimate": [], "f": []})
        design = np.column_stack((np.ones(4), pdf["a"], pdf["b"], pdf["a"] * pdf["b"])).astype(float)
        n, m = pdf["n"].to_numpy(float), pdf["m"].to_numpy(float)
        inverse = np.linalg.inv(design)
        beta = inverse @ m
        residual = np.maximum(pdf["ss"].to_numpy(float) - n * m * m, 0) / (1 - 1 / n) ** 2
        cov = inverse @ np.diag(residual / n**2) @ inverse.T
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "term": ["constant", "a", "b", "a:b"], "estimate": beta, "f": beta**2 / np.maximum(np.diag(cov), 1e-300)})

    return cells.groupBy("feature").applyInPandas(run, "feature string, term string, estimate double, f double")
