"""Running sums, quantiles, reports and sinks on small cases, where SQL does not reach."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklore.operators import learn as L
from tracklore.operators import regions as G
from tracklore.operators import reports as P
from tracklore.operators import stats as S
from tracklore.operators.lineage import quantiles, running
from tracklore.sources import tables
from tracklore.streaming import link_stream as Q


def test_running_and_quantiles_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"k": ["hot"] * 900 + ["cold"] * 20 + ["one"], "v": [*rng.permutation(900), *rng.permutation(20), 5], "w": rng.integers(0, 9, 921)})
    df = spark.createDataFrame(rows)
    got = running(df, ["k"], "v", {"s": (F.sum, F.col("w")), "m": (F.min, F.col("w"))}).toPandas().sort_values(["k", "v"])
    want = rows.sort_values(["k", "v"])
    assert got.s.tolist() == want.groupby("k").w.cumsum().tolist() and got.m.tolist() == want.groupby("k").w.cummin().tolist()
    down = running(df.withColumn("x", F.monotonically_increasing_id()), [], "x", {"s": (F.sum, F.lit(1))}, down=True)
    assert sorted(r.s for r in down.collect()) == list(range(1, 922))
    q = {r.k: r for r in quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}).collect()}
    for k, own in rows.groupby("k"):
        assert np.allclose([q[k].a, q[k].b, q[k].c], np.quantile(own.v, [0.1, 0.5, 0.999])) and q[k].n == len(own)


def test_frozen_model_of_many_features(spark):
    n = 10_001
    model = spark.range(n).select(F.concat(F.lit("f"), "id").alias("feature"), F.lit(1.0).alias("imputer_median"), F.lit(0.0).alias("scaler_mean"), F.lit(2.0).alias("scaler_scale"), F.lit(1.0).alias("coefficient"))
    long = spark.createDataFrame([("s", "f10000", 5.0), ("t", "f0", 3.0)], "subject string, feature string, value double")
    scores, parts = S.frozen_scores(long, model, 0.5)
    assert {r.subject: r.margin for r in scores.collect()} == {"s": (n - 1) / 2 + 3.0, "t": (n - 1) / 2 + 2.0} and parts.count() == 2 * n


def test_projection_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 20)) @ np.diag(np.arange(1, 21))
    got = L.pca_scores(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>"), 2).orderBy("id").toPandas()
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    for j in range(2):
        axis = v[j] * np.sign(v[j][np.abs(v[j]).argmax()])
        assert np.allclose(got[f"pc{j + 1}"], c @ axis, atol=1e-6)


def test_checks_that_raise(spark):
    points, mask = spark.createDataFrame([(1, 2.4, 3.6)], "block int, y double, x double"), spark.createDataFrame([(1, 2, 4)], "block int, y int, x int")
    with pytest.raises(ValueError, match="outside"):
        G.must_be_outside(points, mask, ["block"])
    assert G.censored(points, mask, ["block"]).isEmpty()
    blocks = spark.createDataFrame([("a", 1), ("b", None)], "block string, n int")
    with pytest.raises(ValueError, match="failed"):
        P.block_audit(blocks, "block", {"n is missing": F.col("n").isNotNull()}, F.lit(False), strict=True)
    frames = spark.createDataFrame([(0,), (9,)], "t int")
    with pytest.raises(ValueError, match="frames"):
        P.time_offset(frames, "t", 5)
    labels = spark.createDataFrame([(1, 5)], "f int, label int")
    with pytest.raises(ValueError, match="label"):
        P.label_column(spark.createDataFrame([(1, 6)], "f int, a int"), ["a"], labels, ["f"], "label")


def test_fold_filter_prefers_full_and_varied_features(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=40)
    value = {"a": base, "b": base * 3, "c": rng.normal(size=40), "d": np.where(np.arange(40) < 5, np.nan, base), "e": np.full(40, np.nan)}
    rows = [(0, k, f, None if np.isnan(v[k]) else float(v[k])) for f, v in value.items() for k in range(40)]
    got = {r.feature: r.reason for r in P.fold_filter(spark.createDataFrame(rows, "fold int, subject int, feature string, value double"), "fold", 0.3, 0.85, "abcde").collect()}
    assert got == {"a": "follows b", "b": None, "c": None, "d": "follows b", "e": "missing"}


def test_harvest_reads_results_by_their_paths(spark, tmp_path):
    for method, model, acc in (("svm", "b", 0.8), ("lap", "c", 0.7)):
        folder = tmp_path / method / model / "muscle"
        folder.mkdir(parents=True)
        (folder / "metrics.csv").write_text(f"balanced_accuracy,n\n{acc},19\n")
    got = P.harvest(spark, str(tmp_path), r"([^/]+)/([^/]+)/([^/]+)/metrics\.csv$")
    assert {(r.method, r.model, r.dataset, r.balanced_accuracy, r.n) for r in got.collect()} == {("svm", "b", "muscle", 0.8, 19), ("lap", "c", "muscle", 0.7, 19)}


def test_upserts_replace_rows_and_may_be_replayed(spark, tmp_path):
    write = Q.keep_last_writer(str(tmp_path / "t"), ["k"], "at", buckets=4)
    first = spark.createDataFrame([(k, 1, "a") for k in range(20)], "k int, at int, v string")
    second = spark.createDataFrame([(3, 2, "b"), (4, 0, "old"), (99, 1, "new")], "k int, at int, v string")
    for n, batch in enumerate((first, second, second)):
        write(batch, n)
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {**{k: "a" for k in range(20)}, 3: "b", 99: "new"}


def test_appended_split_keeps_old_parts(spark):
    files = spark.range(60).select(F.col("id").cast("string").alias("path"))
    old = tables.split_files(files.where("id < 40"), (0.5, 0.25), 1)
    new = tables.split_files(files, (0.5, 0.25), 1, old)
    assert {(r.path, r.part) for r in old.collect()} <= {(r.path, r.part) for r in new.collect()} and new.count() == 60
    assert {r.part: r["count"] for r in new.groupBy("part").count().collect()} == {"train": 30, "validation": 15, "test": 15}
