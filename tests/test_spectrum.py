"""Spectrum, clusters and resampled intervals against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import spectrum as P


def test_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    n, mean, cov = P.moments(df)
    assert n == 200 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T), rel=1e-6)
    got = P.spectrum(df, list("abcd"), 3).collect()
    value, axes = np.linalg.eigh(np.corrcoef(x.T))
    for r in got:
        k, i = 4 - r.component, "abcd".index(r.feature)
        axis = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
        assert r.loading == pytest.approx(axis[i] * np.sqrt(value[k]), abs=1e-6) and r.contribution == pytest.approx(100 * axis[i] ** 2, abs=1e-5) and r.share == pytest.approx(value[k] / 4, abs=1e-6)


def test_number_of_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(scale=0.2, size=2) + [10 * (k % 3), 5 * (k % 3 == 1)]).tolist()) for k in range(120)]
    table, told = P.choose_clusters(spark.createDataFrame(rows, "g int, x array<double>"), range(2, 6))
    assert [r.k for r in table.where("chosen").collect()] == [3]
    shares = P.cluster_shares(told.withColumn("g", F.col("g") % 3), "g").collect()
    assert len(shares) == 3 and all(r.share == 1.0 and r.n == 40 for r in shares)


def test_intervals(spark):
    rng = np.random.default_rng(4)
    rows = [(f, g, float(v)) for f, d in (("x", 1.0), ("y", 0.0)) for g in ("WT", "MUT") for v in np.round(rng.normal(d * (g == "MUT"), 1, 60), 1)]
    df = spark.createDataFrame(rows, "feature string, genotype string, value double")
    got = {r.feature: r for r in P.effect_intervals(df, "WT", "MUT", 2000).collect()}
    again = {r.feature: r for r in P.effect_intervals(df.repartition(7), "WT", "MUT", 2000).collect()}
    assert got == again
    for f in "xy":
        a, b = (np.array([r[2] for r in rows if r[:2] == (f, g)]) for g in ("WT", "MUT"))
        delta = lambda a, b: np.sign(b[:, None] - a).mean()
        draws = [delta(rng.choice(a, 60), rng.choice(b, 60)) for _ in range(2000)]
        assert got[f].delta == pytest.approx(delta(a, b))
        assert (got[f].low, got[f].high) == pytest.approx(np.quantile(draws, [0.025, 0.975]), abs=0.03)
