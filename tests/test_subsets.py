"""Subsets against plain least squares without each subject in turn."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import subsets as U

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(9)
    y = np.arange(30) % 3 == 0
    x = rng.normal(size=(30, 4)) + 0.8 * np.outer(y, [1, 0.5, 0, 0])
    return x, y.astype(float), spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(30)], "subject int, y int, a double, b double, c double, d double")


def plain(x, y, own):
    m = np.column_stack((np.ones(len(y)), x[:, own]))
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    share = 1 - ((y - m @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    ahead = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        ahead.append(m[i] @ np.linalg.lstsq(m[rest], y[rest], rcond=None)[0])
    ahead = np.array(ahead)
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in ahead[y == 1] for q in ahead[y == 0]])
    return share, ((ahead[y == 1] >= 0.5).mean() + (ahead[y == 0] < 0.5).mean()) / 2, auc


def test_all_subsets(subjects):
    x, y, df = subjects
    got = {r.subset: r for r in U.screen(df, NAMES, most=3, families={"first": ["a", "b"]}).collect()}
    assert len(got) == 1 + 1 + 4 + 6 + 4
    every = plain(x, y, [0, 1, 2, 3])
    for r in got.values():
        want = plain(x, y, [NAMES.index(f) for f in r.features.split("|")])
        assert (r.r_squared, r.balanced_accuracy, r.auc) == pytest.approx(want)
        assert (r.delta_r_squared, r.delta_balanced_accuracy, r.delta_auc) == pytest.approx(np.subtract(want, every))
    assert got["without b"].features == "a|c|d" and got["family first"].features == "a|b"


def test_elimination_removes_what_costs_least(subjects):
    x, y, df = subjects
    steps, own = U.eliminate(df, NAMES).orderBy("step").collect(), [0, 1, 2, 3]
    for r in steps[1:]:
        costs = {k: plain(x, y, [i for i in own if i != k])[0] for k in own}
        gone = max(costs, key=costs.get)
        assert r.removed == NAMES[gone]
        own.remove(gone)
        assert (r.size, r.r_squared) == (len(own), pytest.approx(costs[gone]))


def test_features_that_follow_from_others(subjects):
    x, y, df = subjects
    more = df.withColumns({"d": F.col("a") * 2 - F.col("b"), "c": F.lit(1.0)})
    got = {r.subset: r for r in U.screen(more, NAMES, most=2).collect()}
    assert got["all"].r_squared == pytest.approx(plain(x, y, [0, 1])[0])
    assert {r.removed for r in U.eliminate(more, NAMES).where("step IN (1, 2)").collect()} == {"c", "d"}


def test_sweeps_undo_each_other():
    m = np.cov(np.random.default_rng(1).normal(size=(5, 40)))
    for order in itertools.permutations(range(3)):
        done = m
        for k in order:
            done = U.sweep(done, k)
        assert -done[:3, :3] == pytest.approx(np.linalg.inv(m[:3, :3]))
    assert U.sweep(U.sweep(m, 2), 2)[:2, :2] == pytest.approx(m[:2, :2])
