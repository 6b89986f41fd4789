"""Models of every group held out against plain fits of each fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import heldout as H
from tracklore.operators import stats as S


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(8):
        y = g % 2
        for _ in range(30 + 5 * g):
            x = rng.normal(size=3) + np.array([0.9 * y, 0.2 * g, 0.0])
            rows.append((f"g{g}", y, [float(x[0]), float(x[1]) * 10, None if rng.random() < 0.1 else float(x[2])]))
    rows += [(None, 1, [0.0, 0.0, 0.0]), ("g0", None, [0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame(rows, "group string, y int, x array<double>").repartition(4)


def fold(rows, gone):
    own = [r for r in rows if r[0] and r[1] is not None and r[0] not in gone]
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in own])
    y = np.array([r[1] for r in own], float)
    m, s = np.nanmean(x, 0), np.nanstd(x, 0)
    z = np.nan_to_num((x - m) / s)
    return np.column_stack((z, np.ones(len(z)))), y, len(y) / (2 * np.bincount(y.astype(int)))[y.astype(int)]


@pytest.mark.parametrize(("l1", "c"), [(0.0, 1.0), (1.0, 0.05), (0.5, 0.1)])
def test_logistic_folds_are_at_their_optimum(cells, l1, c):
    rows, df = cells
    tasks = H.fit(df, H.left_out([f"g{k}" for k in range(8)], c, l1))
    assert len(tasks) == 8
    for t in tasks:
        z, y, w = fold(rows, t.name)
        slope = z.T @ (w * (1 / (1 + np.exp(-z @ t.beta)) - y))
        assert abs(slope[-1]) < 1e-4
        for k in range(3):
            b, rest = t.beta[k], slope[k] + (1 - l1) / c * t.beta[k]
            assert abs(rest + l1 / c * np.sign(b)) < 1e-4 if b else abs(rest) <= l1 / c + 1e-4


def test_margins_and_their_sigmoid(cells):
    rows, df = cells
    for t in H.fit(df, H.left_out(["g1", "g2", "g3", "g4"], 0.5), "svm"):
        z, y, w = fold(rows, {r[0] for r in rows} - t.learns)
        side = 2 * y - 1
        slope = z.T @ (w * -2 * side * np.maximum(1 - side * (z @ t.beta), 0)) + np.append(t.beta[:-1] / 0.5, 0)
        assert np.abs(slope).max() < 1e-4
        d = np.column_stack((z @ t.beta, np.ones(len(z))))
        assert np.abs(d.T @ (1 / (1 + np.exp(-d @ np.array(t.sigmoid))) - y)).max() < 1e-4


def test_discriminants(cells):
    rows, df = cells
    groups = [f"g{k}" for k in range(8)]
    tasks = H.fit_discriminants(df, H.left_out(groups), 0.2)
    every = np.array([[np.nan if v is None else v for v in r[2]] for r in rows if r[0] and r[1] is not None])
    filled = np.nanmean(every, 0)
    for t in tasks:
        own = [r for r in rows if r[0] in t.learns and r[1] is not None]
        x = np.array([[filled[k] if v is None else v for k, v in enumerate(r[2])] for r in own])
        y = np.array([r[1] for r in own])
        z = (x - t.mean) / t.scale
        m = [z[y == k].mean(0) for k in (0, 1)]
        within = sum((z[y == k] - m[k]).T @ (z[y == k] - m[k]) for k in (0, 1)) / len(y)
        within = 0.8 * within + 0.2 * np.trace(within) / 3 * np.eye(3)
        w = np.linalg.solve(within, m[1] - m[0])
        assert t.beta == pytest.approx(np.append(w, -(m[0] + m[1]) @ w / 2 + np.log((y == 1).sum() / (y == 0).sum())))


def test_groups_are_judged_by_models_that_have_not_seen_them(cells):
    rows, df = cells
    groups = [f"g{k}" for k in range(8)]
    tasks = H.tuned(df, groups, [0.1, 1.0])
    assert [t.name[0] for t in tasks] == groups and all(t.c in (0.1, 1.0) for t in tasks)
    fitted = H.fit(df, tasks)
    got = {r.group: r for r in H.held_out_groups(df, fitted).collect()}
    for t in fitted:
        x = np.array([[np.nan if v is None else v for v in r[2]] for r in rows if r[0] == t.name[0] and r[1] is not None])
        assert got[t.name[0]].probability == pytest.approx(t.probability(x).mean()) and got[t.name[0]].n_cells == len(x)
    one = H.fit(df.where("y = 1"), H.left_out(groups))
    assert one == [] and {r.probability for r in H.held_out_groups(df.where("y = 1"), one).collect() or []} <= {None}


def test_frozen_models_are_read_by_the_scoring(spark, cells, tmp_path):
    rows, df = cells
    groups = [f"g{k}" for k in range(8)]
    tasks = H.exclusion_tasks({"all": frozenset(groups), "half": frozenset(groups[:4])}, {"none": frozenset(), "first": frozenset(["g0"])}, 1.0)
    table = H.freeze(df, ["a", "b", "c"], str(tmp_path / "model"), tasks)
    facts = H.read_sidecar(spark, str(tmp_path / "model_facts"))
    assert facts["models"]["half|first"]["groups"] == ["g1", "g2", "g3"] and table.count() == 12
    one = table.where("model = 'half|none'")
    long = df.where("group = 'g5' AND y = 1").groupBy(F.col("group").alias("subject")).agg(*[F.avg(F.col("x")[k]).alias(f) for k, f in enumerate("abc")]).unpivot("subject", ["a", "b", "c"], "feature", "value")
    score = S.frozen_scores(long, one, one.first().intercept)[0].first()
    t = next(t for t in H.fit(df, [x for x in tasks if x.name == ("half", "none")]))
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in rows if r[0] == "g5"])
    assert score.margin == pytest.approx(float(t.decision(np.nanmean(x, 0)[None])[0]))


@pytest.mark.parametrize("loss", ["logistic", "svm"])
def test_a_pass_gives_the_sums_of_each_task(cells, loss):
    rows, df = cells
    live = df.where("group IS NOT NULL AND y IN (0, 1)")
    tasks = H.prepare(H.left_out([f"g{k}" for k in range(8)]), H.group_sums(live), 3)
    for k, t in enumerate(tasks):
        t.beta = np.array([3.0, -0.5, 40.0 * k, 0.2])
    for t, sums in zip(tasks, H._pass(live, tasks, loss, False), strict=True):
        z, y, w = fold(rows, t.name)
        m, side = z @ t.beta, 2 * y - 1
        short = np.maximum(1 - side * m, 0)
        p = 1 / (1 + np.exp(-m))
        value, first, second = (np.logaddexp(0, m) - y * m, p - y, p * (1 - p)) if loss == "logistic" else (short**2, -2 * side * short, 2.0 * (short > 0))
        want = np.concatenate(([(w * value).sum()], z.T @ (w * first), ((z * (w * second)[:, None]).T @ z).ravel()))
        assert np.allclose(sums, want, rtol=1e-9, atol=1e-7)
