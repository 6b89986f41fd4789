"""Tails against closed forms and numerical integrals; rank, factorial, exact and permutation tests against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import inference as I


def integral(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / (n - 1) / 3)


def f_exact(f, d1, d2):
    """By integrating over the angle whose squared sine is beta distributed: smooth for degrees of 1, too."""
    scale = 2 * math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2))
    return scale * integral(lambda u: np.sin(u) ** (d2 - 1) * np.cos(u) ** (d1 - 1), 0, math.asin(math.sqrt(d2 / (d2 + d1 * f))))


def chi_exact(x, d):
    scale = 2 / (2 ** (d / 2) * math.gamma(d / 2))
    return 1 - scale * integral(lambda u: u ** (d - 1) * np.exp(-u * u / 2), 0, math.sqrt(x))


def test_tails(spark):
    grid = [(f, float(a), float(b)) for f in (0.0, 0.01, 0.5, 1.0, 3.7, 25.0) for a in (1, 2, 5, 40) for b in (1, 3, 24, 900)]
    got = spark.createDataFrame(grid, "f double, a double, b double").select("f", "a", "b", I.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p"), I.t_tail(F.col("f"), F.col("b")).alias("t"), I.chi_squared_tail(F.col("f"), F.col("a")).alias("c")).collect()
    for r in got:
        assert r.p == pytest.approx(f_exact(r.f, r.a, r.b), abs=1e-8)
        assert r.t == pytest.approx(f_exact(r.f**2, 1, r.b), abs=1e-8)
        assert r.c == pytest.approx(chi_exact(r.f, r.a), abs=1e-8)
    df = [1.0, 2.0, 7.0, 60.0, 5000.0]
    got = spark.createDataFrame([(x,) for x in df], "df double").select("df", I.t_quantile(0.05, F.col("df")).alias("q"), I.log_gamma(F.col("df")).alias("g")).collect()
    for r in got:
        assert f_exact(r.q**2, 1, r.df) == pytest.approx(0.05, abs=1e-8)
        assert r.g == pytest.approx(math.lgamma(r.df), rel=1e-11, abs=1e-11)


def test_kruskal(spark):
    rng = np.random.default_rng(1)
    rows = [(f, g, float(v)) for f in "xy" for g in "abc" for v in rng.integers(0, 8, 30) + (g == "b") * (f == "x")] + [("same", "a", 1.0), ("same", "b", 1.0), ("one", "a", 2.0), ("one", "a", None)]
    got = {r.feature: r for r in I.kruskal(spark.createDataFrame(rows, "feature string, g string, value double"), "g").collect()}
    for f in "xy":
        v, g = np.array([r[2] for r in rows if r[0] == f]), np.array([r[1] for r in rows if r[0] == f])
        rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        n, ties = len(v), np.unique(v, return_counts=True)[1].astype(float)
        h = (12 / (n * (n + 1)) * sum(rank[g == k].sum() ** 2 / (g == k).sum() for k in "abc") - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
        assert got[f].h == pytest.approx(h) and got[f].p == pytest.approx(math.exp(-h / 2), rel=1e-9)
    assert got["same"].h is None and got["one"].p is None


def test_factorial_equals_the_fit_of_all_rows(spark):
    rng = np.random.default_rng(2)
    a, b = ["WT", "MUT"], ["none", "mmp", "lira"]
    rows = [(f, g, c, float(rng.normal(k * (g == "MUT"), 1 + (c == "mmp")))) for k, f in enumerate(("x", "y")) for g in a for c in b for _ in range(4 + len(c) + k)]
    df = spark.createDataFrame(rows, "feature string, a string, b string, value double")
    terms = {(r.feature, r.term): r for r in I.factorial_terms(df, a, b).collect()}
    told = {(r.feature, r.contrast): r for r in I.factorial_contrasts(df, a, b).collect()}
    for f in ("x", "y"):
        own = [r for r in rows if r[0] == f]
        x = np.array([I.factorial_design(3)[a.index(r[1]) * 3 + b.index(r[2])] for r in own])
        y, inverse = np.array([r[3] for r in own]), np.linalg.inv(x.T @ x)
        beta = inverse @ x.T @ y
        left = y - x @ beta
        cov = inverse @ (x.T @ (x * ((left / (1 - ((x @ inverse) * x).sum(1))) ** 2)[:, None])) @ inverse
        for term, columns in {"a": [1], "b": [2, 3], "a:b": [4, 5]}.items():
            wald = beta[columns] @ np.linalg.inv(cov[np.ix_(columns, columns)]) @ beta[columns] / len(columns)
            rest = np.delete(x, columns, axis=1)
            more = ((y - rest @ np.linalg.lstsq(rest, y, rcond=None)[0]) ** 2).sum() - left @ left
            r = terms[f, term]
            assert r.f == pytest.approx(wald) and r.partial_eta_squared == pytest.approx(more / (more + left @ left)) and r.p == pytest.approx(f_exact(wald, len(columns), len(y) - 6), abs=1e-8)
        v = I.factorial_design(3)[3] - I.factorial_design(3)[0]
        r = told[f, "MUT - WT | none"]
        error = math.sqrt(v @ cov @ v)
        assert r.estimate == pytest.approx(v @ beta) and r.error == pytest.approx(error) and f_exact(((r.high - r.low) / 2 / error) ** 2, 1, len(y) - 6) == pytest.approx(0.05, abs=1e-8)
    assert len(told) == 2 * 7 and all(r.q >= r.p - 1e-12 for r in told.values())
    assert I.factorial_terms(df.where("b <> 'mmp'"), a, b).count() == 0


def test_exact_nulls_equal_enumeration_and_go_further(spark):
    rng = np.random.default_rng(3)
    rows = [(c, bool(k % 3 == 0), float(s), bool(s > 4)) for c in ("u", "v") for k, s in enumerate(rng.integers(0, 9, 12))]
    rows += [("large", bool(k % 2), float(rng.normal() + k % 2), bool(rng.random() < 0.5)) for k in range(60)] + [("one class", True, 1.0, True), (None, True, 1.0, None)]
    got = {r.cohort: r for r in I.exact_label_nulls(spark.createDataFrame(rows, "cohort string, positive boolean, score double, predicted boolean"), ["cohort"]).collect()}

    def auc(y, s):
        return np.mean([(p > q) + 0.5 * (p == q) for p in s[y] for q in s[~y]])

    for c in ("u", "v"):
        y, s, p = (np.array([r[k] for r in rows if r[0] == c]) for k in (1, 2, 3))
        null = []
        for own in itertools.combinations(range(12), int(y.sum())):
            t = np.zeros(12, bool)
            t[list(own)] = True
            null.append((auc(t, s), (p[t].mean() + (~p[~t]).mean()) / 2))
        u, b = np.array(null).T
        seen, mine = auc(y, s), (p[y].mean() + (~p[~y]).mean()) / 2
        want = [((u >= seen - 1e-12).sum() + 1) / (len(u) + 1), ((abs(u - 0.5) >= abs(seen - 0.5) - 1e-12).sum() + 1) / (len(u) + 1), ((b >= mine - 1e-12).sum() + 1) / (len(u) + 1)]
        assert [got[c].auc_p, got[c].auc_two_sided_p, got[c].balanced_accuracy_p] == pytest.approx(want)
        assert got[c].auc == pytest.approx(seen) and got[c].balanced_accuracy == pytest.approx(mine) and got[c].label_sets == len(u)
    assert 0 < got["large"].auc_p < 1 and got["large"].label_sets == pytest.approx(math.comb(60, 30)) and set(got) == {"u", "v", "large"}


def test_permutation_tests_of_a_cohort(spark):
    rng = np.random.default_rng(4)
    who = [(k, "MUT" if k % 2 else "WT", ("none", "mmp", "lira")[k % 3]) for k in range(36)]
    x = rng.normal(size=(36, 7)) + np.array([[1.5 * (g == "MUT")] * 7 for _, g, _ in who])
    z = spark.createDataFrame([(f"f{j}", k, float(x[k, j])) for k in range(36) for j in range(7)], "feature string, subject int, z double")
    groups = spark.createDataFrame(who, "subject int, a string, b string")
    a, b = ["WT", "MUT"], ["none", "mmp", "lira"]
    got = {r.term: r for r in I.permanova(z, groups, a, b, 199).collect()}
    design = np.array([I.factorial_design(3)[a.index(g) * 3 + b.index(c)] for _, g, c in who])

    def squares(y, m):
        return float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())

    for term, columns in {"a": [1], "b": [2, 3], "a:b": [4, 5]}.items():
        rest = np.delete(design, columns, axis=1)
        pseudo = lambda y, rest=rest, columns=columns: (squares(y, rest) - squares(y, design)) / len(columns) / (squares(y, design) / 30)
        fitted = rest @ np.linalg.lstsq(rest, x, rcond=None)[0]
        null = [pseudo(fitted + (x - fitted)[np.random.default_rng([42, i]).permutation(36)]) for i in range(199)]
        assert got[term].pseudo_f == pytest.approx(pseudo(x)) and got[term].p == pytest.approx((sum(f >= pseudo(x) * (1 - 1e-12) for f in null) + 1) / 200)
    assert got["a"].p == 0.005
    wide = I.dispersion(z, groups.select("subject", F.col("a").alias("g")), 199).first()

    def ratio(of):
        d = np.array([np.linalg.norm(x[k] - x[of == of[k]].mean(0)) for k in range(36)])
        m = [d[of == g] for g in np.unique(of)]
        return sum(len(v) * (v.mean() - d.mean()) ** 2 for v in m) / (sum(((v - v.mean()) ** 2).sum() for v in m) / 34)

    of = np.array([g for _, g, _ in who])
    null = [ratio(of[np.random.default_rng([42, i]).permutation(36)]) for i in range(199)]
    assert wide.f == pytest.approx(ratio(of)) and wide.p == pytest.approx((sum(f >= ratio(of) * (1 - 1e-12) for f in null) + 1) / 200)


def test_q_values_of_few_and_of_many_alike(spark, monkeypatch):
    from tracklore.operators import stats as S

    rng = np.random.default_rng(6)
    rows = [(f"f{k}", "ab"[k % 2], float(round(p, 2)) if k % 11 else None) for k, p in enumerate(rng.random(120) ** 2)]
    df = spark.createDataFrame(rows, "feature string, family string, p double")
    for family in ([], ["family"]):
        few = {r.feature: r.q for r in S.benjamini_hochberg(df, "p", "q", *family).collect()}
        with monkeypatch.context() as m:
            m.setattr(S, "FEW", 0)
            many = {r.feature: r.q for r in S.benjamini_hochberg(df, "p", "q", *family).collect()}
        assert few == pytest.approx(many, nan_ok=True)
        for f, g, p in rows:
            own = sorted(x for _, h, x in rows if x is not None and (not family or h == g))
            assert few[f] is None if p is None else few[f] == pytest.approx(min(1.0, min(x * len(own) / (sum(y <= x for y in own)) for x in own if x >= p)))
