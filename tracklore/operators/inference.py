"""Tails of the usual tests as column expressions, rank tests of several groups, factorial tests, exact and permutation nulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.operators.lineage import kept, running
from tracklore.operators.stats import benjamini_hochberg, brown_forsythe

#: Steps of a continued fraction, and of a series: enough for a million degrees of freedom.
STEPS = 600
#: Subjects of a cohort that goes whole to a task or to the driver; more are refused.
COHORT = 2_000


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0, to twelve digits: an asymptotic series ten further on."""
    z = x + 10.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return series - sum((F.log(x + k) for k in range(1, 10)), F.log(x))


def _fraction(n: int, first: Column, terms) -> Column:
    """A continued fraction 1 / (1 + t1 / (1 + t2 / ...)) from both ends of its partial quotients, n pairs of terms."""
    start = F.struct(F.lit(1.0).alias("c"), (1 / first).alias("d"), (1 / first).alias("h"))

    def step(s: Column, m: Column) -> Column:
        c, d, h = s["c"], s["d"], s["h"]
        for t in terms(m.cast("double")):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            h = h * c * d
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    return F.reduce(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x in [0, 1] with a, b > 0."""

    def low(x: Column, a: Column, b: Column) -> Column:
        def terms(m: Column):
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        return front * _fraction(STEPS, 1 - (a + b) * x / (a + 1), terms) / a

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low(x, a, b)).otherwise(1 - low(1 - x, b, a))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """How likely an F of df1 and df2 degrees is at least f."""
    return F.when((df1 > 0) & (df2 > 0) & (f >= 0), beta_share(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0))


def t_tail(t: Column, df: Column) -> Column:
    """How likely a t of df degrees is at least as far from 0."""
    return F.when(df > 0, beta_share(df / (df + t * t), df / 2.0, F.lit(0.5)))


def t_quantile(two_sided: float, df: Column) -> Column:
    """The t that df degrees exceed on either side with this probability in all, by Newton's steps in one column."""
    scale = F.exp(log_gamma((df + 1) / 2.0) - log_gamma(df / 2.0)) / F.sqrt(df * math.pi)

    def step(t: Column, _: Column) -> Column:
        density = scale * F.pow(1 + t * t / df, -(df + 1) / 2)
        return F.greatest(t + (t_tail(t, df) - two_sided) / (2 * density), t / 2)

    return F.reduce(F.sequence(F.lit(1), F.lit(12)), F.lit(1.0), step)


def chi_squared_tail(x: Column, df: Column) -> Column:
    """How likely chi-squared of df degrees is at least x: a series below the mean, a continued fraction above."""
    a, h = df / 2.0, x / 2.0
    front = F.exp(a * F.log(h) - h - log_gamma(a))
    grow = F.reduce(F.sequence(F.lit(1), F.lit(STEPS)), F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda s, m: F.struct((s["t"] * h / (a + m)).alias("t"), (s["s"] + s["t"] * h / (a + m)).alias("s")), lambda s: s["s"])
    start = F.struct(F.lit(1e300).alias("c"), (1 / (h + 1 - a)).alias("d"), (1 / (h + 1 - a)).alias("h"))

    def step(s: Column, m: Column) -> Column:
        t, b = m.cast("double") * (a - m), h + 1 - a + 2 * m
        d, c = 1 / (b + t * s["d"]), b + t / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    down = F.reduce(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(h < a + 1, 1 - front * grow).otherwise(front * down)


def kruskal(long: DataFrame, group: str) -> DataFrame:
    """Kruskal and Wallis' H of each feature (feature, value, group) over its groups, corrected for ties, with its p.

    Rank sums come from counts of distinct values, so no feature is one task's work. A feature of one group, or of one
    value, has no H.
    """
    v = long.where(F.col("value").isNotNull() & F.col(group).isNotNull())
    counts = kept(v.groupBy("feature", "value", group).agg(F.count("*").alias("c")))
    every = counts.groupBy("feature", "value").agg(F.sum("c").alias("all"))
    up = running(every, ["feature"], "value", {"up": (F.sum, F.col("all"))}).select("feature", "value", "all", (F.col("up") - (F.col("all") - 1) / 2.0).alias("rank"))
    sums = counts.join(up.hint("merge"), ["feature", "value"]).groupBy("feature", group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    ties = up.groupBy("feature").agg(F.sum("all").alias("n_total"), F.sum(F.col("all").cast("double") * F.col("all") * F.col("all") - F.col("all")).alias("t"))
    g = sums.groupBy("feature").agg(F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).join(ties.hint("merge"), "feature")
    n = F.col("n_total").cast("double")
    fair = 1 - F.col("t") / (n * n * n - n)
    g = g.withColumn("h", F.when((F.col("k") > 1) & (fair > 0), (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / fair))
    return g.select("feature", "k", "n_total", "h", F.when(F.col("h").isNotNull(), chi_squared_tail(F.greatest(F.col("h"), F.lit(0.0)), (F.col("k") - 1).cast("double"))).alias("p"))


def spread_tests(long: DataFrame, group: str) -> DataFrame:
    """Brown and Forsythe's F of each feature with its p."""
    f = brown_forsythe(long, group)
    return f.withColumn("p", f_tail(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n_total") - F.col("k")).cast("double")))


def sum_coded(levels: int) -> np.ndarray:
    """A row for each level: the last level is minus all others."""
    return np.vstack((np.eye(levels - 1), -np.ones(levels - 1)))


def factorial_design(levels: int) -> np.ndarray:
    """Rows of the cells (a, b), a first: constant, a at -1/2 and 1/2, b sum-coded, and their products."""
    b = sum_coded(levels)
    return np.array([[1.0, side, *b[k], *(side * b[k])] for side in (-0.5, 0.5) for k in range(levels)])


def _cells(rows: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Count, mean and sum of squares of each feature's cells (a, b); only features with two values a cell at least stay."""
    v = rows.where(F.col("value").isNotNull() & F.col("a").isin(*a) & F.col("b").isin(*b))
    cell = F.array_position(F.lit(a), F.col("a")) * len(b) + F.array_position(F.lit(b), F.col("b")) - len(b) - 1
    g = v.groupBy("feature", cell.cast("int").alias("cell")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s"))
    g = g.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "m", "s"))).alias("cells"), F.sum("n").alias("total"), F.min("n").alias("least"))
    return g.where((F.size("cells") == len(a) * len(b)) & (F.col("least") >= 2))


def _fits(design: np.ndarray):
    """Coefficients of a saturated model of cells, their HC3 covariance, and squares left: a row's leverage is one over
    its cell's count, so sums of cells tell all."""
    inverse = np.linalg.inv(design)

    def fit(cells: list) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
        n, m, s = (np.array([c[k] for c in cells], float) for k in ("n", "m", "s"))
        spread = s / (1 - 1 / n) ** 2 / n
        return inverse @ m, inverse @ np.diag(spread) @ inverse.T, float((s * n).sum()), n, m

    return fit


def factorial_terms(rows: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Each feature's two-way test (feature, a, b, value): Wald F with HC3 errors, p, q within a term, partial eta squared.

    a has two levels, b any. The effect's squares are what the fit without the term leaves more than the full one.
    """
    design = factorial_design(len(b))
    k = len(b)
    terms = {"a": [1], "b": list(range(2, k + 1)), "a:b": list(range(k + 1, 2 * k))}
    fit = _fits(design)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feature, cells, total in zip(batch["feature"], batch["cells"], batch["total"], strict=True):
                beta, cov, sse, n, m = fit(cells)
                for name, columns in terms.items():
                    own = cov[np.ix_(columns, columns)]
                    wald = float(beta[columns] @ np.linalg.pinv(own) @ beta[columns]) / len(columns)
                    rest, w = np.delete(design, columns, axis=1), np.sqrt(n)
                    more = float((((m - rest @ np.linalg.lstsq(rest * w[:, None], m * w, rcond=None)[0]) * w) ** 2).sum())
                    out.append((feature, name, len(columns), int(total) - 2 * k, wald, more / (more + sse) if more + sse > 0 else None))
            yield pd.DataFrame(out, columns=["feature", "term", "df_term", "df_rest", "f", "partial_eta_squared"])

    found = _cells(rows, a, b).mapInPandas(run, "feature string, term string, df_term int, df_rest long, f double, partial_eta_squared double")
    found = kept(found).withColumn("p", f_tail(F.col("f"), F.col("df_term").cast("double"), F.col("df_rest").cast("double")))
    return benjamini_hochberg(found, "p", "q", "term")


def factorial_contrasts(rows: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Planned contrasts of each feature: a's second level less its first within each level of b, and each level of b less
    the first within each level of a, with HC3 errors, t, p, a 95 % interval and q within a contrast."""
    design, k = factorial_design(len(b)), len(b)
    cell = lambda i, j: design[i * k + j]
    wanted = {f"{a[1]} - {a[0]} | {b[j]}": cell(1, j) - cell(0, j) for j in range(k)} | {f"{b[j]} - {b[0]} | {a[i]}": cell(i, j) - cell(i, 0) for i in range(2) for j in range(1, k)}
    fit = _fits(design)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feature, cells, total in zip(batch["feature"], batch["cells"], batch["total"], strict=True):
                beta, cov, *_ = fit(cells)
                out += [(feature, name, float(v @ beta), float(math.sqrt(max(v @ cov @ v, 0.0))), int(total) - 2 * k) for name, v in wanted.items()]
            yield pd.DataFrame(out, columns=["feature", "contrast", "estimate", "error", "df"])

    found = kept(_cells(rows, a, b).mapInPandas(run, "feature string, contrast string, estimate double, error double, df long"))
    df, wide = F.col("df").cast("double"), F.col("error")
    critical = kept(found.select("df").distinct().withColumn("critical", t_quantile(0.05, df)))
    found = found.join(critical.hint("merge"), "df").withColumn("t", F.when(wide > 0, F.col("estimate") / wide)).withColumn("p", t_tail(F.col("t"), df))
    found = found.withColumns({"low": F.col("estimate") - F.col("critical") * wide, "high": F.col("estimate") + F.col("critical") * wide}).drop("critical")
    return benjamini_hochberg(found, "p", "q", "contrast")


def label_sets(ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, count): of all sets of size of these whole numbers, how many have each sum, by adding one number at a time."""
    counts = np.zeros((size + 1, int(ranks.sum()) + 1))
    counts[0, 0] = 1
    for r in ranks.astype(int).tolist():
        counts[1:, r:] += counts[:-1, : counts.shape[1] - r].copy()
    return np.arange(counts.shape[1]), counts[size]


def exact_label_nulls(rows: DataFrame, key: list[str]) -> DataFrame:
    """Exact tests of each cohort's fixed scores (key, positive, score, predicted) over all ways to give out its labels.

    auc counts ties as halves. Under the null all label sets of the cohort's size are alike likely: those with each rank
    sum are counted by adding one subject after another, and those with each number of hits in closed form, so no set is
    listed and cohorts of hundreds are exact. p values count the observed set once more, as permutation tests do; the
    two-sided one counts sets as far from a half. A cohort is a group of at most COHORT subjects, more are refused; a
    cohort of one class has no result; nulls in any column leave a row out.
    """
    rows = rows.where(F.col("positive").isNotNull() & F.col("score").isNotNull() & F.col("predicted").isNotNull()).select(*key, "positive", "score", "predicted")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n > COHORT:
            raise ValueError(f"{n} subjects are more than a cohort")
        truth, predicted = pdf["positive"].to_numpy(bool), pdf["predicted"].to_numpy(bool)
        m = int(truth.sum())
        if m in (0, n):
            return pdf.iloc[:0].reindex(columns=names)
        twice = (pdf["score"].rank(method="average") * 2).to_numpy(int)
        sums, counts = label_sets(twice, m)
        possible = counts > 0
        sums, counts = sums[possible], counts[possible]
        u2, pairs = sums - m * (m + 1), m * (n - m)
        own = int(twice[truth].sum()) - m * (m + 1)
        whole = counts.sum()
        called = int(predicted.sum())
        hits = range(max(0, called - (n - m)), min(called, m) + 1)
        ways = {j: math.comb(called, j) * math.comb(n - called, m - j) for j in hits}
        accuracy = lambda j: (j * (n - m) + (n - m - called + j) * m)
        mine = accuracy(int((truth & predicted).sum()))
        total = math.comb(n, m)
        row = {
            "n": n, "n_positive": m, "auc": own / (2 * pairs), "balanced_accuracy": mine / (2 * pairs), "label_sets": float(total), "auc_p": (counts[u2 >= own].sum() + 1) / (whole + 1),
            "auc_two_sided_p": (counts[np.abs(u2 - pairs) >= abs(own - pairs)].sum() + 1) / (whole + 1), "balanced_accuracy_p": (sum(w for j, w in ways.items() if accuracy(j) >= mine) + 1) / (total + 1),
        }
        return pdf[key].iloc[:1].assign(**row)

    kinds = {"n": "int", "n_positive": "int", "auc": "double", "balanced_accuracy": "double", "label_sets": "double", "auc_p": "double", "auc_two_sided_p": "double", "balanced_accuracy_p": "double"}
    names = [*key, *kinds]
    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes if c in key] + [f"{c} {t}" for c, t in kinds.items()])
    return rows.groupBy(*key).applyInPandas(run, schema)


def gram(z: DataFrame, subjects: list) -> np.ndarray:
    """Inner products of subjects over features (feature, subject, z): partial sums by partition, subjects squared each."""
    place = {s: k for k, s in enumerate(subjects)}
    n = len(subjects)
    rows = z.where("z IS NOT NULL").groupBy("feature").agg(F.collect_list(F.struct("subject", "z")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.zeros((len(batch), n))
            for i, v in enumerate(batch["v"]):
                for r in v:
                    x[i, place[r["subject"]]] = r["z"]
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    out = np.zeros((n, n))
    for r in rows.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def permanova(z: DataFrame, groups: DataFrame, a: list[str], b: list[str], permutations: int = 9999, seed: int = 42) -> DataFrame:
    """Multivariate two-way test of subjects (subject, a, b) over features (feature, subject, z): pseudo F, partial R squared
    and p of each term, by permutation of what the model without the term leaves.

    Squares of a fit to permuted residuals need only inner products of subjects: one matrix of the cohort, summed over
    features by partition. Permutations are rows of a range, each with its own seed. The cohort is at most COHORT
    subjects; a missing feature counts as 0.
    """
    cohort = groups.where(F.col("a").isin(*a) & F.col("b").isin(*b)).select("subject", "a", "b").orderBy("subject").limit(COHORT + 1).collect()
    if len(cohort) > COHORT:
        raise ValueError(f"more than {COHORT} subjects are more than a cohort")
    k, cells = len(b), factorial_design(len(b))
    x = np.array([cells[a.index(r["a"]) * k + b.index(r["b"])] for r in cohort])
    inner = gram(z.where(F.col("subject").isin([r["subject"] for r in cohort])), [r["subject"] for r in cohort])
    n = len(cohort)
    off = lambda m: np.eye(n) - m @ np.linalg.pinv(m)
    terms = {"a": [1], "b": list(range(2, k + 1)), "a:b": list(range(k + 1, 2 * k))}
    full, spark = off(x), z.sparkSession
    df_rest = n - int(np.linalg.matrix_rank(x))
    out = None
    for name, columns in terms.items():
        rest = off(np.delete(x, columns, axis=1))
        left = rest @ inner @ rest
        df_term = int(np.linalg.matrix_rank(x) - np.linalg.matrix_rank(np.delete(x, columns, axis=1)))

        def pseudo(order: np.ndarray, left=left, rest=rest, df_term=df_term) -> tuple[float, float]:
            moved = left[np.ix_(order, order)]
            f, r = float((full * moved).sum()), float((rest * moved).sum())
            return (max(0.0, r - f) / df_term) / (f / df_rest), max(0.0, r - f) / max(max(0.0, r - f) + f, 1e-300)

        observed, share = pseudo(np.arange(n))

        def run(batches: Iterator[pd.DataFrame], pseudo=pseudo) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"f": [pseudo(np.random.default_rng([seed, int(i)]).permutation(n))[0] for i in batch["id"]]})

        null = spark.range(permutations).mapInPandas(run, "f double").agg(((F.count_if(F.col("f") >= observed * (1 - 1e-12)) + 1) / (permutations + 1)).alias("p"))
        row = null.select(F.lit(name).alias("term"), F.lit(df_term).alias("df_term"), F.lit(df_rest).alias("df_rest"), F.lit(observed).alias("pseudo_f"), F.lit(share).alias("partial_r_squared"), "p")
        out = row if out is None else out.unionAll(row)
    return out


def dispersion(z: DataFrame, groups: DataFrame, permutations: int = 9999, seed: int = 42) -> DataFrame:
    """Whether groups (subject, g) scatter alike over features (feature, subject, z): F of the subjects' distances from their
    group's centre, and p by permutation of the groups, whose centres are then new.

    Distances from any group's centre need only inner products of subjects, as in permanova; the cohort is checked alike.
    """
    cohort = groups.where("g IS NOT NULL").select("subject", "g").orderBy("subject").limit(COHORT + 1).collect()
    if len(cohort) > COHORT:
        raise ValueError(f"more than {COHORT} subjects are more than a cohort")
    subjects = [r["subject"] for r in cohort]
    inner = gram(z.where(F.col("subject").isin(subjects)), subjects)
    names, of = np.unique([r["g"] for r in cohort], return_inverse=True)
    n, k = len(cohort), len(names)

    def ratio(of: np.ndarray) -> float:
        size = np.bincount(of, minlength=k)
        share = np.eye(k)[of] / size
        met = inner @ share
        d = np.sqrt(np.maximum(np.diag(inner) - 2 * met[np.arange(n), of] + np.diag(share.T @ met)[of], 0.0))
        mean = np.bincount(of, d, k) / size
        return float((size * (mean - d.mean()) ** 2).sum() / (k - 1)) / float(((d - mean[of]) ** 2).sum() / (n - k))

    observed = ratio(of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"f": [ratio(of[np.random.default_rng([seed, int(i)]).permutation(n)]) for i in batch["id"]]})

    null = z.sparkSession.range(permutations).mapInPandas(run, "f double")
    return null.agg(F.lit(k).alias("groups"), F.lit(n).alias("n"), F.lit(observed).alias("f"), ((F.count_if(F.col("f") >= observed * (1 - 1e-12)) + 1) / (permutations + 1)).alias("p"))
