"""Subsets of features screened and eliminated from one matrix of sums: a subset costs no pass over the data.

A subset's fit is the least squares line from its features to a class of 0 or 1, which parts the classes as the linear
discriminant does. Subjects are a checked cohort; subsets are rows and are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.operators.lineage import kept

#: Subjects of a cohort, and features whose subsets are numbered by bits, at most.
COHORT, FEATURES = 2_000, 40
#: Smallest share of a feature's own squares that the swept ones may leave: below, it follows from them.
FOLLOWS = 1e-9

METRICS = ("r_squared", "balanced_accuracy", "auc")


def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The matrix with feature k swept in; swept again it is out. Its last row then holds coefficients, its last cell the
    squares left."""
    d = matrix[k, k]
    out = matrix - np.outer(matrix[:, k], matrix[k]) / d
    out[k], out[:, k] = matrix[k] / d, matrix[:, k] / d
    out[k, k] = -1 / d
    return out


def cohort(rows: DataFrame, features: list[str], y: str, subject: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, class) of a cohort in the order of its subjects; missing features are filled with their median."""
    if len(features) > FEATURES:
        raise ValueError(f"more than {FEATURES} features")
    fills = rows.agg(*[F.median(f).alias(f) for f in features]).first()
    own = rows.where(F.col(y).isin(0, 1)).select(subject, y, *[F.coalesce(F.col(f).cast("double"), F.lit(fills[f]), F.lit(0.0)).alias(f) for f in features])
    found = own.orderBy(subject).limit(COHORT + 1).toPandas()
    if len(found) > COHORT:
        raise ValueError(f"more than {COHORT} subjects are more than a cohort")
    return found[features].to_numpy(float), found[y].to_numpy(float)


def cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of scaled features and the class about their means."""
    z = np.column_stack((x, y))
    z = z - z.mean(0)
    size = np.sqrt((z * z).sum(0))
    z = z / np.where(size > 0, size, 1.0)
    return z.T @ z


def swept(matrix: np.ndarray, own: list[int]) -> tuple[np.ndarray, list[int]]:
    """The matrix with all features of a subset in, but those that follow from others before them, and those that are in."""
    inside = []
    for k in own:
        if matrix[k, k] > FOLLOWS:
            matrix = sweep(matrix, k)
            inside.append(k)
    return matrix, inside


def measures(x: np.ndarray, y: np.ndarray, matrix: np.ndarray, own: list[int]) -> tuple[float, float, float]:
    """Share of the class's squares that a subset explains, and balanced accuracy and area under the curve of predictions
    for each subject by the fit without it, from the residual and leverage of the fit to all."""
    done, inside = swept(matrix, own)
    share = float(1 - done[-1, -1])
    if not inside:
        return share, 0.5, 0.5
    z = x[:, inside] - x[:, inside].mean(0)
    z = z / np.sqrt((z * z).sum(0))
    inverse = -done[np.ix_(inside, inside)]
    spread = np.sqrt(((y - y.mean()) ** 2).sum())
    fitted = y.mean() + z @ done[inside, -1] * spread
    leverage = np.minimum(1 / len(y) + ((z @ inverse) * z).sum(1), 1 - 1e-9)
    ahead = np.round(y - (y - fitted) / (1 - leverage), 9)
    called = ahead >= 0.5
    one, zero = ahead[y == 1], ahead[y == 0]
    order = np.sort(zero)
    auc = float((np.searchsorted(order, one, "left") + np.searchsorted(order, one, "right")).sum() / (2 * len(one) * len(zero)))
    return share, float((called[y == 1].mean() + (~called[y == 0]).mean()) / 2), auc


def screen(rows: DataFrame, features: list[str], y: str = "y", subject: str = "subject", most: int = 3, families: dict[str, list[str]] | None = None) -> DataFrame:
    """(subset, features, size, r_squared, balanced_accuracy, auc, delta_* against all features) of all features, of each
    family, of all but one, and of all subsets of 2 to most features.

    The subsets' numbers, whose bits are features, are rows of a range; each is measured from the cohort's one matrix.
    """
    spark = rows.sparkSession
    x, z = cohort(rows, features, y, subject)
    p = len(features)
    full = (1 << p) - 1
    named = [("all", full)] + [(f"family {n}", sum(1 << features.index(f) for f in own if f in features)) for n, own in sorted((families or {}).items())] + [(f"without {f}", full & ~(1 << k)) for k, f in enumerate(features) if p > 1]
    listed = spark.createDataFrame([r for r in named if r[1]], "subset string, code long")
    some = spark.range(1 << p).where(F.bit_count("id").between(2, most)).select(F.format_string("subset %d", "id").alias("subset"), F.col("id").alias("code")) if most >= 2 else listed.limit(0)
    shared = spark.sparkContext.broadcast((x, z, cross(x, z)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, z, matrix = shared.value
        for batch in batches:
            own = [[k for k in range(p) if code >> k & 1] for code in batch["code"].tolist()]
            found = [measures(x, z, matrix, k) for k in own]
            yield pd.DataFrame([(s, "|".join(features[i] for i in k), len(k), *m) for s, k, m in zip(batch["subset"], own, found, strict=True)], columns=["subset", "features", "size", *METRICS])

    schema = "subset string, features string, size int, " + ", ".join(f"{m} double" for m in METRICS)
    base = dict(zip(METRICS, measures(x, z, cross(x, z), list(range(p))), strict=True))
    return listed.unionAll(some).mapInPandas(run, schema).withColumns({f"delta_{m}": F.col(m) - base[m] for m in METRICS})


def eliminate(rows: DataFrame, features: list[str], y: str = "y", subject: str = "subject") -> DataFrame:
    """(step, removed, size, r_squared, balanced_accuracy, auc): one feature after the other goes, each time the one whose
    loss costs least, until one is left; of equal costs the last one goes. Features that follow from others go first.

    The swept matrix tells what each loss costs, so a step takes no pass; what stays is measured at each step.
    """
    x, z = cohort(rows, features, y, subject)
    matrix = cross(x, z)
    own = list(range(len(features)))
    out = [(0, None, len(own), *measures(x, z, matrix, own))]
    while len(own) > 1:
        done, inside = swept(matrix, own)
        cost = {k: -1.0 if k not in inside else round(float(done[k, -1] ** 2 / -done[k, k]), 12) for k in own}
        gone = min(own, key=lambda k: (cost[k], -k))
        own.remove(gone)
        out.append((len(out), features[gone], len(own), *measures(x, z, matrix, own)))
    return kept(rows.sparkSession.createDataFrame(out, "step int, removed string, size int, " + ", ".join(f"{m} double" for m in METRICS)))
