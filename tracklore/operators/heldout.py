"""Models of cells for every group held out, or any choice of groups, at once: passes over cells give sums, and small systems are solved.

Rows are (group, y, x): a subject, 0 or 1, and an array of features. A task is a choice of groups to learn from, with its
own penalty; all tasks share each pass over the rows, whose partial sums, one a partition and task, are all that is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.operators.lineage import kept

#: Groups and tasks, at most: their sums are on the driver, a square of the features for each task.
GROUPS, TASKS = 2_000, 20_000
#: Passes over the rows, at most, and the largest change of a coefficient that ends them.
PASSES, CLOSE = 60, 1e-8


@dataclass
class Task:
    """A model to fit: the groups that it learns from, strength c and share of absolute penalties, and what it is for."""

    learns: frozenset
    c: float = 1.0
    l1: float = 0.0
    name: tuple = ()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(2))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sigmoid: tuple[float, float] = (1.0, 0.0)

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows; a missing feature counts as the mean."""
        z = (x - self.mean) / self.scale
        return np.where(np.isfinite(z), z, 0.0) @ self.beta[:-1] + self.beta[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.sigmoid
        return 1 / (1 + np.exp(-np.clip(a * self.decision(x) + b, -500, 500)))


def group_sums(rows: DataFrame) -> pd.DataFrame:
    """Counts, sums and sums of squares of each group's features by class; features that are not finite count for nothing."""
    x = F.posexplode("x").alias("k", "v")
    g = rows.select("group", "y", x).where("v IS NOT NULL AND abs(v) < double('Infinity')").groupBy("group", "y", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    n = rows.groupBy("group", "y").agg(F.count("*").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")).select("group", "y", F.lit(-1).alias("k"), "n", "s", "ss")
    found = g.unionAll(n)
    if rows.select("group").distinct().count() > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    return found.toPandas()


def prepare(tasks: list[Task], sums: pd.DataFrame, width: int) -> list[Task]:
    """Means, scales and class weights of each task from the sums of its groups; tasks that learn from one class are left out."""
    if len(tasks) > TASKS:
        raise ValueError(f"more than {TASKS} tasks")
    groups = sorted(sums["group"].unique())
    place = {g: k for k, g in enumerate(groups)}
    total = np.zeros((len(groups), 2, width + 1, 3))
    for g, y, k, *v in sums[["group", "y", "k", "n", "s", "ss"]].itertuples(index=False):
        total[place[g], int(y), int(k)] = v
    out = []
    for t in tasks:
        own = total[[place[g] for g in groups if g in t.learns]].sum(axis=0)
        classes = own[:, -1, 0]
        if (classes > 0).all():
            n, s, ss = own[:, :-1].sum(axis=0).T
            t.mean = s / np.maximum(n, 1)
            spread = np.sqrt(np.maximum(ss / np.maximum(n, 1) - t.mean**2, 0))
            t.scale = np.where(spread > 1e-12, spread, 1.0)
            t.weight = classes.sum() / (2 * classes)
            t.beta = np.zeros(width + 1)
            out.append(t)
    return out


#: Rows whose losses are multiplied before one logarithm is taken, each at most a factor of 2.
FACTORS = 500
#: Margins of rows under tasks held at a time.
MARGINS = 100_000


def _logistic(margin: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.exp(-np.abs(margin))
    up = 1 + e
    tail = sum(np.log(np.multiply.reduce(up[k : k + FACTORS], axis=0)) for k in range(0, len(up), FACTORS))
    q = e / up
    p = np.where(margin >= 0, 1 - q, q)
    loss = tail + np.maximum(margin if y == 0 else -margin, 0).sum(axis=0)
    return loss, p - y, q * (1 - q)


def _squared_hinge(margin: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side = 2 * y - 1
    short = np.maximum(1 - side * margin, 0)
    return (short * short).sum(axis=0), -2 * side * short, 2.0 * (short > 0)


LOSSES = {"logistic": _logistic, "svm": _squared_hinge}


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, classes and features of a batch; features that are missing are not numbers."""
    x = batch.column("x")
    width = len(x.values) // len(x) if len(x) and not x.offset else 0
    offsets = x.offsets.to_numpy()
    if not x.null_count and width and (np.diff(offsets) == width).all() and offsets[0] == 0 and len(x.values) == width * len(x):
        x = x.values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    else:
        x = np.array([[np.nan if v is None else v for v in r] for r in x.to_pylist()], float)
    return batch.column("group").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False).astype(int), x


def _pass(rows: DataFrame, tasks: list[Task], loss: str, calibrate: bool) -> list[np.ndarray]:
    """For each task loss, gradient and second derivatives over its rows, in one vector.

    Margins of a group's rows of a class under all tasks that learn from it are one product of matrices, and so are their
    sums; features are taken about a mean and spread that all tasks share, and sums are carried to each task's own.
    """
    width = len(tasks[0].beta)
    centre, spread = np.mean([t.mean for t in tasks], axis=0), np.mean([t.scale for t in tasks], axis=0)
    mean, scale = np.array([t.mean for t in tasks]), np.array([t.scale for t in tasks])
    beta = np.array([t.beta for t in tasks])
    if calibrate:
        beta = beta * np.array([[t.sigmoid[0]] for t in tasks])
        beta[:, -1] += [t.sigmoid[1] for t in tasks]
    # a task's z is slope times the shared z, plus shift
    slope, shift = spread / scale, (centre - mean) / scale
    shared_beta = np.column_stack((beta[:, :-1] * slope, beta[:, -1] + (beta[:, :-1] * shift).sum(axis=1)))
    learns: dict = {}
    for k, t in enumerate(tasks):
        for g in t.learns:
            learns.setdefault(g, []).append(k)
    learns = {g: np.array(k) for g, k in learns.items()}
    shared = rows.sparkSession.sparkContext.broadcast((learns, shared_beta, centre, spread, slope, shift, beta))
    i, j = np.triu_indices(width)
    kind = "logistic" if calibrate else loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learns, shared_beta, centre, spread, slope, shift, beta = shared.value
        # by class: sums of all rows without a missing feature in shared terms, and of the others in each task's own
        total = np.zeros((2, 2, len(beta), 1 + width + len(i)))
        for batch in batches:
            if not batch.num_rows:
                continue
            of, y, x = _arrays(batch)
            codes, names = pd.factorize(of)
            x = (x - centre) / spread
            whole = np.isfinite(x).all(axis=1)
            code = (codes * 2 + y) * 2 + ~whole
            order = np.argsort(code, kind="stable")
            x, code = np.column_stack((x[order], np.ones(len(x)))), code[order]
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()], [*cuts[1:], len(code)], strict=True):
                g, c, missing = names[code[lo] // 4], int(code[lo] // 2 % 2), int(code[lo] % 2)
                ks = learns.get(g)
                if ks is None:
                    continue
                if missing:
                    for k in ks:
                        z = x[lo:hi].copy()
                        z[:, :-1] = np.where(np.isfinite(z[:, :-1]), z[:, :-1] * slope[k] + shift[k], 0.0)
                        value, first, second = LOSSES[kind]((z @ beta[k])[:, None], c)
                        total[c, 1, k] += np.concatenate((value, z.T @ first[:, 0], (z[:, i] * z[:, j]).T @ second[:, 0]))
                    continue
                step = max(1, MARGINS // len(ks))
                for s in range(lo, hi, step):
                    z = x[s : min(s + step, hi)]
                    value, first, second = LOSSES[kind](z @ shared_beta[ks].T, c)
                    total[c, 0, ks] += np.column_stack((value, first.T @ z, second.T @ (z[:, i] * z[:, j])))
        flat = total.transpose(2, 0, 1, 3).reshape(len(beta), -1)
        yield pa.RecordBatch.from_pydict({"task": pa.array(np.arange(len(beta)), pa.int32()), "sums": pa.array(list(flat), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "task int, sums array<double>").select("task", F.posexplode("sums").alias("k", "v")).groupBy("task", "k").agg(F.sum("v").alias("v"))
    found = np.zeros((len(tasks), 2, 2, 1 + width + len(i)))
    for r in parts.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).collect():
        found[r["task"]] = np.array([v["v"] for v in r["s"]]).reshape(found.shape[1:])
    out = []
    for k, t in enumerate(tasks):
        to = np.diag(np.append(slope[k], 1.0))
        to[:-1, -1] = shift[k]
        value, first, second = 0.0, np.zeros(width), np.zeros((width, width))
        for c in (0, 1):
            w = 1.0 if calibrate else t.weight[c]
            for own, move in zip(found[k, c], (to, np.eye(width)), strict=True):
                square = np.zeros((width, width))
                square[i, j] = square[j, i] = own[1 + width :]
                value, first, second = value + w * own[0], first + w * (move @ own[1 : 1 + width]), second + w * (move @ square @ move.T)
        if calibrate:
            along = np.column_stack((t.beta, np.append(np.zeros(width - 1), 1.0)))
            first, second = along.T @ first, along.T @ second @ along
        out.append(np.concatenate(([value], first, second.ravel())))
    return out


def penalised(second: np.ndarray, linear: np.ndarray, start: np.ndarray, absolute: float, square: float) -> np.ndarray:
    """The b that makes b second b / 2 - linear b and the penalties least, one coordinate after the other; the last has none."""
    b, d = start.copy(), np.diag(second)
    for _ in range(2_000):
        most = 0.0
        for k in range(len(b)):
            rest = linear[k] - second[k] @ b + d[k] * b[k]
            if k == len(b) - 1:
                new = rest / max(d[k], 1e-12)
            else:
                new = np.sign(rest) * max(abs(rest) - absolute, 0.0) / max(d[k] + square, 1e-12)
            most, b[k] = max(most, abs(new - b[k])), new
        if most < CLOSE / 10:
            break
    return b


def fit(rows: DataFrame, tasks: list[Task], loss: str = "logistic") -> list[Task]:
    """All tasks fitted: Newton's steps with absolute and squared penalties, a pass over the rows for each, for all tasks together.

    loss is logistic, or svm: squared hinge, with a sigmoid fitted to the decisions. A step that makes a task's objective
    larger is halved.
    """
    rows = rows.select("group", "y", "x").where("group IS NOT NULL AND y IN (0, 1)")
    first = rows.select(F.max(F.size("x"))).first()[0]
    tasks = prepare(tasks, group_sums(rows), first or 0)
    seen = [np.inf] * len(tasks)
    last = [t.beta for t in tasks]
    open_ = list(range(len(tasks)))
    for _ in range(PASSES):
        if not open_:
            break
        still = []
        for k, sums in zip(open_, _pass(rows, [tasks[k] for k in open_], loss, False), strict=True):
            t, width = tasks[k], len(tasks[k].beta)
            value = sums[0] + (t.l1 * np.abs(t.beta[:-1]).sum() + (1 - t.l1) / 2 * (t.beta[:-1] ** 2).sum()) / t.c
            if value > seen[k] + 1e-9 * abs(seen[k]):
                t.beta = (t.beta + last[k]) / 2
                still.append(k)
                continue
            seen[k], last[k] = value, t.beta
            second = sums[1 + width :].reshape(width, width)
            new = penalised(second + 1e-10 * np.eye(width), second @ t.beta + 1e-10 * t.beta - sums[1 : 1 + width], t.beta, t.l1 / t.c, (1 - t.l1) / t.c)
            moved, t.beta = np.abs(new - t.beta).max(), new
            if moved > CLOSE:
                still.append(k)
        open_ = still
    if loss == "svm" and tasks:
        for t in tasks:
            t.sigmoid = (1.0, 0.0)
        for _ in range(20):
            moved = 0.0
            for t, sums in zip(tasks, _pass(rows, tasks, loss, True), strict=True):
                step = np.linalg.solve(sums[3:].reshape(2, 2) + 1e-9 * np.eye(2), -sums[1:3])
                t.sigmoid = tuple(float(a + s) for a, s in zip(t.sigmoid, np.clip(step, -5, 5), strict=True))
                moved = max(moved, float(np.abs(step).max()))
            if moved < CLOSE:
                break
    return tasks


def fit_discriminants(rows: DataFrame, tasks: list[Task], shrinkage: float = 0.1) -> list[Task]:
    """Linear discriminants of all tasks from one pass: scatter of every group by class, summed over the groups of a task.

    The within-class covariance is drawn towards its mean variance by shrinkage. Scatter is about the grand means, so
    that sums of groups add up; missing features count as those.
    """
    rows = rows.select("group", "y", "x").where("group IS NOT NULL AND y IN (0, 1)")
    sums = group_sums(rows)
    width = int(sums["k"].max()) + 1
    tasks = prepare(tasks, sums, width)
    own = sums[sums["k"] >= 0].groupby("k")[["n", "s", "ss"]].sum().reindex(range(width)).fillna(0)
    centre = (own["s"] / own["n"].clip(lower=1)).to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch["x"]], float) - centre
            x = np.column_stack((np.ones(len(x)), np.where(np.isfinite(x), x, 0.0)))
            for key, at in batch.groupby(["group", "y"]).indices.items():
                found[key] = found.get(key, 0) + x[at].T @ x[at]
        yield pd.DataFrame([(*k, v.ravel()) for k, v in found.items()], columns=["group", "y", "sums"])

    kinds = dict(rows.dtypes)
    parts = rows.mapInPandas(run, f"group {kinds['group']}, y int, sums array<double>").select("group", "y", F.posexplode("sums").alias("k", "v")).groupBy("group", "y", "k").agg(F.sum("v").alias("v"))
    scatter: dict[tuple, np.ndarray] = {(r["group"], r["y"]): np.array([v["v"] for v in r["s"]]).reshape(width + 1, -1) for r in parts.groupBy("group", "y").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).toLocalIterator()}
    for t in tasks:
        mean, within, counts = [], np.zeros((width, width)), []
        for y in (0, 1):
            m = sum((v for (g, c), v in scatter.items() if c == y and g in t.learns), np.zeros((width + 1, width + 1)))
            n, s = m[0, 0], m[0, 1:]
            mean.append(s / n)
            counts.append(n)
            within += m[1:, 1:] - np.outer(s, s) / n
        scale = np.diag(t.scale)
        within = np.linalg.inv(scale) @ (within / sum(counts)) @ np.linalg.inv(scale)
        within = (1 - shrinkage) * within + shrinkage * np.trace(within) / width * np.eye(width)
        zero, one = ((m + centre - t.mean) / t.scale for m in mean)
        w = np.linalg.solve(within + 1e-10 * np.eye(width), one - zero)
        t.beta = np.append(w, -(zero + one) @ w / 2 + np.log(counts[1] / counts[0]))
    return tasks


def left_out(groups: list, c: float = 1.0, l1: float = 0.0) -> list[Task]:
    """A task for each group, which learns from all others."""
    every = frozenset(groups)
    return [Task(every - {g}, c, l1, (g,)) for g in sorted(groups)]


def tuned(rows: DataFrame, groups: list, grid: list[float], l1: float = 0.0, loss: str = "logistic", splits: int = 3) -> list[Task]:
    """left_out with the strength of each task chosen inside it: its groups are dealt to splits, and the strength with the
    best mean balanced accuracy of cells in the splits left out wins, the smaller of equals. All inner fits are one job's tasks."""
    every, inner = sorted(groups), []
    for g in every:
        rest = [x for x in every if x != g]
        for s in range(min(splits, len(rest))):
            out = frozenset(rest[s :: min(splits, len(rest))])
            inner += [Task(frozenset(rest) - out, c, l1, (g, s, c, out)) for c in grid]
    scores = _accuracies(rows, fit(rows, inner, loss))
    best: dict = {}
    for (g, c), values in scores.items():
        best[g] = max(best.get(g, (-1.0, 0.0)), (float(np.mean(values)), -c))
    return [Task(frozenset(every) - {g}, -best[g][1] if g in best else 1.0, l1, (g,)) for g in every]


def _accuracies(rows: DataFrame, tasks: list[Task]) -> dict[tuple, list[float]]:
    """Balanced accuracy of each inner task on the groups that its name leaves out, by outer group and strength."""
    if not tasks:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(tasks)

    judged: dict = {}
    for k, t in enumerate(tasks):
        for g in t.name[3]:
            judged.setdefault(g, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(shared.value), 2, 2), int)
        for batch in batches:
            if not batch.num_rows:
                continue
            of, y, x = _arrays(batch)
            for g, at in pd.Series(np.arange(len(of))).groupby(of).indices.items():
                for k in judged.get(g, ()):
                    positive = shared.value[k].decision(x[at]) >= 0
                    n[k] += np.bincount(y[at] * 2 + positive, minlength=4).reshape(2, 2)
        yield pa.RecordBatch.from_pydict({"task": pa.array(np.repeat(np.arange(len(n)), 4), pa.int32()), "cell": pa.array(np.tile(np.arange(4), len(n)), pa.int32()), "n": pa.array(n.ravel(), pa.int64())})

    found = np.zeros((len(tasks), 4))
    for r in rows.select("group", "y", "x").where("y IN (0, 1)").mapInArrow(run, "task int, cell int, n long").groupBy("task", "cell").agg(F.sum("n").alias("n")).collect():
        found[r["task"], r["cell"]] = r["n"]
    out: dict[tuple, list[float]] = {}
    for t, (tn, fp, fn, tp) in zip(tasks, found, strict=True):
        if tn + fp and fn + tp:
            out.setdefault((t.name[0], t.name[2]), []).append((tn / (tn + fp) + tp / (fn + tp)) / 2)
    return out


def held_out_groups(rows: DataFrame, tasks: list[Task]) -> DataFrame:
    """(group, y, n_cells, probability, predicted, correct, c): each left-out group by the mean probability of its cells, under
    the task of its name. A group whose task has one class to learn from has a null probability."""
    shared = rows.sparkSession.sparkContext.broadcast({t.name[0]: t for t in tasks})
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch["x"]], float)
            p = np.full(len(batch), np.nan)
            for g, at in batch.groupby("group").indices.items():
                if g in shared.value:
                    p[at] = shared.value[g].probability(x[at])
            yield pd.DataFrame({"group": batch["group"], "y": batch["y"], "p": p})

    cells = rows.select("group", "y", "x").where("group IS NOT NULL AND y IN (0, 1)").mapInPandas(run, f"group {kinds['group']}, y int, p double")
    g = cells.groupBy("group").agg(F.max("y").alias("y"), F.count("*").alias("n_cells"), F.avg(F.when(~F.isnan("p"), F.col("p"))).alias("probability"))
    g = g.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    strengths = rows.sparkSession.createDataFrame([(t.name[0], float(t.c)) for t in tasks], f"group {kinds['group']}, c double")
    return g.withColumn("correct", (F.col("predicted") == F.col("y")).cast("int")).join(F.broadcast(strengths), "group", "left")


def model_table(spark: SparkSession, tasks: list[Task], features: list[str]) -> DataFrame:
    """Fitted tasks as rows (model, feature, imputer_median, scaler_mean, scaler_scale, coefficient, intercept), as frozen_scores
    reads them, a model at a time; missing features are filled with the mean."""
    rows = [("|".join(map(str, t.name)), f, float(t.mean[k]), float(t.mean[k]), float(t.scale[k]), float(t.sigmoid[0] * t.beta[k]), float(t.sigmoid[0] * t.beta[-1] + t.sigmoid[1])) for t in tasks for k, f in enumerate(features)]
    return spark.createDataFrame(rows, "model string, feature string, imputer_median double, scaler_mean double, scaler_scale double, coefficient double, intercept double")


def exclusion_tasks(conditions: dict[str, frozenset], exclusions: dict[str, frozenset], c: float = 1.0, l1: float = 0.0) -> list[Task]:
    """A task for each condition and each set of groups left out of it, so that one job fits them all."""
    return [Task(own - gone, c, l1, (name, why)) for name, own in sorted(conditions.items()) for why, gone in sorted(exclusions.items())]


def write_sidecar(spark: SparkSession, path: str, facts: dict) -> None:
    """facts as one JSON text beside a table."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def freeze(rows: DataFrame, features: list[str], path: str, tasks: list[Task], loss: str = "logistic") -> DataFrame:
    """Fits tasks on all of their groups, writes the model table to path and what was done to path with _facts added, and
    gives the table as read back; predictions on the rows learnt from are descriptive only."""
    done = fit(rows, tasks, loss)
    model_table(rows.sparkSession, done, features).coalesce(1).write.mode("overwrite").parquet(path)
    write_sidecar(rows.sparkSession, f"{path}_facts", {"features": features, "loss": loss, "models": {"|".join(map(str, t.name)): {"c": t.c, "l1": t.l1, "groups": sorted(map(str, t.learns))} for t in done}})
    return kept(rows.sparkSession.read.parquet(path))
