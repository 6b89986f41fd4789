"""Lineage cuts, and running sums over ranges of ordered rows, so that no key is one task's work."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, cut by a checkpoint in spark.checkpoint.dir, which a cluster must name; one machine has a folder of its own."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Has the driver let go of plans that nothing refers to: only then Spark removes the files of their shuffles and checkpoints,
    and a driver with free memory puts that off while the disks of a long job fill."""
    spark._jvm.System.gc()


def sized(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of parameters, computed once: to be broadcast if it is counted to be small, else to be sorted and merged."""
    table = kept(table)
    return table.hint("broadcast" if table.count() <= most else "merge")


def running(rows: DataFrame, keys: list[str], by: str, values: dict[str, tuple[Callable[[Column], Column], Column]], down: bool = False) -> DataFrame:
    """rows with further columns: an aggregate (sum, min or max) of a value over the key's rows up to and with each, in order of by.

    Rows must differ in (keys, by). They are dealt to ranges of that order; ranges are aggregated, their totals run up
    over the few ranges of a key, and each range then runs apart: a key that holds all rows is many tasks' work.
    """
    order = F.desc(by) if down else F.asc(by)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(*[f(v).alias(f"_total_{c}") for c, (f, v) in values.items()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", *[f(F.col(f"_total_{c}")).over(before).alias(f"_before_{c}") for c, (f, _) in values.items()])
    here = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.join(totals.hint("merge"), [*keys, "_range"])
    for c, (f, v) in values.items():
        now, old = f(v).over(here), F.col(f"_before_{c}")
        out = out.withColumn(c, (now + F.coalesce(old, F.lit(0))) if f is F.sum else (F.least(now, old) if f is F.min else F.greatest(now, old)))
    return out.drop("_range", *[f"_before_{c}" for c in values])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column for each share): exact quantiles, linear between neighbours, from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    up = running(counts, keys, value, {"_up": (F.sum, F.col("_c"))})
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    up = up.join(n.hint("merge"), keys) if keys else up.withColumn("n", F.lit(n.first()[0]))
    aggs = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1)
        aggs += [F.min(F.when(F.col("_up") > F.floor(at), F.col(value))).alias(f"_lo_{name}"), F.min(F.when(F.col("_up") > F.ceil(at), F.col(value))).alias(f"_hi_{name}")]
    g = up.groupBy(*keys).agg(F.first("n").alias("n"), *aggs)
    for name, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1)
        part = at - F.floor(at)
        g = g.withColumn(name, F.col(f"_lo_{name}") + F.when(part > 0, part * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).otherwise(0.0))
    return g.select(*keys, "n", *shares)


def _tied(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): a node's larger neighbours, or it and its smaller ones, are tied to the least of them all."""
    if large:
        own = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = own.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = own.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, component) for every node of the edges (u, v), both long: component is the least node that u reaches.

    Nodes are tied to the least of their neighbourhood, larger and smaller ones in turn, until all are tied to their
    component's least: as many rounds as the logarithm of the nodes, each cut by a checkpoint. Only a count and a
    checksum of a round reach the driver.
    """
    edges = kept(edges.select("u", "v").distinct())
    now, seen = edges.where("u <> v"), None
    for _ in range(rounds):
        now = kept(_tied(_tied(now, large=True), large=False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select("u").unionAll(edges.select(F.col("v").alias("u"))).distinct()
    return nodes.join(now.select("u", F.col("v").alias("component")).hint("merge"), "u", "left").select("u", F.coalesce("component", "u").alias("component"))


#: Edges that one task settles, about, and edges of one key from which on its graph is settled in rounds over all tasks.
EDGES, LARGE = 200_000, 2_000_000


def least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each one reaches over edges (u, v): the least label spreads, and jumps ahead."""
    label = np.arange(n)
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _least(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of a task's edges with the least node that each reaches."""
    edges = [t.to_numpy(np.int64) for t in tables]
    nodes, ends = np.unique(np.concatenate(edges) if edges else np.empty((0, 2), np.int64), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    yield pd.DataFrame({"u": nodes, "component": nodes[least_reached(u, v, len(nodes))]})


def apart(rows: DataFrame, key: list[str], large: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of keys that have at most large of them, and rows of the other keys, or None if there is no such key."""
    if rows.count() <= large:
        return rows, None
    heavy = kept(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > large).drop("n"))
    if heavy.isEmpty():
        return rows, None
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in key]
    light, rest = (rows.alias("_r").join(heavy.alias("_h").hint("merge"), same, how) for how in ("left_anti", "left_semi"))
    return light, rest


def components_within(edges: DataFrame, key: list[str], each: int | None = None, large: int | None = None) -> DataFrame:
    """components of edges (key, u, v) that never leave their key: whole keys are settled in a task, without rounds.

    A key of more than large edges is settled by components with others of its size.
    """
    edges = kept(edges.select(*key, "u", "v"))
    heavy = kept(edges.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > (large or LARGE)).drop("n"))
    light, rest = edges, None
    if not heavy.isEmpty():
        light, rest = edges.join(heavy.hint("merge"), key, "left_anti"), edges.join(heavy.hint("merge"), key, "left_semi")
    tasks = max(-(-edges.count() // (each or EDGES)), edges.sparkSession.sparkContext.defaultParallelism)
    found = light.repartition(tasks, *key).select("u", "v").mapInPandas(_least, "u long, component long")
    return found if rest is None else found.unionAll(components(rest.select("u", "v")))
