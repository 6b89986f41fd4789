"""Shared helpers: reading tables, cutting lineage, size-checked joins, packed exchange blocks, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key tables of at most this many rows may be broadcast (8 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse's file
    system, or on one machine a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None)
        if not found and spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        found = found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        shared_dir.own = found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, for results that outlive a Scratch.

    Its files go when nothing refers to it where spark.cleaner.referenceTracking.cleanCheckpoints is set, as it should
    be on a cluster; else with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver let go of plans that nothing refers to: Spark removes a shuffle's files only once its plan is collected,
    which a driver with free memory puts off while the disks of a long job fill."""
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder, all removed on leaving the block; the shuffles that made one go when the next is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        """df, written out and read back: exact sizes for the planner, and a lineage of one scan."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_) -> None:
        self._delete(self.root)


def keys_hint(keys: DataFrame) -> DataFrame:
    """A table of keys with the join strategy that its counted size allows."""
    return keys.hint("broadcast" if keys.count() <= BROADCAST_ROWS else "shuffle_hash")


#: Parts that each key's rows are dealt to in a join with a table too large to broadcast.
SALTS = 16


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], row_bytes: int | Column, how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once, whatever share of rows a key holds.

    The table is broadcast if its counted rows take at most BROADCAST_ROWS words of 8 bytes; else it is copied SALTS
    times, and each key's rows are dealt to the copies.
    """
    size = table.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    if size <= 8 * BROADCAST_ROWS:
        return rows.join(table.hint("broadcast"), on, how)
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(table.hint("merge"), [*on, "_salt"], how).drop("_salt")


def pack(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that occurs, each column's values packed in bytes: a block of a distributed matrix."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:], len(order)]
    rows = {"bucket": pa.array(found.astype(np.int32))}
    for name, values in columns.items():
        values = values[order]
        rows[name] = pa.array([values[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(rows)


def unpack(pdf: pd.DataFrame, **types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[name]), kind) for name, kind in types.items()]


def empty_safe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours of u are tied to the least of u's closed neighbourhood."""
    if large:
        e = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sized_join(e, least, ["u"], 16)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, component) for every node of the edges (u, v): component is the least node it reaches.

    Alternating large-star and small-star steps, each round cut by a checkpoint; the number of rounds grows with the
    logarithm of the nodes. Self loops give a node its own component. No row is collected but a count and a checksum.
    """
    nodes = edges.select("u").unionAll(edges.select(F.col("v").alias("u"))).distinct()
    now, seen = cut(edges.where("u <> v").distinct()), None
    for _ in range(rounds):
        now = cut(_stars(_stars(now, large=True), large=False))
        tidy(edges.sparkSession)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    tied = now.select("u", F.col("v").alias("component"))
    return nodes.join(tied.hint("merge"), "u", "left").select("u", F.coalesce("component", "u").alias("component"))
