"""Trajectory views over the driver tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a view that one task holds, about: tasks follow the table, so that a task's memory does not.
ROWS = 100_000


def dealt(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, *keys: str) -> DataFrame:
    """rows of a table dealt once by keys; what follows by those keys and others stays in its task."""
    n = -(-table(spark, sf_dir, name).count() // ROWS)
    return rows.repartition(max(n, spark.sparkContext.defaultParallelism), *keys)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: a user is a block, an event type a track."""
    e = dealt(spark, sf_dir, "events", table(spark, sf_dir, "events"), "user_id")
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    return e.select(
        F.col("user_id").alias("block_name"), F.col("event_type").alias("track_id"), (F.row_number().over(order) - 1).alias("time"),
        (k % 40).cast("double").alias("centroid_z"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("centroid_y"), F.col("value").alias("centroid_x"),
        (1 + F.col("event_id") % 97).cast("double").alias("volume_voxels"), F.col("value").alias("mean_intensity"), F.col("event_id").alias("object_label"),
    )


DET = r"""det AS (
  SELECT user_id AS block_name, event_type AS track_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::INT AS time,
    (regexp_extract(props, '"k": *(\d+)', 1)::INT % 40)::DOUBLE AS centroid_z, (hour(ts) * 60 + minute(ts))::DOUBLE AS centroid_y, value AS centroid_x,
    (1 + event_id % 97)::DOUBLE AS volume_voxels, value AS mean_intensity, event_id AS object_label FROM events)"""


def big_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detections: a supplier is a block, a part number modulo 50 a track."""
    x = dealt(spark, sf_dir, "lineitem", table(spark, sf_dir, "lineitem").withColumn("track_id", F.col("l_partkey") % 50), "l_suppkey", "track_id")
    order = W.partitionBy("l_suppkey", "track_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return x.select(
        F.col("l_suppkey").alias("block_name"), "track_id", (F.row_number().over(order) - 1).alias("time"),
        F.col("l_linenumber").cast("double").alias("centroid_z"), F.col("l_quantity").alias("centroid_y"), (F.col("l_extendedprice") / 1000).alias("centroid_x"),
        F.col("l_quantity").alias("volume_voxels"), (F.col("l_discount") * 100).alias("mean_intensity"),
    )


BIG = """big AS (
  SELECT l_suppkey AS block_name, l_partkey % 50 AS track_id,
    (row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1)::INT AS time,
    l_linenumber::DOUBLE AS centroid_z, l_quantity AS centroid_y, l_extendedprice / 1000 AS centroid_x, l_quantity AS volume_voxels, l_discount * 100 AS mean_intensity
  FROM lineitem)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as cohort metadata."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("block_name"), F.concat(F.lit("fish"), key.cast("string")).alias("fish_id"), F.when(key % 3 == 0, "MUT").otherwise("WT").alias("genotype"),
        (250.0 + 50 * (key % 7)).cast("double").alias("time_interval_seconds"), F.when(key % 2 == 0, "treated").otherwise("untreated").alias("condition"),
    )


META = """meta AS (
  SELECT s_suppkey AS block_name, 'fish' || s_suppkey AS fish_id, CASE WHEN s_suppkey % 3 = 0 THEN 'MUT' ELSE 'WT' END AS genotype,
    (250.0 + 50 * (s_suppkey % 7))::DOUBLE AS time_interval_seconds, CASE WHEN s_suppkey % 2 = 0 THEN 'treated' ELSE 'untreated' END AS condition FROM supplier)"""


def block_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections whose time is the frame of their block, so a track (an event type) has gaps."""
    e = dealt(spark, sf_dir, "events", table(spark, sf_dir, "events"), "user_id")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    return e.select(
        F.col("user_id").alias("block_name"), F.col("event_type").alias("track_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("time"), F.to_date("ts").alias("day"),
        (k % 40).cast("double").alias("centroid_z"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("centroid_y"), F.col("value").alias("centroid_x"), (1 + F.col("event_id") % 97).cast("double").alias("volume_voxels"), F.col("value").alias("mean_intensity"),
    )


FRM = r"""frm AS (
  SELECT user_id AS block_name, event_type AS track_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS time, ts::DATE AS day,
    (regexp_extract(props, '"k": *(\d+)', 1)::INT % 40)::DOUBLE AS centroid_z, (hour(ts) * 60 + minute(ts))::DOUBLE AS centroid_y, value AS centroid_x, (1 + event_id % 97)::DOUBLE AS volume_voxels, value AS mean_intensity FROM events)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as voxels, one value for each place, the largest intensity: a supplier is a block, so blocks grow with the table."""
    x = dealt(spark, sf_dir, "lineitem", table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber").select(
        F.col("l_suppkey").alias("block"), F.col("l_linenumber").alias("t"), (F.col("l_quantity").cast("int") % 8).alias("z"),
        (F.col("l_partkey") % 8).cast("int").alias("y"), (F.col("l_orderkey") % 8).cast("int").alias("x"), F.col("l_extendedprice").alias("intensity"),
    )
    x = x.groupBy("block", "t", "z", "y", "x").agg(F.max("intensity").alias("intensity"))
    return x.withColumn("label", (1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("int"))


VOX = """vox AS (
  SELECT block, t, z, y, x, max(i) AS intensity, (1 + (y // 4) * 2 + x // 4)::INT AS label FROM (
    SELECT l_suppkey AS block, l_linenumber AS t, (l_quantity::INT % 8)::INT AS z, (l_partkey % 8)::INT AS y, (l_orderkey % 8)::INT AS x, l_extendedprice AS i FROM lineitem)
  GROUP BY block, t, z, y, x)"""


def fish_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features of customers as subjects: (subject, genotype, feature, value)."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")
    genotype = F.when(F.col("c_nationkey") % 3 == 0, "MUT").otherwise("WT")
    values = {"balance": F.col("c_acctbal"), "scaled": (F.col("c_acctbal") * (1 + F.col("c_nationkey") % 5)), "rank_like": (F.col("c_custkey") % 101).cast("double"), "coarse": (F.col("c_custkey") % 7).cast("double")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])).alias("p")
    return c.select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("fish"), genotype.alias("genotype"), pairs).select("subject", "fish", "genotype", "p.feature", "p.value")


FISH = """feat AS (
  SELECT c_custkey AS subject, c_nationkey AS fish, CASE WHEN c_nationkey % 3 = 0 THEN 'MUT' ELSE 'WT' END AS genotype, unnest(['balance', 'scaled', 'rank_like', 'coarse']) AS feature,
    unnest([c_acctbal, c_acctbal * (1 + c_nationkey % 5), (c_custkey % 101)::DOUBLE, (c_custkey % 7)::DOUBLE]) AS value FROM customer)"""
