"""Streams replayed over the driver tables, and readers of sources; their results equal one batch's, as the SQL has them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.functions.scalar import relative_difference, rounded
from tracklore.operators import reports as P
from tracklore.plans.views import VOX, table, voxels
from tracklore.sources import tables as S
from tracklore.streaming import link_stream as L


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern, as a stream takes one file only so
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _replayed(spark, stream: DataFrame, mode: str) -> DataFrame:
    folder = _folder(spark)
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")
    L.replay(stream, write, f"{folder}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def event_windows(spark, sf_dir):
    return _replayed(spark, L.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "6 hours", "1 hour"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sessions(spark, sf_dir):
    found = _replayed(spark, L.sessions(_events(spark, sf_dir), "ts", "user_id", "2 hours", "1 hour"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def latest_events(spark, sf_dir):
    folder = _folder(spark)
    rows = _events(spark, sf_dir).select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    L.replay(rows, L.keep_last_writer(f"{folder}/rows", ["user_id", "event_type"], "at"), f"{folder}/state")
    return rounded(spark.read.parquet(f"{folder}/rows").select("user_id", "event_type", "event_id", "value"))


def stream_crossings(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("block_name"), F.lit(0).alias("track_id"), F.col("event_id").alias("time"), (F.col("value") > 20).alias("inside"))
    return _replayed(spark, L.crossing_stream(e), "append")


STEPS, LATE = 5, "7 days"


def _arriving(spark, sf_dir) -> list[DataFrame]:
    """events in the order in which they arrive: six days a step; some one step after their own, some of the first two
    steps with the last one, which is too late; at the end one row of later days, which closes what is open."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    own = F.least(F.floor((F.dayofmonth("at") - 1) / 6), F.lit(STEPS - 1)).cast("int")
    step = F.when((own <= 1) & (F.col("event_id") % 101 == 5), STEPS - 1).when(F.col("event_id") % 50 == 7, F.least(own + 1, F.lit(STEPS - 1))).otherwise(own)
    e = e.withColumn("step", step)
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), (F.max("at") + F.expr("INTERVAL 40 DAYS")).alias("at"))
    return [*[e.where(F.col("step") == k).drop("step") for k in range(STEPS)], end]


def _in_steps(spark, sf_dir, made) -> DataFrame:
    """What a stream gives whose input grows step by step, and which is started again after each from what it kept."""
    folder = _folder(spark)
    steps = _arriving(spark, sf_dir)
    for k, rows in enumerate(steps):
        rows.write.parquet(f"{folder}/in/step={k}")
        stream = made(spark.readStream.schema(steps[0].schema).parquet(f"{folder}/in/*"))
        L.replay(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}"), f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


def late_windows(spark, sf_dir):
    return _in_steps(spark, sf_dir, lambda e: L.windowed_counts(e, "at", "event_type", "6 hours", LATE)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def late_sessions(spark, sf_dir):
    found = _in_steps(spark, sf_dir, lambda e: L.sessions(e, "at", "user_id", "2 hours", LATE))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def crossing_counts(spark, sf_dir):
    inside = lambda e: e.select(F.col("user_id").alias("track_id"), "at", F.col("event_id").alias("number"), (F.col("value") > 20).alias("inside"))
    with L.rocks_state(spark):
        found = _in_steps(spark, sf_dir, lambda e: L.crossing_counts(L.crossings_in_order(inside(e), LATE), "1 day"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _paths(spark, sf_dir, root):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", F.lit(root), "p_brand", F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("path"), F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("priority"))


QUERIES = {
    "event_windows": event_windows,
    "event_sessions": event_sessions,
    "latest_events": latest_events,
    "stream_crossings": stream_crossings,
    "late_windows": late_windows,
    "late_sessions": late_sessions,
    "crossing_counts": crossing_counts,
    "resolved_columns": lambda spark, sf: rounded(S.resolve_columns(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("Track"), F.col("o_totalprice").alias("VOLUME")), {"track_id": ["id", "track"], "volume_voxels": ["volume", "area"], "mean_intensity": ["intensity"]}, {"mean_intensity": 0.0}, ["track_id"])),
    "unioned_sources": lambda spark, sf: rounded(S.union_sources({"supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")})),
    "valid_metadata": lambda spark, sf: rounded(S.validated_metadata(table(spark, sf, "orders").select(F.col("o_custkey").alias("block"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, "-3").otherwise((F.col("o_orderkey") % 50).cast("string")).alias("seconds")), "block", "seconds", strict=False)),
    "paired_masks": lambda spark, sf: S.pair_manifests(_paths(spark, sf, "img").select("key", "path"), _paths(spark, sf, "mask").unionAll(_paths(spark, sf, "mask2").withColumn("priority", F.col("priority") + 1)).where("priority < 3 AND key % 4 <> 0")),
    "file_split": lambda spark, sf: S.split_files(_paths(spark, sf, "img"), (0.7, 0.15), 1),
    "file_split_appended": lambda spark, sf: S.split_files(_paths(spark, sf, "img"), (0.7, 0.15), 1, _paths(spark, sf, "img").where("key % 2 = 0").select("path", F.lit("train").alias("part"))),
    "sampled_rows": lambda spark, sf: P.sample_each(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 3, 42),
    "feret_proxies": lambda spark, sf: P.feret_proxies(voxels(spark, sf).groupBy("block", "t", "label").agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in "zyx"]), "z", "y", "x"),
    "relative_differences": lambda spark, sf: rounded(table(spark, sf, "part").select("p_partkey", relative_difference(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("difference"))),
    "per_minute_speeds": lambda spark, sf: rounded(_speeds(spark, sf)),
    "zero_based_frames": lambda spark, sf: _zero_based(spark, sf),
    "named_orders": lambda spark, sf: table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("place", P.named_order("c_mktsegment", ["MACHINERY", "BUILDING"])),
    "largest_orders": lambda spark, sf: rounded(table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)),
    "numeric_columns": lambda spark, sf: P.numeric_candidates(table(spark, sf, "customer"), [("identifier", r"(key|_id)$")]).join(P.availability(table(spark, sf, "customer"), {c: None for c in table(spark, sf, "customer").columns}).select("feature", "n_nonmissing"), "feature"),
}


def _speeds(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("speed_per_second"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("speed_per_min"))
    return p.select("p_partkey", S.per_minute(p, "speed_per_min").alias("speed_per_min"))


def _zero_based(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - P.time_offset(rows, "l_linenumber", 7)).cast("int").alias("frame"))


_IN_TIME = "it AS (SELECT * FROM events WHERE NOT (day(ts) <= 12 AND event_id % 101 = 5))"
_PATH = "SELECT 'img/' || p_brand || '/f' || p_partkey AS path, p_partkey AS key FROM part"
ORACLE_SQL = {
    "late_windows": f"WITH {_IN_TIME} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM it GROUP BY ALL",
    "late_sessions": f"""WITH {_IN_TIME}, g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '2 hours', true)::INT AS new FROM it WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "crossing_counts": f"""WITH {_IN_TIME}, l AS (SELECT user_id, event_id, ts, value > 20 AS i, lag(value > 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM it), c AS (SELECT *, CASE WHEN i THEN 'entry' ELSE 'exit' END AS event FROM l WHERE i <> p),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, event_id) AS total FROM c) SELECT date_trunc('day', ts)::TIMESTAMP AS start, event, count(*) AS n, max(total) AS largest_total FROM k GROUP BY ALL""",
    "event_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '2 hours', true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "latest_events": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stream_crossings": "WITH l AS (SELECT user_id AS block_name, 0 AS track_id, event_id::INT AS time, value > 20 AS i, lag(value > 20) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT block_name, track_id, time, CASE WHEN i THEN 'entry' ELSE 'exit' END AS event FROM l WHERE p IS NOT NULL AND i <> p",
    "resolved_columns": "SELECT o_orderkey, o_custkey AS track_id, round(o_totalprice, 6) AS volume_voxels, 0.0::DOUBLE AS mean_intensity FROM orders",
    "unioned_sources": "SELECT s_suppkey AS id, round(s_acctbal, 6) AS balance, NULL AS c_mktsegment, 'supplier' AS source FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'customer' FROM customer",
    "valid_metadata": "SELECT o_custkey AS block, min(o_orderkey % 50)::DOUBLE AS seconds FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 50 > 0 GROUP BY o_custkey",
    "paired_masks": """WITH m AS (SELECT p_partkey AS key, 'mask/' || p_brand || '/f' || p_partkey AS path, p_size % 3 AS p FROM part UNION ALL SELECT p_partkey, 'mask2/' || p_brand || '/f' || p_partkey, p_size % 3 + 1 FROM part),
b AS (SELECT key, path FROM m WHERE p < 3 AND key % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, path) = 1) SELECT p_partkey AS key, 'img/' || p_brand || '/f' || p_partkey AS path, b.path AS mask_path FROM part LEFT JOIN b ON b.key = p_partkey""",
    "file_split": f"WITH p AS ({_PATH}), k AS (SELECT path, row_number() OVER (ORDER BY md5(path || ':1'), path) AS k, count(*) OVER () AS n FROM p) SELECT path, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END AS part FROM k",
    "file_split_appended": f"WITH p AS ({_PATH}), k AS (SELECT path, row_number() OVER (ORDER BY md5(path || ':1'), path) AS k, count(*) OVER () AS n FROM p WHERE key % 2 <> 0) SELECT path, 'train' AS part FROM p WHERE key % 2 = 0 UNION ALL SELECT path, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END FROM k",
    "sampled_rows": "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':42'), c_custkey) <= 3",
    "feret_proxies": f"WITH {VOX}, o AS (SELECT block, t, label, max(z) - min(z) + 1 AS z, max(y) - min(y) + 1 AS y, max(x) - min(x) + 1 AS x FROM vox GROUP BY ALL) SELECT *, greatest(z, y, x) AS feret_max, list_sort([z, y, x])[2] AS feret_median, least(z, y, x) AS feret_min FROM o",
    "relative_differences": "SELECT p_partkey, round(abs(p_size - p_retailprice / 100) / greatest(abs(p_size), abs(p_retailprice / 100), 1e-6), 6) AS difference FROM part",
    "per_minute_speeds": "SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_retailprice / 1000 * 60 END, 6) AS speed_per_min FROM part",
    "zero_based_frames": "SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::INT AS frame FROM lineitem",
    "named_orders": "SELECT c_mktsegment, count(*) AS n, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS place FROM customer GROUP BY c_mktsegment",
    "largest_orders": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "numeric_columns": "SELECT f.feature, f.candidate, f.reason, (SELECT count(*) FROM customer) AS n_nonmissing FROM (VALUES ('c_custkey', false, 'identifier'), ('c_name', false, 'not numeric'), ('c_nationkey', false, 'identifier'), ('c_acctbal', true, NULL), ('c_mktsegment', false, 'not numeric')) f(feature, candidate, reason)",
}
