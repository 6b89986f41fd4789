"""What a Scratch leaves on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tracklore.llm.common import Scratch


def test_the_shuffles_of_a_table_go_when_the_next_is_written(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    dirs = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*.data")}
    before = files()
    with Scratch(spark) as scratch:
        scratch.table(spark.range(200_000).groupBy((F.col("id") % 99_991).alias("k")).agg(F.count("*").alias("n")))
        assert files() - before
        time.sleep(2)  # the listeners of the session let go of a query a little after its end
        scratch.table(spark.range(1))
        end = time.time() + 8
        while files() - before and time.time() < end:
            time.sleep(0.2)
        assert not files() - before
