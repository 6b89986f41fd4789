"""Shards hold near equal bytes, equal texts stay together unless they are many, and every row has its own slot."""

import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklore.llm.sharding import shard


def checked(docs, shards):
    got = shard(docs, shards).toPandas()
    want = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas()
    size = want.text.map(lambda t: len(t.encode()) + 8)
    crc = want.text.map(lambda t: zlib.crc32(t.encode()))
    plain = lambda ids, n, c: sorted(zip(ids.fillna(-1), n, c, strict=True))
    assert plain(got.doc_id, got["size"], got.text_crc32) == plain(want.doc_id, size, crc)
    assert got.shard.between(0, shards - 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    bytes_ = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    return got, bytes_


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_even(spark, shards):
    rng = random.Random(shards)
    rows = [(k, "x" * rng.randrange(400) + str(rng.randrange(3000))) for k in range(4000)]
    rows += [(k, "group of seven") for k in range(5000, 5007)]
    got, bytes_ = checked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards)
    mean = bytes_.mean()
    assert (bytes_ - mean).abs().max() <= 0.01 * mean + 450
    assert got[got.doc_id.between(5000, 5006)].shard.nunique() == 1


def test_hot_groups_and_repeats(spark):
    rows = [(k, "a text that a third of all rows have") for k in range(1500)] + [(7, "one row many times")] * 900 + [(None, None)] * 700
    rows += [(k, f"own {k}") for k in range(2000, 4000)] + [(9999, "long " * 500)]
    _, bytes_ = checked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 11)
    mean = bytes_.mean()
    assert (bytes_ - mean).abs().max() <= 0.01 * mean + 2600


def test_few_rows_and_one_huge_text(spark):
    got, bytes_ = checked(spark.createDataFrame([(1, "a"), (2, "b" * 100_000), (3, "c")], "doc_id long, text string"), 4)
    assert bytes_.sum() == 100_026 and len(got) == 3


def test_ties_stay_whole(spark):
    rows = [(k, f"text {k % 500}") for k in range(50_000)]  # groups of 100, each 0.6 % of a third
    got, bytes_ = checked(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])), 3)
    got["key"] = got.doc_id % 500
    assert (got.groupby("key").shard.nunique() == 1).all()
    assert (bytes_ - bytes_.mean()).abs().max() <= 0.01 * bytes_.mean()
