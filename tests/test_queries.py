"""Every query of the plans with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracklore.plans import cohort_queries, inference_queries, link_queries, mask_queries, model_queries, report_queries, series_queries, stream_queries, track_queries, voxel_queries

SF = "/root/testdata/sf0.001"
PLANS = (track_queries, cohort_queries, series_queries, voxel_queries, mask_queries, inference_queries, model_queries, link_queries, report_queries, stream_queries)
CASES = [(m, n) for m in PLANS for n in m.ORACLE_SQL]


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, bool):
        return int(x)
    return int(x) if isinstance(x, float) and x == int(x) and abs(x) < 1e15 else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return c


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_matches_sql(spark, duck, module, name):
    ours, theirs = module.QUERIES[name](spark, SF).toPandas(), duck.sql(module.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
