"""Queries of models of held-out groups, frozen models and subsets of features, and their SQL where there is a closed form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import heldout as H
from tracklore.operators import spectrum as P
from tracklore.operators import stats as S
from tracklore.operators import subsets as U
from tracklore.plans.views import fish_features, table

GROUPS = 24
FEATURES = ["quantity", "price"]


def _cells(spark, sf):
    """Lines as cells of groups of suppliers, a group's class by its number; a line's quantity tells a little of it."""
    x = table(spark, sf, "lineitem")
    g = (F.col("l_suppkey") % GROUPS).cast("int")
    y = (g % 3 == 0).cast("int")
    return x.select(g.alias("group"), y.alias("y"), F.array(F.col("l_quantity") + 6 * y + F.col("l_suppkey") % 5, F.col("l_extendedprice") / 1000 - 4 * y).alias("x"))


def _tasks():
    return H.left_out(list(range(GROUPS)), 0.01, 0.5)


def _discriminants(spark, sf):
    rows = _cells(spark, sf)
    return H.held_out_groups(rows, H.fit_discriminants(rows, _tasks(), 0.1)).drop("c")


def _folds(spark, sf, loss):
    rows = _cells(spark, sf)
    return H.held_out_groups(rows, H.fit(rows, _tasks(), loss))


def _tuned(spark, sf):
    rows = _cells(spark, sf)
    return H.held_out_groups(rows, H.fit(rows, H.tuned(rows, list(range(GROUPS)), [0.001, 0.1], 1.0)))


def _frozen(spark, sf):
    """Scores of all groups' means under models of each condition, with and without some groups, as written and read back."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/model-{uuid.uuid4().hex}"
    rows = _cells(spark, sf)
    conditions = {"all": frozenset(range(GROUPS)), "untreated": frozenset(range(0, GROUPS, 2))}
    model = H.freeze(rows, FEATURES, path, H.exclusion_tasks(conditions, {"none": frozenset(), "two": frozenset([4, 6])}, 0.1))
    long = rows.groupBy(F.col("group").alias("subject")).agg(*[F.avg(F.col("x")[k]).alias(f) for k, f in enumerate(FEATURES)]).unpivot("subject", FEATURES, "feature", "value")
    out = None
    for r in model.select("model", "intercept").distinct().orderBy("model").collect():
        own = S.frozen_scores(long, model.where(F.col("model") == r.model).drop("model", "intercept"), r.intercept)[0].withColumn("model", F.lit(r.model))
        out = own if out is None else out.unionAll(own)
    return out


def _subjects(spark, sf):
    """Nations as subjects, by the balances of their customers and the prices of their suppliers."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.stddev_samp("c_acctbal").alias("b"), (F.max("c_acctbal") - F.min("c_acctbal")).alias("c"), F.count("*").cast("double").alias("d"))
    return c.select(F.col("c_nationkey").alias("subject"), (F.col("c_nationkey") % 3 == 0).cast("int").alias("y"), "a", "b", "c", "d")


QUERIES = {
    "cells_left_out_discriminant": lambda spark, sf: rounded(_discriminants(spark, sf), 5),
    "cells_left_out_elastic_net": lambda spark, sf: rounded(_folds(spark, sf, "logistic"), 5),
    "cells_left_out_margins": lambda spark, sf: rounded(_folds(spark, sf, "svm"), 5),
    "cells_left_out_tuned": lambda spark, sf: rounded(_tuned(spark, sf), 5),
    "frozen_by_condition": lambda spark, sf: rounded(_frozen(spark, sf), 5),
    "feature_spectrum": lambda spark, sf: rounded(P.spectrum(table(spark, sf, "embeddings").select(F.slice("embedding", 1, 2).alias("x")), ["first", "second"], 2), 4),
    "chosen_clusters": lambda spark, sf: P.choose_clusters(table(spark, sf, "embeddings").select("label", F.col("embedding").alias("x")), range(2, 7))[0],
    "cluster_shares": lambda spark, sf: P.cluster_shares(P.choose_clusters(table(spark, sf, "embeddings").select("label", F.col("embedding").alias("x")), range(2, 7))[1], "label"),
    "effect_intervals": lambda spark, sf: rounded(P.effect_intervals(fish_features(spark, sf), "WT", "MUT", 2000), 5),
    "subset_screen": lambda spark, sf: rounded(U.screen(_subjects(spark, sf), ["a", "b", "c", "d"], most=2, families={"spread": ["b", "c"]}).where("size = 2").drop("delta_r_squared", "delta_balanced_accuracy", "delta_auc"), 5),
    "subset_ablation": lambda spark, sf: rounded(U.screen(_subjects(spark, sf), ["a", "b", "c", "d"], most=3), 5),
    "backward_elimination": lambda spark, sf: rounded(U.eliminate(_subjects(spark, sf), ["a", "b", "c", "d"]), 5),
}

ORACLE_SQL = {
    "feature_spectrum": """WITH r AS (SELECT corr(embedding[1], embedding[2]) AS r FROM embeddings), c AS (SELECT unnest([1, 2])::INT AS component, unnest([1 + abs(r), 1 - abs(r)]) AS v, unnest([sign(r), -sign(r)]) AS s FROM r)
SELECT component, f.feature, round(sqrt(v / 2) * CASE WHEN i = 1 THEN 1 ELSE s END, 4) AS loading, 50.0::DOUBLE AS contribution, round(v, 4) AS variance, round(v / 2, 4) AS share, round(CASE component WHEN 1 THEN v / 2 ELSE 1 END, 4) AS cumulative FROM c, (VALUES ('first', 1), ('second', 2)) f(feature, i)""",
    "cells_left_out_discriminant": f"""WITH r AS (SELECT (l_suppkey % {GROUPS})::INT AS g, (l_suppkey % {GROUPS} % 3 = 0)::INT AS y, l_quantity + l_suppkey % 5 AS q, l_extendedprice / 1000 AS p FROM lineitem), c AS (SELECT g, y, q + 6 * y AS u, p - 4 * y AS v FROM r),
s AS (SELECT g, y, count(*)::DOUBLE AS n, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv FROM c GROUP BY g, y),
f AS (SELECT o.g AS fold, s.y, sum(n) AS n, sum(u) AS u, sum(v) AS v, sum(uu) AS uu, sum(vv) AS vv, sum(uv) AS uv FROM (SELECT DISTINCT g FROM s) o JOIN s ON s.g <> o.g GROUP BY o.g, s.y),
t AS (SELECT fold, sum(n) AS n, sum(u) / sum(n) AS mu, sum(v) / sum(n) AS mv, sqrt(sum(uu) / sum(n) - (sum(u) / sum(n)) ** 2) AS su, sqrt(sum(vv) / sum(n) - (sum(v) / sum(n)) ** 2) AS sv, sum(uu - u * u / n) / sum(n) AS a, sum(vv - v * v / n) / sum(n) AS b, sum(uv - u * v / n) / sum(n) AS c,
  max(u / n) FILTER (y = 0) AS u0, max(u / n) FILTER (y = 1) AS u1, max(v / n) FILTER (y = 0) AS v0, max(v / n) FILTER (y = 1) AS v1, max(n) FILTER (y = 0) AS n0, max(n) FILTER (y = 1) AS n1 FROM f GROUP BY fold),
z AS (SELECT fold, mu, mv, su, sv, 0.9 * a / su / su + 0.05 * (a / su / su + b / sv / sv) AS a, 0.9 * b / sv / sv + 0.05 * (a / su / su + b / sv / sv) AS b, 0.9 * c / su / sv AS c, (u0 - mu) / su AS u0, (u1 - mu) / su AS u1, (v0 - mv) / sv AS v0, (v1 - mv) / sv AS v1, ln(n1 / n0) AS l FROM t),
w AS (SELECT *, (b * (u1 - u0) - c * (v1 - v0)) / (a * b - c * c) AS x, (a * (v1 - v0) - c * (u1 - u0)) / (a * b - c * c) AS k FROM z),
p AS (SELECT c.g, y, 1 / (1 + exp(-(x * (u - mu) / su + k * (v - mv) / sv - (x * (u0 + u1) + k * (v0 + v1)) / 2 + l))) AS p FROM c JOIN w ON w.fold = c.g)
SELECT g AS "group", max(y) AS y, count(*) AS n_cells, round(avg(p), 5) AS probability, (avg(p) >= 0.5)::INT AS predicted, ((avg(p) >= 0.5)::INT = max(y))::INT AS correct FROM p GROUP BY g""",
    "subset_screen": """WITH c AS (SELECT c_nationkey AS s, (c_nationkey % 3 = 0)::INT AS y, avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS b, max(c_acctbal) - min(c_acctbal) AS c, count(*)::DOUBLE AS d FROM customer GROUP BY c_nationkey),
l AS (SELECT s, y, unnest([0, 1, 2, 3]) AS k, unnest(['a', 'b', 'c', 'd']) AS f, unnest([a, b, c, d]) AS v FROM c), m AS (SELECT *, coalesce(v, median(v) OVER (PARTITION BY f), 0) AS w FROM l), z AS (SELECT *, w - avg(w) OVER (PARTITION BY f) AS x, y - avg(y) OVER (PARTITION BY f) AS dy, count(*) OVER (PARTITION BY f) AS n FROM m),
j AS (SELECT p.f || '|' || q.f AS features, (1 << p.k) + (1 << q.k) AS code, p.s, p.y, p.dy, p.n, p.x AS x1, q.x AS x2, sum(p.x * p.x) OVER w AS a, sum(q.x * q.x) OVER w AS b, sum(p.x * q.x) OVER w AS c, sum(p.x * p.dy) OVER w AS u, sum(q.x * p.dy) OVER w AS v, sum(p.dy * p.dy) OVER w AS t FROM z p JOIN z q ON p.s = q.s AND p.k < q.k WINDOW w AS (PARTITION BY p.f, q.f)),
e AS (SELECT *, (b * u - c * v) / (a * b - c * c) AS g, (a * v - c * u) / (a * b - c * c) AS h FROM j), r AS (SELECT *, (u * g + v * h) / t AS share, round(y - (dy - g * x1 - h * x2) / (1 - 1 / n - (b * x1 * x1 - 2 * c * x1 * x2 + a * x2 * x2) / (a * b - c * c)), 9) AS o FROM e),
k AS (SELECT features, code, any_value(share) AS r2, (avg((o >= 0.5)::INT) FILTER (y = 1) + avg((o < 0.5)::INT) FILTER (y = 0)) / 2 AS ba FROM r GROUP BY features, code),
q AS (SELECT x.features, avg(CASE WHEN x.o > z.o THEN 1 WHEN x.o = z.o THEN 0.5 ELSE 0 END) AS auc FROM r x JOIN r z ON x.features = z.features AND x.y = 1 AND z.y = 0 GROUP BY x.features)
SELECT u.subset, k.features, 2 AS size, round(r2, 5) AS r_squared, round(ba, 5) AS balanced_accuracy, round(auc, 5) AS auc FROM k JOIN q USING (features) JOIN (SELECT code, 'subset ' || code AS subset FROM k UNION ALL SELECT 6, 'family spread') u USING (code)""",
}
