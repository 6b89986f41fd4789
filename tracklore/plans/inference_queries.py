"""Queries of tests with their tails, and their SQL, which integrates numerically."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.functions.scalar import rounded
from tracklore.operators import inference as I
from tracklore.plans.views import FISH, fish_features, table

A, B = ["WT", "MUT"], ["none", "mmp", "lira"]


def _factors(spark, sf):
    """Totals and lengths of priorities of orders, by customer's and order's number as two factors."""
    o = table(spark, sf, "orders")
    b = F.element_at(F.array(*map(F.lit, B)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.select(F.when(F.col("o_custkey") % 2 == 0, "MUT").otherwise("WT").alias("a"), b.alias("b"), (F.col("o_totalprice") / 1000).alias("total"), (F.length("o_orderpriority") + F.col("o_custkey") % 2).cast("double").alias("priority"))
    return rows.unpivot(["a", "b"], ["total", "priority"], "feature", "value")


def _cohorts(spark, sf):
    """Nations as subjects of each market segment, scored by their customers' mean balance."""
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("cohort"), "c_nationkey").agg(F.round(F.avg("c_acctbal"), 0).alias("score"))
    return c.select("cohort", (F.col("c_nationkey") % 3 == 0).alias("positive"), "score", (F.col("score") > 4500).alias("predicted"))


def _many(spark, sf):
    """(feature, subject, z): suppliers of the first 50 numbers as subjects, prices of 40 groups of parts as features, scaled."""
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("subject"), (F.col("l_partkey") % 40).alias("feature")).agg(F.avg("l_extendedprice").alias("m"))
    s = m.groupBy("feature").agg(F.avg("m").alias("c"), F.stddev_samp("m").alias("s"))
    return m.join(s.hint("merge"), "feature").select("feature", "subject", F.when(F.col("s") > 0, (F.col("m") - F.col("c")) / F.col("s")).otherwise(0.0).alias("z"))


def _groups(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("subject")).distinct()
    return n.select("subject", F.when(F.col("subject") % 2 == 0, "MUT").otherwise("WT").alias("a"), F.element_at(F.array(*map(F.lit, B)), (F.col("subject") % 3 + 1).cast("int")).alias("b"))


QUERIES = {
    "kruskal": lambda spark, sf: rounded(I.kruskal(fish_features(spark, sf).withColumn("g", F.col("fish") % 5), "g"), 5),
    "spread_tests": lambda spark, sf: rounded(I.spread_tests(fish_features(spark, sf), "genotype"), 4),
    "factorial_terms": lambda spark, sf: rounded(I.factorial_terms(_factors(spark, sf), A, B).drop("q"), 5),
    "factorial_contrasts": lambda spark, sf: rounded(I.factorial_contrasts(_factors(spark, sf), A, B).withColumn("reach", (F.col("high") - F.col("low")) / 2 / F.col("error")).drop("q", "low", "high"), 4),
    "exact_label_nulls": lambda spark, sf: rounded(I.exact_label_nulls(_cohorts(spark, sf), ["cohort"])),
    "permanova": lambda spark, sf: rounded(I.permanova(_many(spark, sf), _groups(spark, sf), A, B, 999)),
    "dispersion": lambda spark, sf: rounded(I.dispersion(_many(spark, sf), _groups(spark, sf).select("subject", F.col("b").alias("g")), 999)),
}


def _tail(f: str, d1: str, d2: str) -> str:
    """p of an F by the trapezoidal rule over the angle whose squared sine is beta distributed."""
    top, n = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))", 40_000
    low = f"greatest(0, {top} - 60 / sqrt({d2}))"
    term = lambda k: f"exp((({d2}) - 1) * ln(greatest(sin({low} + ({k}) * ({top} - {low}) / {n}), 1e-300)) + (({d1}) - 1) * ln(greatest(cos({low} + ({k}) * ({top} - {low}) / {n}), 1e-300)))"
    inside = f"list_sum(list_transform(range(1, {n}), lambda node: {term('node')})) + ({term('0')} + {term(str(n))}) / 2"
    return f"2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)) * ({inside}) * ({top} - {low}) / {n}"


_FACTORS = """fa AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'MUT' ELSE 'WT' END AS a, ['none', 'mmp', 'lira'][o_orderkey % 3 + 1] AS b, unnest(['total', 'priority']) AS feature, unnest([o_totalprice / 1000, (length(o_orderpriority) + o_custkey % 2)::DOUBLE]) AS v FROM orders),
ce AS (SELECT feature, a, b, count(*) AS n, avg(v) AS m, var_pop(v) / (1 - 1 / count(*)) ** 2 / count(*) AS s, var_pop(v) * count(*) AS ss FROM fa GROUP BY ALL),
tt AS (SELECT feature, sum(n)::BIGINT - 6 AS d, sum(ss) AS sse FROM ce GROUP BY feature)"""  # fmt: skip

ORACLE_SQL = {
    "kruskal": f"""WITH {FISH}, v AS (SELECT feature, fish % 5 AS g, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM feat), s AS (SELECT feature, g, count(*) AS n, sum(r) AS r FROM v GROUP BY ALL),
t AS (SELECT feature, sum(c * c * c - c)::DOUBLE AS t FROM (SELECT feature, count(*)::DOUBLE AS c FROM feat GROUP BY feature, value) GROUP BY feature), k AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n_total, sum(r * r / n) AS q FROM s GROUP BY feature),
h AS (SELECT feature, k, n_total, (12 / (n_total * (n_total + 1)) * q - 3 * (n_total + 1)) / (1 - t / (n_total::DOUBLE ** 3 - n_total)) AS h FROM k JOIN t USING (feature)) SELECT feature, k, n_total, round(h, 5) AS h, round(exp(-h / 2) * (1 + h / 2), 5) AS p FROM h""",
    "spread_tests": f"""WITH {FISH}, d AS (SELECT feature, genotype, abs(value - median(value) OVER (PARTITION BY feature, genotype)) AS d FROM feat), g AS (SELECT feature, genotype, count(*) AS n, avg(d) AS m, var_pop(d) AS s FROM d GROUP BY ALL), t AS (SELECT feature, avg(d) AS gm FROM d GROUP BY feature),
f AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n_total, sum(n * (m - gm) ** 2) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))) AS f FROM g JOIN t USING (feature) GROUP BY feature) SELECT feature, k, n_total, round(f, 4) AS f, round({_tail('f', 'k - 1', 'n_total - k')}, 4) AS p FROM f""",
    "factorial_terms": f"""WITH {_FACTORS}, w AS (SELECT feature, b, max(m) FILTER (a = 'MUT') AS x, max(m) FILTER (a = 'WT') AS y, sum(s) AS s, sum(1 / n) AS r FROM ce GROUP BY feature, b),
e AS (SELECT feature, 'a' AS term, 1 AS k, avg(x - y) AS u, NULL::DOUBLE AS v, sum(s) / 9 AS uu, NULL::DOUBLE AS vv, NULL::DOUBLE AS uv, sum(r) / 9 AS ru, NULL::DOUBLE AS rv, NULL::DOUBLE AS ruv FROM w GROUP BY feature
 UNION ALL SELECT p.feature, t.term, 2, p.x + t.z * p.y - l.x - t.z * l.y, q.x + t.z * q.y - l.x - t.z * l.y, p.s + l.s, q.s + l.s, l.s, p.r + l.r, q.r + l.r, l.r FROM w p JOIN w q ON p.feature = q.feature AND p.b = 'none' AND q.b = 'mmp' JOIN w l ON l.feature = p.feature AND l.b = 'lira', (VALUES ('b', 1), ('a:b', -1)) t(term, z)),
f AS (SELECT e.*, d, sse, CASE k WHEN 1 THEN u * u / uu ELSE (u * u * vv - 2 * u * v * uv + v * v * uu) / (uu * vv - uv * uv) / 2 END AS f, CASE k WHEN 1 THEN u * u / ru ELSE (u * u * rv - 2 * u * v * ruv + v * v * ru) / (ru * rv - ruv * ruv) END AS ss FROM e JOIN tt USING (feature))
SELECT feature, term, k AS df_term, d AS df_rest, round(f, 5) AS f, round(ss / (ss + sse), 5) AS partial_eta_squared, round(CASE k WHEN 2 THEN (1 + 2 * f / d) ** (-d / 2.0) ELSE {_tail('f', '1', 'd')} END, 5) AS p FROM f""",
    "factorial_contrasts": f"""WITH {_FACTORS}, c AS (SELECT x.feature, x.a || ' - ' || y.a || ' | ' || x.b AS contrast, x.m - y.m AS e, sqrt(x.s + y.s) AS s FROM ce x JOIN ce y ON x.feature = y.feature AND x.b = y.b AND x.a = 'MUT' AND y.a = 'WT'
 UNION ALL SELECT x.feature, x.b || ' - ' || y.b || ' | ' || x.a, x.m - y.m, sqrt(x.s + y.s) FROM ce x JOIN ce y ON x.feature = y.feature AND x.a = y.a AND x.b <> 'none' AND y.b = 'none')
SELECT feature, contrast, round(e, 4) + 0 AS estimate, round(s, 4) AS error, d AS df, round(e / s, 4) + 0 AS t, round({_tail('(e / s) ** 2', '1', 'd')}, 4) AS p, round(1.959963984540054 + 2.3722712 / d + 2.8225 / d / d, 4) AS reach FROM c JOIN tt USING (feature)""",
    "exact_label_nulls": """WITH RECURSIVE s AS (SELECT c_mktsegment AS cohort, c_nationkey % 3 = 0 AS y, round(avg(c_acctbal), 0) AS v FROM customer GROUP BY c_mktsegment, c_nationkey), i AS (SELECT cohort, y, v > 4500 AS p, row_number() OVER (PARTITION BY cohort ORDER BY v) AS k, 2 * rank() OVER (PARTITION BY cohort ORDER BY v) + count(*) OVER (PARTITION BY cohort, v) - 1 AS r FROM s),
g AS (SELECT cohort, count(*)::INT AS n, count(*) FILTER (y)::INT AS m, sum(r) FILTER (y) AS own, count(*) FILTER (p) AS called, count(*) FILTER (p AND y) AS hit FROM i GROUP BY cohort),
d AS (SELECT cohort, 0::BIGINT AS k, 0::BIGINT AS m, 0::BIGINT AS s, 1::DOUBLE AS c FROM g UNION ALL SELECT d.cohort, any_value(d.k) + 1, d.m + t, (d.s + t * i.r)::BIGINT, sum(c) FROM d JOIN i ON i.cohort = d.cohort AND i.k = d.k + 1, (VALUES (0), (1)) u(t) GROUP BY d.cohort, d.m + t, d.s + t * i.r),
e AS (SELECT d.cohort, d.s - g.m * (g.m + 1) AS u, c, own - g.m * (g.m + 1) AS o, g.m * (g.n - g.m) AS w FROM d JOIN g ON g.cohort = d.cohort AND d.k = g.n AND d.m = g.m),
a AS (SELECT cohort, any_value(o) / (2 * any_value(w)) AS auc, sum(c) AS sets, (sum(c) FILTER (u >= o) + 1) / (sum(c) + 1) AS p1, (sum(c) FILTER (abs(u - w) >= abs(o - w)) + 1) / (sum(c) + 1) AS p2 FROM e GROUP BY cohort),
h AS (SELECT cohort, j, n, m, called, hit, exp(lgamma(called + 1) - lgamma(j + 1) - lgamma(called - j + 1) + lgamma(n - called + 1) - lgamma(m - j + 1) - lgamma(n - called - m + j + 1)) AS c, j * (n - m) + (n - m - called + j) * m AS acc, hit * (n - m) + (n - m - called + hit) * m AS mine FROM (SELECT *, unnest(range(greatest(0, called - (n - m)), least(called, m) + 1)) AS j FROM g)),
b AS (SELECT cohort, any_value(mine) / (2 * any_value(m) * (any_value(n) - any_value(m))) AS ba, (round(sum(c) FILTER (acc >= mine), 0) + 1) / (round(sum(c), 0) + 1) AS p3 FROM h GROUP BY cohort)
SELECT cohort, n, m AS n_positive, round(auc, 6) AS auc, round(ba, 6) AS balanced_accuracy, sets AS label_sets, round(p1, 6) AS auc_p, round(p2, 6) AS auc_two_sided_p, round(p3, 6) AS balanced_accuracy_p FROM g JOIN a USING (cohort) JOIN b USING (cohort)""",
}
