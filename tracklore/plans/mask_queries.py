"""Queries over masks as runs, and their SQL, which works on pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracklore.operators import morphology as M
from tracklore.plans.views import VOX, dealt, table, voxels

SIZE = 32
FRAME = ["block", "t"]


def plates(spark, sf):
    """lineitem as images of every supplier's own: the largest price at each place, lighter towards the middle; 0 where no row is."""
    x = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("block"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % SIZE).cast("int").alias("y"), ((F.col("l_partkey") * 5 + F.col("l_quantity").cast("long")) % SIZE).cast("int").alias("x"), F.col("l_extendedprice").alias("v"),
    )
    x, blocks = (dealt(spark, sf, "lineitem", rows, "block") for rows in (x, x.select("block").distinct()))
    middle = F.pow(F.col("y") - 14, F.lit(2)) + F.pow(F.col("x") - 17, F.lit(2))
    x = x.withColumn("v", F.when(middle < 90, F.col("v") + 40_000).otherwise(F.col("v") / 2))
    axis = F.sequence(F.lit(0), F.lit(SIZE - 1))
    grid = blocks.select("block", F.explode(axis).alias("y")).select("block", "y", F.explode(axis).alias("x"), F.lit(0.0).alias("v"))
    return x.unionAll(grid).groupBy("block", "y", "x").agg(F.max("v").alias("v"))


_PLATES = f"""pl AS (SELECT block, y, x, max(v) AS v FROM (
  SELECT block, y, x, CASE WHEN (y - 14) ** 2 + (x - 17) ** 2 < 90 THEN v + 40000 ELSE v / 2 END AS v FROM (
    SELECT l_suppkey AS block, ((l_orderkey * 7 + l_linenumber * 3) % {SIZE})::INT AS y, ((l_partkey * 5 + l_quantity::BIGINT) % {SIZE})::INT AS x, l_extendedprice AS v FROM lineitem)
  UNION ALL SELECT block, y, x, 0 FROM (SELECT DISTINCT l_suppkey AS block FROM lineitem), (SELECT unnest(range({SIZE}))::INT AS y), (SELECT unnest(range({SIZE}))::INT AS x)) GROUP BY block, y, x),
gr AS (SELECT block, y, x FROM pl)"""


def _body(spark, sf):
    return M.body_outline(plates(spark, sf), ["block"], "v", SIZE, SIZE, sigma=1.2, relaxed=0.9, closing=2, hole=12, least=20, dilation=1)


def _bright(spark, sf):
    return plates(spark, sf).where("v > 60000").select("block", "y", "x")


def _cluster(spark, sf, body):
    return M.dense_outline(_bright(spark, sf), ["block"], SIZE, SIZE, body, sigma=1.5, quantile=0.6, floor=0.08, closing=1, least=6, dilation=1)


def _exclusion(spark, sf):
    body = _body(spark, sf)
    return M.exclusion_outline(_cluster(spark, sf, body), ["block"], SIZE, SIZE, body, 3)


def _flat(runs, *more):
    return M.pixels_of(runs, ["block"], *more)


def _frames(spark, sf):
    return voxels(spark, sf).select(*FRAME).distinct()


def _masks(spark, sf):
    return M.runs_of(voxels(spark, sf).where("intensity > 85000").select(*FRAME, "y", "x"), FRAME)


def _links(spark, sf):
    """Links of a place to another two frames later."""
    at = voxels(spark, sf).select(*FRAME, "y", "x").distinct()
    return at.select("block", ((F.col("block") * 8 + F.col("t")) * 64 + F.col("y") * 8 + F.col("x")).alias("link_id"), F.col("t").alias("t0"), (F.col("t") + 2).alias("t1"), F.col("y").alias("y0"), F.col("x").alias("x0"), (7 - F.col("x")).alias("y1"), F.col("y").alias("x1"))


QUERIES = {
    "mask_parts": lambda spark, sf: M.parts(M.runs_of(_bright(spark, sf), ["block"]), ["block"], corners=True).groupBy("block", "first").agg(F.first("area").alias("area"), F.count("*").alias("runs")).select("block", "first.y", "first.x", "area", "runs"),
    "closed_mask": lambda spark, sf: _flat(M.closed_runs(M.runs_of(_bright(spark, sf), ["block"]), plates(spark, sf).select("block").distinct(), ["block"], 2, SIZE, SIZE)),
    "filled_mask": lambda spark, sf: _flat(M.filled(M.runs_of(_bright(spark, sf), ["block"]), plates(spark, sf).select("block").distinct(), ["block"], 12, SIZE, SIZE)),
    "body_outline": lambda spark, sf: _flat(_body(spark, sf)),
    "cluster_outline": lambda spark, sf: _flat(_cluster(spark, sf, _body(spark, sf)), "cluster_id"),
    "cluster_numbers": lambda spark, sf: _flat(M.dense_outline(_bright(spark, sf), ["block"], SIZE, SIZE, sigma=1.0, quantile=0.5, floor=0.2, closing=1, least=4, only_largest=False, dilation=0), "cluster_id"),
    "exclusion_outline": lambda spark, sf: _flat(_exclusion(spark, sf)),
    "carried_masks": lambda spark, sf: M.pixels_of(M.carried(_masks(spark, sf), _frames(spark, sf), ["block"], "t", 3), FRAME, "carried_from"),
    "links_across_frames": lambda spark, sf: M.links_across(_links(spark, sf), M.carried(_masks(spark, sf), _frames(spark, sf), ["block"], "t", 3), ["block"], "t", 9),
}


def _disk(r: int) -> str:
    return f"(SELECT dy, dx FROM (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest(range(-{r}, {r + 1})) AS dx) WHERE dy * dy + dx * dx <= {r * r})"


def _dilated(name: str, src: str, r: int) -> str:
    return f"{name} AS (SELECT DISTINCT block, (y + dy)::INT AS y, (x + dx)::INT AS x FROM {src}, {_disk(r)} WHERE y + dy BETWEEN 0 AND {SIZE - 1} AND x + dx BETWEEN 0 AND {SIZE - 1})"


def _closed(name: str, src: str, r: int, grid: str = "gr") -> str:
    return f"{_dilated(name + '_d', src, r)}, {name}_o AS (SELECT * FROM {grid} ANTI JOIN {name}_d USING (block, y, x)), {_dilated(name + '_e', name + '_o', r)}, {name} AS (SELECT * FROM {grid} ANTI JOIN {name}_e USING (block, y, x))"


def _parts(name: str, src: str, corners: bool) -> str:
    """name has (block, y, x, part, area, fy, fx); part is the run of the least row and column."""
    c = int(corners)
    return f"""{name}_r AS (SELECT block, y, min(x) AS a, max(x) AS b, block * 100000 + y * 1000 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY block, y ORDER BY x) AS g FROM {src}) GROUP BY block, y, g),
{name}_t AS (SELECT p.id AS u, q.id AS v FROM {name}_r p JOIN {name}_r q ON p.block = q.block AND q.y = p.y + 1 AND p.a <= q.b + {c} AND q.a <= p.b + {c}), {name}_b AS (SELECT u, v FROM {name}_t UNION ALL SELECT v, u FROM {name}_t),
{name}_c AS (SELECT id AS u, id AS v FROM {name}_r UNION SELECT {name}_c.u, {name}_b.v FROM {name}_c JOIN {name}_b ON {name}_b.u = {name}_c.v), {name}_p AS (SELECT u AS id, min(v) AS part FROM {name}_c GROUP BY u),
{name}_s AS (SELECT part, sum(b - a + 1)::BIGINT AS area, count(*) AS runs FROM {name}_r JOIN {name}_p USING (id) GROUP BY part),
{name} AS (SELECT block, y, unnest(range(a, b + 1))::INT AS x, part, area, runs FROM {name}_r JOIN {name}_p USING (id) JOIN {name}_s USING (part))"""


def _smooth(name: str, src: str, sigma: float) -> str:
    r, two = int(4 * sigma + 0.5), 2 * SIZE
    total = sum(math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1))
    k = f"(SELECT d, exp(-d * d / {2 * sigma * sigma}) / {total!r} AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS d))"
    one = f"SELECT block, x, least(t, {two - 1} - t) AS y, sum(v * w) AS v FROM (SELECT block, x, v, w, (y + d + {2 * two}) % {two} AS t FROM {src}, {k}) GROUP BY ALL"
    return f"{name} AS (SELECT block, y, least(t, {two - 1} - t) AS x, round(sum(v * w), 9) AS v FROM (SELECT block, y, v, w, (x + d + {2 * two}) % {two} AS t FROM ({one}), {k}) GROUP BY ALL)"


_BODY = f"""{_PLATES}, q AS (SELECT block, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.998) AS b FROM pl GROUP BY block HAVING b > a),
sc AS (SELECT block, y, x, least(greatest((v - a) / (b - a), 0), 1) AS v FROM pl JOIN q USING (block)), {_smooth("sm", "sc", 1.2)},
sp AS (SELECT block, min(v) AS a, max(v) AS b FROM sm GROUP BY block HAVING max(v) > min(v)), hi AS (SELECT block, a, b, least(floor((v - a) / (b - a) * 256), 255) AS l, count(*) AS n FROM sm JOIN sp USING (block) GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER u AS w, sum(n * l) OVER u AS m, sum(n) OVER e AS ww, sum(n * l) OVER e AS mm FROM hi WINDOW u AS (PARTITION BY block ORDER BY l), e AS (PARTITION BY block)),
th AS (SELECT block, a + (l + 0.5) * (b - a) / 256 AS th FROM cu WHERE ww > w QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(w * (ww - w) * (m / w - (mm - m) / (ww - w)) ** 2, 6) DESC, l) = 1),
li AS (SELECT block, y, x FROM sm JOIN th USING (block) WHERE v > greatest(round(0.9 * th, 9), 0.03)), {_closed("cl", "li", 2)}, ho AS (SELECT * FROM gr ANTI JOIN cl USING (block, y, x)), {_parts("hp", "ho", False)},
fi AS (SELECT block, y, x FROM cl UNION ALL SELECT block, y, x FROM hp WHERE area < 12), {_parts("fp", "fi", False)}, bi AS (SELECT block, y, x FROM fp WHERE area >= 20), {_parts("bp", "bi", True)},
lg AS (SELECT block, y, x FROM bp SEMI JOIN (SELECT part FROM bp GROUP BY block, part, area QUALIFY row_number() OVER (PARTITION BY block ORDER BY area DESC, part) = 1) USING (part)), {_dilated("bo", "lg", 1)}"""  # fmt: skip

_CLUSTER = f"""{_BODY}, br AS (SELECT block, y, x FROM pl SEMI JOIN bo USING (block, y, x) WHERE v > 60000), dn AS (SELECT *, 1.0::DOUBLE AS v FROM br), {_smooth("de", "dn", 1.5)},
ct AS (SELECT block, greatest(round(quantile_cont(v, 0.6), 9), 0.08) AS c FROM de SEMI JOIN br USING (block, y, x) GROUP BY block), co AS (SELECT block, y, x FROM de JOIN ct USING (block) SEMI JOIN bo USING (block, y, x) WHERE v >= c), gc AS (SELECT * FROM gr SEMI JOIN br USING (block)),
{_closed("cc", "co", 1, "gc")}, {_parts("cs", "cc", False)}, cb AS (SELECT block, y, x FROM cs WHERE area >= 6), {_parts("cp", "cb", True)},
cg AS (SELECT block, y, x FROM cp SEMI JOIN (SELECT part FROM cp WHERE area >= 6 GROUP BY block, part, area QUALIFY row_number() OVER (PARTITION BY block ORDER BY area DESC, part) = 1) USING (part)), {_dilated("cd", "cg", 1)}, cx AS (SELECT * FROM cd SEMI JOIN bo USING (block, y, x))"""  # fmt: skip

_CARRIED = f"""{VOX}, mk AS (SELECT DISTINCT block, t, y, x FROM vox WHERE intensity > 85000), fr AS (SELECT DISTINCT block, t FROM vox), ar AS (SELECT block, t, count(*) AS n FROM mk GROUP BY block, t),
ca AS (SELECT block, t, coalesce(last_value(CASE WHEN n >= 3 THEN t END IGNORE NULLS) OVER (PARTITION BY block ORDER BY t), t) AS s FROM fr LEFT JOIN ar USING (block, t)),
cm AS (SELECT ca.block, ca.t, ca.s AS carried_from, y, x FROM ca JOIN mk ON mk.block = ca.block AND mk.t = ca.s)"""  # fmt: skip

ORACLE_SQL = {
    "mask_parts": f"WITH RECURSIVE {_PLATES}, br AS (SELECT block, y, x FROM pl WHERE v > 60000), {_parts('pt', 'br', True)} SELECT block, min(y) AS y, arg_min(x, y * 100 + x) AS x, area, runs FROM pt GROUP BY block, part, area, runs",
    "closed_mask": f"WITH {_PLATES}, br AS (SELECT block, y, x FROM pl WHERE v > 60000), {_closed('cl', 'br', 2)} SELECT * FROM cl",
    "filled_mask": f"WITH RECURSIVE {_PLATES}, br AS (SELECT block, y, x FROM pl WHERE v > 60000), ho AS (SELECT * FROM gr ANTI JOIN br USING (block, y, x)), {_parts('hp', 'ho', False)} SELECT * FROM br UNION ALL SELECT block, y, x FROM hp WHERE area < 12",
    "body_outline": f"WITH RECURSIVE {_BODY} SELECT * FROM bo",
    "cluster_outline": f"WITH RECURSIVE {_CLUSTER} SELECT block, 1 AS cluster_id, y, x FROM cx",
    "cluster_numbers": f"""WITH RECURSIVE {_PLATES}, br AS (SELECT block, y, x, 1.0::DOUBLE AS v FROM pl WHERE v > 60000), {_smooth("de", "br", 1.0)}, ct AS (SELECT block, greatest(round(quantile_cont(de.v, 0.5), 9), 0.2) AS c FROM de SEMI JOIN br USING (block, y, x) GROUP BY block),
co AS (SELECT block, y, x FROM de JOIN ct USING (block) WHERE v >= c), gc AS (SELECT * FROM gr SEMI JOIN br USING (block)), {_closed("cc", "co", 1, "gc")}, {_parts("cs", "cc", False)}, cb AS (SELECT block, y, x FROM cs WHERE area >= 4), {_parts("cp", "cb", True)}
SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY part)::INT AS cluster_id, y, x FROM cp WHERE area >= 4""",
    "exclusion_outline": f"WITH RECURSIVE {_CLUSTER}, {_dilated('ex', 'cx', 3)} SELECT * FROM ex SEMI JOIN bo USING (block, y, x)",
    "carried_masks": f"WITH {_CARRIED} SELECT block, t, carried_from, y, x FROM cm",
    "links_across_frames": f"""WITH {_CARRIED}, ln AS (SELECT DISTINCT block, t, y, x, (block * 8 + t) * 64 + y * 8 + x AS link_id FROM vox), an AS (SELECT link_id, block, unnest(range(t, t + 3)) AS t, y, x FROM ln),
pt AS (SELECT link_id, block, t, y + (7 - x - y) * k / 8.0 AS a, x + (y - x) * k / 8.0 AS b FROM an, (SELECT unnest(range(9)) AS k)), ri AS (SELECT DISTINCT link_id, block, t, round_even(a, 0)::INT AS y, round_even(b, 0)::INT AS x FROM pt),
h AS (SELECT DISTINCT link_id FROM ri SEMI JOIN cm USING (block, t, y, x)) SELECT ln.link_id, h.link_id IS NOT NULL AS crosses FROM ln LEFT JOIN h ON h.link_id = ln.link_id""",
}
