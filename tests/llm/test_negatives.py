"""Hard negatives against a plain version, over lengths, ties, repeats, dimensions, huge components and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm import negatives as neg
from tracklore.llm.negatives import Search, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor boolean"


def plain(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    good, seen = [], set()
    for vec_id, v, label, anchor in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(max(-(2**62), min(2**62, math.floor(scale * x))) for x in v)
        if (vec_id, q, label) not in seen:
            seen.add((vec_id, q, label))
            good.append((vec_id, q, label, anchor))
    out = []
    for a, q, label, anchor in good:
        if not anchor:
            continue
        scored = [(-max(-neg.MOST, min(neg.MOST, sum(x * y for x, y in zip(q, v, strict=True)))), b, other) for b, v, other, _ in good if len(v) == len(q) and (b != a or other != label)]
        for p, b, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            out += [(a, b, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def same(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"bucket": F.lit(1), "score": F.lit("x"), "dim": F.lit(None)})
    assert sorted(tuple(r) for r in hard_negatives(docs, **how).collect()) == plain(rows, **how)


def clouds(n, dim, seed):
    """Near copies around a few centres, of many lengths, and vectors at random."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = np.where(rng.random(n)[:, None] < 0.7, centres[rng.integers(0, 8, n)] + 0.15 * rng.normal(size=(n, dim)), rng.normal(size=(n, dim)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= rng.choice([0.1, 0.5, 1, 1, 1.5], n)[:, None]
    return [(k, v.tolist(), int(c), k % 9 == 0) for k, (v, c) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("bucket", [40, 8192])
def test_equals_plain_version(spark, monkeypatch, bucket):
    monkeypatch.setattr(neg, "BUCKET", bucket)
    same(spark, clouds(600, 12, bucket))


def test_feasible_ranges_are_used_and_lose_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 60, axis=0) + 0.02 * rng.normal(size=(2400, 16))
    x = np.floor(1000 * x / np.linalg.norm(x, axis=1)[:, None])
    labels, ids = np.arange(2400) % 2, np.arange(2400)
    flags = ids % 60 == 0
    tile = {"ids": ids[flags].tobytes(), "labels": labels[flags].tobytes(), "vectors": x[flags].tobytes(), "bands": b"", "scores": b""}
    search, narrow = Search(tile, 0, 5, 50, 95), [0, 0]
    whole = Search._narrow

    def counted(self, *args):
        narrow[0] += 1
        return whole(self, *args)

    Search._narrow = counted
    try:
        order = np.argsort(-(x * x).sum(axis=1), kind="stable")
        for part in np.array_split(order, 30):
            search.meet(neg._bucket(ids[part], labels[part], flags[part], x[part]))
    finally:
        Search._narrow = whole
    assert narrow[0] > 20
    band, found, scores = search.best.rows()
    for k, a in enumerate(ids[flags]):
        exact = sorted((-int(x[a] @ x[b]), b) for b in ids if b != a and labels[b] == labels[a])[:5]
        assert list(zip((-scores[band == k]).tolist(), found[band == k].tolist(), strict=True)) == exact


def test_odd_rows(spark):
    one = [1.0, 0.5, -0.25]
    rows = [
        (0, one, 1, True), (0, one, 1, True), (1, one, 1, False), (2, one, 1, None), (3, [0.9, 0.2, 0.0], 2, True), (4, [0.7, 0.4, 0.0], 2, False), (5, [0.6, 0.4, -0.2], 3, False),
        (6, [0.0, 0.0, 0.0], 1, True), (7, None, 1, True), (8, [1.0, None, 2.0], 1, True), (9, [1.0, float("nan"), 0.0], 1, True), (10, [float("inf"), 0.0, 0.0], 1, True), (11, one, None, True),
        (None, one, 2, True), (12, [1.0], 1, True), (13, [2.0], 1, False), (14, [0.7], 2, False), (15, [-1.0], 2, True), (16, [], 1, True), (17, [], 1, False), (18, [], 2, False), (0, one, 2, True), (0, [0.8, 0.4, 0.1], 1, True),
        (19, [1e30, 1.0], 1, True), (20, [1e25, 2.0], 1, False), (21, [1e12, 3.0], 2, False), (22, [3e5, 2e7], 2, True), (23, [2e5, 3e7], 2, False), (24, [1e5, 2e7], 1, False),
    ]
    same(spark, rows)
    same(spark, rows[:1])
    docs = spark.createDataFrame(rows, SCHEMA)
    assert hard_negatives(docs.limit(0)).count() == 0
    assert hard_negatives(docs.where("vec_id = 14")).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 0.0], 1, k == 3) for k in range(12)] + [(k, [0.9, 0.1], 2, False) for k in range(30, 20, -1)]
    same(spark, rows)
    same(spark, rows, positives=2, negatives=20, low=10, high=90)
