"""Near vectors against brute force: planted pairs in a label of two shards, a crowd of near copies, and small labels."""

import numpy as np
import pandas as pd

from tracklore.llm.hnsw import LINK_RECALL, Graph, near_vectors, unit


def planted():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(18_000, 16))
    twins = rng.permutation(18_000)[:2_400].reshape(-1, 2)
    v[twins[:, 1]] = v[twins[:, 0]] + rng.normal(scale=0.02, size=(1_200, 16))
    crowd = rng.permutation(18_000)[:700]
    v[crowd] = v[crowd[0]] + rng.normal(scale=0.05, size=(700, 16))
    v[crowd[100:110]] = v[crowd[0]]  # equal vectors
    label = np.zeros(18_000, int)
    few = rng.permutation(18_000)[:300]
    label[few] = few % 7 + 1
    return v, label


def brute(v, label):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    links, part = np.zeros(len(v), int), np.arange(len(v))
    edges = []
    for lo in range(0, len(v), 2000):
        near = (v[lo : lo + 2000] @ v.T >= 0.98) & (label[lo : lo + 2000, None] == label)
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
        links[lo : lo + len(near)] = near.sum(1)
        x, y = np.nonzero(near)
        edges.append(np.stack((x + lo, y)))
    x, y = np.concatenate(edges, 1)
    while True:
        new = part.copy()
        np.minimum.at(new, x, part[y])
        if (new == part).all():
            return links, part
        part = new


def test_planted(spark):
    v, label = planted()
    rows = pd.DataFrame({"vec_id": np.arange(len(v)), "label": label, "embedding": v.tolist()})
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")).toPandas().sort_values("vec_id")
    links, part = brute(v, label)
    assert links.sum() > 100_000 and (links == 1).sum() > 2_000
    found = got.n_links.to_numpy()
    assert len(got) == len(v) and (found <= links).all()
    assert found.sum() >= 0.999 * links.sum() and (found == links).mean() > 0.995
    assert (got.component_id.to_numpy() == part).mean() > 0.995
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_repeated_ids_and_extreme_components(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [2e200, 1e199], 1), (3, [1e-320, 0.0], 1), (4, [0.0, 1.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [float("inf"), 1.0], 1), (6, None, 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4, 4, 4, 5, 6]
    by = {r.vec_id: r for r in got}
    assert {k: by[k].component_id for k in by} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_small_graphs_are_searched_and_the_audit_counts_what_searches_find():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    v = unit(np.repeat(centres, 10, axis=0) + 0.01 * rng.normal(size=(200, 24)), 24)
    single = v.astype(np.float32)
    for n in (50, 200):
        graph, own = Graph(single[:n], np.arange(n)), np.arange(n)
        width, told = graph.width_for(single[:n], own, 0.98)
        assert width < n and told[0] >= LINK_RECALL * told[1] and told[1] > 0
        q, k, rest = graph.within(single[:n], own, 0.98, width)
        links = v[:n] @ v[:n].T >= 0.98
        np.fill_diagonal(links, False)
        if n <= 64:
            assert links[q, k].sum() + links[rest].sum() == links.sum() and len(rest) < n
