"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, searched from every block of vectors."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.common import Scratch, components, cut, sized_join

#: Vectors in a shard, at most, and bytes of their components: longer vectors make smaller shards.
SHARD, SHARD_BYTES = 16_384, 1 << 25
#: Links of a node, beam while building, first beam while searching, nodes expanded at once.
LINKS, BUILD_BEAM, FIRST_BEAM, EXPAND = 16, 48, 64, 4
#: First beam in a small graph, and share of a graph that the first beam may take.
LEAST_BEAM = 8
#: Links to a node, at least, and slots of a node for links that see to it.
INWARD, SPARE = 3, 6
#: Each level keeps one node in so many of the one below.
LEVEL = 16
#: Audited queries of each search, the shares of their links and of their nearest others that a beam must find before it is
#: used, and the share of all audited ones, summed by label, below which the job fails.
AUDIT, LINK_RECALL, NEAR_RECALL, LEAST_RECALL = 64, 0.98, 0.95, 0.9
_CELLS = 1 << 25


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def _near(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (rows @ q[:, :, None])[:, :, 0]


class Graph:
    """Levels of neighbour lists over unit vectors; nodes enter in growing batches, each searched in what stands."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray):
        self.v = vectors
        n = len(vectors)
        draw = np.random.default_rng(7).permutation(n)[np.argsort(np.argsort(keys))] + 1
        height = np.zeros(n, int)
        while (draw % LEVEL ** (height.max() + 1) == 0).sum() > LEVEL:
            height[draw % LEVEL ** (height.max() + 1) == 0] += 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(height.max(), -1, -1):
            self._build(np.flatnonzero(height >= level))

    def _build(self, nodes: np.ndarray) -> None:
        upper = self.levels[-1][0] if self.levels else nodes[:0]
        nodes = np.concatenate((upper, np.setdiff1d(nodes, upper)))
        links = np.full((len(self.v), LINKS + SPARE), -1, np.int32)
        done = min(len(nodes), 64)
        seed = nodes[:done]
        sims = self.v[seed] @ self.v[seed].T
        np.fill_diagonal(sims, -np.inf)
        near = _top(sims, min(BUILD_BEAM, done))
        links[seed, :LINKS] = self._choose(seed, seed[near], np.take_along_axis(sims, near, 1))
        while done < len(nodes):
            batch = nodes[done : done + max(64, done // 2)]
            starts = self.descend(self.v[batch]) if self.levels else np.tile(nodes[:16], (len(batch), 1))
            for _ in range(2):  # the second time the batch's nodes find each other
                found, sims = self.beam(self.v[batch], starts, links, BUILD_BEAM, own=batch)
                links[batch, :LINKS] = self._choose(batch, found, sims)
                self._back(batch, links)
                starts = np.concatenate((starts, batch[:, None]), 1)
            done += len(batch)
        self._reach(nodes, links)
        self.levels.append((nodes, links))

    @staticmethod
    def _reach(nodes: np.ndarray, links: np.ndarray) -> None:
        """Links back to nodes that few others link to, in their neighbours' spare slots."""
        inward = np.bincount(links[links >= 0], minlength=len(links))
        used = np.zeros(len(links), int)
        for x in nodes[inward[nodes] < INWARD].tolist():
            for y in links[x].tolist():
                if inward[x] >= INWARD or y < 0:
                    break
                if used[y] < SPARE:
                    links[y, LINKS + used[y]] = x
                    used[y] += 1
                    inward[x] += 1

    def _choose(self, nodes: np.ndarray, found: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """For each node up to LINKS of its candidates, sorted by similarity: first those nearer to it than to any chosen before."""
        out = np.full((len(nodes), LINKS), -1, np.int32)
        for a in range(0, len(nodes), 512):
            f, s = found[a : a + 512], sims[a : a + 512]
            x = self.v[np.maximum(f, 0)]
            cross = x @ x.transpose(0, 2, 1)
            good = np.isfinite(s) & (f >= 0)
            taken = np.zeros(f.shape, bool)
            for k in range(f.shape[1]):
                worst = np.where(taken, cross[:, k, :], -np.inf).max(1)
                taken[:, k] = good[:, k] & (s[:, k] > worst) & (taken.sum(1) < LINKS)
            rank = np.where(taken, 0, np.where(good, 1, 2)) * f.shape[1] + np.arange(f.shape[1])
            order = np.argsort(rank, axis=1)[:, :LINKS]
            out[a : a + 512, : order.shape[1]] = np.where(np.take_along_axis(good, order, 1), np.take_along_axis(f, order, 1), -1)
        return out

    def _back(self, batch: np.ndarray, links: np.ndarray) -> None:
        """Links from the chosen neighbours back to the batch; full lists are chosen anew."""
        src = np.repeat(batch, LINKS)
        dst = links[batch, :LINKS].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at, first, n = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(at), 1024):
            t, f, c = at[lo : lo + 1024], first[lo : lo + 1024], n[lo : lo + 1024]
            width = int(min(c.max(), 4 * LINKS))
            cols = np.arange(width)
            fresh = np.where(cols < c[:, None], src[np.minimum(f[:, None] + cols, len(src) - 1)], -1)
            every = np.concatenate((links[t, :LINKS], fresh), 1)
            every = np.sort(every, axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            every[every == t[:, None]] = -1
            sims = np.where(every >= 0, _near(self.v[t], self.v[np.maximum(every, 0)]), -np.inf)
            best = _top(sims, min(sims.shape[1], BUILD_BEAM))
            links[t, :LINKS] = self._choose(t, np.take_along_axis(every, best, 1), np.take_along_axis(sims, best, 1))

    def descend(self, queries: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Entry nodes for the level below those built: the nearest found on each level, from the top."""
        starts = None
        for nodes, links in self.levels[: levels if levels is not None else len(self.levels)]:
            if starts is None:
                starts = np.tile(nodes[:16], (len(queries), 1))
            starts, _ = self.beam(queries, starts, links, 16)
        return starts

    def beam(self, queries: np.ndarray, starts: np.ndarray, links: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the width nearest found for each query, nearest first, -1 where there are fewer."""
        width = min(width, len(self.v))
        nodes = np.full((len(queries), width), -1, np.int32)
        sims = np.full((len(queries), width), -np.inf, np.float32)
        step = max(1, min(2048, _CELLS // len(self.v)))
        for a in range(0, len(queries), step):
            rows = slice(a, a + step)
            nodes[rows], sims[rows] = self._beam(queries[rows], starts[rows], links, width, None if own is None else own[rows])
        return nodes, sims

    def _beam(self, q: np.ndarray, starts: np.ndarray, links: np.ndarray, width: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        seen = np.zeros((n, len(self.v)), bool)
        nodes = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -np.inf, np.float32)
        spent = np.ones((n, width), bool)
        rows = np.arange(n)
        hide = own is not None
        new = starts
        while len(rows):
            good = new >= 0
            good &= ~seen[rows[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(good)
            seen[rows[r], new[r, c]] = True
            order = np.sort(np.where(good, new, -1), axis=1)  # a node may come from several lists
            good = order >= 0
            good[:, 1:] &= order[:, 1:] != order[:, :-1]
            new = order
            fresh = np.where(good, _near(q[rows], self.v[np.maximum(new, 0)]), -np.inf).astype(np.float32)
            every = np.concatenate((sims[rows], fresh), 1)
            best = _top(every, width)
            nodes[rows] = np.take_along_axis(np.concatenate((nodes[rows], new), 1), best, 1)
            sims[rows] = np.take_along_axis(every, best, 1)
            spent[rows] = np.take_along_axis(np.concatenate((spent[rows], ~good), 1), best, 1)
            waiting = np.where(spent[rows] | ~np.isfinite(sims[rows]), -np.inf, sims[rows])
            pick = _top(waiting, min(max(EXPAND, width // 32), width))
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            going = live.any(1)
            rows, pick, live = rows[going], pick[going], live[going]
            if not len(rows):
                break
            spent[rows[:, None], pick] |= live
            at = nodes[rows[:, None], pick]
            new = np.where(live[:, :, None], links[np.maximum(at, 0)], -1).reshape(len(rows), -1)
        if hide:
            mine = nodes == own[:, None]
            sims[mine], nodes[mine] = -np.inf, -1
            best = np.argsort(-sims, axis=1, kind="stable")
            nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
        return nodes, sims

    def dump(self) -> bytes:
        """The levels, as bytes: a graph is built once and read by every search."""
        out = io.BytesIO()
        np.savez(out, *[x for nodes, links in self.levels for x in (nodes.astype(np.int32), links[nodes])])
        return out.getvalue()

    @classmethod
    def load(cls, vectors: np.ndarray, kept: bytes) -> Graph:
        graph = cls.__new__(cls)
        graph.v, graph.levels = vectors, []
        with np.load(io.BytesIO(kept)) as found:
            arrays = [found[f"arr_{k}"] for k in range(len(found.files))]
        for nodes, own in zip(arrays[::2], arrays[1::2], strict=True):
            links = np.full((len(vectors), LINKS + SPARE), -1, np.int32)
            links[nodes] = own
            graph.levels.append((nodes.astype(np.int64), links))
        return graph

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        return self.descend(queries, len(self.levels) - 1) if len(self.levels) > 1 else np.tile(self.levels[0][0][:16], (len(queries), 1))

    def width_for(self, queries: np.ndarray, own: np.ndarray, least: float) -> tuple[int, list[int]]:
        """The beam that passes an audit against brute force, and what the audit counted: links found and there are, and
        nearest others found and there are. A query's own node, where the graph holds it, counts for nothing.

        Links are searched for as within does, so what it finds for vectors with full beams is measured, too. The first
        beam grows with the graph, so small graphs are searched, not met with; where all queries are audited, all links
        must be found.
        """
        audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
        sims = queries[audit] @ self.v.T
        mine = own[audit]
        sims[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        links, nearest = sims >= least, sims.argmax(1)
        some = np.isfinite(sims.max(1))
        links_there, near_there = int(links.sum()), int(some.sum())
        wanted = LINK_RECALL if len(audit) < len(queries) else 1.0
        width = min(FIRST_BEAM, max(LEAST_BEAM, len(self.v) // LEAST_BEAM))
        while width < len(self.v):
            nodes, _ = self.beam(queries[audit], self._entry(queries[audit]), self.levels[-1][1], width)
            near = int(((nodes == nearest[:, None]) & some[:, None]).any(1).sum())
            q, k, rest = self.within(queries[audit], mine, least, width)
            hits = int(links[q, k].sum() + links[rest].sum())  # the rest are met with all vectors
            if hits >= wanted * links_there and near >= NEAR_RECALL * near_there:
                return width, [hits, links_there, near, near_there]
            width *= 2
        return width, [links_there, links_there, near_there, near_there]

    def within(self, queries: np.ndarray, own: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) of the links found, and the queries whose beam may have cut links off at four times the width.

        Those must be met with all vectors.
        """
        left, right, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(queries))
        for w in (width, 4 * width):
            if not len(todo) or w >= len(self.v):
                break
            entry = self._entry(queries[todo])
            entry = np.concatenate((entry, own[todo][:, None]), 1)
            nodes, sims = self.beam(queries[todo], entry, self.levels[-1][1], w)
            good = sims >= least
            full = good[:, -1]
            q, k = np.nonzero(good & ~full[:, None])
            left.append(todo[q])
            right.append(nodes[q, k].astype(np.int64))
            todo = todo[full]
        return np.concatenate(left), np.concatenate(right), todo


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of length 1: scaled by the largest component first, so that no square overflows or vanishes."""
    v = flat.reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


SHARDS = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())])


def _sharded(key: tuple, group: pa.Table) -> pa.Table:
    """One shard in one row: its ids, how often each occurs, its vectors, in the order of the ids, and their graph."""
    group = group.sort_by("rep")
    ids = group["rep"].to_numpy()
    flat = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    graph = Graph(unit(flat, key[1].as_py()).astype(np.float32), ids)
    row = {"label": [key[0].as_py()], "dim": [key[1].as_py()], "part": [key[2].as_py()], "ids": [ids.tobytes()], "copies": [group["copies"].to_numpy().astype(np.int64).tobytes()], "vectors": [flat.tobytes()], "graph": [graph.dump()]}
    return pa.table(row, schema=SHARDS)


class Union:
    """Components of nodes met so far; pairs come in arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            self.flatten()
            i, j = self.up[i], self.up[j]
            i, j = np.maximum(i, j), np.minimum(i, j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.up, i, j)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


class Side:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int64)
        self.exact = unit(np.frombuffer(row["vectors"]), row["dim"])
        self.single = self.exact.astype(np.float32)
        self.graph = Graph.load(self.single, row["graph"])


def _met(least: float):
    """Two shards, or one with itself: each side's vectors search the other's graph.

    What either side finds counts for both, after the cosine in double precision. A vector with more links than a beam
    holds is met with the whole other side, and its links are counted without being listed, so a group of near copies
    costs one row of similarities for each of its vectors in turn. Rows of kind 0 are (vector, other rows linked, a
    vector of its component here); kinds 1 and 2 are the audits of links and of nearest others.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sides = [Side(r) for r in group.sort_by("part").to_pylist()]
        same = len(sides) == 1
        a, b = sides[0], sides[-1]
        base = 0 if same else len(a.ids)
        union, counts = Union(base + len(b.ids)), np.zeros(base + len(b.ids), np.int64)
        pairs, dense, told = [np.zeros(0, np.int64)], np.zeros(len(counts), bool), []
        crowds = []
        for q, g, q_base, g_base in ((a, b, 0, base), (b, a, base, 0))[: 1 if same else 2]:
            own = np.arange(len(q.ids)) if same else np.full(len(q.ids), -1)
            width, audit = g.graph.width_for(q.single, own, least - 1e-5)
            told.append(audit)
            x, y, full = g.graph.within(q.single, own, least - 1e-5, width)
            keep = np.zeros(len(x), bool)
            for lo in range(0, len(x), 1 << 16):
                i, j = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                keep[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", q.exact[i], g.exact[j]) >= least
            x, y = x[keep] + q_base, y[keep] + g_base
            x, y = np.minimum(x, y), np.maximum(x, y)
            pairs.append((x * len(counts) + y)[x != y])
            dense[full + q_base] = True
            crowds.append((q, g, q_base, g_base, full))
        for q, g, q_base, g_base, full in crowds:
            for lo in range(0, len(full), 128):
                i = full[lo : lo + 128]
                near = q.exact[i] @ g.exact.T >= least
                if same:
                    near[np.arange(len(i)), i] = False
                counts[i + q_base] = near @ g.copies
                x, y = np.nonzero(near)
                x, y = i[x] + q_base, y + g_base
                union.add(x, y)
                sparse = ~dense[y]
                x, y = np.minimum(x, y)[sparse], np.maximum(x, y)[sparse]
                pairs.append(x * len(counts) + y)
        pairs = np.unique(np.concatenate(pairs))
        x, y = pairs // max(len(counts), 1), pairs % max(len(counts), 1)
        union.add(x, y)
        copies = a.copies if same else np.concatenate((a.copies, b.copies))
        for i, j in ((x, y), (y, x)):
            own = ~dense[i]
            np.add.at(counts, i[own], copies[j[own]])
        ids = a.ids if same else np.concatenate((a.ids, b.ids))
        some = np.flatnonzero(counts)
        rows = [(np.zeros(len(some), np.int32), ids[some], counts[some], ids[union.flatten()[some]])]
        total = np.sum(told, axis=0)
        label = key[0].as_py()
        rows.append((np.array([1, 2], np.int32), np.array([label, label]), total[[0, 2]], total[[1, 3]]))
        return pa.table(dict(zip(("kind", "u", "n", "v"), (pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)), strict=True)))

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Equal vectors of one label are one class. Each label's classes are dealt by hash to shards, each shard's graph is
    built once, and each two shards of a label are met in one task, where each side's vectors search the other's graph.
    Found pairs are verified by cosine in double precision; beams widen where they may cut links off, and for a whole
    search until an audit against brute force passes; the job fails if the audits of a label, summed, find less than
    LEAST_RECALL. n_links counts the other rows linked directly; component_id is the least vec_id reachable, itself
    included; kept tells vec_id = component_id. A null label, and
    a vector that is null, zero, or has null or non-finite components links with nothing; vectors of different lengths
    don't link. A null vec_id has null results; rows that repeat a vec_id are taken as equal rows and count as others.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    fine = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    with Scratch(spark) as scratch:
        good = rows.where(fine)
        classes = scratch.table(good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
        most = F.greatest(F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))), F.lit(FIRST_BEAM))
        sizes = scratch.table(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("shards")))
        dealt = sized_join(classes, sizes, ["label", "dim"], 16)
        dealt = dealt.select("label", "dim", F.pmod(F.xxhash64("rep"), "shards").cast("int").alias("part"), "rep", "copies", "vector")
        shards = scratch.table(dealt.groupBy("label", "dim", "part").applyInArrow(_sharded, "label long, dim int, part int, ids binary, copies binary, vectors binary, graph binary"))
        tasks = sizes.agg(F.sum(F.expr("shards * (shards + 1) / 2").cast("long"))).first()[0] or 1
        other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
        meetings = sized_join(shards, sizes, ["label", "dim"], 16).select("*", other)
        meetings = meetings.select("label", "dim", F.least("part", "other").alias("s"), F.greatest("part", "other").alias("t"), "part", "ids", "copies", "vectors", "graph")
        met = meetings.repartition(min(tasks, 10_000), "label", "dim", "s", "t").groupBy("label", "dim", "s", "t").applyInArrow(_met(least), "kind int, u long, n long, v long")
        met = scratch.table(met)
        audits = met.where("kind > 0").groupBy("u", "kind").agg(F.sum("n").alias("found"), F.sum("v").alias("there"))
        low = audits.where(F.col("found") < LEAST_RECALL * F.col("there")).limit(5).collect()
        if low:
            raise RuntimeError(f"recall is too low: {[(r.u, 'links' if r.kind == 1 else 'nearest', r.found, r.there) for r in low]}")
        met = met.where("kind = 0")
        linked = met.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("linked"))
        parts = components(met.select("u", "v")).toDF("rep", "component")
        found = classes.groupBy("rep").agg(F.sum("copies").alias("copies")).join(linked.hint("merge"), "rep", "left").join(parts.hint("merge"), "rep", "left")
        found = found.select("rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
        several = classes.where("copies > 1").select("label", "vector", "rep")
        member = sized_join(good.select("vec_id", "label", "vector"), several, ["label", "vector"], 8 * F.size("vector") + 32, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
        member = cut(member.join(found.hint("merge"), "rep").select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id")))
    rest = rows.where(~fine).select("vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionAll(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
