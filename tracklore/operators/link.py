"""Linking detections to tracks: gated costs, optimal assignment in a frame, gap closing; one ordered pass per block."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.operators.lineage import components_within, kept
from tracklore.operators.morphology import links_across


@dataclass(frozen=True)
class LinkRules:
    """Method and gates of a tracker; distances are in pixels, z already weighted by z_weight.

    max_distance and forward_distance grow with the frames that a track was missing, back_radius does not.
    """

    method: str = "nearest"
    max_distance: float = 32.0
    max_z_step: float = 2.0
    max_gap: int = 2
    z_weight: float = 1.0
    volume_weight: float = 0.0
    intensity_weight: float = 0.0
    cost_cutoff: float = float("inf")
    cone_degrees: float = 80.0
    forward_distance: float = 45.0
    back_radius: float = 12.0
    least_speed: float = 1e-3


def assign(cost: np.ndarray, cutoff: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; cells that are not finite are never chosen, nor are costs over cutoff.

    Pairs that have no other choice are taken at once; for the rest, shortest augmenting paths with potentials over the
    smaller side, as cost matrices of one frame are small.
    """
    finite = np.isfinite(cost)
    alone = finite & (finite.sum(1, keepdims=True) == 1) & (finite.sum(0, keepdims=True) == 1)
    if alone.any():
        r, c = np.nonzero(alone)
        taken = [(i, j) for i, j in zip(r.tolist(), c.tolist(), strict=True) if cost[i, j] <= cutoff]
        rows, cols = np.flatnonzero(finite.any(1) & ~alone.any(1)), np.flatnonzero(finite.any(0) & ~alone.any(0))
        return sorted(taken + [(int(rows[i]), int(cols[j])) for i, j in assign(cost[np.ix_(rows, cols)], cutoff)])
    rows, cols = cost.shape
    if not rows or not cols:
        return []
    if rows > cols:
        return sorted((r, c) for c, r in assign(cost.T, cutoff))
    big = (np.abs(cost[finite]).max() if finite.any() else 0.0) * (rows + 1) + 1e6
    a = np.where(finite, cost, big)
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, way, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while owner[at]:
            done[at] = True
            row = owner[at]
            slack = a[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            reach = np.where(done[1:], np.inf, least[1:])
            nxt = int(np.argmin(reach)) + 1
            step = reach[nxt - 1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    found = [(int(owner[c]) - 1, c - 1) for c in range(1, cols + 1) if owner[c]]
    return sorted((r, c) for r, c in found if finite[r, c] and cost[r, c] <= cutoff)


def costs(active: list[dict], now: np.ndarray, rules: LinkRules) -> np.ndarray:
    """Cost of continuing each active track with each detection (z, y, x, volume, intensity); infinite beyond its gates."""
    last = np.array([t["last"] for t in active])
    reach = np.array([t["gap"] + 1 for t in active], float)[:, None]
    z = rules.z_weight
    d = now[None, :, :3] - last[:, None, :3]
    flat = d * np.array([z, 1.0, 1.0])
    distance = np.sqrt((flat**2).sum(2))
    ok, out = distance <= rules.max_distance * reach, distance
    if rules.method == "keyhole":
        speed = np.array([t["speed"] for t in active])
        size = np.sqrt((speed**2).sum(1))[:, None]
        moving = size > rules.least_speed
        forward = (flat * speed[:, None, :]).sum(2) / np.maximum(size, 1e-12)
        aside = np.sqrt(np.maximum(distance**2 - forward**2, 0))
        cone = (forward >= 0) & (forward <= rules.forward_distance * reach) & (np.arctan2(aside, forward + 1e-6) <= np.radians(rules.cone_degrees))
        ok = np.where(moving, cone | (distance <= rules.back_radius), ok)
        ahead = flat - speed[:, None, :] * reach[:, :, None]
        out = np.where(moving, np.sqrt((ahead**2).sum(2)), distance)
    if rules.method in ("lap", "keyhole"):
        for k, weight in ((3, rules.volume_weight), (4, rules.intensity_weight)):
            a, b = last[:, None, k], now[None, :, k]
            gap = np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-6)
            out = out + weight * rules.max_distance * np.where(np.isfinite(a) & np.isfinite(b), gap, 0.0)
    return np.where(ok & (np.abs(d[:, :, 0]) <= rules.max_z_step * reach), out, np.inf)


class Tracker:
    """State of one block: active tracks with their last place, speed and gap, and the next id."""

    def __init__(self, rules: LinkRules, active: list[dict] | None = None, next_id: int = 1):
        self.rules, self.active, self.next_id = rules, active or [], next_id

    def wait(self, frames: int) -> None:
        """Ages all tracks by frames in which none of them can go on."""
        for t in self.active:
            t["gap"] += frames
        self.active = [t for t in self.active if t["gap"] <= self.rules.max_gap]

    def step(self, rows: np.ndarray) -> list[int]:
        """Track ids of a frame's detections; a frame without any row never comes, so absent frames do not age tracks."""
        ids = [0] * len(rows)
        pairs = assign(costs(self.active, rows, self.rules), self.rules.cost_cutoff) if self.active else []
        taken = set()
        for a, j in pairs:
            t = self.active[a]
            scale = np.array([self.rules.z_weight, 1.0, 1.0])
            t["speed"] = ((rows[j, :3] - np.asarray(t["last"][:3])) * scale).tolist()
            t["last"], t["gap"] = rows[j].tolist(), 0
            ids[j] = t["id"]
            taken.add(a)
        for a, t in enumerate(self.active):
            t["gap"] += a not in taken
        self.active = [t for t in self.active if t["gap"] <= self.rules.max_gap]
        for j, found in enumerate(ids):
            if not found:
                ids[j] = self.next_id
                self.active.append({"id": self.next_id, "last": rows[j].tolist(), "speed": [0.0, 0.0, 0.0], "gap": 0})
                self.next_id += 1
        return ids


PLACE = ["centroid_z", "centroid_y", "centroid_x", "volume_voxels", "mean_intensity"]
#: Stands for a null block in a task, where numbers would else become floats.
NONE = -(2**63)
LINKED = "block_name long, time int, object_label long, track_id long"


#: Detections of a frame up to which blocks are stepped together, and cells of their cost matrices at a time.
TOGETHER, CELLS = 64, 1_000_000


def _assign_many(cost: np.ndarray, n: np.ndarray, m: np.ndarray, cutoff: float) -> np.ndarray:
    """assign of many matrices at once, cost (b, rows, columns) of which n and m are real: the column of each row, or -1."""
    out = np.full(cost.shape[:2], -1)
    finite = np.isfinite(cost)
    alone = finite & (finite.sum(2, keepdims=True) == 1) & (finite.sum(1, keepdims=True) == 1)
    b, i, j = np.nonzero(alone & (cost <= cutoff))
    out[b, i] = j
    some = alone.any((1, 2))[:, None]
    rows = np.where(some, finite.any(2) & ~alone.any(2), np.arange(cost.shape[1]) < n[:, None])
    cols = np.where(some, finite.any(1) & ~alone.any(1), np.arange(cost.shape[2]) < m[:, None])
    of = np.flatnonzero((finite & ~alone).any((1, 2)))
    if not len(of):
        return out
    rows, cols, size = rows[of], cols[of], max(cost.shape[1:])
    r, c = np.argsort(~rows, axis=1, kind="stable"), np.argsort(~cols, axis=1, kind="stable")
    own = np.full((len(of), size, size), np.inf)
    own[:, : r.shape[1], : c.shape[1]] = cost[of[:, None, None], r[:, :, None], c[:, None, :]]
    n, m = rows.sum(1), cols.sum(1)
    turned = n > m
    own[turned] = own[turned].transpose(0, 2, 1)
    low, high = np.minimum(n, m), np.maximum(n, m)
    real = (np.arange(size)[:, None] < low[:, None, None]) & (np.arange(size) < high[:, None, None])
    good = np.isfinite(own) & real
    big = np.where(good, np.abs(own), 0.0).max((1, 2)) * (low + 1) + 1e6
    a = np.where(good, own, np.where(real, big[:, None, None], np.inf))
    u, v, owner = np.zeros((len(of), size + 1)), np.zeros((len(of), size + 1)), np.zeros((len(of), size + 1), int)
    for k in range(1, int(low.max()) + 1):
        q = np.flatnonzero(low >= k)
        owner[q, 0] = k
        least, way, done = np.full(u.shape, np.inf), np.zeros(u.shape, int), np.zeros(u.shape, bool)
        at, ended = np.zeros(len(of), int), q
        while len(q):
            done[q, at[q]] = True
            row = owner[q, at[q]]
            slack = a[q, row - 1] - u[q, row][:, None] - v[q, 1:]
            shut, near, ways = done[q], least[q], way[q]
            better = ~shut[:, 1:] & (slack < near[:, 1:])
            near[:, 1:][better] = slack[better]
            ways[:, 1:] = np.where(better, at[q][:, None], ways[:, 1:])
            reach = np.where(shut[:, 1:], np.inf, near[:, 1:])
            nxt = reach.argmin(1) + 1
            step = reach[np.arange(len(q)), nxt - 1]
            x, y = np.nonzero(shut)
            u[q[x], owner[q[x], y]] += step[x]
            v[q] -= np.where(shut, step[:, None], 0.0)
            least[q], way[q] = np.where(shut, near, near - step[:, None]), ways
            at[q] = nxt
            q = q[owner[q, nxt] > 0]
        q = ended
        while len(q):
            to = way[q, at[q]]
            owner[q, at[q]] = owner[q, to]
            at[q] = to
            q = q[to > 0]
    b, col = np.nonzero(owner[:, 1:])
    row = owner[b, col + 1] - 1
    took = good[b, row, col] & (own[b, row, col] <= cutoff)
    b, row, col = b[took], row[took], col[took]
    i, j = np.where(turned[b], col, row), np.where(turned[b], row, col)
    out[of[b], r[b, i]] = c[b, j]
    return out


def _costs_many(last: np.ndarray, speed: np.ndarray, gap: np.ndarray, now: np.ndarray, rules: LinkRules) -> np.ndarray:
    """costs of many blocks at once; places that are padded are not numbers and beyond every gate."""
    reach = (gap + 1.0)[:, :, None]
    d = now[:, None, :, :3] - last[:, :, None, :3]
    flat = d * np.array([rules.z_weight, 1.0, 1.0])
    distance = np.sqrt((flat**2).sum(3))
    ok, out = distance <= rules.max_distance * reach, distance
    if rules.method == "keyhole":
        size = np.sqrt((speed**2).sum(2))[:, :, None]
        moving = size > rules.least_speed
        forward = (flat * speed[:, :, None, :]).sum(3) / np.maximum(size, 1e-12)
        aside = np.sqrt(np.maximum(distance**2 - forward**2, 0))
        cone = (forward >= 0) & (forward <= rules.forward_distance * reach) & (np.arctan2(aside, forward + 1e-6) <= np.radians(rules.cone_degrees))
        ok = np.where(moving, cone | (distance <= rules.back_radius), ok)
        ahead = flat - speed[:, :, None, :] * reach[:, :, :, None]
        out = np.where(moving, np.sqrt((ahead**2).sum(3)), distance)
    if rules.method in ("lap", "keyhole"):
        for k, weight in ((3, rules.volume_weight), (4, rules.intensity_weight)):
            x, y = last[:, :, None, k], now[:, None, :, k]
            apart = np.abs(x - y) / np.maximum(np.maximum(np.abs(x), np.abs(y)), 1e-6)
            out = out + weight * rules.max_distance * np.where(np.isfinite(x) & np.isfinite(y), apart, 0.0)
    return np.where(ok & (np.abs(d[:, :, :, 0]) <= rules.max_z_step * reach), out, np.inf)


def _fronts(values: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    """values (b, k, ...) with those to keep moved to the front in their order, and as wide as the most that are kept."""
    order = np.argsort(~keep, axis=1, kind="stable")[:, : max(int(keep.sum(1).max()), 1)]
    return [v[np.arange(len(v))[:, None], order] for v in values]


def _steps(place: np.ndarray, first: np.ndarray, size: np.ndarray, wait: np.ndarray, of: list[np.ndarray], rules: LinkRules, ids: np.ndarray) -> None:
    """Tracker.step of many blocks at once, frame by frame; of has each block's frames, blocks with most frames first."""
    width = int(max(size[o].max() for o in of))
    count = np.array([len(o) for o in of])
    last, speed = np.full((len(of), 1, 5), np.nan), np.zeros((len(of), 1, 3))
    gap, name, n, new = np.zeros((len(of), 1), int), np.zeros((len(of), 1), int), np.zeros(len(of), int), np.ones(len(of), int)
    scale = np.array([rules.z_weight, 1.0, 1.0])
    for k in range(int(count[0])):
        live = int((count > k).sum())
        last, speed, gap, name, n, new = (v[:live] for v in (last, speed, gap, name, n, new))
        f = np.array([o[k] for o in of[:live]])
        gap = gap + wait[f][:, None]
        held = np.arange(gap.shape[1]) < n[:, None]
        keep = held & (gap <= rules.max_gap)
        last, speed, gap, name = _fronts([last, speed, gap, name], keep)
        n = keep.sum(1)
        held = np.arange(gap.shape[1]) < n[:, None]
        there = np.arange(width) < size[f][:, None]
        at = np.where(there, first[f][:, None] + np.arange(width), 0)
        now = np.where(there[:, :, None], place[at], np.nan)
        cost = np.where(held[:, :, None] & there[:, None, :], _costs_many(last, speed, gap, now, rules), np.inf)
        to = _assign_many(cost, n, size[f], rules.cost_cutoff)
        g, i = np.nonzero(to >= 0)
        j = to[g, i]
        gap = gap + 1
        speed[g, i], last[g, i], gap[g, i] = (now[g, j, :3] - last[g, i, :3]) * scale, now[g, j], 0
        found = np.zeros(there.shape, int)
        found[g, j] = name[g, i]
        fresh = there & (found == 0)
        found = np.where(fresh, new[:, None] + np.cumsum(fresh, axis=1) - 1, found)
        ids[at[there]] = found[there]
        new = new + fresh.sum(1)
        keep = np.concatenate((held & (gap <= rules.max_gap), fresh), axis=1)
        zero = np.zeros(there.shape, int)
        last, speed, gap, name = _fronts([np.concatenate((last, now), 1), np.concatenate((speed, np.zeros((*there.shape, 3))), 1), np.concatenate((gap, zero), 1), np.concatenate((name, found), 1)], keep)
        n = keep.sum(1)


def link_many(place: np.ndarray, block: np.ndarray, frame: np.ndarray, rules: LinkRules, aged: bool = False) -> np.ndarray:
    """Track ids of the detections of many blocks, in order of block and frame, as a Tracker of each block gives them.

    Blocks of small frames are stepped together, a frame of each at a time, those of large frames one after the other.
    If aged, tracks age by the frames that a block lacks.
    """
    cut = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
    other = cut(block)
    first = np.flatnonzero(other | cut(frame))
    size, start = np.diff(np.append(first, len(block))), other[first]
    wait = np.where(start | (not aged), 0, np.diff(frame[first], prepend=frame[:1]) - 1)
    of = np.split(np.arange(len(first)), np.flatnonzero(start)[1:])
    most = np.maximum.reduceat(size, np.flatnonzero(start))
    ids = np.zeros(len(block), np.int64)
    classes = np.ceil(np.log2(most)).astype(int)
    for c in np.unique(classes):
        own = [of[k] for k in np.flatnonzero(classes == c)]
        if 2**c > TOGETHER:
            for frames in own:
                tracker = Tracker(rules)
                for f in frames:
                    tracker.wait(int(wait[f]))
                    ids[first[f] : first[f] + size[f]] = tracker.step(place[first[f] : first[f] + size[f]])
            continue
        own.sort(key=len, reverse=True)
        each = max(1, CELLS // ((rules.max_gap + 1) * 4**c))
        for k in range(0, len(own), each):
            with np.errstate(invalid="ignore"):
                _steps(place, first, size, wait, own[k : k + each], rules, ids)
    return ids


PLACE = ["centroid_z", "centroid_y", "centroid_x", "volume_voxels", "mean_intensity"]
#: Stands for a null block in a task, where numbers would else become floats.
NONE = -(2**63)
LINKED = "block_name long, time int, object_label long, track_id long"


def _linked(rules: LinkRules):
    """Whole blocks of a task's rows, in order of block, about BUCKET rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = link_many(pdf[PLACE].to_numpy(float), pdf["block_name"].to_numpy(), pdf["time"].to_numpy(), rules)
            return pdf[["block_name", "time", "object_label"]].assign(track_id=ids)

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < BUCKET or held[0]["block_name"].iloc[0] == batch["block_name"].iloc[-1]:
                continue
            rows = pd.concat(held)
            open_ = (rows["block_name"] == rows["block_name"].iloc[-1]).to_numpy()
            if not open_.all():
                yield done(rows[~open_])
            held = [rows[open_]] if open_.any() else []
        rows = pd.concat(held) if held else None
        if rows is not None and len(rows):
            yield done(rows)

    return run


def link_tracks(detections: DataFrame, rules: LinkRules) -> DataFrame:
    """(block_name, time, object_label, track_id): blocks are linked apart, each in one pass over its frames.

    Linking is ordered within a block, so a block is the unit of parallel work; it holds one acquisition's detections. A
    task streams its blocks and steps many of them together.
    """
    rows = detections.select(F.col("block_name").cast("long"), F.col("time").cast("int"), F.col("object_label").cast("long"), *PLACE)
    rows = rows.withColumn("block_name", F.coalesce("block_name", F.lit(NONE)))
    linked = rows.repartition("block_name").sortWithinPartitions("block_name", "time", "object_label").mapInPandas(_linked(rules), LINKED)
    return linked.withColumn("block_name", F.nullif("block_name", F.lit(NONE)))


#: Detections of the components that one group links, about; a larger component is a group of its own.
BUCKET = 20_000


def gate(rules: LinkRules) -> float:
    """How far apart, a frame, two detections of one track can be at most."""
    if rules.method != "keyhole":
        return rules.max_distance
    cone = math.cos(math.radians(rules.cone_degrees))
    return max(rules.max_distance, rules.back_radius, rules.forward_distance / cone if cone > 1e-9 else float("inf"))


def _apart(rules: LinkRules):
    """Frames of each component of a bucket, linked in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block_name", "_part", "_frame", "object_label"], kind="stable")
        key = pdf[["block_name", "_part"]].to_numpy()
        part = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]).any(1))))
        return pdf[["block_name", "time", "object_label", "_frame", "_part"]].assign(_local=link_many(pdf[PLACE].to_numpy(float), part, pdf["_frame"].to_numpy(), rules, aged=True))

    return run


def link_apart(detections: DataFrame, rules: LinkRules) -> DataFrame:
    """link_tracks for blocks that are too large for one task: the same tracks, from parts of a block that no gate joins.

    Two detections that no chain of gates joins never meet in a cost, so frames of each component of the graph of gated
    pairs are linked in order apart, and tracks age by the frames of their block that a component has no detection in.
    Pairs come from cells of the gate's size by equality. Tracks are numbered by their first detection, as in one pass. A
    block whose detections are all within each other's gates is one component.
    """
    rows = detections.select(F.col("block_name").cast("long"), F.col("time").cast("int"), F.col("object_label").cast("long"), *PLACE)
    rows = kept(rows.withColumn("_node", F.monotonically_increasing_id()))
    frames = rows.select("block_name", "time").distinct().withColumn("_frame", F.row_number().over(W.partitionBy("block_name").orderBy("time")))
    rows = rows.join(frames.hint("merge"), ["block_name", "time"])
    size, far = gate(rules), rules.max_gap + 1
    cell = lambda c: F.floor(F.col(c) / (size * far))
    if math.isinf(size):
        of, alone = rows.withColumn("_part", F.lit(0).cast("long")), None
    else:
        to = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(a).alias("a"), F.lit(b).alias("b")) for g in range(1, far + 1) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
        a = rows.select("block_name", "_frame", F.col("_node").alias("u"), *[F.col(c).alias(f"_{c}") for c in PLACE[:3]], to).select("block_name", (F.col("_frame") + F.col("o.g")).alias("_frame"), "u", *[f"_{c}" for c in PLACE[:3]], F.col("o.g").alias("g"), (F.floor(F.col("_centroid_y") / (size * far)) + F.col("o.a")).alias("_y"), (F.floor(F.col("_centroid_x") / (size * far)) + F.col("o.b")).alias("_x"))
        b = rows.select("block_name", "_frame", F.col("_node").alias("v"), *PLACE[:3], cell("centroid_y").alias("_y"), cell("centroid_x").alias("_x"))
        d = {c: F.col(f"centroid_{c}") - F.col(f"_centroid_{c}") for c in "zyx"}
        near = (d["z"] * rules.z_weight) ** 2 + d["y"] ** 2 + d["x"] ** 2 <= (F.lit(size) * F.col("g")) ** 2 * (1 + 1e-9)
        pairs = a.join(b.hint("merge"), ["block_name", "_frame", "_y", "_x"]).where(near & (F.abs(d["z"]) <= rules.max_z_step * F.col("g"))).select("block_name", "u", "v")
        found = components_within(pairs, ["block_name"]).select(F.col("u").alias("_node"), F.col("component").alias("_part"))
        found = kept(found)
        of = rows.join(found.hint("merge"), "_node")
        alone = rows.join(found.hint("merge"), "_node", "left_anti").select("block_name", "time", "object_label", "_frame", F.col("_node").alias("_part"), F.lit(1).cast("long").alias("_local"))
    schema = "block_name long, time int, object_label long, _frame int, _part long, _local long"
    buckets = max(1, -(-of.count() // BUCKET))
    linked = of.groupBy(F.pmod(F.xxhash64("block_name", "_part"), F.lit(buckets)).alias("_bucket")).applyInPandas(_apart(rules), schema)
    linked = kept(linked if alone is None else linked.unionAll(alone))
    starts = linked.groupBy("block_name", "_part", "_local").agg(F.min(F.struct("_frame", "object_label")).alias("_first"))
    ids = starts.withColumn("track_id", F.row_number().over(W.partitionBy("block_name").orderBy("_first", "_part")).cast("long"))
    return linked.join(ids.drop("_first").hint("merge"), ["block_name", "_part", "_local"]).select("block_name", "time", "object_label", "track_id")


def stopped_at_mask(tracks: DataFrame, mask: DataFrame, samples: int = 80) -> DataFrame:
    """tracks (block_name, time, track_id, y, x) without rows in the mask, runs (block_name, time, y, x0, x1); a track is cut where
    the line from one of its rows to the next meets the mask in any frame from the one to the other, and what follows has a
    track_id of its own. Tracks are numbered anew within a block by their old number and time.
    """
    rows = tracks.withColumns({"_y": F.rint("y").cast("int"), "_x": F.rint("x").cast("int")})
    inside = rows.join(mask.select("block_name", "time", F.col("y").alias("_y"), "x0", "x1").hint("merge"), ["block_name", "time", "_y"]).where("_x BETWEEN x0 AND x1").select("block_name", "time", "track_id").distinct()
    rows = rows.join(inside.hint("merge"), ["block_name", "time", "track_id"], "left_anti").drop("_y", "_x")
    w = W.partitionBy("block_name", "track_id").orderBy("time")
    rows = kept(rows.withColumn("link_id", F.monotonically_increasing_id()))
    links = rows.select("block_name", "link_id", F.lag("time").over(w).alias("t0"), F.col("time").alias("t1"), F.lag("y").over(w).alias("y0"), F.lag("x").over(w).alias("x0"), F.col("y").alias("y1"), F.col("x").alias("x1")).where("t0 IS NOT NULL")
    cut = links_across(links, mask, ["block_name"], "time", samples).where("crosses").select("link_id", F.lit(1).alias("_cut"))
    rows = rows.join(cut.hint("merge"), "link_id", "left").withColumn("_piece", F.sum(F.coalesce("_cut", F.lit(0))).over(w))
    pieces = rows.select("block_name", "track_id", "_piece").distinct().withColumn("_new", F.row_number().over(W.partitionBy("block_name").orderBy("track_id", "_piece")).cast("long"))
    return rows.join(pieces.hint("merge"), ["block_name", "track_id", "_piece"]).drop("_piece", "_cut", "link_id").withColumnRenamed("track_id", "uncut_track_id").withColumnRenamed("_new", "track_id")


def link_by_mode(detections: DataFrame, methods: list[LinkRules], mode: str = "all", mask: DataFrame | None = None, flags: list[str] | None = None, samples: int = 80) -> DataFrame:
    """Tracks of every method, with tracking_method and is_default; the default is the keyhole tracker's, else the first's.

    In any mode but all, detections with a flag or in the mask are left out before linking, and tracks are cut at the mask
    afterwards; a detection's region is not looked at otherwise.
    """
    rows = detections
    masked = mode != "all" and mask is not None
    if mode != "all":
        for f in flags or []:
            rows = rows.where(~F.coalesce(F.col(f).cast("boolean"), F.lit(False)))
    if masked:
        at = rows.withColumns({"_y": F.rint("centroid_y").cast("int"), "_x": F.rint("centroid_x").cast("int")})
        inside = at.join(mask.select("block_name", "time", F.col("y").alias("_y"), "x0", "x1").hint("merge"), ["block_name", "time", "_y"]).where("_x BETWEEN x0 AND x1").select("block_name", "time", "object_label").distinct()
        rows = kept(rows.join(inside.hint("merge"), ["block_name", "time", "object_label"], "left_anti"))
    names = [m.method for m in methods]
    default = "keyhole" if "keyhole" in names else names[0]
    out = None
    for rules in methods:
        tracks = link_tracks(rows, rules)
        if masked:
            tracks = tracks.join(rows.select("block_name", "time", "object_label", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x")).hint("merge"), ["block_name", "time", "object_label"])
            tracks = stopped_at_mask(tracks, mask, samples).select("block_name", "time", "object_label", "track_id")
        tracks = tracks.withColumns({"tracking_method": F.lit(rules.method), "is_default": F.lit(rules.method == default)})
        out = tracks if out is None else out.unionAll(tracks)
    return out


def candidate_links(detections: DataFrame, rules: LinkRules) -> DataFrame:
    """Pairs of detections up to max_gap + 1 frames apart within the gates, by grid cells of the largest reach."""
    r = rules.max_distance * (rules.max_gap + 1)
    cell = lambda c: F.floor(F.col(c) / r)
    d = detections.select("block_name", "time", "object_label", F.col("centroid_z").alias("z"), F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))
    near = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t in range(1, rules.max_gap + 2) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    a = d.select("block_name", F.col("time").alias("time_a"), F.col("object_label").alias("label_a"), F.col("z").alias("za"), F.col("y").alias("ya"), F.col("x").alias("xa"), cell("y").alias("_y"), cell("x").alias("_x"), near)
    a = a.withColumns({"time": F.col("time_a") + F.col("o.t"), "_y": F.col("_y") + F.col("o.a"), "_x": F.col("_x") + F.col("o.b"), "frames": F.col("o.t")}).drop("o")
    b = d.withColumns({"_y": cell("y"), "_x": cell("x")})
    dz = F.col("z") - F.col("za")
    distance = F.sqrt((F.col("y") - F.col("ya")) ** 2 + (F.col("x") - F.col("xa")) ** 2 + (dz * rules.z_weight) ** 2)
    m = a.join(b.hint("merge"), ["block_name", "time", "_y", "_x"]).withColumn("distance", distance)
    good = (F.col("distance") <= rules.max_distance * F.col("frames")) & (F.abs(dz) <= rules.max_z_step * F.col("frames"))
    return m.where(good).select("block_name", "time_a", "label_a", "time", F.col("object_label").alias("label_b"), "frames", "distance")


def constrained_union(edges: DataFrame, max_span: int) -> DataFrame:
    """(block, t, z, label, component_z, component_label) from edges (block, t, z, gap, la, lb): unions in order of z, gap, la, lb.

    An edge ties the mask (z, la) to (z + gap, lb), unless the object would span more than max_span slices; a component
    is named by its least mask. The result depends on the order, so a frame's few edges are joined in one task, which takes
    about BUCKET edges of many frames.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[tuple[int, ...], tuple[int, ...]] = {}
        span: dict[tuple[int, ...], tuple[int, int]] = {}

        def root(x: tuple[int, ...]) -> tuple[int, ...]:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        columns = pdf.sort_values(["z", "gap", "la", "lb"])[["block", "t", "z", "gap", "la", "lb"]]
        for block, t, z, gap, la, lb in zip(*[columns[c].tolist() for c in columns], strict=True):
            ends = (block, t, z, la), (block, t, z + gap, lb)
            for x in ends:
                if x not in parent:
                    parent[x], span[x] = x, (x[2], x[2])
            x, y = map(root, ends)
            lo, hi = min(span[x][0], span[y][0]), max(span[x][1], span[y][1])
            if x != y and hi - lo + 1 <= max_span:
                parent[max(x, y)] = min(x, y)
                span[min(x, y)] = (lo, hi)
        rows = [(*n, *root(n)[2:]) for n in parent]
        return pd.DataFrame(rows, columns=["block", "t", "z", "label", "component_z", "component_label"])

    edges = kept(edges.select("block", "t", "z", "gap", "la", "lb"))
    buckets = max(1, -(-edges.count() // BUCKET), edges.sparkSession.sparkContext.defaultParallelism)
    return edges.groupBy(F.pmod(F.xxhash64("block", "t"), F.lit(buckets)).alias("_bucket")).applyInPandas(run, "block long, t int, z int, label long, component_z int, component_label long")
