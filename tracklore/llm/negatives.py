"""Hard negatives: buckets of vectors of like length hold sorted coordinate lists, whose feasible ranges give candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.common import Scratch, cut, empty_safe, sized_join

#: Vectors of a bucket, and anchors that are met with buckets together.
BUCKET, TILE = 8192, 2048
#: Coordinates of an anchor whose feasible ranges are intersected: those with the largest parts of its length.
FOCUS = 3
#: Candidates above this share of a bucket are verified with all others of their kind in one product of matrices.
BULK_SHARE = 0.2
#: Vectors met at once in that product; afterwards thresholds are raised.
STEP = 1024
#: Whole numbers up to here are exact in double precision; components and scores are held within the second.
EXACT, MOST = 2.0**53, 2**62 - 1

BUCKETS = "bucket long, dim int, n int, anchors int, longest double, kind string, ids binary, labels binary, flags binary, vectors binary, lists binary"
TILES = "dim int, tile int, n int, reach double, ids binary, labels binary, vectors binary, bands binary, found binary, scores binary"
TASK = "dim int, tile int, slot int, role int, longest double, n int, kind string, ids binary, labels binary, vectors binary, lists binary, bands binary, found binary, scores binary"
BEST = "dim int, tile int, bands binary, found binary, scores binary"


def _numbers(blob: bytes, kind: str | type = np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their lengths, and lengths; a vector of zeros stays."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(length > 0, length, 1.0)[:, None], length


def _bucket(ids: np.ndarray, labels: np.ndarray, flags: np.ndarray, vectors: np.ndarray) -> dict:
    unit, length = _unit(vectors)
    most = float(np.abs(vectors).max(initial=0.0))
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    lists = np.argsort(unit, axis=0, kind="stable").T.astype("<u2")
    return {"dim": vectors.shape[1], "n": len(ids), "anchors": int(flags.sum()), "longest": float(length.max(initial=0.0)), "kind": kind, "ids": ids.tobytes(), "labels": labels.tobytes(), "flags": flags.tobytes(), "vectors": vectors.astype(kind).tobytes(), "lists": lists.tobytes()}


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def _buckets(scale: float):
    """Buckets of the partition's rows, which come by dimension and falling length; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 32, [], None
        for batch in empty_safe(batches):
            vectors = batch.column("vector")
            ids, labels, flags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "anchor"))
            for k in range(batch.num_rows):
                v = np.clip(np.floor(np.asarray(vectors[k].values, np.float64) * scale), -float(2**62), float(2**62))
                row = (len(v), int(ids[k]), int(labels[k]), v.tobytes())
                if row == last:
                    continue
                if held and (len(held) == BUCKET or row[0] != last[0]):
                    yield _told(number, held)
                    number, held = number + 1, []
                held.append((row[1], row[2], bool(flags[k]), v))
                last = row
        if held:
            yield _told(number, held)

    def _told(number: int, held: list) -> pa.RecordBatch:
        ids, labels, flags, vectors = zip(*held, strict=True)
        row = {"bucket": number} | _bucket(np.array(ids, np.int64), np.array(labels, np.int64), np.array(flags, bool), np.stack(vectors))
        return pa.RecordBatch.from_pylist([row], _schema(BUCKETS))

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in empty_safe(batches):
        for r in batch.to_pylist():
            own = np.flatnonzero(_numbers(r["flags"], bool))
            vectors = _numbers(r["vectors"], r["kind"]).reshape(r["n"], r["dim"])[own].astype("<f8")
            yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]] * len(own), pa.int32()), "vec_id": _numbers(r["ids"])[own], "label": _numbers(r["labels"])[own], "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})


def _tile(key: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by([("vec_id", "ascending"), ("label", "ascending"), ("vector", "ascending")])
    row = {"dim": key[0].as_py(), "tile": key[1].as_py(), "n": len(group), "reach": 0.0, "vectors": b"".join(group["vector"].to_pylist()), "bands": b"", "found": b"", "scores": b""}
    return pa.Table.from_pylist([row | {to: group[c].to_numpy().astype(np.int64).tobytes() for c, to in (("vec_id", "ids"), ("label", "labels"))}], _schema(TILES))


class Best:
    """The first so many (score, id) of each band: higher scores first, then smaller ids."""

    def __init__(self, bands: int, most: int):
        self.most = most
        self.score, self.id = np.full((bands, most), -MOST - 1, np.int64), np.full((bands, most), np.iinfo(np.int64).max)

    def put(self, band: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some, at = np.unique(band, return_inverse=True)
        row = np.concatenate((np.repeat(np.arange(len(some)), self.most), at))
        score, ids = np.concatenate((self.score[some].ravel(), score)), np.concatenate((self.id[some].ravel(), ids))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, np.arange(len(some)))
        take = (first[:, None] + np.arange(self.most)).ravel()
        self.score[some], self.id[some] = score[take].reshape(-1, self.most), ids[take].reshape(-1, self.most)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(band, id, score) of all that were put, in order."""
        band, place = np.nonzero(self.score >= -MOST)
        return band, self.id[band, place], self.score[band, place]


class Search:
    """Anchors of a tile, met with bucket after bucket; bands, if any, bound the scores of each (anchor, positive)."""

    def __init__(self, row: dict, per: int, most: int, low: int, high: int):
        self.ids, self.labels = _numbers(row["ids"]), _numbers(row["labels"])
        self.vectors = _numbers(row["vectors"], "<f8").reshape(len(self.ids), -1)
        self.unit, self.length = _unit(self.vectors)
        self.top = float(np.abs(self.vectors).max(initial=0.0))
        self.angle = np.arccos(np.clip(self.unit, -1, 1))
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.per, self.negatives = per, bool(per)
        if self.negatives:
            self.low, self.high = np.full(len(self.ids) * per, MOST), np.full(len(self.ids) * per, -MOST)
            bands, scores = _numbers(row["bands"]), _numbers(row["scores"]).tolist()
            place = bands * per + np.arange(len(bands)) - np.searchsorted(bands, bands)
            self.low[place] = [-(-low * s // 100) for s in scores]
            self.high[place] = [high * s // 100 for s in scores]
            self.best = Best(len(self.low), most)
        else:
            self.best = Best(len(self.ids), most)

    def needed(self) -> np.ndarray:
        """The score that a vector must have for each anchor to count; beyond all for one without positives."""
        if not self.negatives:
            return self.best.least()
        own = np.where(self.low <= self.high, np.maximum(self.low, self.best.least()), MOST)
        return own.reshape(-1, self.per).min(axis=1) if len(own) else own

    def _scores(self, vectors: np.ndarray, others: np.ndarray, product) -> np.ndarray:
        """Inner products as whole numbers: in double precision where that is exact, else in Python's integers."""
        bound = self.top * float(np.abs(others).max(initial=0.0)) * max(others.shape[1], 1)
        if bound < EXACT:
            return product(vectors, others).astype(np.int64)
        exact = product(*(np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in (vectors, others)))
        return np.clip(exact, -MOST, MOST).astype(np.int64)

    def _put(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not self.negatives:
            self.best.put(anchor, score, ids)
            return
        band = (anchor[:, None] * self.per + np.arange(self.per)).ravel()
        score, ids = np.repeat(score, self.per), np.repeat(ids, self.per)
        fits = (score >= self.low[band]) & (score <= self.high[band]) & (score >= self.best.least()[band])
        if fits.any():
            self.best.put(band[fits], score[fits], ids[fits])

    def meet(self, row: dict) -> None:
        """Raises what is best by a bucket's vectors.

        Anchors that its longest vector can't reach are left out. For the others, a vector within the angle that the
        needed score asks for has each focus coordinate within a feasible range, found in that coordinate's sorted list;
        vectors in all ranges are candidates, and their inner products decide.
        """
        ids, labels = _numbers(row["ids"]), _numbers(row["labels"])
        vectors = _numbers(row["vectors"], row["kind"]).reshape(len(ids), -1).astype("<f8")
        lists = _numbers(row["lists"], "<u2").reshape(-1, len(ids))
        most = self.length * row["longest"] * (1 + 1e-9)
        needed = self.needed()
        active = np.flatnonzero(needed <= most)
        share = np.clip(needed[active] / np.where(most[active] > 0, most[active], 1.0), 0.0, 1.0)
        angle = np.arccos(share) + 1e-7
        bulk = np.ones(len(active), bool)
        if vectors.shape[1] and (share > 0).any():
            unit, _ = _unit(vectors)
            begin, end = self._ranges(active, angle, unit, lists)
            size = (end - begin).min(axis=1)
            bulk = (size > BULK_SHARE * len(ids)) | (share <= 0)
            for k in np.flatnonzero(~bulk).tolist():
                self._narrow(active[k], needed[active[k]], angle[k], begin[k], end[k], ids, labels, vectors, unit, lists)
        rest = active[bulk]
        for at in range(0, len(ids) if len(rest) else 0, STEP):
            own = slice(at, at + STEP)
            scores = self._scores(self.vectors[rest], vectors[own], lambda a, b: a @ b.T)
            same = self.labels[rest, None] == labels[own]
            fits = (scores >= self.needed()[rest, None]) & (~same if self.negatives else same & (self.ids[rest, None] != ids[own]))
            anchor, found = np.nonzero(fits)
            if len(anchor):
                self._put(rest[anchor], scores[anchor, found], ids[own][found])

    def _ranges(self, active: np.ndarray, angle: np.ndarray, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the feasible range of each focus coordinate begins and ends in the coordinate's list."""
        focus = self.focus[active]
        own = self.angle[active[:, None], focus]
        low, high = np.cos(np.minimum(own + angle[:, None], np.pi)) - 1e-9, np.cos(np.maximum(own - angle[:, None], 0.0)) + 1e-9
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus).tolist():
            values, at = unit[lists[f], f], focus == f
            begin[at], end[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        return begin, end

    def _narrow(self, anchor, needed, angle, begin, end, ids, labels, vectors, unit, lists) -> None:
        order = np.argsort(end - begin, kind="stable")
        focus = self.focus[anchor]
        found = lists[focus[order[0]]][begin[order[0]] : end[order[0]]].astype(np.int64)
        for k in order[1:].tolist():
            own, x = self.angle[anchor, focus[k]], unit[found, focus[k]]
            found = found[(x >= np.cos(min(own + angle, np.pi)) - 1e-9) & (x <= np.cos(max(own - angle, 0.0)) + 1e-9)]
        same = labels[found] == self.labels[anchor]
        found = found[~same if self.negatives else same & (ids[found] != self.ids[anchor])]
        if len(found):
            scores = self._scores(self.vectors[anchor][None], vectors[found], lambda a, b: b @ a[0])
            fits = scores >= needed
            self._put(np.full(int(fits.sum()), anchor), scores[fits], ids[found][fits])


def _searched(per: int, most: int, low: int, high: int):
    """Runs of rows, each an anchor tile and then buckets by falling length: what is best for the tile in these buckets."""

    def told(row: dict, search: Search) -> pa.RecordBatch:
        band, ids, scores = search.best.rows()
        return pa.RecordBatch.from_pylist([{"dim": row["dim"], "tile": row["tile"], "bands": band.tobytes(), "found": ids.tobytes(), "scores": scores.tobytes()}], _schema(BEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, search = None, None
        for batch in empty_safe(batches):
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["role"] == 0:
                    if search:
                        yield told(own, search)
                    own, search = row, Search(row, per, most, low, high)
                else:
                    search.meet(row)
        if search:
            yield told(own, search)

    return run


def _best_of(group: pa.Table, bands: int, most: int) -> Best:
    best = Best(bands, most)
    for r in group.to_pylist():
        if r["bands"]:
            best.put(_numbers(r["bands"]), _numbers(r["scores"]), _numbers(r["found"]))
    return best


def _with_positives(most: int, low: int):
    """An anchor tile with the best of all its tasks, and the length that a vector must have to count for any anchor."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tile = next(r for r in group.to_pylist() if r["n"])
        band, ids, scores = _best_of(group.filter(pc.equal(group["n"], 0)), tile["n"], most).rows()
        length = _unit(_numbers(tile["vectors"], "<f8").reshape(tile["n"], -1))[1][band]
        reach = np.where(scores < 0, np.inf, np.where(length > 0, low / 100 * scores / np.where(length > 0, length, 1.0), 0.0))
        row = tile | {"reach": max(0.0, float(reach.min(initial=np.inf))) * (1 - 1e-9) if len(band) else np.inf, "bands": band.tobytes(), "found": ids.tobytes(), "scores": scores.tobytes()}
        return pa.Table.from_pylist([row], _schema(TILES))

    return run


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _negatives(per: int, most: int):
    """Rows of an anchor tile from the best of all its tasks."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tile = next(r for r in group.to_pylist() if r["n"])
        bands, found, scores = (_numbers(tile[c]) for c in ("bands", "found", "scores"))
        band, ids, score = _best_of(group.filter(pc.equal(group["n"], 0)), tile["n"] * per, most).rows()
        place = np.searchsorted(bands, band // per) + band % per
        rank = np.arange(len(band)) - np.searchsorted(band, band) + 1
        columns = [_numbers(tile["ids"])[band // per], found[place], rank.astype(np.int32), ids, scores[place], score]
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def _tasks(tiles: DataFrame, buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every tile with every bucket of its dimension that is long enough for it, dealt to the tile's slots."""
    spark = tiles.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, tiles.count())
    slots = F.least(F.lit(-(-most // n)), F.col("buckets"))
    sizes = sizes.withColumn("slots", F.greatest(slots.cast("int"), F.lit(1)))
    left = sized_join(tiles, sizes.select("dim", "slots"), ["dim"], 16).select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    right = sized_join(buckets, sizes.select("dim", "slots", "tiles"), ["dim"], 24).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    right = sized_join(right, tiles.select("dim", "tile", "reach"), ["dim", "tile"], 24).where("longest >= reach")
    right = right.withColumn("slot", F.pmod(F.xxhash64("bucket"), F.col("slots")).cast("int"))
    none = F.lit(b"")
    left = left.withColumns({"role": F.lit(0), "longest": F.lit(float("inf")), "kind": F.lit("<f8"), "lists": none})
    right = right.withColumns({"role": F.lit(1), "bands": none, "found": none, "scores": none})
    columns = [c.split()[0] for c in TASK.split(", ")]
    both = left.select(*columns, "slots").unionAll(right.select(*columns, "slots"))
    task = F.pmod(F.col("dim") + F.col("tile") * F.col("slots") + F.col("slot"), F.lit(most))
    return both.repartitionById(most, task).sortWithinPartitions("dim", "tile", "slot", "role", F.desc("longest")).select(*columns)


def hard_negatives(vectors: DataFrame, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, embedding, label, anchor).

    Components count as floor(scale * x), scores are inner products of these whole numbers. For each row of which anchor
    is true and each of its best positives (rows of its label with another id, at most so many), the best rows of other
    labels whose score is from low to high per cent of the positive's; higher scores come first, ties by smaller id.

    Rows are sorted by length into buckets, each with a sorted list of every coordinate. Anchors are dealt to tiles, and
    each tile meets all buckets, the longest first, in a few tasks, whose best are put together; what is best so far
    bounds lengths and angles, and so the candidates of the next bucket. The search is exact.

    Rows with a null id, label or vector, or with null or non-finite components take no part; vectors of different
    lengths don't meet; a null anchor is none; repeated rows count once, rows of one id that differ each for itself.
    Components and scores are held within 2^62. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    good = rows.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    length = F.reduce("vector", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    good = good.select("*", F.size("vector").alias("dim"), length.alias("_length"), F.xxhash64("vector").alias("_hash"))
    order = [F.col("dim"), F.desc("_length"), F.col("vec_id"), F.col("label"), F.col("_hash")]
    with Scratch(spark) as scratch:
        ranges = max(1, -(-good.count() // BUCKET))
        buckets = good.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("vec_id", "label", "anchor", "vector").mapInArrow(_buckets(scale), BUCKETS)
        buckets = scratch.table(buckets)
        sizes = buckets.groupBy("dim").agg(F.count("*").alias("buckets"), F.ceil(F.sum("anchors") / TILE).cast("int").alias("tiles")).where("tiles > 0")
        sizes = scratch.table(sizes)
        anchors = buckets.where("anchors > 0").mapInArrow(_anchors, "dim int, vec_id long, label long, vector binary")
        dealt = sized_join(anchors, sizes.select("dim", "tiles"), ["dim"], 16).withColumn("tile", F.pmod(F.xxhash64("vec_id", "label"), F.col("tiles")).cast("int"))
        tiles = scratch.table(dealt.drop("tiles").groupBy("dim", "tile").applyInArrow(_tile, TILES))
        blank = {"n": F.lit(0), "reach": F.lit(0.0), "ids": F.lit(b""), "labels": F.lit(b""), "vectors": F.lit(b"")}
        names = [c.split()[0] for c in TILES.split(", ")]

        def with_best(tiles: DataFrame, per: int, most: int, merged, schema: str) -> DataFrame:
            best = _tasks(tiles, buckets, sizes).mapInArrow(_searched(per, most, low, high), BEST).withColumns(blank)
            return tiles.unionAll(best.select(names)).groupBy("dim", "tile").applyInArrow(merged, schema)

        tiles = scratch.table(with_best(tiles, 0, positives, _with_positives(positives, low), TILES))
        return cut(with_best(tiles, positives, negatives, _negatives(positives, negatives), RESULT))
