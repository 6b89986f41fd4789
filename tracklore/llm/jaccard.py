"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import Scratch, components, cut, empty_safe, keys_hint, pack, sized_join, unpack

#: A column of the incidence matrix that this many documents of one batch share, or this many of all, is a common one.
BATCH_COMMON, COMMON = 3, 100
#: Common columns known to every task, the commonest first: at most 8 MB.
KNOWN_COMMON = 1_000_000
#: Incidence entries in one block of columns.
BLOCK = 400_000
#: Columns with up to this many documents give all their pairs at once.
SHORT = 6

SETS = "doc_id long, n_shingles long, k1 long, k2 long"
HOT = "h long, n long"
#: Pairs that one copy of a document's set is met with, and rows of a long column in one tile of its product.
PAIRS, TILE = 1_000, 512
#: Tiles that short ones of the long columns share, for each block of columns.
SHARED = 32
#: Rounds in which a long column ties its documents to one of them, before all its pairs between components are tried.
STARS = 2
PAIR = ["a", "b", "n_a", "n_b", "hits"]
PAIR_BLOCK = ["bucket", *PAIR]

BLOCKS = "bucket int, h binary, doc binary, n binary"
PRODUCT = "kind int, a long, b long, h long, n_a int, n_b int, hits int"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text and then hash; a shorter text is one shingle."""
    w = tk.words(data, offsets, lower=True)
    h, text, _ = w.grams(size)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = tk._ranges(w.hashes(), w.of[:-1][short], w.of[1:][short])
        h, text = np.concatenate((h, own)), np.concatenate((text, short))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[keep], h[keep]


def _row_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            ns, k1, k2 = [], [], []
            for _, _, data, offsets in tk.slices(batch.column("text")):
                text, h = shingles(data, offsets, size)
                n = np.bincount(text, minlength=len(offsets) - 1)
                for out, value in ((k1, tk.mix(h + np.uint64(1))), (k2, tk.mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                    ends = np.cumsum(n)
                    out.append((total[ends] - total[ends - n]).view(np.int64))
                ns.append(n)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(np.concatenate(ns).astype(np.int64)), "k1": pa.array(np.concatenate(k1)), "k2": pa.array(np.concatenate(k2))})

    return run


def _common(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            found = np.concatenate([shingles(data, offsets, size)[1] for _, _, data, offsets in tk.slices(batch.column("text"))])
            found.sort()
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))[: len(found)])
            n = np.diff(np.append(first, len(found)))
            many = n >= BATCH_COMMON
            yield pa.RecordBatch.from_pydict({"h": pa.array(found[first[many]].view(np.int64)), "n": pa.array(n[many].astype(np.int64))})

    return run


def _entries(size: int, common, buckets: int):
    """Blocks of the incidence matrix: for each document the columns of which a partner must share one.

    Of a column that more than SHORT documents of a batch have, so many and one go to its block, which show there that it is
    long; the others are told already as rows of a long column, in blocks dealt by document. So no block grows with a column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = common.value
        for batch in empty_safe(batches):
            ids, valid = tk.ids_of(batch.column("doc_id"))
            hs, docs, ns = [], [], []
            for a, b, data, offsets in tk.slices(batch.column("text")):
                text, h = shingles(data, offsets, size)
                if len(hot) and len(h):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    late = hot[at] == h
                    order = np.lexsort((h, late, text))
                    text, h = text[order], h[order]
                n = np.bincount(text, minlength=b - a)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = (place <= (n // 5)[text]) & valid[a:b][text]
                hs.append(h[keep])
                docs.append(ids[a:b][text[keep]])
                ns.append(n[text[keep]].astype(np.int32))
            h, doc, n = np.concatenate(hs), np.concatenate(docs), np.concatenate(ns)
            if len(h):
                order = np.argsort(h, kind="stable")
                h, doc, n = h[order], doc[order], n[order]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                rank = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                told = -1 - (tk.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield pack(np.where(rank > SHORT, told, bucket), h=h, doc=doc, n=n)

    return run


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of documents that share a column of this block, with the columns shared, and the rows of long columns."""
    h, doc, n = unpack(pdf, h=np.uint64, doc=np.int64, n=np.int32)
    if pdf["bucket"].iloc[0] < 0:
        return pd.DataFrame({"kind": 1, "a": doc, "b": 0, "h": h.view(np.int64), "n_a": n, "n_b": 0, "hits": 0})
    order = np.argsort(h, kind="stable")
    h, doc, n = h[order], doc[order], n[order]
    length = np.diff(np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h)))
    keep = np.repeat(length > 1, length)
    h, doc, n = h[keep], doc[keep], n[keep]
    length = length[length > 1]
    start = np.cumsum(length) - length
    i, j = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(2, SHORT + 1):
        at = start[length == k]
        x, y = np.triu_indices(k, 1)
        i.append((at[:, None] + x).ravel())
        j.append((at[:, None] + y).ravel())
    i, j = np.concatenate(i), np.concatenate(j)
    swap = doc[i] > doc[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    x, y = n[i].astype(np.int64), n[j].astype(np.int64)
    good = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (doc[i] != doc[j])
    i, j = i[good], j[good]
    order = np.lexsort((doc[j], doc[i]))
    i, j = i[order], j[order]
    a, b = doc[i], doc[j]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    pairs = pd.DataFrame({"kind": 0, "a": a[first], "b": b[first], "h": 0, "n_a": n[i[first]], "n_b": n[j[first]], "hits": np.diff(np.append(first, len(a)))})
    rest = np.repeat(length > SHORT, length)
    again = pd.DataFrame({"kind": 1, "a": doc[rest], "b": 0, "h": h[rest].view(np.int64), "n_a": n[rest], "n_b": 0, "hits": 0})
    return pd.concat([pairs, again])[["kind", "a", "b", "h", "n_a", "n_b", "hits"]]


def _packed_sets(size: int):
    """Each text's shingles, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            for a, b, data, offsets in tk.slices(batch.column("text")):
                text, h = shingles(data, offsets, size)
                ends = np.cumsum(np.bincount(text, minlength=b - a)).tolist()
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc_id").slice(a, b - a), "set": pa.array([h[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose overlap, over all columns, is the least that their two sizes allow, or more."""
    for batch in empty_safe(batches):
        linked = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            least = -(-4 * (len(x) + len(y)) // 9)
            linked.append(len(x) > 0 and min(len(x), len(y)) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least)
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_pydict({"u": batch.column("a").filter(mask), "v": batch.column("b").filter(mask)})


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, scratch: Scratch) -> DataFrame:
    """Pairs with the set of one end; a set that very many pairs need is copied, and its pairs are dealt to the copies."""
    hot = scratch.table(pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("copies")).where("copies > 1"))
    own = sized_join(sets.toDF(end, f"set_{end}"), hot, [end], 12, "left")
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    pairs = sized_join(pairs, hot, [end], 12, "left")
    pairs = pairs.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    return pairs.join(own.hint("merge"), [end, "copy"]).drop("copy")


def _links(docs: DataFrame, pairs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    pairs = pairs.select("a", "b")
    needed = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    with Scratch(docs.sparkSession) as own:
        texts = docs.join(keys_hint(own.table(needed)), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = own.table(texts.mapInArrow(_packed_sets(size), "doc long, set binary"))
        both = _with_sets(_with_sets(pairs, sets, "b", own), sets, "a", own)
        return scratch.table(both.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "u long, v long"))


def _with_part(rows: DataFrame, key: str, name: str, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return rows.withColumn(name, F.col(key))
    return rows.join(parts.toDF(key, name).hint("merge"), key, "left").withColumn(name, F.coalesce(name, key))


def _apart(pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Pairs whose documents are in different components."""
    return _with_part(_with_part(pairs, "a", "part_a", parts), "b", "part_b", parts).where("part_a <> part_b").select(PAIR)


def _mixed(lists: DataFrame, parts: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The rows of long columns whose documents are in more than one component."""
    rows = scratch.table(_with_part(lists, "doc", "part", parts))
    mixed = rows.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("h")
    return scratch.table(rows.join(keys_hint(scratch.table(mixed)), "h", "left_semi"))


def _star_pairs(rows: DataFrame, round_: int, scratch: Scratch) -> DataFrame:
    """Each document of a long column with one of the column, where sizes and components allow a link: the one in most
    long columns, then another in each round."""
    order = F.struct(F.col("degree") if round_ == 0 else F.lit(0), F.xxhash64("doc", F.lit(round_)))
    lead = rows.groupBy("h").agg(F.max_by(F.struct("doc", "n", "part"), order).alias("l")).select("h", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("doc", "n", "part")])
    both = sized_join(rows, scratch.table(lead), ["h"], 32)
    good = both.where("l_doc <> doc AND l_part <> part AND 5 * l_n >= 4 * n AND 5 * n >= 4 * l_n")
    low = F.expr("l_doc < doc")
    ends = [F.when(low, F.col(f"l_{c}")).otherwise(F.col(c)).alias(x) for c, x in (("doc", "a"), ("n", "n_a"))]
    ends += [F.when(low, F.col(c)).otherwise(F.col(f"l_{c}")).alias(x) for c, x in (("doc", "b"), ("n", "n_b"))]
    return good.select(*ends).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("hits")).select(PAIR)


def _tiles(rows: DataFrame, columns: int, scratch: Scratch) -> DataFrame:
    """The product of long columns in tiles of about TILE by TILE rows: rows outside a column's largest part by all.

    Short columns share tiles, by their hash; each tile is a task's work, however many documents have a column.
    """
    sizes = rows.groupBy("h", "part").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("part", F.struct("c", "part")).alias("large"), F.sum("c").alias("all"), F.max("c").alias("most"))
    sizes = scratch.table(sizes.select("h", "large", F.ceil(F.col("all") / TILE).cast("int").alias("wide"), F.greatest(F.ceil((F.col("all") - F.col("most")) / TILE), F.lit(1)).cast("int").alias("high")))
    rows = sized_join(rows.select("h", "doc", "part", F.col("n").cast("long").alias("n")), sizes, ["h"], 24).withColumn("other", F.col("part") != F.col("large"))
    own = {c: F.pmod(F.xxhash64("doc", F.lit(c)), F.col(c)).cast("int") for c in ("wide", "high")}
    split = F.sequence(F.lit(0), F.col("high") - 1), F.sequence(F.lit(0), F.col("wide") - 1)
    every = rows.withColumn("side", F.lit(0)).withColumn("c", own["wide"]).withColumn("o", F.explode(split[0]))
    others = rows.where("other").withColumn("side", F.lit(1)).withColumn("c", F.explode(split[1])).withColumn("o", own["high"])
    long = (F.col("wide") > 1) | (F.col("high") > 1)
    tile = F.when(long, F.col("h")).otherwise(F.pmod("h", F.lit(SHARED * columns))).alias("tile")
    return every.unionByName(others).select(tile, *[F.when(long, F.col(x)).otherwise(-1).alias(x) for x in ("c", "o")], "h", "doc", "part", "n", "other", "side")


def _pair_blocks(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, hits: np.ndarray, buckets: int) -> pa.RecordBatch:
    key = tk.mix(a.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.int64).view(np.uint64))
    return pack((key % np.uint64(buckets)).astype(np.int32), a=a.astype(np.int64), b=b.astype(np.int64), n_a=n_a.astype(np.int32), n_b=n_b.astype(np.int32), hits=hits.astype(np.int32))


def _summed(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, hits: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n_a, n_b, hits = (x[order] for x in (a, b, n_a, n_b, hits))
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    return [a[first], b[first], n_a[first], n_b[first], np.add.reduceat(hits, first) if len(first) else hits]


def _tile_product(buckets: int):
    """The product of one tile, between components only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, doc, part, n = (pdf[c].to_numpy(np.int64) for c in ("h", "doc", "part", "n"))
        other, side = pdf["other"].to_numpy(bool), pdf["side"].to_numpy(np.int64)
        order = np.lexsort((side, h))
        h, doc, part, n, other, side = (x[order] for x in (h, doc, part, n, other, side))
        cuts = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        found, held = [[np.zeros(0, np.int64)] * 5], 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            d, p, s, second = doc[lo:mid], part[lo:mid], n[lo:mid], other[lo:mid]
            for i in range(mid, hi):
                near = (p != part[i]) & (5 * s >= 4 * n[i]) & (5 * n[i] >= 4 * s) & (~second | (d > doc[i]))  # two others once
                j = np.flatnonzero(near)
                if len(j):
                    low = d[j] < doc[i]
                    mine, its = np.full(len(j), doc[i]), np.full(len(j), n[i])
                    found.append([np.where(low, d[j], mine), np.where(low, mine, d[j]), np.where(low, s[j], its), np.where(low, its, s[j]), np.ones(len(j), np.int64)])
                    held += len(j)
            if held > 4_000_000:
                found, held = [_summed(*map(np.concatenate, zip(*found, strict=True)))], 0
        sums = _summed(*map(np.concatenate, zip(*found, strict=True)))
        return _pair_blocks(*sums, buckets).to_pandas() if len(sums[0]) else pd.DataFrame({c: [] for c in PAIR_BLOCK}).astype({"bucket": np.int32})

    return run


def _as_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            yield _pair_blocks(*(batch.column(c).to_numpy() for c in PAIR), buckets)

    return run


def _hopeful(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block whose hits over all columns leave a link possible."""
    a, b, n_a, n_b, hits = _summed(*(x.astype(np.int64) for x in unpack(pdf, a=np.int64, b=np.int64, n_a=np.int32, n_b=np.int32, hits=np.int32)))
    least = (4 * (n_a + n_b) + 8) // 9 - np.maximum(n_a - n_a // 5 - 1, n_b - n_b // 5 - 1)
    good = hits >= least
    return pd.DataFrame({"a": a[good], "b": b[good], "n_a": n_a[good], "n_b": n_b[good], "hits": hits[good]})


def _open_pairs(pairs: DataFrame, rows: DataFrame, parts: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """All pairs between components that short and long columns give together, as far as their hits allow a link."""
    schema = ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in PAIR_BLOCK)
    short = _apart(pairs, parts).mapInArrow(_as_blocks(buckets), schema)
    long = _tiles(rows, buckets, scratch).groupBy("tile", "c", "o").applyInPandas(_tile_product(buckets), schema)
    return short.unionAll(long).groupBy("bucket").applyInPandas(_hopeful, "a long, b long, n_a long, n_b long, hits long")


def _best(pairs: DataFrame) -> DataFrame:
    """For each document its pair with the most hits."""
    ends = F.explode(F.array("a", "b")).alias("doc")
    return pairs.select("*", ends).groupBy("doc").agg(F.max_by(F.struct(PAIR), F.struct("hits", "a", "b")).alias("p")).select("p.*").distinct()


def jaccard_groups(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text), linked where Jaccard >= 0.8 exactly.

    Rows with equal shingle sets are one class from the start. Of each class's set, ordered with common columns last,
    the first n // 5 + 1 shingles are incidence entries: two sets with the needed overlap share one of them. Blocks of
    columns are multiplied apart, and sizes discard pairs. Each document's pair with the most hits is verified first, on the
    whole sets; a column with many documents gives only pairs with one of them, another one in each of a few rounds. Of
    all other pairs only those still in different components are verified, as far as the hits over all columns allow a
    link: none between components is missed, and groups of copies give few pairs. Every order of columns gives the same links; the common ones only come last to keep lists short.
    Rows are documents, also where they repeat a doc_id. A null doc_id links with nothing and has a null component; null
    and empty texts have n_shingles 0 and link with nothing. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as scratch:
        sets = scratch.table(docs.mapInArrow(_row_sets(size), SETS))
        live = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = scratch.table(live.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        extra = scratch.table(live.join(classes.where("copies > 1").hint("merge"), ["k1", "k2", "n_shingles"]).where("doc_id > rep").select("doc_id").distinct())
        reps = docs.where("doc_id IS NOT NULL").join(keys_hint(extra), "doc_id", "left_anti")
        common = scratch.table(reps.mapInArrow(_common(size), HOT).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON))
        known = common.orderBy(F.desc("n"), "h").limit(KNOWN_COMMON).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        order = spark.sparkContext.broadcast(np.sort(known))
        entries = classes.agg(F.sum(F.expr("n_shingles div 5 + 1"))).first()[0] or 0
        columns = max(8, -(-entries // BLOCK))
        blocks = reps.mapInArrow(_entries(size, order, columns), BLOCKS)
        with Scratch(spark) as own:
            product = own.table(blocks.groupBy("bucket").applyInPandas(_product, PRODUCT))
            pairs = scratch.table(product.where("kind = 0").groupBy("a", "b", "n_a", "n_b").agg(F.sum("hits").alias("hits")).select(PAIR))
            lists = product.where("kind = 1").select("h", F.col("a").alias("doc"), F.col("n_a").alias("n"))
            degrees = lists.groupBy("doc").agg(F.count("*").alias("degree"))
            lists = scratch.table(lists.join(degrees.hint("merge"), "doc"))
        links = tried = parts = None
        for k in range(STARS):
            rows = _mixed(lists, parts, scratch)
            star = _star_pairs(rows, k, scratch)
            now = _best(_apart(pairs, parts).unionAll(star)) if k == 0 else _best(star)
            now = scratch.table(now if tried is None else now.join(tried.hint("merge"), ["a", "b"], "left_anti"))
            if k and now.isEmpty():
                break
            found = _links(reps, now, size, scratch)
            links, tried = (found, now.select("a", "b")) if links is None else (links.unionAll(found), tried.unionAll(now.select("a", "b")))
            parts = scratch.table(components(links))
        left = _open_pairs(pairs, _mixed(lists, parts, scratch), parts, columns, scratch)
        left = scratch.table(left.join(tried.hint("merge"), ["a", "b"], "left_anti").select(PAIR))
        more = _links(reps, left, size, scratch)
        if not more.isEmpty():
            parts = scratch.table(components(links.unionAll(more)))
        ends = classes.select("k1", "k2", "n_shingles", "rep").join(parts.toDF("rep", "component").hint("merge"), "rep", "left")
        ends = ends.select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("found"))
        out = sets.join(ends.hint("merge"), ["k1", "k2", "n_shingles"], "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
        return cut(out)
