"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges; built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.llm.common import cut, sized_join

#: Ranges cut for each shard at first, and for each range that a boundary cuts later, with sampled keys for each range on
#: average: they bound what the driver sees, whatever the input.
RANGES, SAMPLES = (16, 128), (64, 16)
#: A group of equal texts stays whole if it is at most this share of a shard; a larger one may be cut.
WHOLE = 0.01
#: A range that a boundary cuts is subdivided until it holds at most this share of a shard, or one row or whole group.
FINE = 0.0002
#: Rows numbered in one group, about.
NUMBERED = 1 << 20

Key = tuple[int, int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _reached(key: Key) -> Column:
    """Whether a row's key is key or more."""
    a, b, c = (F.lit(x) for x in key)
    x, y, z = F.col("text_key"), F.col("row_key"), F.col("row")
    return (x > a) | ((x == a) & ((y > b) | ((y == b) & (z >= c))))


def _place(splitters: list[Key]) -> Column:
    """How many of the splitters a row's key has reached: coarse ones first, then those between two of them."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))

    def literal(found: list[Key]) -> Column:
        return F.from_json(F.lit("[" + ",".join(f'{{"a":{a},"b":{b},"c":{c}}}' for a, b, c in found) + "]"), "array<struct<a:bigint,b:bigint,c:bigint>>")

    def reached(rows: Column) -> Column:
        x, y, z = F.col("text_key"), F.col("row_key"), F.col("row")
        return F.size(F.filter(rows, lambda s: (s["a"] < x) | ((s["a"] == x) & ((s["b"] < y) | ((s["b"] == y) & (s["c"] <= z))))))

    block = reached(literal(splitters[width - 1 :: width]))
    return block * width + reached(F.slice(literal(splitters), block * width + 1, F.lit(width - 1))) if width > 1 else block


def _sampled(rows: DataFrame, size: int, samples: int) -> list[tuple[Key, int]]:
    """(key, times) of a size-weighted sample: a row is taken as often as multiples of a step fall in its size, shifted by its hash."""
    shift = F.pmod(F.xxhash64("row", "row_key", "text_key"), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("size") / (size / samples) + shift).cast("long")
    found = rows.select("text_key", "row_key", "row", times.alias("times")).where("times > 0").collect()
    return sorted(((r[0], r[1], r[2]), r[3]) for r in found)


def _quantiles(sample: list[tuple[Key, int]], each: int, hot: set[int]) -> list[Key]:
    """Keys at multiples of each in a sample; a group of equal texts that is not hot is never cut, but may be set apart."""
    cuts, seen = set(), 0
    for (a, b, c), times in sample:
        if (seen + times) // each > seen // each:
            cuts |= {(a, b, c), (a, b, c + 1)} if a in hot else {(a, LOW, LOW), (min(a + 1, HIGH), LOW, LOW)}
        seen += times
    return sorted(cuts)


def _bounds(rows: DataFrame, total: int, shards: int) -> list[Key]:
    """The shards' splitters: the first key of every shard but the first.

    A sample of all keys gives quantiles that cut ranges; their exact sums tell which ranges hold a boundary between
    shards, and only these are sampled, cut and summed again, until they are small.
    """
    spark = rows.sparkSession
    sample, each = _sampled(rows, total, shards * RANGES[0] * SAMPLES[0]), SAMPLES[0]
    often: dict[int, int] = {}
    for (a, _, _), times in sample:
        often[a] = often.get(a, 0) + times
    tried = [(a,) for a, n in often.items() if n >= 4]
    groups = rows.join(F.broadcast(spark.createDataFrame(tried, "text_key long")), "text_key").groupBy("text_key").agg(F.sum("size").alias("n")) if tried else None
    hot = {r[0] for r in groups.where(F.col("n") > WHOLE * total / shards).collect()} if tried else set()
    goals = [k * total / shards for k in range(1, shards)]
    found: dict[int, Key] = {}
    # open ranges: (first key, end key, bytes before, bytes)
    todo: list[tuple[Key | None, Key | None, int, int]] = [(None, None, 0, total)]
    while todo:
        splitters = sorted({k for lo, hi, _, _ in todo for k in (lo, hi) if k is not None})
        within = [(F.lit(True) if lo is None else _reached(lo)) & (F.lit(True) if hi is None else ~_reached(hi)) for lo, hi, _, _ in todo]
        inside = rows.where(reduce(lambda a, b: a | b, within))
        if each != SAMPLES[0]:
            sample = _sampled(inside, sum(t[3] for t in todo), len(todo) * RANGES[1] * SAMPLES[1])
        new = [k for k in _quantiles(sample, each, hot) if any((lo is None or k > lo) and (hi is None or k < hi) for lo, hi, _, _ in todo)]
        splitters = sorted({*splitters, *new})
        sums = {r[0]: r[1] for r in inside.groupBy(_place(splitters).alias("range")).agg(F.sum("size")).collect()}
        again = []
        for lo, hi, before, size in todo:
            own = [lo, *(k for k in new if (lo is None or k > lo) and (hi is None or k < hi)), hi]
            base = 0 if lo is None else splitters.index(lo) + 1
            for i, (x, y) in enumerate(zip(own, own[1:], strict=False)):
                n = sums.get(base + i, 0)
                cut_by = [k for k, g in enumerate(goals) if k not in found and before < g <= before + n]
                if cut_by and (n <= FINE * total / shards or len(own) == 2):
                    for k in cut_by:  # the end of the range that is nearer to the goal
                        found[k] = (x or (LOW, LOW, LOW)) if goals[k] - before < n / 2 else (y or (HIGH, HIGH, HIGH))
                elif cut_by:
                    again.append((x, y, before, n))
                before += n
        todo, each = again, SAMPLES[1]
    last = (LOW, LOW, LOW)
    out = []
    for k in range(shards - 1):
        last = max(last, found.get(k, (HIGH, HIGH, HIGH)))
        out.append(last)
    return out


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) of each row of docs (doc_id, text): shards of near equal bytes.

    The key of a row is its text's hash, then its id's, then its number, so equal texts stand together and no two rows
    have one key. The shards' splitters are quantiles of all bytes in the order of keys, found by sampling: ranges that
    a boundary cuts are subdivided until they are small. A group of equal texts of at most WHOLE of a shard stays
    together; a larger one is cut within. So shards differ by about one percent and a document at most. Slots number a
    shard's rows, in groups dealt by hash. Size is the text's bytes and 8. Null text: no bytes, crc32 0; a null doc_id
    stays null; rows that repeat are placed each; other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64("doc_id", F.lit(shards)).alias("row_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows)
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    bounds = _bounds(rows, total, shards) if total else []
    groups = max(1, round((n or 0) / NUMBERED))
    number = reduce(lambda a, b: a + b, [_reached(k).cast("int") for k in bounds], F.lit(0))
    rows = rows.withColumns({"shard": number.cast("int"), "group": F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")})
    before = W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("shard", "group").agg(F.count("*").alias("n")).select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = F.row_number().over(W.partitionBy("shard", "group").orderBy("row"))
    out = sized_join(rows.withColumn("number", order), cut(first), ["shard", "group"], 16).withColumn("slot", F.col("first") + F.col("number") - 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
