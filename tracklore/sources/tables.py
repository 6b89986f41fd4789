"""Reading many files into one table, validating metadata, file manifests, and writing results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.functions.scalar import number
from tracklore.operators.lineage import running


def resolve_columns(df: DataFrame, roles: dict[str, Sequence[str]], defaults: dict[str, object] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """df with each role named: an existing column of that name, else the first candidate found in any case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    for role, candidates in roles.items():
        if role in df.columns:
            continue
        found = next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
        if found is not None:
            df = df.withColumnRenamed(found, role)
        elif defaults and role in defaults:
            df = df.withColumn(role, F.lit(defaults[role]))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def per_minute(df: DataFrame, name: str) -> Column:
    """A per-minute feature, taken from its per-second form where only that is there."""
    have = [c for c, f in ((name, 1.0), (name.replace("_per_min", "_per_second"), 60.0)) if c in df.columns]
    return F.coalesce(*[F.col(c) * (1.0 if c == name else 60.0) for c in have]) if have else F.lit(None).cast("double")


def read_many(spark: SparkSession, path: str, fmt: str, schema: str, required: Sequence[str] = (), **options: str) -> DataFrame:
    """All files of a glob with their source; files in which a required column is null throughout are left out."""
    df = spark.read.format(fmt).options(**options).schema(schema).load(path).withColumn("source_file", F.col("_metadata.file_path"))
    if not required:
        return df
    good = df.groupBy("source_file").agg(*[F.count(c).alias(c) for c in required]).where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in required]))
    return df.join(good.select("source_file"), "source_file", "left_semi")


def union_sources(tables: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Tables of differing columns under each other, with the name of each."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in tables.items()])


def validated_metadata(df: DataFrame, key: str, interval: str, strict: bool = True) -> DataFrame:
    """Metadata with a positive numeric interval and unique keys; otherwise an error, or those rows dropped."""
    df = df.withColumn(interval, number(F.trim(F.col(interval).cast("string"))))
    good = F.col(key).isNotNull() & F.coalesce(F.col(interval) > 0, F.lit(False))
    if not strict:
        w = W.partitionBy(key).orderBy(interval)
        return df.where(good).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    bad = df.where(~good).limit(5).collect() or df.groupBy(key).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"metadata rows are not valid: {bad}")
    return df


def best_file(manifest: DataFrame, block: str, patterns: Sequence[str]) -> DataFrame:
    """Of each block's files (block, path) the one of the best pattern, then the least depth, then name."""
    rank = reduce(lambda acc, p: acc.when(F.col("path").rlike(p[1]), p[0]), list(enumerate(patterns))[1:], F.when(F.col("path").rlike(patterns[0]), 0))
    m = manifest.withColumns({"rank": rank, "depth": F.size(F.split("path", "/"))}).where("rank IS NOT NULL")
    return m.withColumn("_n", F.row_number().over(W.partitionBy(block).orderBy("rank", "depth", "path"))).where("_n = 1").drop("_n")


def completeness(expected: DataFrame, present: DataFrame, block: str) -> DataFrame:
    """Status of each block by its expected files (block, path): DONE, INCOMPLETE with the missing, or SKIPPED if none is there."""
    e = expected.join(present.select("path").distinct().withColumn("_p", F.lit(1)), "path", "left")
    g = e.groupBy(block).agg(F.count("*").alias("expected"), F.count("_p").alias("present"), F.array_sort(F.collect_list(F.when(F.col("_p").isNull(), F.col("path")))).alias("missing"))
    return g.withColumn("status", F.when(F.col("present") == F.col("expected"), "DONE").when(F.col("present") == 0, "SKIPPED").otherwise("INCOMPLETE"))


def pair_manifests(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images (key, path) with their mask of the same key, by the masks' priority; those without one keep a null."""
    m = masks.groupBy("key").agg(F.min_by("path", F.struct("priority", "path")).alias("mask_path"))
    return images.join(m, "key", "left")


def frame_intervals(times: DataFrame) -> DataFrame:
    """Seconds between frames of each block (block, t, acquired_at): mean, median, spread; not increasing is an error."""
    w = W.partitionBy("block").orderBy("t")
    at = F.unix_micros(F.col("acquired_at").cast("timestamp"))
    d = (at - F.lag(at).over(w)) / 1e6
    s = times.withColumn("d", d)
    s = s.withColumn("d", F.when(F.col("d") <= 0, F.raise_error(F.lit("frame times must increase"))).otherwise(F.col("d")))
    return s.groupBy("block").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_samp("d").alias("sd"), F.min("d").alias("min"), F.max("d").alias("max"))


def pixel_sizes(blocks: DataFrame, overrides: DataFrame, known: DataFrame, default: float) -> DataFrame:
    """Pixel size of each block: its override, else the known one, else the default."""
    o = overrides.select("block", F.col("xy_um").alias("_o"))
    k = known.select("block", F.col("xy_um").alias("_k"))
    return blocks.select("block").join(o, "block", "left").join(k, "block", "left").select("block", F.coalesce("_o", "_k", F.lit(default)).alias("xy_um"))


def split_files(files: DataFrame, shares: tuple[float, float], seed: int, old: DataFrame | None = None) -> DataFrame:
    """(path, part): train, validation and test by a hash order of paths, without a random generator.

    Paths of old (path, part) keep their part; only the others are dealt, among themselves.
    """
    new = files.select("path").distinct()
    new = new if old is None else new.join(old.select("path"), "path", "left_anti")
    new = new.withColumn("_h", F.concat(F.md5(F.concat_ws(":", "path", F.lit(seed))), F.col("path")))
    new = running(new, [], "_h", {"k": (F.sum, F.lit(1))})
    n = new.count()
    part = F.when(F.col("k") <= round(n * shares[0]), "train").when(F.col("k") <= round(n * (shares[0] + shares[1])), "validation").otherwise("test")
    found = new.select("path", part.alias("part"))
    return found if old is None else old.select("path", "part").unionAll(found)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes a table unless it is empty; Spark commits the files at the end."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
