"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import Scratch, cut
from tracklore.llm.jaccard import jaccard_groups
from tracklore.llm.language import document_fields, language_id
from tracklore.llm.packing import pack_documents
from tracklore.llm.quality_rules import cleaned
from tracklore.llm.substring import without_repeats

ORACLE_SQL = None


ROW = "_row_of_stage"


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, from its content: rows that differ in id, text, language or source differ in it."""
    own = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    return docs.withColumn(ROW, F.xxhash64(*own, *[c.isNull() for c in own]))


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number is in kept."""
    return rows.join(kept.select(ROW).distinct().hint("shuffle_hash"), ROW, "left_semi")


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text, declared language and source together speak for one language, and whose text agrees.

    Decided by the fused posterior. Null and empty texts, and those without letters, go; null ids, languages and sources
    are no reason to go; rows that repeat have one verdict; extra columns stay; no rows give no rows.
    """
    rows = _rows(docs)
    found = language_id(document_fields(rows.withColumn("doc_id", F.col(ROW))), docs.select("lang", "text"))
    return _keep(rows, found.where("accepted").select(F.col("id").alias(ROW))).drop(ROW)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, less the lines that are boilerplate in their source.

    Null and empty texts have no words and go; a null source is a source of its own kind, null ids stay null; rows that
    repeat have one verdict and stay; extra columns stay; no rows give no rows.
    """
    return _resized(cleaned(docs)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, nulls last.

    Texts without a word link with nothing and stay; rows with null ids, or with one id and several texts, are documents
    of their own; of rows that repeat one stays; extra columns stay, with those of any one of repeated rows; no rows
    give no rows.
    """
    rows = _rows(docs)
    groups = jaccard_groups(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id").distinct()
    ids = rows.groupBy(ROW).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))
    kept = cut(groups.join(ids.hint("merge"), ROW).groupBy("component_id").agg(F.min_by(F.struct(ROW, "copies"), order).alias("kept")).select("kept.*"))
    once = _keep(rows, kept.where("copies = 1"))
    return once.unionAll(_keep(rows, kept.where("copies > 1")).dropDuplicates([ROW])).drop(ROW)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that one with a smaller id has; those left without a word go.

    Null and empty texts go; rows with null ids neither lose nor cost words; rows of one id cost each other nothing;
    texts of any length are read whole; extra columns stay; no rows give no rows.
    """
    return _resized(without_repeats(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 tokens.

    Null and empty texts are the end token alone; longer ones than a sequence are cut; null ids stay null; rows that
    repeat are packed each; other columns are left out; no rows give no rows.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", languages), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeats), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
