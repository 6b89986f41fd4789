"""What may repeat without bound: rows of one labelled id, values of lang, pieces that are alike, labels of one kind."""

from pyspark.sql import functions as F

from tracklore.llm.language import LANGUAGE_SHARE, profiles
from tracklore.llm.packing import pack_documents
from tracklore.llm.quality_model import quality_scores
from tracklore.llm.toxicity import toxicity

from public_tokenizers import path


def test_scores_of_one_kind_of_labels_are_that_kind(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(60)], "doc_id long, text string")
    for label in (0, 1):
        got = quality_scores(docs, docs.select("doc_id", F.lit(label).alias("quality"))).select("score", "predicted").distinct().collect()
        assert [tuple(r) for r in got] == [(float(label), label)]
    assert {r.score for r in quality_scores(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality"))).collect()} == {1.0}


def test_an_id_that_half_of_all_rows_have_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(k, "you are a total scum" if k % 2 else "a quiet day by the sea") for k in range(40)], "doc_id long, text string")
    hot = docs.unionAll(spark.range(20_000).select(F.lit(1).cast("long"), F.lit("you are a total scum")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    once = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    again = {r.doc_id: r.score for r in toxicity(hot, labels).distinct().collect()}
    assert once == again


def test_values_of_lang_that_hardly_any_row_has_are_no_languages(spark):
    plain = spark.range(3 * LANGUAGE_SHARE).select(F.when(F.col("id") % 2 == 0, "xa").otherwise("xb").alias("lang"), F.concat(F.lit("text of number "), F.col("id")).alias("text"))
    odd = spark.range(2 * LANGUAGE_SHARE).select(F.concat(F.lit("odd"), F.col("id")).alias("lang"), F.lit("text").alias("text"))
    names, table = profiles(plain.unionAll(odd))
    assert names == ["xa", "xb"] and len(table) == 2


def test_profiles_do_not_depend_on_the_order_of_rows_or_on_copies(spark):
    rows = spark.range(9000).select(F.lit("xa").alias("lang"), F.concat(F.lit("text of number "), F.col("id")).alias("text"))
    copies = spark.range(5000).select(F.lit("xa").alias("lang"), F.lit("text of number 5").alias("text"))
    one, two = profiles(rows)[1], profiles(rows.unionAll(copies).repartition(7))[1]
    assert (one == two).all()


def test_rows_that_are_alike_are_packed_in_many_groups(spark, monkeypatch):
    from tracklore.llm import packing

    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 2)
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"))
    got = pack_documents(docs, path("byte_bpe_50k.json"), capacity=64)
    assert got.count() == 3000 and got.select(F.shiftright("sequence_id", 32)).distinct().count() > 20
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 64 OR n <> end").count() == 0
