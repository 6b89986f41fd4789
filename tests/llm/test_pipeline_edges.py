"""Each stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, extra columns and no rows."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ENGLISH = "the old house near the river was sold to a family from the city because they wanted more room for the children and a garden".split()
GERMAN = "das alte haus am fluss wurde an eine familie aus der stadt verkauft weil sie mehr platz fuer die kinder und einen garten wollte".split()


def prose(words, k, n=70):
    return " ".join(words[(j * (k + 3) + j // 7 + k) % len(words)] + (f"{chr(97 + (j + k) % 26)}" if j % 2 else "") for j in range(n))


LONG = " ".join(f"{ENGLISH[j % 25]}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676 % 26)}" for j in range(40_000))
PASSAGE = " ".join(f"passage{j}" for j in range(60))
ROWS = [(k, prose(ENGLISH, k), "en", "a.com") for k in range(1, 9)] + [(k, prose(GERMAN, k), "de", "b.org") for k in range(11, 19)]
EDGES = [
    (None, prose(ENGLISH, 40), "en", "a.com"), (None, prose(ENGLISH, 41), None, None), (21, None, "en", "a.com"), (22, "", "en", None), (23, " \n\t ", "de", "b.org"), (24, LONG, "en", "a.com"),
    (25, prose(ENGLISH, 50), "en", "a.com"), (25, prose(GERMAN, 51), "de", "b.org"), (26, prose(ENGLISH, 52), "en", "a.com"), (26, prose(ENGLISH, 52), "en", "a.com"), (27, prose(ENGLISH, 52), "en", "a.com"), (28, "12 34 56 !!", "en", "a.com"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"accepted": F.lit(True), "kept": F.lit("x"), "spans": F.lit(1), "copy": F.lit("c"), "row": F.lit(2), "id": F.lit("i"), "component_id": F.lit(3)}
    return spark.createDataFrame(ROWS + EDGES, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumns(extra)


def found(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", range(5))
def test_no_rows(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), "")
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_languages(spark, docs):
    out = corpus_pipeline.languages(spark, docs, "")
    assert out.columns == docs.columns
    have = [(d, t) for d, t, _, _ in ROWS + EDGES if t and t.strip() and d != 28]
    assert found(out) == sorted(have, key=repr)


def test_rules(spark, docs):
    out = corpus_pipeline.rules(spark, docs, "")
    assert out.columns == docs.columns
    got = found(out)
    assert {d for d, _ in got} <= {d for d, *_ in ROWS + EDGES} - {21, 22, 23, 28} and (24, LONG) in got
    assert sum(d == 26 for d, _ in got) == 2 and sum(d is None for d, _ in got) == 2
    assert out.where("n_chars <> length(text)").count() == 0


def test_near_duplicates(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    gone = [(26, prose(ENGLISH, 52)), (27, prose(ENGLISH, 52))]  # a repeated row once, and a copy
    want = [(d, t) for d, t, _, _ in ROWS + EDGES]
    for x in gone:
        want.remove(x)
    assert found(out) == sorted(want, key=repr)


def test_repeats(spark, docs):
    more = spark.createDataFrame([(25, "first " + PASSAGE, "en", "a"), (30, PASSAGE + " last", "en", "a"), (None, PASSAGE, "en", "a"), (31, PASSAGE, "en", "a")], SCHEMA)
    own = docs.select("doc_id", "text", "lang", "source").unionAll(more)
    out = corpus_pipeline.repeats(spark, own, "")
    assert out.columns == own.columns
    got = found(out)
    assert (30, "last") in got and (25, "first " + PASSAGE) in got and (None, PASSAGE) in got and (24, LONG) in got
    assert not {21, 22, 23, 31, 27} & {d for d, _ in got} and sum(d == 26 for d, _ in got) == 2 and sum(d == 25 for d, _ in got) == 3


def test_packing(spark, docs):
    out = corpus_pipeline.packing(spark, docs, "").toPandas()
    assert len(out[out.piece == 0]) == len(ROWS + EDGES) and out.groupby("sequence_id").length.sum().max() <= 1024
    assert out[out.doc_id == 24].length.sum() > 40_000 and out[out.doc_id == 22].length.tolist() == [1]
