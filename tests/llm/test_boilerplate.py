"""Lines that a source repeats: they go from the texts that the rules keep."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tracklore.llm.common import Scratch
from tracklore.llm.quality_rules import boilerplate, quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def body(k):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def test_lines_go_from_kept_texts(spark):
    rows = [(k, f"{body(k)}\n\nHome  about {k % 10}\nlast {body(k)[::-1]}", "host") for k in range(60)] + [(k, f"{body(k)}\nHome about 1\nend", "other") for k in range(60, 62)]
    rows += [(70, body(70), "host"), (70, f"{body(71)}\nhome about 3", "host"), (71, None, "host")]
    docs = table(spark, rows)
    want = {(d, "\n".join(x for x in t.split("\n") if s != "host" or not x.lower().startswith("home")), s) for d, t, s in rows if t}
    out = corpus_pipeline.rules(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.source) for r in out.collect()} == want
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    whole = quality_rules(docs, whole=True).where("kept").select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in whole} == {x[:2] for x in want}


def test_small_hosts_have_boilerplate(spark):
    rows = [(k, f"{body(k)}\n{'nav home' if k < 3 else 'pair' if k < 5 else 'own line'[: k - 4]}", "small") for k in range(9)]
    out = {r.doc_id: r.text for r in corpus_pipeline.rules(spark, table(spark, rows), "").collect()}
    assert out == {d: body(d) if d < 3 else t for d, t, _ in rows}


def test_many_texts_of_a_large_host(spark):
    name = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    text = F.concat(name, F.when(F.col("id") < 10_000, "\nmany").when(F.col("id") < 19_999, "\nfewer").otherwise(""))
    docs = spark.range(110_000).select(F.lit("h").alias("host"), F.col("id").alias("text_key"), text.alias("text"))
    with Scratch(spark) as scratch:
        found = boilerplate(docs, scratch)
        assert found.count() == 10_000 and found.where("size(lines) = 1 AND boilerplate_words = 1").count() == 10_000


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    key = lambda x: re.sub("[0-9]", "0", re.sub(r"[ \t-\r]+", " ", x.lower())).strip(" ")
    have, n = collections.Counter(), collections.Counter(s for s, _ in {(s, t) for _, t, s in rows})
    for s, t in {(s, t) for _, t, s in rows}:
        have.update((s, x) for x in {key(x) for x in t.split("\n")} if x)
    above = {(s, x) for (s, x), k in have.items() if k >= 3 and k > 0.1 * n[s]}
    want = {d: "\n".join(x for x in t.split("\n") if (s, key(x)) not in above) for d, t, s in rows}
    out = {r.doc_id: r.text for r in corpus_pipeline.rules(spark, docs, "").collect()}
    assert above and len(out) > 500 and all(want[d] == t for d, t in out.items())
    assert sum(t != x for d, t, _ in rows for x in [out.get(d, t)]) >= 50
