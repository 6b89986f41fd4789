"""Texts that the fused evidence does and does not accept."""

import codecs

import pytest

from tracklore.llm import language
from tracklore.llm.language import document_fields, language_id

corpus_pipeline = pytest.importorskip("corpus_pipeline")
EN = "the cat and the dog went to the house with bread "
DE = codecs.encode(EN, "rot13")
BOTH = "alpha gamma delta "
KNOWN = [("en", (EN + BOTH) * 20), ("de", (DE + BOTH) * 20)]
FIELDS = "doc_id long, text string, lang string, source string"


def test_fused_evidence_decides(spark, monkeypatch):
    monkeypatch.setattr(language, "CERTAIN", 0.9)
    hosts = [(100 + k, EN * 2, "en", "a.en") for k in range(30)] + [(200 + k, DE * 2, "de", "b.de") for k in range(30)]
    cases = [(1, EN, "en", "a.en"), (2, DE, "de", "b.de"), (3, EN, None, "c"), (8, DE, None, "e"), (4, "alpha", None, "d"), (5, "with", "de", "b.de"), (6, "alpha", "de", "b.de")]
    rows = spark.createDataFrame(hosts + cases, FIELDS)
    got = {r.id: r for r in language_id(document_fields(rows), spark.createDataFrame(KNOWN, "lang string, text string")).collect()}
    assert all(got[d].accepted for d, *_ in hosts) and [got[k].accepted for k in (1, 2, 3, 8)] == [True] * 4
    assert got[4].probability < 0.9 and not got[4].accepted  # too uncertain
    assert (got[5].lang, got[5].text_lang) == ("de", "en") and not got[5].accepted  # the text speaks against the rest


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = docs.count(), corpus_pipeline.languages(spark, docs, "").count()
    assert 0.98 * before <= after <= before
