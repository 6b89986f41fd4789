"""Each text operator on a small table with nulls, empty and long texts, repeats, ties and clashing columns, and on none."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracklore.llm.bpe import bpe_round_trip, load_ranks
from tracklore.llm.hnsw import near_vectors
from tracklore.llm.jaccard import jaccard_groups
from tracklore.llm.language import document_fields, language_id, page_fields
from tracklore.llm.packing import pack_documents
from tracklore.llm.quality_model import quality_scores
from tracklore.llm.quality_rules import quality_rules
from tracklore.llm.sharding import shard
from tracklore.llm.substring import substring_dedup
from tracklore.llm.toxicity import toxicity

WORDS = [f"w{k % 97}x{k % 31}" for k in range(400)]
BASE = " ".join(WORDS[:200])
NEAR = " ".join(WORDS[:190] + ["other"] * 5)
LONG = " ".join(f"long{k}" for k in range(30_000))
ROWS = [
    (1, BASE, "en", "a.com", 1), (2, NEAR, "en", "a.com", 2), (3, BASE, None, None, 3), (3, BASE, None, None, 3), (None, BASE, "en", "a.com", 4), (5, None, "en", "b.org", 5), (6, "", "de", "b.org", 6),
    (7, "one two", "de", "b.org", 7), (8, "ONE Two", "de", "b.org", 8), (9, LONG, "fr", "c", 9), (10, " ".join(WORDS[100:400]), "fr", "c", 10), (11, " \n\t ", "en", "a.com", 11), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"component_id": F.lit(1), "score": F.lit("x"), "shard": F.lit(2), "kept": F.lit(None), "h": F.lit(0)}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_jaccard(docs, none):
    rows = jaccard_groups(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[k].component_id for k in (1, 2, 3, 5, 6, 7, 8, 9, 11)] == [1, 1, 1, 5, 6, 7, 7, 9, 11]
    assert got[5].n_shingles == got[6].n_shingles == got[11].n_shingles == 0 and got[7].n_shingles == 1
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_groups(none).count() == 0


def test_substring(docs, none):
    got = by_id(substring_dedup(docs))
    words = {r[0]: (r[1] or "").split() for r in ROWS}
    first = {}
    for d in sorted(k for k in words if k is not None):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    for d in (1, 2, 3, 5, 6, 7, 9, 10, 11):
        gone = {j for i in range(len(words[d]) - 49) if first[tuple(words[d][i : i + 50])] < d for j in range(i, i + 50)}
        assert got[d].n_words == len(words[d]) and got[d].n_removed == len(gone)
        assert got[d].kept == " ".join(w for j, w in enumerate(words[d]) if j not in gone)
    digests = by_id(substring_dedup(docs, whole=False))
    assert digests[2].kept_sha256 == hashlib.sha256(got[2].kept.encode()).hexdigest()
    assert substring_dedup(docs).count() == len(ROWS) and substring_dedup(none).count() == 0


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(load_ranks(path))}, special_tokens={})
    rows = bpe_round_trip(docs, path).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.n_tokens, r.decoded) for r in rows) == sorted((len(own.encode_ordinary(r[1] or "")), r[1] or "") for r in ROWS)
    assert bpe_round_trip(none, path).count() == 0


def test_packing(docs, none):
    path = P.path("byte_bpe_50k.json")
    rows = pack_documents(docs, path, capacity=64).toPandas()
    assert rows.length.max() <= 64 and rows.length.min() >= 1
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    one = rows[rows.doc_id == 5]
    assert one.length.tolist() == [1] and one.ids_crc32.tolist() == [zlib.crc32(np.array([2], "<u4").tobytes())]
    long = rows[rows.doc_id == 9].sort_values("piece")
    assert (long.length[1:] == 64).all() and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    assert pack_documents(none, path).count() == 0


def test_quality_rules(docs, none):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].kept and got[9].kept and not got[5].kept and not got[6].kept and got[5].n_words == 0
    assert got[7].n_words == 2 and got[7].word_chars == 6 and got[7].base_failed
    spam = docs.sparkSession.createDataFrame([(1, "#a b\n#a b\n\n#a b", "s"), (2, "a b c a b c", "s")], "doc_id long, text string, source string")
    one = by_id(quality_rules(spam))
    assert (one[1].n_symbols, one[1].n_dup_lines, one[1].n_repeat_words) == (3, 2, 6) and one[2].n_repeat_words == 6
    assert quality_rules(none).count() == 0


def test_boilerplate_lines(spark):
    body, menu = " ".join(WORDS[:60]), " ".join(f"m{k}" for k in range(80))
    own = lambda k: f"{body} {chr(97 + k % 26)}{chr(97 + k // 26)}"  # noqa: E731  a line of its own, without digits, as those are alike
    rows = [(k, f"{own(k)}\nnav home about {menu}", "host") for k in range(60)] + [(k, f"{own(k)} end", "host") for k in range(60, 120)]
    got = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not got[0].kept and got[0].boilerplate_words == 83 and got[100].kept and not got[0].base_failed
    copies = spark.createDataFrame([(k, f"{body}\n{body} end", "host") for k in range(200)], "doc_id long, text string, source string")
    assert quality_rules(copies).where("boilerplate_words > 0").count() == 0


def test_sharding(docs, none):
    many = docs.select("doc_id", "text").unionAll(docs.sparkSession.range(100, 3000).select("id", F.concat(F.lit("text "), (F.col("id") % 700).cast("string"))))
    rows = shard(many, 5).toPandas()
    assert len(rows) == many.count() and (rows["size"] >= 8).all()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    hot = docs.sparkSession.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    size = shard(hot, 6).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(size) == 6 and size.max() - size.min() <= 0.02 * size.mean()
    assert shard(none, 5).count() == 0


def test_vectors(spark):
    v = lambda *x: [float(k) for k in x]
    rows = [(1, v(1, 0, 0), 1), (2, v(2, 0, 0), 1), (3, v(1, 0, 0), 1), (4, v(1, 0, 0), 2), (5, v(1, 0.05, 0), 1), (6, None, 1), (7, v(0, 0, 0), 1), (8, v(float("nan"), 0, 0), 1), (9, [1.0, None, 0.0], 1), (10, v(1, 0, 0), None), (11, v(1, 0), 1), (None, v(1, 0, 0), 1), (12, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    rows = near_vectors(df).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == 13
    assert [got[k].n_links for k in (1, 2, 3, 5)] == [3, 3, 3, 3]
    assert [got[k].component_id for k in (1, 2, 3, 4, 5, 6, 10, 11)] == [1, 1, 1, 4, 1, 6, 10, 11]
    assert all(got[k].n_links == 0 and got[k].kept for k in (4, 6, 7, 8, 9, 10, 11, 12))
    assert got[None].component_id is None
    assert near_vectors(df.limit(0)).count() == 0


def test_models(docs, none, spark):
    rows = [(k, ("fine words here and there " * 20 + str(k)) if k % 2 else ("### $$$ ||| " * 30 + f"you moronic {k}")) for k in range(100, 300)]
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k, _ in rows] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for found, name in ((quality_scores(every, labels), "quality"), (toxicity(every, labels), "toxic")):
        found = found.toPandas()
        assert len(found) == every.count() and found.score.between(0, 1).all() and found.predicted.isin([0, 1]).all()
        truth = found.merge(labels.toPandas().dropna(), on="doc_id")
        assert (truth.predicted == truth[name]).mean() > 0.97
        parts, rest = (3, 1) if name == "quality" else (5, 0)
        known = found.dropna(subset=["doc_id"])
        assert (known.held_out == [zlib.crc32(str(int(d)).encode()) % parts == rest for d in known.doc_id]).all()
    assert quality_scores(none, labels).count() == 0 and toxicity(none, labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).where("score = 1").count() == len(ROWS)
    assert toxicity(docs, labels.limit(0)).where("predicted = 0").count() == len(ROWS)


def test_language(spark, docs, none):
    known = spark.createDataFrame([("en", "the cat and the dog went to the house " * 5), ("de", "der hund und die katze gehen in das haus " * 5), (None, "x"), ("de", None)], "lang string, text string")
    rows = [(1, "the dog and the cat", "en", "a"), (2, "die katze und der hund", "de", "b"), (3, None, "de", "b"), (None, "12 ##", None, None), (4, "", None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = language_id(document_fields(df), known).collect()
    got = {r.id: r for r in out}
    assert len(out) == 5 and got[1].lang == "en" and got[2].lang == got[3].lang == "de"
    assert got[1].accepted and not got[3].accepted and not got[4].accepted and not got[None].accepted
    assert language_id(document_fields(docs), docs.select("lang", "text")).count() == len(ROWS)
    assert language_id(document_fields(none), known).count() == 0
    assert language_id(document_fields(df), known.limit(0)).where("lang IS NULL").count() == 5
    html = '<!DOCTYPE html><html lang="de"><head><style>p{}</style></head><body><p>Hund &amp; Katze</p><!-- x --></body></html>'
    page = page_fields(spark.createDataFrame([(1, "https://www.x.de/a?b", html), (2, None, None)], "page_id long, url string, html string")).orderBy("id").collect()
    assert (page[0].declared, page[0].host, page[0].suffix, page[0].text.split()) == ("de", "www.x.de", "de", ["Hund", "Katze"])
    assert page[1].text == "" and page[1].host == ""
