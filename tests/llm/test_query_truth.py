"""Queries without SQL against libraries, plain Python and held-out labels on given tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tracklore.llm import queries as Q
from tracklore.llm.bpe import load_ranks

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def held_out(spark, query, name, parts, rest):
    found = query(spark, MIDDLE).toPandas()
    assert found.score.between(0, 1).all() and len(found) == len(texts(spark, MIDDLE))
    assert (found.held_out == [zlib.crc32(str(d).encode()) % parts == rest for d in found.doc_id]).all()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas().dropna(subset=[name])
    own = found[found.held_out].merge(labels, on="doc_id")
    assert len(own) > 50 and 0 < own[name].mean() < 1
    return (own.predicted == own[name]).mean()


def test_quality_is_told_on_held_out_rows(spark):
    assert held_out(spark, Q.op1_quality, "quality", 3, 1) >= 0.97


def test_toxicity_is_told_on_held_out_rows(spark):
    assert held_out(spark, Q.op10_toxicity, "toxic", 5, 0) >= 0.95


def test_ids_and_texts_come_back(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(load_ranks(path))}, special_tokens={})
    got = {r.doc_id: r for r in Q.op5_byte_bpe(spark, SMALL).collect()}
    for d, t in texts(spark, SMALL).items():
        ids = library.encode_ordinary(t)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_packing_is_the_librarys_ids_in_full_sequences(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = Q.op4_best_fit_packing(spark, SMALL).toPandas()
    for d, t in texts(spark, SMALL).items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == d].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
        assert (own.length.iloc[1:] == 1024).all()
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 1024) + 2


def test_language_of_pages(spark):
    found = Q.op3_language_id(spark, MIDDLE).toPandas()
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").toPandas()
    assert len(found) == len(pages) and found.accepted.mean() > 0.9
    declared = dict(zip(pages.page_id, pages.html.fillna("").str.extract(r"(?i)<html[^>]*lang=[\"\']?([a-z]{2})", expand=False), strict=True))
    known = [(declared[p], x) for p, x, a in zip(found.page_id, found.lang, found.accepted, strict=True) if a and isinstance(declared[p], str)]
    assert np.mean([a == b for a, b in known]) > 0.8
