"""Sketches of paragraphs: differences against plain sets, edited texts against plain Python, edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.fingerprint import CELLS, Sets, Sketch, differ, differences, edited_and_next, fingerprints, paragraphs


def sets_of(texts):
    text, digest = paragraphs(*tk.text_bytes(pa.array(texts, pa.string())))
    return [set(digest[text == k].tolist()) for k in range(len(texts))]


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def version(text, after):
    part = len(text) // 4
    return text[: len(text) - part] + after[:part]


def texts_of(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"{'äb' if k % 3 else 'c'}{k}" for k in range(500)]
    out = []
    for _ in range(n):
        size = int(rng.choice([0, 1, 5, 40, 300]))
        out.append("".join(words[rng.integers(0, 500)] + rng.choice([" ", " ", "\n", "  "]) for _ in range(size)))
    return out


def test_paragraphs_of_plain_text():
    text = "one two\nthree\n\none two\n"
    found = sets_of([text, "one two", "three", "", " \n "])
    assert found[3] == found[4] == set()
    assert found[1] | found[2] <= found[0] and len(found[0]) == 2 * len(found[1]) + len(found[2])
    words, places = [f"w{k}" for k in range(400)], np.arange(400)
    h = tk.words(*tk.text_bytes(pa.array([" ".join(words)]))).hashes()
    cuts = [0, *(places[h % np.uint64(4) == 0] + 1).tolist(), 400]
    pieces = [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    assert len(sets_of([" ".join(words)])[0]) == len(pieces)
    assert set().union(*sets_of(pieces)) == sets_of([" ".join(words)])[0]


def test_sketch_gives_back_what_differs():
    rng = np.random.default_rng(2)
    kept, old, new = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (5000, 6, 4))
    a = Sketch.of(1, np.zeros(5006, np.int64), np.concatenate((kept, old)))
    b = Sketch.of(1, np.zeros(5004, np.int64), np.concatenate((new, kept)))
    _, digest, times, whole = a.less(b).peel()
    assert whole.all() and set(digest[times == 1]) == set(old) and set(digest[times == -1]) == set(new)
    many = Sketch.of(1, np.zeros(5006, np.int64), np.concatenate((kept, old)))
    assert not many.peel()[3].any()


def test_differences_are_those_of_sets():
    texts = texts_of(120)
    found = sets_of(texts)
    read = Sets.read(*tk.text_bytes(pa.array(texts)))
    a, b = np.arange(120), (np.arange(120) * 7 + 3) % 120
    d = differ(read, a, read, b)
    assert [likeness(found[i], found[j]) for i, j in zip(a, b, strict=True)] == d.near.tolist()
    for k in range(120):
        own = d.pair == k
        assert Counter(zip(d.digest[own].tolist(), d.times[own].tolist(), strict=True)) == Counter([(x, 1) for x in found[a[k]] - found[b[k]]] + [(x, -1) for x in found[b[k]] - found[a[k]]])
    assert d.cells.max() > CELLS


def check(rows, got):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) + [r for r in rows if r[0] is None]
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        r = got[doc_id]
        edited = version(text, after)
        own, new, following = sets_of([text, edited, after])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next, r.n_paragraphs) == (likeness(own, new), likeness(own, following), len(own))
        assert (r.fingerprint == r.edited_fingerprint) == (own == new)


def test_edited_and_next(spark):
    texts = texts_of(90, 5)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "\t\n"), (503, "日本語 テキスト は 四 つ"), (504, "äöü" * 40), (505, texts[40]), (None, "last of all, without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"after": F.lit(1), "near": F.lit("x"), "_range": F.lit(0)})
    for ranges in (1, 4, 150):
        got = edited_and_next(docs, ranges).collect()
        check(rows, {r.doc_id: r for r in got})
    assert len({r.fingerprint for r in got if r.doc_id in (500, 501, 502)}) == 1
    one = edited_and_next(docs.where("doc_id = 503"), 3).collect()
    check([r for r in rows if r[0] == 503], {r.doc_id: r for r in one})
    assert edited_and_next(docs.limit(0), 3).count() == 0


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "a b c d e f g h")] * 50 + [(2, "x y z w")]
    got = edited_and_next(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter((r.doc_id, r.near_next) for r in got) == {(1, 1.0): 49, (1, 0.0): 1, (2, 0.0): 1}


def test_one_exchange_carries_texts(spark, capsys):
    edited_and_next(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 3).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_general_forms(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d"), (None, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint == got[None].fingerprint and got[3].n_paragraphs == 0
    pairs = spark.createDataFrame([(1, "a b\nc d", "a b\nx y"), (2, None, ""), (None, "a", None)], "pair_id long, text string, other string").withColumn("near", F.lit(0))
    got = {r.pair_id: r for r in differences(pairs).collect()}
    one, two = sets_of(["a b\nc d", "a b\nx y"])
    assert {x % 2**64 for x in got[1].removed} == one - two and {x % 2**64 for x in got[1].added} == two - one
    assert got[2].near == 1.0 and got[None].near == 0.0 and len(got[None].removed) == 1
    assert differences(pairs.limit(0)).count() == fingerprints(docs.limit(0)).count() == 0
