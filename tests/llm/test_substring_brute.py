"""Substring dedup against plain Python: passages shared by many documents, in one batch and in many, and repeated ids."""

import random

import pytest

from tracklore.llm.substring import substring_dedup

LENGTH = 6


def brute(rows):
    """(doc_id, kept words) of each row, by sets of windows."""
    least = {}
    for doc, text in rows:
        words = (text or "").split()
        for k in range(len(words) - LENGTH + 1) if doc is not None else ():
            w = tuple(words[k : k + LENGTH])
            least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").split()
        gone = set()
        for k in range(len(words) - LENGTH + 1) if doc is not None else ():
            if least[tuple(words[k : k + LENGTH])] < doc:
                gone |= set(range(k, k + LENGTH))
        out.append((doc, " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("letters", [3, 12, 400])
def test_brute_force(spark, parts, letters):
    rng = random.Random(letters)
    word = lambda: f"w{rng.randrange(letters)}"
    common = " ".join(f"c{k}" for k in range(9))
    rows = [(k, " ".join([*(word() for _ in range(rng.randrange(20))), *([common] if k % 3 == 0 else []), *(word() for _ in range(rng.randrange(30)))])) for k in range(120)]
    rows += [(k, rows[k][1]) for k in range(5)]  # repeated rows
    rows += [(7, rows[60][1]), (7, rows[61][1] + " " + common), (None, rows[3][1]), (500, None), (501, ""), (502, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r.doc_id, r.kept) for r in substring_dedup(docs, length=LENGTH).collect()), key=repr)
    assert got == brute(rows)
