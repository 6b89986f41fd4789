"""Runs of words against a brute-force version, sums of squared differences against plain ones, and edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm.periodic import PRIMES, Field, periodic_runs, run_digests, with_periodic_tails, word_runs, zeros


def brute(v, least):
    out = {}
    for q in range(1, len(v) // 2 + 1):
        j = 0
        while j + q < len(v):
            s = j
            while j + q < len(v) and v[j] == v[j + q]:
                j += 1
            if j > s and j - s + q >= max(least, 2 * q):
                out.setdefault((s, j + q), q)
            j += j == s
    return sorted((s, e, q) for (s, e), q in out.items())


@pytest.mark.parametrize("prime", PRIMES)
def test_sums_of_squared_differences(prime):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8):
        block, after = rng.integers(0, 10**6, (5, n)), rng.integers(0, 10**6, (5, 3 * n - 1))
        direct = [[sum((int(b) - int(x)) ** 2 for b, x in zip(block[r], after[r, s:], strict=False)) % prime[0] for s in range(2 * n)] for r in range(5)]
        assert Field(*prime).differences(block, after).tolist() == direct


def test_zeros_need_every_prime_of_the_bound():
    p = PRIMES[0][0]
    x = next(x for x in range(p - 2, 0, -1) if pow(p - (p - 1 - x) ** 2 % p, (p - 1) // 2, p) == 1)
    y = _root(p - (p - 1 - x) ** 2 % p, p)
    values = np.array([p - 1, 0, x, y], np.int64)
    assert (int((p - 1 - x) ** 2) + y * y) % p == 0
    starts, gaps = zeros(values, np.array([0]), 2, 1, 2)
    assert not len(starts) and not len(gaps)


def _root(a, p):
    """A square root of a modulo p, by Tonelli and Shanks."""
    q, s = p - 1, 0
    while q % 2 == 0:
        q, s = q // 2, s + 1
    c, r, t, m = pow(31, q, p), pow(a, (q + 1) // 2, p), pow(a, q, p), s
    while t != 1:
        i, u = 0, t
        while u != 1:
            u, i = u * u % p, i + 1
        b = pow(c, 1 << (m - i - 1), p)
        r, c, t, m = r * b % p, b * b % p, t * b * b % p, i
    return r


def test_runs_are_all_found():
    rng = random.Random(5)
    for _ in range(400):
        n, kinds = rng.randrange(1, 200), rng.choice([1, 2, 3, 30])
        v = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.7 and n > 20:
            a = rng.randrange(n - 10)
            p = 1 + (n - a) // rng.randrange(2, 9)
            v[a:] = [v[a + (i - a) % p] for i in range(a, n)]
        least = rng.choice([5, 8, 12])
        assert sorted(word_runs(np.unique(v, return_inverse=True)[1].astype(np.int64), n, least)) == brute(v, least)


def test_one_word_a_hundred_thousand_times_and_a_long_period():
    assert word_runs(np.zeros(100_000, np.int64), 100_000) == [(0, 100_000, 1)]
    assert word_runs(np.arange(100_000) % 40_000, 100_000) == [(0, 100_000, 40_000)]
    with pytest.raises(ValueError, match="at least 5"):
        word_runs(np.zeros(9, np.int64), 9, 4)


def test_documents(spark):
    again = " ".join(["a b c"] * 5)
    rows = [(1, again + " d"), (1, again + " d"), (2, "a a a a a a"), (3, None), (4, ""), (5, " \t\n"), (None, again), (6, "x y " * 7 + "z " + "x y " * 7), (7, "a\tb  c\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("x"), "collapsed": F.lit(None)})
    got = {(r.doc_id, r.n_words): r for r in periodic_runs(docs).collect()}
    assert periodic_runs(docs).count() == len(rows)
    assert [tuple(x) for x in got[1, 16].runs] == [(0, 15, 3)] and got[1, 16].collapsed == "a b c d"
    assert got[None, 15].collapsed == "a b c" and got[2, 6].runs == [] and got[2, 6].collapsed == "a a a a a a"
    assert all(got[k, 0].collapsed == "" and got[k, 0].runs == [] for k in (3, 4, 5))
    assert [tuple(x) for x in got[6, 29].runs] == [(0, 14, 2), (15, 14, 2)]
    assert got[7, 9].runs == [] and got[7, 9].collapsed == "a b c a b c a b c"
    digests = {r.doc_id: r for r in run_digests(periodic_runs(docs, whole=False)).collect()}
    assert digests[1].runs_sha256 == hashlib.sha256(b"0,15,3\n").hexdigest() and digests[1].exponent_milli == 5000
    assert digests[3].start is digests[3].period is None and digests[3].n_runs == 0
    assert digests[3].collapsed_sha256 == digests[3].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic_runs(docs.limit(0)).count() == 0


def test_tails(spark):
    import zlib

    rows = [(k, " ".join(f"w{(k * 7 + i) % 23}" for i in range(k % 60))) for k in range(400)] + [(None, "a b"), (11, None)]
    got = {(r.doc_id, r.text is None): r.text for r in with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if k is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
        assert got[k, text is None] == text
