"""Periodic runs of words: blocks at dyadic scales, met with what follows them by exact convolution, seed maximal runs."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import empty_safe

#: Primes with a generator each, whose fields have roots of unity of order 2^27 and more.
PRIMES = ((2_013_265_921, 31), (2_281_701_377, 3), (3_221_225_473, 5))
#: Numbers of a matrix that is transformed at once; a longer row is transformed alone.
POINTS = 1 << 18
#: Blocks of the first scale, which serves periods 1 to 6; a scale of blocks of n words serves periods 2n - 1 to 4n - 2.
FIRST = 2

RUNS = "array<struct<start:long,length:long,period:long>>"
_U = np.uint64


class Field:
    """Residues of a prime below 2^32 in 64-bit words, and their transform."""

    def __init__(self, prime: int, generator: int):
        self.p, self.g = prime, generator

    @functools.lru_cache(maxsize=64)  # noqa: B019
    def roots(self, half: int, back: bool) -> np.ndarray:
        """The first half powers of a root of unity of order 2 * half, or of its inverse."""
        root = pow(self.g, (self.p - 1) // (2 * half), self.p)
        root = pow(root, -1, self.p) if back else root
        out = np.ones(1, _U)
        while len(out) < half:
            out = np.concatenate((out, out * _U(pow(root, len(out), self.p)) % _U(self.p)))
        return out

    def _reduced(self, x: np.ndarray) -> np.ndarray:
        return np.where(x >= self.p, x - _U(self.p), x)

    def forward(self, a: np.ndarray) -> np.ndarray:
        """Transform of each row, whose length is a power of two, in bit-reversed order."""
        rows, size = a.shape
        half = size // 2
        while half:
            pairs = a.reshape(rows, -1, 2, half)
            u, v = pairs[:, :, 0], pairs[:, :, 1]
            low = self._reduced(u + v)
            high = self._reduced(u + (_U(self.p) - v)) * self.roots(half, False) % _U(self.p)
            a = np.stack((low, high), axis=2).reshape(rows, size)
            half //= 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        """What forward made a of."""
        rows, size = a.shape
        half = 1
        while half < size:
            pairs = a.reshape(rows, -1, 2, half)
            u, v = pairs[:, :, 0], pairs[:, :, 1] * self.roots(half, True) % _U(self.p)
            a = np.stack((self._reduced(u + v), self._reduced(u + (_U(self.p) - v))), axis=2).reshape(rows, size)
            half *= 2
        return a * _U(pow(size, -1, self.p)) % _U(self.p)

    def differences(self, block: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For each row, sums of squared differences of the block and of what stands at each shift in after, modulo p."""
        rows, n = block.shape
        shifts = after.shape[1] - n + 1
        size = 1 << (after.shape[1] - 1).bit_length()
        b, x = block.astype(_U) % _U(self.p), after.astype(_U) % _U(self.p)
        left, right = np.zeros((rows, size), _U), np.zeros((rows, size), _U)
        left[:, :n] = b[:, ::-1]
        right[:, : x.shape[1]] = x
        both = self.backward(self.forward(left) * self.forward(right) % _U(self.p))[:, n - 1 : n - 1 + shifts]
        up = np.zeros((rows, x.shape[1] + 1), _U)
        np.cumsum(x * x % _U(self.p), axis=1, out=up[:, 1:])
        squares = (b * b % _U(self.p)).sum(axis=1)[:, None] + up[:, n:] - up[:, :-n]
        return (squares % _U(self.p) + _U(2) * (_U(self.p) - both)) % _U(self.p)


_FIELDS = tuple(Field(*x) for x in PRIMES)


def zeros(values: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of each block values[start : start + size] that stands again distance further, low to high.

    A sum of squared differences is nothing where its residues are, modulo as many primes as its bound needs. Past the
    end of values stands what no block has.
    """
    most = int(values.max()) + 1
    fields, product = [], 1
    for field in _FIELDS:
        if not fields or product <= most * most * size:
            fields.append(field)
            product *= field.p
    if product <= most * most * size:
        raise ValueError("a text is too long for exact sums")
    padded = np.concatenate((values, np.full(high + size, most, np.int64)))
    at, after = np.arange(size), np.arange(low, high + size)
    found = []
    step = max(1, POINTS // (4 * size))
    for k in range(0, len(starts), step):
        own = starts[k : k + step]
        rows, shifts = np.nonzero(fields[0].differences(padded[own[:, None] + at], padded[own[:, None] + after]) == 0)
        for field in fields[1:]:
            some = np.unique(rows)
            if len(some):
                left = field.differences(padded[own[some, None] + at], padded[own[some, None] + after])
                fine = left[np.searchsorted(some, rows), shifts] == 0
                rows, shifts = rows[fine], shifts[fine]
        found.append((own[rows], shifts + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Recurrence:
    """Where each word stands again."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.key = values * n
        order = np.argsort(values, kind="stable")
        self.sorted = self.key[order] + order
        last = np.append(np.flatnonzero(np.diff(values[order])), n - 1) if n else np.zeros(0, np.int64)
        self.last = order[last][values] if n else order

    def within(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word at each place stands again from low to high further."""
        found = np.searchsorted(self.sorted, self.key[at] + np.minimum(at + low, len(self.key)))
        there = self.sorted[np.minimum(found, len(self.key) - 1)]
        return (found < len(self.key)) & (there - self.key[at] <= np.minimum(at + high, len(self.key) - 1))


def _blocks(seen: Recurrence, size: int, low: int, high: int, reach: np.ndarray) -> np.ndarray:
    """Starts of the blocks at multiples of size all of whose words recur at these distances.

    Without those that lie, with all that follows at these distances, in one run whose period is at most size: there
    they recur at multiples of the period only.
    """
    n = len(seen.key)
    later = (seen.last - np.arange(n) >= low)[: n - n % size].reshape(-1, size)
    starts = np.flatnonzero(later.all(axis=1)) * size
    starts = starts[reach[starts] < starts + size + high]
    for k in (0, size - 1):
        starts = starts[seen.within(starts + k, low, high)]
    rest = np.arange(1, size - 1)
    step = max(1, POINTS // size)
    return np.concatenate([own[seen.within((own[:, None] + rest).ravel(), low, high).reshape(len(own), size - 2).all(axis=1)] for own in np.split(starts, range(step, len(starts), step))])


def _implied(starts: np.ndarray, gaps: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a block and its recurrence lie in one known run whose period divides their distance."""
    out = np.zeros(len(starts), bool)
    order = np.argsort(starts, kind="stable")
    places = starts[order]
    for s, e, q in runs if len(starts) else ():
        own = order[np.searchsorted(places, s) : np.searchsorted(places, e)]
        if len(own):
            out[own] |= (gaps[own] % q == 0) & (starts[own] + size + gaps[own] <= e)
    return out


def _extended(values: np.ndarray, starts: np.ndarray, gaps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, gap) of the longest stretches around the blocks in which each word is the one gap further.

    Blocks side by side are one stretch, which on either side ends within the next block.
    """
    order = np.lexsort((starts, gaps))
    starts, gaps = starts[order], gaps[order]
    new = np.concatenate(([True], (gaps[1:] != gaps[:-1]) | (starts[1:] != starts[:-1] + size)))[: len(starts)]
    first = np.flatnonzero(new)
    begin, gap = starts[first], gaps[first]
    end = starts[np.append(first[1:], len(starts))[: len(first)] - 1] + size
    n, step = len(values), max(1, POINTS // size)
    for k in range(0, len(begin), step):
        own = slice(k, k + step)
        for places, by in ((begin, -1), (end, 1)):
            at = places[own, None] + (np.arange(-1, -size - 1, -1) if by < 0 else np.arange(size))
            to = at + gap[own, None]
            same = (at >= 0) & (to < n)
            same[same] = values[at[same]] == values[to[same]]
            far = np.where(same.all(axis=1), size, same.argmin(axis=1))
            places[own] += by * far
    return begin, end, gap


def word_runs(values: np.ndarray, longest: int, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs of values: stretches of smallest period q of at least 2q and least values.

    longest bounds a run. A run of period q has q values or more, and least - q or more, that stand again q further, so
    at the scale that serves q one whole block is among them; where blocks recur, stretches are extended to the maximum.
    A stretch that has a smaller period, too, is the run of that period.
    """
    if least < 5:
        raise ValueError("a run has at least 5 words")
    runs: list[tuple[int, int, int]] = []
    if not len(values):
        return runs
    seen, reach, pending = Recurrence(values), np.zeros(len(values), np.int64), 0
    size, low = FIRST, 1
    while 2 * low <= longest:
        high = 4 * size - 2
        for s, e, q in runs[pending:]:
            np.maximum(reach[s:e], e if q <= size else 0, out=reach[s:e])
        pending = next((k for k in range(pending, len(runs)) if runs[k][2] > size), len(runs))
        starts = _blocks(seen, size, low, high, reach)
        if len(starts):
            starts, gaps = zeros(values, starts, size, low, high)
            fresh = ~_implied(starts, gaps, size, runs)
            begin, end, gap = _extended(values, starts[fresh], gaps[fresh], size)
            fine = end - begin >= np.maximum(least - gap, gap)
            begin, end, gap = begin[fine], (end + gap)[fine], gap[fine]
            order = np.lexsort((gap, end, begin))
            begin, end, gap = begin[order], end[order], gap[order]
            once = np.concatenate(([True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])))[: len(begin)]
            runs += sorted(zip(begin[once].tolist(), end[once].tolist(), gap[once].tolist(), strict=True), key=lambda r: r[2])
        size, low = 2 * size, 4 * size - 1
    return runs


def _found(least: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            for a, b, _, _ in tk.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = [(t or b"").split() for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                counts = np.array([len(t) for t in texts])
                of = np.concatenate(([0], np.cumsum(counts)))
                codes = pa.array(itertools.chain.from_iterable(texts), pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                _, values = np.unique(np.repeat(np.arange(len(texts)), counts) * (of[-1] + 1) + codes, return_inverse=True)
                own: list[list[dict]] = [[] for _ in texts]
                over = np.zeros(of[-1] + 1, np.int64)
                for s, e, q in sorted(word_runs(values, int(counts.max()), least)):
                    k = int(np.searchsorted(of, s, "right")) - 1
                    own[k].append({"start": s - int(of[k]), "length": e - s, "period": q})
                    over[s + q] += 1
                    over[e] -= 1
                kept = np.cumsum(over[:-1]) == 0
                left = [b" ".join(itertools.compress(t, kept[i:j].tolist())) for t, i, j in zip(texts, of[:-1].tolist(), of[1:].tolist(), strict=True)]
                left = [x.decode() if whole else hashlib.sha256(x).hexdigest() for x in left]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "collapsed" if whole else "collapsed_sha256": pa.array(left, pa.string()),
                    "runs": pa.array([sorted(r, key=lambda x: (x["start"], x["period"])) for r in own], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                })

    return run


def periodic_runs(docs: DataFrame, least: int = 12, whole: bool = True) -> DataFrame:
    """(doc_id, n_words, collapsed, runs) of each row of docs (doc_id, text): runs of words, and the text without repetitions.

    A run is a stretch of consecutive words of smallest period q, of at least 2q and least words, that no neighbouring
    word extends; runs are in the order of start and period. collapsed has the words that no run contains after its
    first q words, joined by one space; with whole=False its digest, collapsed_sha256, is given instead. All runs of
    whole texts are found, in one pass without a shuffle. Null and empty texts have no words and no runs; a null doc_id
    stays null; rows that repeat stay; other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_found(least, whole), f"doc_id long, n_words long, {'collapsed' if whole else 'collapsed_sha256'} string, runs {RUNS}")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs, of which one row in ten by the checksum of its id has a tail that repeats one stretch of its words.

    A text of n words, with checksum h and g = h // 10, then repeats from word g % n on with period
    1 + (n - g % n) // (3 + g % 8). Rows without a word or an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def tail(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)))[0]
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(once, F.col("text"))).otherwise(F.col("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what periodic_runs gave.

    start to exponent_milli are those of the longest run, of ties the first, then the one of the smallest period; null
    without a run.
    """
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, x: F.when(a.isNull() | (x["length"] > a["length"]), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
