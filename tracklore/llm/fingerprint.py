"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.bpe import _spread
from tracklore.llm.common import empty_safe

#: Tables of a sketch; each digest has one cell in each.
TABLES = 3
#: Cells of the smallest sketch, which is the fingerprint; a failed comparison is repeated with twice as many.
CELLS = 24
#: A paragraph ends with its line, and after one word in so many, as the words' hashes say.
WORDS_A_PARAGRAPH = 4
#: Cells that are peeled at once; a larger sketch is peeled alone.
AT_ONCE = 1 << 19
#: Doublings after which a comparison fails for good. Cells are chosen anew each time, so one in thousands gets past 2.
LEVELS = 40
#: Rows sampled for each range of rows, and at most; only their keys go to the driver.
SAMPLE, MOST_SAMPLED = 40, 1_000_000

_U = np.uint64
_CHECK = _U(0xA24BAED4963EE407)


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every paragraph of some texts, given as UTF-8 bytes with their offsets.

    Long lines are cut where the words themselves say, so that an edit changes the paragraphs around it only. The k-th
    of equal paragraphs of one text has a digest of its own.
    """
    w = tk.words(data, offsets)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = w.hashes()
    lines = np.cumsum(data == 10)
    ends = h % _U(WORDS_A_PARAGRAPH) == 0
    ends[:-1] |= lines[w.starts[1:]] != lines[w.ends[:-1] - 1]
    ends[w.of[1:][np.diff(w.of) > 0] - 1] = True
    end = np.flatnonzero(ends) + 1
    first = np.concatenate(([0], end[:-1]))
    text = np.searchsorted(w.of, first, "right") - 1
    digest = tk._ranges(h, first, end)
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])))
    copy = np.arange(len(digest)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return text, np.where(copy > 0, tk.mix(digest + tk.mix(copy.astype(_U))), digest)


def _cells(digest: np.ndarray, level: int) -> np.ndarray:
    """(TABLES, n): the cells of each digest."""
    each = (CELLS << level) // TABLES
    return np.stack([(tk.mix(digest ^ _U(0x9E3779B97F4A7C15 * (TABLES * level + t + 1) & 2**64 - 1)) % _U(each)).astype(np.int64) + t * each for t in range(TABLES)])


@dataclass
class Sketch:
    """Sketches of several sets of digests, a row each: counts, sums of digests and sums of their checks, by cell."""

    counts: np.ndarray
    digests: np.ndarray
    checks: np.ndarray
    level: int

    @staticmethod
    def empty(rows: int, level: int) -> Sketch:
        shape = (rows, CELLS << level)
        return Sketch(np.zeros(shape, np.int64), np.zeros(shape, _U), np.zeros(shape, _U), level)

    @staticmethod
    def of(rows: int, row: np.ndarray, digest: np.ndarray, level: int = 0) -> Sketch:
        out = Sketch.empty(rows, level)
        out.put(row, digest, np.ones(len(row), np.int64))
        return out

    def put(self, row: np.ndarray, digest: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Adds each digest so many times to its row; gives the cells changed, of all rows in one."""
        cells = _cells(digest, self.level) + row * self.counts.shape[1]
        check = tk.mix(digest + _CHECK)
        for at in cells:
            np.add.at(self.counts.ravel(), at, times)
            np.add.at(self.digests.ravel(), at, digest * times.astype(_U))
            np.add.at(self.checks.ravel(), at, check * times.astype(_U))
        return cells.ravel()

    def less(self, other: Sketch) -> Sketch:
        return Sketch(self.counts - other.counts, self.digests - other.digests, self.checks - other.checks, self.level)

    def take(self, rows: np.ndarray) -> Sketch:
        return Sketch(self.counts[rows], self.digests[rows], self.checks[rows], self.level)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, times, whole): digests of cells that hold one digest only, taken out until none does.

        times is 1 or -1; whole tells of each row whether nothing is left in it. The sketch is used up.
        """
        width = self.counts.shape[1]
        counts, digests, checks = self.counts.ravel(), self.digests.ravel(), self.checks.ravel()
        at = np.flatnonzero(np.abs(counts) == 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
        for _ in range(2 * width):
            times = counts[at]
            digest = digests[at] * times.astype(_U)
            pure = (np.abs(times) == 1) & (checks[at] * times.astype(_U) == tk.mix(digest + _CHECK))
            row, digest, times = at[pure] // width, digest[pure], times[pure]
            if not len(row):
                break
            order = np.lexsort((digest, row))
            row, digest, times = row[order], digest[order], times[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])))
            row, digest, times = row[new], digest[new], times[new]
            out.append((row, digest, times))
            at = np.unique(self.put(row, digest, -times))
        whole = ~((self.counts != 0) | (self.digests != 0) | (self.checks != 0)).any(axis=1)
        return *(np.concatenate(x) for x in zip(*out, strict=True)), whole

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each row as text: how many digests it has, then counts, sums and checks of its cells, little-endian."""
        rows = zip(sizes.astype("<u4"), self.counts.astype("<i4"), self.digests.astype("<u8"), self.checks.astype("<u8"), strict=True)
        return [base64.b64encode(b"".join(x.tobytes() for x in row)).decode() for row in rows]


@dataclass
class Sets:
    """Digests of several texts: of[k]:of[k + 1] are those of text k; first has the fingerprints."""

    digest: np.ndarray
    of: np.ndarray
    first: Sketch

    @staticmethod
    def read(data: np.ndarray, offsets: np.ndarray) -> Sets:
        text, digest = paragraphs(data, offsets)
        n = len(offsets) - 1
        return Sets(digest, np.searchsorted(text, np.arange(n + 1)), Sketch.of(n, text, digest))

    def sizes(self) -> np.ndarray:
        return np.diff(self.of)

    def sketch(self, texts: np.ndarray, level: int) -> Sketch:
        if level == 0:
            return self.first.take(texts)
        sizes = self.sizes()[texts]
        return Sketch.of(len(texts), np.repeat(np.arange(len(texts)), sizes), self.digest[_spread(self.of[texts], sizes)], level)


@dataclass
class Difference:
    """What pairs of texts have apart: likeness of each pair, cells that it took, and (pair, digest, times) of what differs."""

    near: np.ndarray
    cells: np.ndarray
    pair: np.ndarray
    digest: np.ndarray
    times: np.ndarray


def differ(a: Sets, own: np.ndarray, b: Sets, other: np.ndarray) -> Difference:
    """Texts own of a against texts other of b, pair by pair.

    Sketches of both, subtracted and peeled, give the digests that only one text has; a pair that leaves something is
    tried again with twice the cells, one whose sizes say that too little room is left begins with more. near is the
    share of paragraphs that both have among those that either has, 1 for two texts without a word.
    """
    n, m = a.sizes()[own], b.sizes()[other]
    near, cells = np.ones(len(own)), np.zeros(len(own), np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
    left = np.arange(len(own))
    for level in range(LEVELS):
        size = CELLS << level
        tried = left[np.abs(n - m)[left] < size]
        failed = [left[np.abs(n - m)[left] >= size]]
        step = max(1, AT_ONCE // size)
        for k in range(0, len(tried), step):
            at = tried[k : k + step]
            row, digest, times, whole = a.sketch(own[at], level).less(b.sketch(other[at], level)).peel()
            gone, new = (np.bincount(row[times == t], minlength=len(at)) for t in (1, -1))
            whole &= (gone <= n[at]) & (n[at] - gone == m[at] - new)
            both, either = (n[at] - gone)[whole], (m[at] + gone)[whole]
            near[at[whole]] = np.where(either > 0, both / np.maximum(either, 1), 1.0)
            cells[at[whole]] = size
            keep = whole[row]
            found.append((at[row[keep]], digest[keep], times[keep]))
            failed.append(at[~whole])
        left = np.concatenate(failed)
        if not len(left):
            return Difference(near, cells, *(np.concatenate(x) for x in zip(*found, strict=True)))
    raise RuntimeError("a difference did not decode")


def _edited(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, bytes, offsets) of texts own whose last quarter is the beginning of texts after."""
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(points, offsets)
    points = np.append(points, len(data))
    n = np.diff(first)
    part = n[own] // 4
    starts = np.stack((offsets[own], offsets[after]), axis=1)
    ends = np.stack((points[first[own] + n[own] - part], points[first[after] + np.minimum(part, n[after])]), axis=1)
    sizes = np.maximum(ends - starts, 0)
    out = data[_spread(starts.ravel(), sizes.ravel())]
    return n[own], out, np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"


def _versions(ids: pa.Array, texts: pa.Array, own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    data, offsets = tk.text_bytes(texts)
    data, offsets = data[offsets[0] :], offsets - offsets[0]
    n_chars, new, new_offsets = _edited(data, offsets, own, after)
    old, edited = Sets.read(data, offsets), Sets.read(new, new_offsets)
    fingerprints = old.first.take(own).texts(old.sizes()[own])
    digests = [hashlib.sha256(new[a:b]).hexdigest() for a, b in zip(new_offsets[:-1].tolist(), new_offsets[1:].tolist(), strict=True)]
    columns = [pa.array(n_chars, pa.int64()), pa.array(digests), pa.array(fingerprints), pa.array(edited.first.texts(edited.sizes()))]
    near = [pa.array(differ(old, own, *x).near) for x in ((edited, np.arange(len(own))), (old, after))]
    return pa.RecordBatch.from_arrays([ids, *columns, *near, pa.array(old.sizes()[own], pa.int64())], names=[c.split()[0] for c in RESULT.split(", ")])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a range, with the row that follows it: last comes the first row of the next range, marked as ahead."""
    ids, texts, ahead = pa.array([], pa.int64()), pa.array([], pa.large_string()), True
    for batch in empty_safe(batches):
        ids = pa.concat_arrays([ids, batch.column("doc_id")])
        texts = pa.concat_arrays([texts, batch.column("text").cast(pa.large_string())])
        for a, b, _, _ in tk.slices(texts):
            b = min(b, len(texts) - 1)
            if a < b:
                yield _versions(ids.slice(a, b - a), texts.slice(a, b - a + 1), np.arange(b - a), np.arange(1, b - a + 1))
        ids, texts = (pa.array(x.slice(len(x) - 1).to_pylist(), x.type) for x in (ids, texts))
        ahead = batch.column("ahead")[-1].as_py()
    if not ahead:
        raise RuntimeError("rows of the table came in another order when they were read again")


def _begins(rows: DataFrame, ranges: int) -> list[dict]:
    """Keys of rows that begin up to so many ranges of about equal counts: the first row's, and some sampled ones."""
    share = min(1.0, min(SAMPLE * ranges, MOST_SAMPLED) / max(rows.count(), 1))
    drawn = F.pmod(F.xxhash64("_key.row"), F.lit(1_000_000)) < round(1_000_000 * share) + 1
    found = rows.agg(F.min("_key").alias("first"), F.collect_list(F.when(drawn, F.col("_key"))).alias("some")).first()
    some = sorted(found.some)
    chosen = {some[len(some) * k // ranges] for k in range(1, ranges)} if some else set()
    return [b.asDict() for b in sorted(chosen | {found.first} - {None})]


def edited_and_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text) and of an edited version, with their likeness, and that to the next row.

    Rows follow one another by doc_id, then by a hash of the text; rows without an id come last, and the last row is
    followed by the first. The edited text has the beginning of the next text instead of its last quarter. Texts are
    dealt once to ranges of that order, which begin at sampled rows; each such row is also met at the end of the range
    before. docs is read three times and must give its rows in the same order again, as a stored table does. Null and
    empty texts have no paragraphs: two such texts are alike, likeness 1, and have equal fingerprints. Rows that repeat
    follow each other; one row alone follows itself. Other columns are ignored. An empty table gives no rows.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = docs.withColumn("_key", key)
    begins = _begins(rows, ranges)
    n = max(len(begins), 1)
    table = F.from_json(F.lit(json.dumps(begins)), "array<struct<none:boolean,id:long,hash:long,row:long>>")
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))])
    place = F.reduce(steps, F.lit(-1), lambda at, by: F.when(F.get(table, at + by) <= F.col("_key"), at + by).otherwise(at))
    both = F.when(F.get(table, F.col("_range")) == F.col("_key"), F.array(F.col("_range"), F.pmod(F.col("_range") - 1, F.lit(n)))).otherwise(F.array("_range"))
    dealt = rows.withColumn("_range", place).select("doc_id", "text", "_key", F.posexplode(both).alias("ahead", "_range"))
    dealt = dealt.repartitionById(n, "_range").sortWithinPartitions("ahead", "_key")
    return dealt.select("doc_id", "text", (F.col("ahead") == 1).alias("ahead")).mapInArrow(_followed, RESULT)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in empty_safe(batches):
        for a, b, data, offsets in tk.slices(batch.column("text")):
            own = Sets.read(data, offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "n_paragraphs": pa.array(own.sizes(), pa.int64()), "fingerprint": pa.array(own.first.texts(own.sizes()))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint) of each row of docs (doc_id, text), in one pass without a shuffle.

    A fingerprint has a fixed size whatever the text's length; equal texts have equal ones. Null and empty texts have no
    paragraphs; a null doc_id stays null; rows that repeat stay; other columns are ignored. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketched, "doc_id long, n_paragraphs long, fingerprint string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in empty_safe(batches):
        for a, b, data, offsets in tk.slices(batch.column("text")):
            other = batch.column("other").slice(a, b - a)
            left = Sets.read(data, offsets)
            new, new_offsets = tk.text_bytes(other)
            right = Sets.read(new[new_offsets[0] :], new_offsets - new_offsets[0])
            at = np.arange(b - a)
            d = differ(left, at, right, at)
            lists = []
            for t in (1, -1):
                pair, digest = d.pair[d.times == t], d.digest[d.times == t].view(np.int64)
                order = np.lexsort((digest, pair))
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[order], np.arange(b - a + 1)), pa.int32()), pa.array(digest[order])))
            yield pa.RecordBatch.from_pydict({"pair_id": batch.column("pair_id").slice(a, b - a), "near": pa.array(d.near), "cells": pa.array(d.cells), "removed": lists[0], "added": lists[1]})


def differences(pairs: DataFrame) -> DataFrame:
    """(pair_id, near, cells, removed, added) of each row of pairs (pair_id, text, other): digests of the paragraphs that
    only text has and that only other has, recovered from sketches of so many cells, and the likeness they leave.

    Nulls and empty texts have no paragraphs; a null pair_id stays null; rows that repeat stay; other columns are
    ignored. An empty table gives no rows.
    """
    kinds = "pair_id long, near double, cells long, removed array<long>, added array<long>"
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "text", "other").mapInArrow(_digests, kinds)
