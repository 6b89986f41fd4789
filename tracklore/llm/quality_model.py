"""Quality classifier: random Fourier features of text statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.bpe import LETTER, NUMBER, OTHER, byte_classes
from tracklore.llm.common import cut, empty_safe

#: Random features, width of the kernel in standard deviations, ridge, partial sums added in one group, bins of the calibration.
FEATURES, WIDTH, RIDGE, FAN_IN, BINS = 256, 4.0, 1e-3, 8, 200
STATISTICS = ["log_words", "log_bytes", "mean_word", "spread_word", "distinct", "repeat_next", "repeat_two", "repeat_three", "letters", "numbers", "others", "upper", "symbols", "exclaims", "bars", "lines", "repeat_lines", "words_a_line", "short_words", "long_words", "symbol_words", "upper_words"]
_COUNTED = {"symbols": b"#*$%&|<>", "exclaims": b"!?", "bars": b"|"}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    n = len(offsets) - 1
    w = tk.words(data, offsets)
    words = w.counts()
    size = np.diff(offsets)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    text = np.repeat(np.arange(n), words)
    length = (w.ends - w.starts).astype(float)

    def by_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, n)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / per_byte

    def repeats(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        return np.bincount(of[again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    h = w.hashes()
    nxt = np.zeros(len(h), bool)
    nxt[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    kinds = byte_classes(data)
    upper = (data >= 65) & (data <= 90)
    marks = {k: np.isin(data, np.frombuffer(v, np.uint8)) for k, v in _COUNTED.items()}
    in_word = np.concatenate(([0], np.cumsum(marks["symbols"] | marks["exclaims"])))
    in_upper = np.concatenate(([0], np.cumsum(upper)))
    mean = by_text(length) / per_word
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][size > 0], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    line_text = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_hash = tk._ranges(tk._KEYS[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = {k: w.grams(k)[:2] for k in (2, 3)}
    columns = {
        "log_words": np.log1p(words), "log_bytes": np.log1p(size), "mean_word": mean,
        "spread_word": np.sqrt(np.maximum(by_text(length**2) / per_word - mean**2, 0)), "distinct": repeats(h, text), "repeat_next": by_text(nxt) / per_word,
        "repeat_two": repeats(*grams[2]), "repeat_three": repeats(*grams[3]), "letters": share(kinds == LETTER), "numbers": share(kinds == NUMBER), "others": share(kinds == OTHER),
        "upper": share(upper), "symbols": share(marks["symbols"]), "exclaims": share(marks["exclaims"]), "bars": share(marks["bars"]),
        "lines": np.log1p(lines), "repeat_lines": repeats(line_hash, line_text), "words_a_line": np.log1p(words / np.maximum(lines, 1)),
        "short_words": by_text(length <= 2) / per_word, "long_words": by_text(length >= 12) / per_word,
        "symbol_words": by_text(in_word[w.ends] > in_word[w.starts]) / per_word, "upper_words": by_text(in_upper[w.ends] - in_upper[w.starts] >= 2) / per_word,
    }
    return np.column_stack([columns[c] for c in STATISTICS])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in empty_safe(batches):
        flat = np.concatenate([statistics(data, offsets) for _, _, data, offsets in tk.slices(batch.column("text"))])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))})


class Fourier:
    """cos(scaled statistics times Gaussian directions, shifted): inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.shift) * np.sqrt(2 / FEATURES)
        return np.column_stack((z, np.ones(len(z))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _sums(features: Fourier):
    """The normal equations of one partition, as one row: the upper triangle and the right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        part, gram, right, rows = TaskContext.get().partitionId(), np.zeros((d, d)), np.zeros(d), 0
        for batch in empty_safe(batches):
            z, y = features(_matrix(batch)), np.asarray(batch.column("y"), float)
            gram += z.T @ z
            right += z.T @ y
            rows += len(y)
        if rows:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([np.append(gram[np.triu_indices(d)], right).tobytes()])})

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in group["sums"])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()])})


def _total(sums: DataFrame, parts: int) -> np.ndarray:
    """The sum of all rows: FAN_IN neighbouring partitions' in one group, and again, until few are left."""
    while parts > FAN_IN:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(_added, "part int, sums binary")
        parts = -(-parts // FAN_IN)
    return sum(np.frombuffer(r["sums"]) for r in sums.collect())


def _raw(features: Fourier, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            rows = {n: batch.column(n) for n in batch.schema.names if n != "x"}
            yield pa.RecordBatch.from_pydict(rows | {"raw": pa.array(features(_matrix(batch)) @ weights)})

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to y with weights n: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), n.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_of: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels are (doc_id, quality).

    Every whole text is measured once (STATISTICS). Of the labelled rows whose crc32(doc_id as text) mod held_out_of is
    not held_out, all are learnt from: their partitions' normal equations are summed in levels of FAN_IN, ridge weights are
    solved for on the driver, and raw scores are calibrated by isotonic regression over BINS quantile bins, whose counts
    Spark sums. Ties of raw scores share a bin. Null and empty texts have zero statistics and are scored so; a null
    doc_id is not held out and stays null; rows that repeat get equal results; null labels are not learnt from, and
    of a doc_id labelled again the greater label counts, once; with
    labels of one kind that label is the score of all, without labels it is 1. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out_of)) == held_out
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, x array<double>"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~key)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    train = cut(measured.join(known.hint("merge"), "doc_id").select("x", "y"))
    stats = train.withColumn("part", F.spark_partition_id()).agg(F.count("*"), F.avg("y"), F.max("part"), *[f(F.col("x")[k]) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    if not stats[0] or stats[1] in (0.0, 1.0):
        scored = measured.select("doc_id", F.lit(stats[1] if stats[0] else 1.0).alias("score"))
    else:
        mean, spread = np.array(stats[3::2]), np.array(stats[4::2])
        features = Fourier(mean, np.where(spread > 1e-9, spread, 1.0))
        total = _total(train.mapInArrow(_sums(features), "part int, sums binary"), stats[2] + 1)
        d = FEATURES + 1
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = total[:-d]
        gram = gram + np.triu(gram, 1).T
        weights = np.linalg.solve(gram + RIDGE * stats[0] / FEATURES * np.eye(d), total[-d:])
        raw = cut(train.mapInArrow(_raw(features, weights), "y double, raw double"))
        edges = sorted(set(raw.approxQuantile("raw", [k / BINS for k in range(1, BINS)], 0.2 / BINS)))
        bin_ = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("raw"))) if edges else F.lit(0)
        bins = sorted(tuple(r) for r in raw.groupBy(bin_.alias("bin")).agg(F.avg("raw"), F.avg("y"), F.count("*")).collect())
        centre = np.array([b[1] for b in bins])
        level = isotonic(np.array([b[2] for b in bins]), np.array([b[3] for b in bins], float))

        def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _raw(features, weights)(batches):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.interp(np.asarray(batch.column("raw")), centre, level))})

        scored = measured.mapInArrow(calibrated, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(key, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
