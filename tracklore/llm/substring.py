"""Substring dedup: fixed-block anchors, rolling probes and extension to maximal exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import Scratch, cut, empty_safe, keys_hint, pack, sized_join, unpack

#: Packed entries in one exchange block.
BLOCK = 400_000
#: Entries of a task's texts that are decided and packed at once.
AT_ONCE = 1 << 19
#: Bytes of text for each entry that the first exchange holds, to choose the number of blocks.
BYTES_PER_MARK = 70
#: Places of entries that only tell others of an indexed block, or of any occurrence, in their document.
INDEXED, PRESENT = -1, -2
#: A place is a row's copy number, from its text's hash, over the word's number in the text.
COPY, WORD = (1 << 31) - 1, (1 << 32) - 1

_TOP = np.iinfo(np.int64).max
SEGMENTS = "doc_id long, copy long, start long, end long, src long, src_copy long, src_start long"


def _starts(h: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])


def _told(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Negative buckets, dealt by document, of entries that are decided: their group only passes them on."""
    return -1 - (tk.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int32)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of width values, by doubling; runs that pass the end are cut short."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = best(out[:-step], out[step:])
        done += step
    return out


def _marks(block: int, length: int, buckets: int):
    """Winnowed block-sized grams: equal runs of length words share one, wherever they stand.

    Documents of a batch that share a gram are told at once, and one of them stands for all, so a gram that any number
    of documents have is shuffled once for each batch.
    """
    width = length - block + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            ids, _ = tk.ids_of(batch.column("doc_id"))
            hs, docs = [], []
            for a, b, data, offsets in tk.slices(batch.column("text")):
                h, text, _ = tk.words(data, offsets).grams(block)
                if len(h) < width:
                    picked = np.arange(len(h))
                else:
                    least = _slide(h, width, np.minimum)
                    least[len(h) - width + 1 :] = 0
                    picked = np.flatnonzero(_slide(least[::-1], width, np.maximum)[::-1] == h)
                hs.append(h[picked])
                docs.append(ids[a:b][text[picked]])
            h, doc = np.concatenate(hs), np.concatenate(docs)
            if not len(h):
                continue
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            start = _starts(h)
            n = np.diff(np.append(start, len(h)))
            told = np.unique(doc[np.repeat(doc[start] != doc[start + n - 1], n)])
            h, doc = h[start], doc[start]
            yield pack(np.concatenate((_bucket(h, buckets), _told(told, buckets))), h=np.concatenate((h, np.zeros(len(told), np.uint64))), doc=np.concatenate((doc, told)))

    return run


def _shared_docs(pdf: pd.DataFrame) -> pd.DataFrame:
    h, doc = unpack(pdf, h=np.uint64, doc=np.int64)
    if pdf["bucket"].iloc[0] >= 0:
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        start = _starts(h)
        n = np.diff(np.append(start, len(h)))
        doc = doc[np.repeat(doc[start] != doc[start + n - 1], n)]
    return pd.DataFrame({"doc_id": np.unique(doc)})


def _rolling(size: int, dealt, spans: bool):
    """Rolling windows of size words, all of a text or those that start inside its spans, as dealt packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            ids, _ = tk.ids_of(batch.column("doc_id"))
            copies = batch.column("copy").to_numpy()
            hs, docs, places, held = [], [], [], 0
            for a, b, data, offsets in tk.slices(batch.column("text")):
                h, text, place = tk.words(data, offsets).grams(size)
                if spans:
                    n = np.bincount(text, minlength=b - a)
                    base = np.cumsum(n) - n
                    edge = np.zeros(len(h) + 1, np.int32)
                    for k in range(a, b):
                        first, last = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in ("starts", "ends"))
                        np.add.at(edge, base[k - a] + np.minimum(first, n[k - a]), 1)
                        np.add.at(edge, base[k - a] + np.minimum(last, n[k - a]), -1)
                    keep = np.cumsum(edge[:-1]) > 0
                    h, text, place = h[keep], text[keep], place[keep]
                hs.append(h)
                docs.append(ids[a:b][text])
                places.append((copies[a:b][text] << 32) | place)
                held += len(h)
                if held and (held >= AT_ONCE or b == batch.num_rows):
                    yield from dealt(*map(np.concatenate, (hs, docs, places)))
                    hs, docs, places, held = [], [], [], 0

    return run


def _probes(block: int, buckets: int):
    """Windows as probes, and as index where they stand at a multiple of the block.

    Occurrences that two documents of the batch share are hits already; for others' sake the least document that has
    it indexed and the greatest that has it at all stand for them.
    """

    def dealt(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h)
        h, doc, place = h[order], doc[order], place[order]
        start = _starts(h)
        most = np.maximum.reduceat(doc, start)
        many = np.minimum.reduceat(doc, start) != most
        told = np.repeat(many, np.diff(np.append(start, len(h))))
        indexed = np.minimum.reduceat(np.where((place & WORD) % block == 0, doc, _TOP), start)
        has = many & (indexed < _TOP)
        key = [h[~told], h[start[has]], h[start[many]]]
        where = [_bucket(x, buckets) for x in key]
        docs = [doc[~told], indexed[has], most[many], doc[told]]
        places = [place[~told], np.full(has.sum(), INDEXED), np.full(many.sum(), PRESENT), place[told]]
        yield pack(np.concatenate([*where, _told(doc[told], buckets)]), h=np.concatenate([*key, np.zeros(told.sum(), np.uint64)]), doc=np.concatenate(docs), place=np.concatenate(places))

    return dealt


def _by_doc(buckets: int, doc: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    if not len(doc):
        return pd.DataFrame({"bucket": np.zeros(0, np.int32), "doc": [], **{c: [] for c in columns}})
    return pack((tk.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), doc=doc, **columns).to_pandas()


def _hits(block: int, buckets: int):
    """Probes that meet an indexed block of a smaller document, and blocks that a larger document's probe meets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, doc, place = unpack(pdf, h=np.uint64, doc=np.int64, place=np.int64)
        if pdf["bucket"].iloc[0] >= 0:
            order = np.argsort(h, kind="stable")
            h, doc, place = h[order], doc[order], place[order]
            start = _starts(h)
            n = np.diff(np.append(start, len(h)))
            indexed = (place == INDEXED) | (place >= 0) & ((place & WORD) % block == 0)
            least = np.repeat(np.minimum.reduceat(np.where(indexed, doc, _TOP), start), n)
            most = np.repeat(np.maximum.reduceat(doc, start), n)
            hit = ((least < doc) | indexed & (doc < most)) & (place >= 0)
            doc, place = doc[hit], place[hit]
        return _by_doc(buckets, doc, place=place)

    return run


def _around(before: int, after: int):
    """Places p of each row widened to [p - before, p + after) and joined to maximal spans."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, place = unpack(pdf, doc=np.int64, place=np.int64)
        order = np.lexsort((place, doc))
        doc, copy, place = doc[order], place[order] >> 32, place[order] & WORD
        new_row = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
        new = new_row | np.concatenate(([True], place[1:] - before > place[:-1] + after))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        starts = np.maximum(place[first] - before, 0).astype(np.int32)
        ends = (place[last] + after).astype(np.int32)
        at = np.flatnonzero(new_row[first])
        stop = np.append(at[1:], len(first))
        spans = {"starts": [starts[a:b].tobytes() for a, b in zip(at, stop, strict=True)], "ends": [ends[a:b].tobytes() for a, b in zip(at, stop, strict=True)]}
        return pd.DataFrame({"doc_id": doc[first][at], "copy": copy[first][at], **spans})

    return run


def _with_least(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries by hash, and for each where the first one of its hash's least document stands."""
    order = np.argsort(h)
    h, doc, place = h[order], doc[order], place[order]
    start = _starts(h)
    n = np.diff(np.append(start, len(h)))
    least = np.repeat(start, n)
    again = np.flatnonzero(np.repeat(n > 1, n))
    order = again[np.lexsort((place[again], doc[again], h[again]))]
    doc[again], place[again] = doc[order], place[order]
    return h, doc, place, least


def _matches(buckets: int):
    """Whole windows; those that a smaller document of the batch starts too are decided, with where that one has it."""

    def dealt(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, doc, place, least = _with_least(h, doc, place)
        gone = doc > doc[least]
        if gone.any():
            at = least[gone]
            yield pack(_told(doc[gone], buckets), h=doc[at].view(np.uint64), doc=doc[gone], place=place[gone], at=place[at])
        left = pack(_bucket(h[~gone], buckets), h=h[~gone], doc=doc[~gone], place=place[~gone])
        yield left.append_column("at", pa.array([b""] * left.num_rows, pa.binary()))

    return dealt


def _repeats(buckets: int):
    """Windows of which an equal one starts in a smaller document, with that document and its place there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, doc, place, at = unpack(pdf, h=np.uint64, doc=np.int64, place=np.int64, at=np.int64)
        src = h.view(np.int64)
        if pdf["bucket"].iloc[0] >= 0:
            h, doc, place, least = _with_least(h, doc, place)
            gone = doc > doc[least]
            src, at = doc[least][gone], place[least][gone]
            doc, place = doc[gone], place[gone]
        return _by_doc(buckets, doc, place=place, src=src, at=at)

    return run


def _maximal(length: int):
    """Neighbouring windows that stand side by side in one smaller document, joined to maximal repeats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, place, src, at = unpack(pdf, doc=np.int64, place=np.int64, src=np.int64, at=np.int64)
        order = np.lexsort((place, doc))
        doc, place, src, at = doc[order], place[order], src[order], at[order]
        once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
        doc, place, src, at = doc[once], place[once], src[once], at[once]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        out = {"doc_id": doc[first], "copy": place[first] >> 32, "start": place[first] & WORD, "end": (place[last] & WORD) + length}
        return pd.DataFrame(out | {"src": src[first], "src_copy": at[first] >> 32, "src_start": at[first] & WORD})

    return run


def _digest(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of each text that repeats of other documents name."""
    for batch in empty_safe(batches):
        texts, rows = batch.column("text"), [[], [], []]
        take = []
        for k, asked in enumerate(batch.column("asked").to_pylist()):
            words = (texts[k].as_py() or "").encode().split()
            for x in asked:
                take.append(k)
                for out, value in zip(rows, (x["src_start"], x["n"], _digest(words, x["src_start"], x["src_start"] + x["n"])), strict=True):
                    out.append(value)
        take = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_pydict({"src": batch.column("doc_id").take(take), "src_copy": batch.column("copy").take(take), "src_start": pa.array(rows[0], pa.int64()), "n": pa.array(rows[1], pa.int64()), "digest": pa.array(rows[2], pa.binary())})


def _kept(text: str | None, spans: list[dict]) -> tuple[int, list[bytes]]:
    """How many words a text has, and those left: a repeat goes where its words are those of the document that it
    repeats, by digests of the words."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for x in spans:
        if x["end"] > at and _digest(words, x["start"], x["end"]) == x["digest"]:
            kept += words[at : max(at, x["start"])]
            at = x["end"]
    return len(words), kept + words[at:]


def _results(whole: bool):
    """Counts of each text's words and removed words, and the kept text, or its digest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in empty_safe(batches):
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [()] * batch.num_rows
            n_words, removed, out = [], [], []
            for text, own in zip(batch.column("text"), spans, strict=True):
                n, kept = _kept(text.as_py(), own)
                n_words.append(n)
                removed.append(n - len(kept))
                kept = b" ".join(kept)
                out.append(kept.decode() if whole else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept" if whole else "kept_sha256": pa.array(out, pa.string())})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what is left of their texts."""
    for batch in empty_safe(batches):
        out = [b" ".join(_kept(text.as_py(), own)[1]).decode() for text, own in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def repeats(docs: DataFrame, scratch: Scratch, length: int = 50) -> DataFrame:
    """(doc_id, copy, spans): maximal repeats of each row of docs (doc_id, copy, text), with digests of the repeated words.

    Blocks of length // 2 words at multiples of their size are the index; each window of length words holds one whole
    block. Every rolling block-sized run of words probes it; a hit is an indexed block of a smaller document. Around
    the hits and the blocks hit, windows of length words are matched with the least document that starts each, and
    windows side by side in both documents are extended to one maximal repeat, whose words in the smaller document are
    read again for comparison. Only documents that share a winnowed gram of block size are probed at all: two equal
    windows always share one, so none is lost. Whatever many documents share is decided within each batch, and one
    entry a batch is shuffled for it.
    """
    block = length // 2
    docs = docs.where("doc_id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // (BYTES_PER_MARK * BLOCK)))
    marks = docs.mapInArrow(_marks(block, length, buckets), "bucket int, h binary, doc binary")
    shared = marks.groupBy("bucket").applyInPandas(_shared_docs, "doc_id long").distinct()
    near = scratch.table(docs.join(keys_hint(scratch.table(shared)), "doc_id", "left_semi"))
    size = near.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // (6 * BLOCK)))
    probes = near.mapInArrow(_rolling(block, _probes(block, buckets), spans=False), "bucket int, h binary, doc binary, place binary")
    hits = probes.groupBy("bucket").applyInPandas(_hits(block, buckets), "bucket int, doc binary, place binary")
    around = scratch.table(hits.groupBy("bucket").applyInPandas(_around(block, 1), "doc_id long, copy long, starts binary, ends binary"))
    windows = near.join(around.hint("shuffle_hash"), ["doc_id", "copy"]).mapInArrow(_rolling(length, _matches(buckets), spans=True), "bucket int, h binary, doc binary, place binary, at binary")
    gone = windows.groupBy("bucket").applyInPandas(_repeats(buckets), "bucket int, doc binary, place binary, src binary, at binary")
    found = scratch.table(gone.groupBy("bucket").applyInPandas(_maximal(length), SEGMENTS).withColumn("n", F.col("end") - F.col("start")))
    asked = found.select("src", "src_copy", "src_start", "n").distinct().groupBy(F.col("src").alias("doc_id"), F.col("src_copy").alias("copy")).agg(F.collect_list(F.struct("src_start", "n")).alias("asked"))
    words = near.join(asked.hint("shuffle_hash"), ["doc_id", "copy"]).mapInArrow(_asked, "src long, src_copy long, src_start long, n long, digest binary")
    words = scratch.table(words.distinct())
    told = sized_join(found, words, ["src", "src_copy", "src_start", "n"], row_bytes=64)
    return cut(told.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "end", "digest"))).alias("spans")))


def _with_copy(docs: DataFrame) -> DataFrame:
    return docs.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(COPY)))


def substring_dedup(docs: DataFrame, length: int = 50, whole: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs (doc_id, text): kept is the text less repeated windows.

    A word goes if it lies in a window of length words that also starts in a document with a smaller doc_id; windows
    are those of the input. Kept words are joined by one space; with whole=False their digest, kept_sha256, is given
    instead. Null and empty texts have no words and kept is empty. A null doc_id neither loses words nor costs others
    any. Rows that repeat a doc_id cost each other nothing, whether their texts are equal or not. Other columns are
    ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = _with_copy(docs)
    with Scratch(docs.sparkSession) as scratch:
        spans = repeats(docs, scratch, length)
    ids = keys_hint(spans.select("doc_id", "copy"))
    schema = "doc_id long, n_words long, n_removed long, " + ("kept string" if whole else "kept_sha256 string")
    rest = docs.join(ids, ["doc_id", "copy"], "left_anti").mapInArrow(_results(whole), schema)
    less = docs.join(spans.hint("shuffle_hash"), ["doc_id", "copy"]).mapInArrow(_results(whole), schema)
    return rest.unionAll(less)


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with all their columns, text less repeated windows as substring_dedup has it; texts that lose nothing stay as they are.

    Null and empty texts stay; a null doc_id neither loses words nor costs others any; rows that repeat a doc_id cost
    each other nothing; extra columns stay, whatever their names. An empty table gives no rows.
    """
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    own = _with_copy(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    with Scratch(docs.sparkSession) as scratch:
        spans = repeats(own.select("doc_id", "copy", "text"), scratch, length)
    rest = own.join(keys_hint(spans.select("doc_id", "copy")), ["doc_id", "copy"], "left_anti").select("row", "text")
    less = own.join(spans.hint("shuffle_hash"), ["doc_id", "copy"]).select("row", "text", "spans").mapInArrow(_texts, rest.schema)
    return rest.unionAll(less).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
