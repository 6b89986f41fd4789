"""Byte-level BPE by a rank queue with a hierarchical bitmap, over all new pre-tokens of a batch at once."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import empty_safe

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space of the splitting pattern: fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the splitting pattern: fixed values.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Pre-tokens a worker remembers, about 60 bytes each.
REMEMBERED = 400_000
#: Bytes of text encoded at once: bounds a worker's memory.
AT_ONCE = 4 << 20

_class_of = np.full(0x110000, 255, np.uint8)
_class_of[WHITE] = SPACE
_letter, _number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def _classes(points: np.ndarray) -> np.ndarray:
    for p in np.unique(points[_class_of[points] == 255]).tolist():
        c = chr(p)
        _class_of[p] = LETTER if _letter.match(c) else NUMBER if _number.match(c) else OTHER
    return _class_of[points]


_ascii = _classes(np.arange(128))
_byte_class = np.concatenate((_ascii, np.zeros(128, np.uint8)))


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _byte_class[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        found = _classes(point)
        out[lead] = found
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = found[more]
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start bytes of the matches of the splitting pattern, which cover each text: runs of a class, with rules for spaces."""
    n = len(data)
    kind = byte_classes(data)
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], n)
    closing = np.zeros(n + 1, bool)
    closing[offsets] = True
    spaces = np.flatnonzero((kind[runs] == SPACE) & ~closing[ends])
    if len(spaces):
        last = ends[spaces] - 1
        for _ in range(2):
            last -= (data[last] & 0xC0) == 0x80
        first[last] = True
        first[ends[spaces][data[last] == 0x20]] = False
    quotes = np.flatnonzero((ends - runs == 1) & (data[runs] == 0x27) & first[runs] & ~closing[ends])
    for q in quotes.tolist():
        at = int(ends[q])
        if kind[at] == LETTER and q + 1 < len(runs):
            stop = int(ends[q + 1])
            head = data[at : min(at + 2, stop)].tobytes()
            for c in CONTRACTIONS:
                if head.startswith(c):
                    first[at] = False
                    if at + len(c) < stop:
                        first[at + len(c)] = True
                    break
    return np.flatnonzero(first)


class RankQueue:
    """A set of ranks with find-first-set over three levels of 64-bit words; a bucket of list places for each rank."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, places: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(places)
            return
        self.buckets[rank] = [places]
        for words in self.levels:
            words[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        rank = at
        for words in self.levels:
            words[at >> 6] &= ~(1 << (at & 63))
            if words[at >> 6]:
                break
            at >>= 6
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Encoder:
    """Merge ranks as arrays, and what this worker has encoded so far.

    added are the tokens, with their ids, that are found in a text as they stand before it is split; they do not merge.
    """

    def __init__(self, tokens: list[bytes], added: dict[bytes, int] | None = None):
        if len(tokens) > 1 << 16:
            raise ValueError(f"{len(tokens)} tokens: two ranks must fit 32 bits")
        self.tokens, self.added = tokens, added or {}
        self.literal = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte_rank = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = (x for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank for x in (rank[t[:k]] << 16 | rank[t[k:]], i))
        keys, merged = np.fromiter(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order].astype(np.uint32), merged[order].astype(np.int32)
        self.vocab = np.frombuffer(b"".join(tokens), np.uint8)
        self.vocab_off = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        self.forget()

    def forget(self) -> None:
        h = self._hash(self.vocab, self.vocab_off[:-1], self.vocab_off[1:])
        self.ids, self.off = np.arange(len(self.tokens), dtype=np.int32), np.arange(len(self.tokens) + 1)
        if self.added:
            data = np.frombuffer(b"".join(self.added), np.uint8)
            off = np.concatenate(([0], np.cumsum([len(t) for t in self.added])))
            h = np.concatenate((h, self._hash(data, off[:-1], off[1:])))
            self.ids = np.concatenate((self.ids, np.array(list(self.added.values()), np.int32)))
            self.off = np.arange(len(self.ids) + 1)
        order = np.argsort(h)
        self.known = [(h[order], order)]

    @staticmethod
    def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tk.mix(tk._ranges(tk._KEYS[data], starts, ends) + (ends - starts).astype(np.uint64))

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1).astype(np.int32)

    def _push(self, queue: RankQueue, places: np.ndarray, ranks: np.ndarray) -> None:
        good = ranks >= 0
        places, ranks = places[good], ranks[good]
        if len(places):
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(places)], strict=True):
                queue.push(r, places[a:b])

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many pieces: one linked list, cut between pieces.

        The queue gives the least rank anywhere. A bucket holds all its places, and all that are not stale merge left
        to right: no merge makes a pair of a lower rank than its own, as each token's own merges come before it.
        """
        n = len(data)
        ids = self.byte_rank[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[off[1:] - 1] = -1
        before[off[:-1]] = -1
        rank = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._merged(ids[inner], ids[inner + 1])
        queue = RankQueue(len(self.tokens))
        self._push(queue, inner, rank[inner])
        live = np.ones(n, bool)
        while (top := queue.pop()) is not None:
            r, p = top
            p = p[rank[p] == r]
            if not len(p):
                continue
            q = after[p]
            if len(p) > 1 and (q[:-1] == p[1:]).any():
                keep, used = [], -1
                for k, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    if x != used:
                        keep.append(k)
                        used = y
                p, q = p[keep], q[keep]
            ids[p] = r
            live[q] = False
            rank[q] = -1
            q = after[q]
            after[p] = q
            rank[p] = -1
            some = q >= 0
            before[q[some]] = p[some]
            left = before[p]
            left = left[left >= 0]
            place = np.concatenate((p[some], left))
            if len(place):
                found = self._merged(ids[place], ids[after[place]])
                rank[place] = found
                self._push(queue, place, found)
        count = np.concatenate(([0], np.cumsum(live)))
        return ids[live], count[off]

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1)
        for keys, at in self.known:
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out = np.where(keys[k] == h, at[k], out)
        return out

    def _learn(self, h: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
        ids, ends = self.merge(data, off)
        at = len(self.off) - 1 + np.arange(len(h))
        self.off = np.concatenate((self.off, ends[1:] + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.known.append((h, at))
        while len(self.known) > 1 and 2 * len(self.known[-1][0]) > len(self.known[-2][0]):
            (x, i), (y, j) = self.known.pop(), self.known.pop()
            keys = np.concatenate((x, y))
            order = np.argsort(keys, kind="stable")
            self.known.append((keys[order], np.concatenate((i, j))[order]))

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start bytes of the pre-tokens of each text: an added token is one, and what stands around it is split apart."""
        raw = data.tobytes() if self.literal else b""
        if not self.literal or not self.literal.search(raw):
            return pretokens(data, offsets)
        ends = offsets.tolist()
        spans = np.array([m.span() for a, b in zip(ends[:-1], ends[1:], strict=True) for m in self.literal.finditer(raw, a, b)], np.int64).reshape(-1, 2)
        starts = pretokens(data, np.sort(np.concatenate((offsets, spans.ravel()))))
        at = np.searchsorted(spans[:, 0], starts, "left") - 1
        inside = (at >= 0) & (starts < spans[np.maximum(at, 0), 1]) if len(spans) else np.zeros(len(starts), bool)
        return starts[~inside]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a column, each pre-token by itself."""
        if len(self.off) > REMEMBERED:
            self.forget()
        parts, fresh_h, fresh_data, fresh_n = [], [], [], []
        for _, _, data, offsets in tk.slices(column):
            starts = self._split(data, offsets)
            ends = np.append(starts[1:], len(data))
            h, first, which = np.unique(self._hash(data, starts, ends), return_index=True, return_inverse=True)
            new = np.flatnonzero(self._find(h) < 0)
            size = ends[first[new]] - starts[first[new]]
            fresh_h.append(h[new])
            fresh_n.append(size)
            fresh_data.append(data[_spread(starts[first[new]], size)])
            parts.append((h, which.astype(np.int32), np.searchsorted(starts, offsets)))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, int)
        h, first = np.unique(np.concatenate(fresh_h), return_index=True)
        if len(h):
            size = np.concatenate(fresh_n)
            begin = np.cumsum(size) - size
            data = np.concatenate(fresh_data)[_spread(begin[first], size[first])]
            self._learn(h, data, np.concatenate(([0], np.cumsum(size[first]))))
        ids, ends = [], [np.zeros(1, int)]
        done = 0
        for h, which, of in parts:
            piece = self._find(h)[which]
            size = np.diff(self.off)[piece] if len(self.off) < 2 else self.off[piece + 1] - self.off[piece]
            ids.append(self.ids[_spread(self.off[piece], size)])
            total = np.concatenate(([0], np.cumsum(size)))
            ends.append(done + total[of[1:]])
            done += int(total[-1])
        return np.concatenate(ids), np.concatenate(ends)

    def decode(self, ids: np.ndarray) -> bytes:
        begin = self.vocab_off[ids]
        return self.vocab[_spread(begin, self.vocab_off[ids + 1] - begin)].tobytes()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def load_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ids, of a rank file or of a tokenizer's JSON file, read on the driver (about 1 MB)."""
    if not path.endswith(".json"):
        with open(path, "rb") as file:
            return [base64.b64decode(line.split()[0]) for line in sorted(file, key=lambda line: int(line.split()[1]))]
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {x["content"] for x in found.get("added_tokens", [])}
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = sorted((i, t) for t, i in found["model"]["vocab"].items() if t not in special)
    return [bytes(byte[c] for c in t) for _, t in vocab]


def load_added(path: str) -> dict[bytes, int]:
    """Added tokens of a tokenizer's JSON file with their ids; a rank file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens", [])
    odd = [x["content"] for x in found if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that depend on what stands around them: {odd}")
    return {x["content"].encode(): x["id"] for x in found}


@functools.lru_cache(maxsize=2)
def _encoder(tokens: tuple[bytes, ...], added: tuple[tuple[bytes, int], ...] = ()) -> Encoder:
    return Encoder(list(tokens), dict(added))


def encoder_of(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary: its tokens, and its added tokens with their ids."""
    return _encoder(*shared.value)


def whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about AT_ONCE bytes of text."""
    for batch in empty_safe(batches):
        for a, b, _, _ in tk.slices(batch.column("text"), AT_ONCE):
            yield batch.slice(a, b - a)


def _digests(shared, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_slices(batches):
            own = encoder_of(shared)
            ids, off = own.encode(batch.column("text"))
            n, first, second = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                part = ids[a:b]
                n.append(b - a)
                back = own.decode(part)
                if whole:
                    first.append(part.tolist())
                    second.append(back)
                else:
                    first.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(back).hexdigest())
            rows = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())}
            if whole:
                rows |= {"ids": pa.array(first, pa.list_(pa.int32())), "decoded": pa.array([x.decode() for x in second], pa.string())}
            else:
                rows |= {"ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            yield pa.RecordBatch.from_pydict(rows)

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, whole: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of docs (doc_id, text), or digests of the last two.

    One pass without a shuffle. Null and empty texts have no ids and decode to nothing; a null doc_id stays null; rows
    that repeat stay; other columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(load_ranks(ranks_path)), ()))
    kinds = "ids array<int>, decoded string" if whole else "ids_sha256 string, decoded_sha256 string"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digests(shared, whole), f"doc_id long, n_tokens long, {kinds}")
