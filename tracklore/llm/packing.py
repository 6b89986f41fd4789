"""Best-fit decreasing packing of token pieces, with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.bpe import encoder_of, load_added, load_ranks, whole_slices
from tracklore.llm.common import cut

#: Sequences that one group of pieces fills: groups are packed apart, and each leaves at most a few sequences part full.
GROUP_SEQUENCES = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """Bins by remaining capacity: leaf c of the tree holds the bins with c left, a node whether any leaf below has one."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(self.width)]

    def put(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        node = left + self.width
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a bin with the least capacity of at least need: up to the first right turn, then down to the left."""
        node = need + self.width
        while not self.any[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node *= 2
            if not self.any[node]:
                node += 1
        left = node - self.width
        bin_ = self.bins[left].pop()
        if not self.bins[left]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return left, bin_


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, given in decreasing order; lengths are 1 to capacity."""
    tree, out, bins = OpenBins(capacity), [], 0
    for n in lengths:
        found = tree.tightest(n)
        if found is None:
            left, bin_ = capacity, bins
            bins += 1
        else:
            left, bin_ = found
        out.append((bin_, capacity - left))
        if left > n:
            tree.put(left - n, bin_)
    return out


def _pieces(shared, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_slices(batches):
            ids, off = encoder_of(shared).encode(batch.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            last = np.array([end_id], "<u4")
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                own = np.concatenate((ids[a:b].astype("<u4"), last))
                at = 0
                for p in range(-(-len(own) // capacity)):
                    stop = at + ((len(own) - 1) % capacity + 1 if p == 0 else capacity)
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(own[at:stop].tobytes()))
                    at = stop
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def _pack(capacity: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        placed = np.array(best_fit(group["length"].to_pylist(), capacity), np.int64).reshape(-1, 2)
        group = group.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(placed[:, 0] + (key[0].as_py() << 32)))
        return group.append_column("offset", pa.array(placed[:, 1]))

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each row of docs (doc_id, text) with their places in sequences of at most capacity tokens.

    A document is its ids, with the vocabulary's added tokens found in its text, and the end id; one longer than capacity is cut into pieces of capacity, of which the first
    takes what is over. Pieces are dealt by a hash of their row number to groups that fill about GROUP_SEQUENCES sequences each, as many
    groups as the tokens need, and each group is packed by best-fit decreasing: the longest piece first, into the open
    sequence with the least room that takes it. Null and empty texts are the end id alone. A null doc_id stays null;
    rows that repeat are packed each; other columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(load_ranks(vocabulary)), tuple(load_added(vocabulary).items())))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(docs.mapInArrow(_pieces(shared, capacity, end_id), PIECES))
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (capacity * GROUP_SEQUENCES)))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # pieces that are alike are dealt, too
    return dealt.groupBy("bin_group").applyInArrow(_pack(capacity), PACKED)
