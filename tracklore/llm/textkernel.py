"""Word boundaries and word, shingle and window hashes of many texts at once, on the UTF-8 bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, each with several words of 8 bytes beside it; a longer text is handled alone.
SLICE = 1 << 18

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEYS = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_LOWER_KEYS = _KEYS.copy()
_LOWER_KEYS[65:91] = _KEYS[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, base & (2**64 - 1), _U))))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: each output bit depends on each input bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, the same wherever the range stands: differences of a prefix sum."""
    n = len(values)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(values * _power(_BASE, n), out=total[1:])
    out = total[ends] - total[starts]
    out *= _power(_INVERSE, n + 1)[starts]
    return mix(out)


@dataclass
class Words:
    """Words of the texts of one slice, in order; of[d]:of[d + 1] are those of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    lower: bool = False

    def hashes(self) -> np.ndarray:
        keys = _LOWER_KEYS if self.lower else _KEYS
        h = _ranges(keys[self.data], self.starts, self.ends)
        return mix(h + (self.ends - self.starts).astype(_U))

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, position in the text) of each run of size words inside one text."""
        counts = np.maximum(self.counts() - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = self.of[:-1][text] + place
        return _ranges(self.hashes(), first, first + size), text, place


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    space = _SPACE[data]
    full = np.flatnonzero(np.diff(offsets) > 0)
    start, end = ~space, ~space
    edge = np.ones(len(data), bool)
    edge[1:] = space[:-1]
    edge[offsets[:-1][full]] = True
    start &= edge
    edge[:-1] = space[1:]
    edge[-1:] = True
    edge[offsets[1:][full] - 1] = True
    end &= edge
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets), lower)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[: offsets[-1]] if len(offsets) else data, offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes."""
    data, offsets = text_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids, with 0 where null, and a mask of those that are not null."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(column).to_numpy(zero_copy_only=False)
