"""Words of whole Arrow batches as byte spans and 128-bit names, without a Python object for each word.

White space of the ASCII range never occurs inside a UTF-8 sequence, so spans
are found on bytes. A span of at most fifteen bytes is its own name: its bytes and
its length fill the 128 bits, so two different ones never share it. A longer span is named
by 120 bits of BLAKE2b, or by whatever the caller numbers it with.

Hashes of names and of runs of names are mixed with a key that the driver draws
for each run, so that no text can be made to collide; they are not linear in the words.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers wait for their next task, and what each holds adds up."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int = 0) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003 & (1 << 64) - 1)) * U(0x9E3779B97F4A7C15))


#: Spans of more bytes are named by a digest.
SHORT = 15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each value starts and ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run without blanks (blank tells which bytes are), and the number of runs of each text. Texts lie end to end in raw."""
    solid = ~blank[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    edge = np.concatenate([[False], solid[:-1]])
    edge[starts[starts < len(raw)]] = False
    first = np.flatnonzero(solid & ~edge)
    edge = np.concatenate([solid[1:], [False]])
    edge[ends[ends > 0] - 1] = False
    last = np.flatnonzero(solid & ~edge) + 1
    return first, last, np.searchsorted(first, ends) - np.searchsorted(first, starts)


def digests(spans: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(x, digest_size=SHORT).digest(), "little") for x in spans]


def names(raw: np.ndarray, first: np.ndarray, last: np.ndarray, lower: bool = False, long: Callable[[list[bytes]], list[int]] = digests) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each span's name; with lower, A-Z count as a-z. long gives numbers of at most 120 bits for the spans of more than fifteen bytes."""
    padded = np.concatenate([_LOWER[raw] if lower else raw, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    n = last - first
    low = eight[first] & _KEEP[np.minimum(n, 8)]
    high = (eight[np.minimum(first + 8, len(padded) - 8)] & _KEEP[np.clip(n - 8, 0, 7)]) | (n.astype(U) << U(56))
    if len(at := np.flatnonzero(n > SHORT)):
        data = memoryview(padded)
        numbers = long([data[a:b].tobytes() for a, b in zip(first[at].tolist(), last[at].tolist())])
        low[at] = np.array([x & (1 << 64) - 1 for x in numbers], U)
        high[at] = np.array([x >> 64 for x in numbers], U) | U(0xFF << 56)
    return low, high


def new_key() -> int:
    """A key for the hashes of one run, drawn on the driver."""
    return secrets.randbits(62)


def keyed(low: np.ndarray, high: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of each name."""
    a, b, c = seeds(3, key)
    return mix(mix((low ^ a) * (c | U(1))) + (high ^ b))


def joined(x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of two neighbouring runs from theirs."""
    a, c = seeds(2, key + 1)
    return mix((x ^ a) * (c | U(1)) + y)


class NameIndex:
    """Numbers new names in their order, for whole arrays at a time (open addressing). Both halves of a name are compared."""

    def __init__(self):
        self.bits, self.n = 16, 0
        self._clear()

    def _clear(self) -> None:
        self.low = np.zeros(1 << self.bits, U)
        self.high = np.zeros(1 << self.bits, U)
        self.numbers = np.full(1 << self.bits, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each name, -1 for unknown ones."""
        mask, slots = (1 << self.bits) - 1, self._slots(low, high)
        out = self.numbers[slots]
        open_ = np.flatnonzero((out >= 0) & ((self.low[slots] != low) | (self.high[slots] != high)))
        while len(open_):
            slots[open_] = here = (slots[open_] + 1) & mask
            out[open_] = got = self.numbers[here]
            open_ = open_[(got >= 0) & ((self.low[here] != low[open_]) | (self.high[here] != high[open_]))]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        mask, slots, todo = (1 << self.bits) - 1, self._slots(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.numbers[slots[todo]] < 0]
            self.numbers[slots[free]] = numbers[free]  # of several names for one slot the last one stays
            won = free[self.numbers[slots[free]] == numbers[free]]
            self.low[slots[won]], self.high[slots[won]] = low[won], high[won]
            left = np.ones(len(low), bool)
            left[won] = False
            todo = todo[left[todo]]
            slots[todo] = (slots[todo] + 1) & mask

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Numbers distinct names that are not known yet."""
        numbers = np.arange(self.n, self.n + len(low), dtype=np.int32)
        self.n += len(low)
        if 2 * self.n > 1 << self.bits:
            old = self.numbers >= 0
            low, high, numbers = np.concatenate([self.low[old], low]), np.concatenate([self.high[old], high]), np.concatenate([self.numbers[old], numbers])
            self.bits = int(np.ceil(np.log2(4 * len(low))))
            self._clear()
        self._put(low, high, numbers)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size] in a row."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
