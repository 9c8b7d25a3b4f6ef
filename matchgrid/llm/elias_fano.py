"""Elias-Fano sequences over numpy arrays, with batched access and successor search."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th set bit of a byte, lowest first.
_PLACE = np.array([[next((i for i in range(8) if b >> i & 1 and bin(b & ((1 << i) - 1)).count("1") == r), 8) for r in range(8)] for b in range(256)], np.uint8)


#: Every byte of a word as 1, its highest bits, and masks that add up bits.
_ONES, _HIGH, _TWOS, _FOURS, _EIGHTS = (np.uint64(int(x * 8, 16)) for x in ("01", "80", "55", "33", "0F"))
#: Words between those among which zeros are looked up first, where few are asked for.
_STRIDE = 64


def _inside(words: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Place of the rest-th (from 0) one in each word: bits are added up by bytes, side by side in the word."""
    u = np.uint64
    sums = words - (words >> u(1) & _TWOS)
    sums = (sums & _FOURS) + (sums >> u(2) & _FOURS)
    sums = (sums + (sums >> u(4)) & _EIGHTS) * _ONES  # byte i: ones up to it
    rest = rest.astype(u)
    shift = (((rest * _ONES | _HIGH) - sums & _HIGH) >> u(7)) * _ONES >> u(56) << u(3)  # bytes whose ones are all passed by
    inner = rest - (sums << u(8) >> shift & u(255))
    return shift.astype(np.int64) + _PLACE[words >> shift & u(255), inner]


def _zero_words(before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The words with the k-th zeros. Zeros before word j are 64 * j - before[j]; few k are narrowed down, so that their cost doesn't follow the size of the vector."""
    n = len(before)
    if 16 * len(k) > n:
        return np.searchsorted(64 * np.arange(n) - before.astype(np.int64), k, "right") - 1
    some = np.arange(0, n, _STRIDE)
    lo = (np.searchsorted(64 * some - before[::_STRIDE].astype(np.int64), k, "right") - 1) * _STRIDE
    step = _STRIDE // 2
    while step:
        at = np.minimum(lo + step, n - 1)
        lo = np.where((lo + step < n) & (64 * at - before[at].astype(np.int64) <= k), at, lo)
        step //= 2
    return lo


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Place of the k-th (from 0) one or zero in a bit vector; before: ones before each word."""
    if ones:
        j = np.searchsorted(before, k, "right") - 1
        rest = k - before[j]
    else:
        j = _zero_words(before, k)
        rest = k - (64 * j - before[j].astype(np.int64))
    return 64 * j.astype(np.int64) + _inside(words[j] if ones else ~words[j], rest)


class EliasFano:
    """A sorted sequence of integers below ``universe``, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        width = min(62, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = n + (max(1, universe) - 1 >> width) + 2
        bits = np.zeros((size + 63) // 64 * 8, np.uint8)
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        high = bits.view(np.uint64)
        before = np.concatenate([[0], np.cumsum(_POP[bits].reshape(-1, 8).sum(1, dtype=np.int64))[:-1]])
        before = before.astype(np.uint32 if n < 1 << 32 else np.uint64)
        low = np.zeros(((n * width + 63) // 64 + 2) * 8, np.uint8)
        step = 1 << 18  # a multiple of 64 values fills whole words
        for lo in range(0, n if width else 0, step):
            own = values[lo : lo + step]
            packed = np.packbits(((own[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            low[lo * width // 8 : lo * width // 8 + len(packed)] = packed
        return cls(n, width, low.view(np.uint64), high, before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        more = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift) | more) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        top = _select(self.high, self.before, i, True) - i
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def _starts(self, top: np.ndarray) -> np.ndarray:
        """Number of values whose upper part is below ``top``."""
        out = np.zeros(len(top), np.int64)
        if (some := top > 0).any():
            out[some] = _select(self.high, self.before, top[some] - 1, False) + 1 - top[some]
        return out

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Where each x stands, between lo and hi where given; -1 if it doesn't.

        The bucket of the upper part is searched for the successor of the lower.
        """
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        a, b = np.split(self._starts(np.concatenate([top, top + 1])), 2)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end, want = b.copy(), x & np.uint64((1 << self.width) - 1)
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = self._low(mid) < want[todo]
            a[todo[less]], b[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[a[todo] < b[todo]]
        hit = a < end
        hit[hit] = self._low(a[hit]) == want[hit]
        return np.where(hit, a, -1)

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "before": self.before}
