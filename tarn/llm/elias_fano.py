"""Elias-Fano sequences, quantised values, and an n-gram trie of them in memory-mapped levels."""

from __future__ import annotations

import tempfile

import numpy as np

SAMPLE, BLOCK = 512, 1 << 16
#: From one in so many values on, all are decoded at once instead of each by itself.
DENSE = 16
#: Number of set bits of a byte, and the place of its k-th set bit.
_POP = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], dtype=np.uint8)


class Mapped:
    """Arrays in an unnamed file that are read through a memory map; the file goes when the object does."""

    def __init__(self):
        self.file, self.size = tempfile.TemporaryFile(), 0

    def add(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        pad = -self.size % 64
        self.file.write(b"\0" * pad + np.ascontiguousarray(array).tobytes())
        self.file.flush()
        at, self.size = self.size + pad, self.size + pad + array.nbytes
        return np.memmap(self.file, dtype=array.dtype, mode="r", offset=at, shape=array.shape)


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63: the upper halves in unary, the lower bits as they are."""

    def __init__(self, values: np.ndarray, store: Mapped | None = None):
        values = np.asarray(values, dtype=np.int64)
        keep = store.add if store else (lambda x: x)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = low = max(0, (top // max(1, n)).bit_length() - 1)
        ones = (values >> low) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=bool)
        bits[ones] = True
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.high = keep(np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8))))
        self.samples = keep(ones[::SAMPLE].astype(np.int64))
        # how many ones stand before each 64 bits
        self.before = keep(np.concatenate(([0], np.cumsum(_POP[self.high].reshape(-1, 8).sum(1, dtype=np.int64)))).astype(np.uint32))
        lows = [np.packbits(((values[i : i + BLOCK, None] >> np.arange(low)) & 1).astype(bool), bitorder="little") for i in range(0, n, BLOCK)] if low else []
        self.low = keep(np.concatenate(lows)) if lows else np.zeros(0, dtype=np.uint8)

    def __len__(self) -> int:
        return self.n

    def decode(self, a: int, b: int) -> np.ndarray:
        """The values from a to b (exclusive)."""
        if b <= a:
            return np.zeros(0, dtype=np.int64)
        first = a // SAMPLE
        start = int(self.samples[first]) // 8
        last = (b - 1) // SAMPLE + 1
        stop = int(self.samples[last]) if last < len(self.samples) else self.size
        ones = np.flatnonzero(np.unpackbits(self.high[start : stop // 8 + 1], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.samples[first])]
        high = ones[a - first * SAMPLE : b - first * SAMPLE] - np.arange(a, b)
        if not self.low_bits:
            return high
        low, at = self.low_bits, a * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : (b * low + 7) // 8], bitorder="little")[at % 8 :][: (b - a) * low]
        return (high << low) | (bits.reshape(-1, low) @ (1 << np.arange(low, dtype=np.int64)))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the k-th one (or zero) of the upper halves, from 0, for many k at once."""
        if one:
            word = np.searchsorted(self.before, k, side="right") - 1
            k = k - self.before[word]
        else:
            zeros = np.arange(len(self.before)) * 64 - self.before
            word = np.searchsorted(zeros, k, side="right") - 1
            k = k - zeros[word]
        eight = np.asarray(self.high)[word[:, None] * 8 + np.arange(8)]
        if not one:
            eight = ~eight
        seen = np.cumsum(_POP[eight], axis=1, dtype=np.int64)
        byte = np.minimum((seen <= k[:, None]).sum(1), 7)
        rows = np.arange(len(k))
        k = k - np.where(byte > 0, seen[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _PLACE[eight[rows, byte], k]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        """The lower bits of the values at the given positions."""
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        first = at * self.low_bits
        byte = first >> 3
        out = np.zeros(len(at), dtype=np.uint64)
        last = len(self.low) - 1
        for k in range((self.low_bits + 14) // 8):
            out |= np.asarray(self.low)[np.minimum(byte + k, last)].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The values at the given positions (in any order)."""
        at = np.asarray(at, dtype=np.int64)
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        if len(at) * DENSE > self.n:  # many of them: decode blocks
            return np.concatenate([self.decode(i, min(self.n, i + BLOCK)) for i in range(0, self.n, BLOCK)])[at]
        return ((self._select(at, True) - at) << self.low_bits) | self._lows(at)

    def get(self, i: int) -> int:
        return int(self.decode(i, i + 1)[0])

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) position of the values with each upper half."""
        top = self.size - self.n  # upper half of the last value
        reach = np.minimum(high, top)
        if len(high) * DENSE > self.n:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            zero = lambda k: zeros[k]
        else:
            zero = lambda k: self._select(k, False)
        start = np.where(reach > 0, zero(np.maximum(reach - 1, 0)) - reach + 1, 0)
        stop = np.where(reach < top, zero(np.minimum(reach, max(0, top - 1))) - reach, self.n)
        beyond = high > top
        return np.where(beyond, self.n, start), np.where(beyond, self.n, stop)

    def next_geq(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position in [lo, hi) whose value is at least the wanted one (hi if there is none), and whether it is that
        one, for many at once: the upper half leads to the positions that share it, the lower bits are searched there."""
        lo, hi, values = (np.asarray(x, dtype=np.int64) for x in (lo, hi, values))
        if not self.n or not len(values):
            return lo.copy(), np.zeros(len(lo), dtype=bool)
        start, stop = self._bucket(values >> self.low_bits)
        low = values & ((1 << self.low_bits) - 1)
        a, b = np.clip(start, lo, hi), np.clip(stop, lo, hi)
        end, at = b.copy(), np.flatnonzero(a < b)
        while len(at):
            mid = (a[at] + b[at]) // 2
            less = self._lows(mid) < low[at]
            a[at] = np.where(less, mid + 1, a[at])
            b[at] = np.where(less, b[at], mid)
            at = at[a[at] < b[at]]
        same = np.zeros(len(a), dtype=bool)
        inside = np.flatnonzero(a < end)
        same[inside] = self._lows(a[inside]) == low[inside]
        return a, same


class Quantised:
    """Logarithms as codes of two bytes on one grid for all models: multiples of STEP from LOWEST on, so that no number from
    LOWEST to LOWEST + 65535 STEP is off by more than STEP / 2; others become the nearest of these."""

    STEP, LOWEST = 1 / 2048, -24.0

    def __init__(self, values: np.ndarray, store: Mapped | None = None):
        codes = np.clip(np.rint((np.asarray(values, dtype=np.float64) - self.LOWEST) / self.STEP), 0, 65535).astype(np.uint16)
        self.codes = store.add(codes) if store else codes

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.codes[at] * self.STEP + self.LOWEST


class NgramTrie:
    """N-grams of word numbers below `words`, level by level. An n-gram's parent is its position on the level before;
    children of a parent lie together, and an Elias-Fano sequence of parent * width + child keeps them in order. From
    level 3 on, a child is written relative to its shorter context: as its place among the successors of the n-gram's
    suffix, which is far smaller than a word number. Pointers to each parent's first child are a sequence too.
    """

    def __init__(self, words: int, grams: list[np.ndarray], probabilities: list[np.ndarray], backoffs: list[np.ndarray]):
        """grams[k]: rows of k + 2 word numbers, sorted, with their suffixes on the level before. probabilities[k] goes
        with grams[k]; backoffs[0] with words, backoffs[k] with grams[k - 1]."""
        self.store = Mapped()
        self.words, self.keys, self.pointers, self.width = words, [], [], []
        self.probability = [Quantised(p, self.store) for p in probabilities]
        self.backoff = [Quantised(b, self.store) for b in backoffs]
        parents = words
        for g in grams:
            k = g.shape[1]
            parent = self.find(g[:, :-1]) if k > 2 else g[:, 0].astype(np.int64)
            child = g[:, -1].astype(np.int64) if k == 2 else self._relative(g)
            width = words if k == 2 else int(child.max(initial=0)) + 1
            count = np.bincount(parent, minlength=parents)
            self.pointers.append(EliasFano(np.concatenate(([0], np.cumsum(count))), self.store))
            self.keys.append(EliasFano(parent * width + child, self.store))
            self.width.append(width)
            parents = len(g)

    def _relative(self, grams: np.ndarray) -> np.ndarray:
        """Place of each n-gram's last word among the successors of its suffix; -1 if it isn't one of them."""
        k = grams.shape[1]
        whole = self.find(grams[:, 1:])
        context = grams[:, 1].astype(np.int64) if k == 3 else self.find(grams[:, 1:-1])
        return self.place(k - 3, context, whole)

    def place(self, level: int, parent: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of positions `at` of a level (from 0) among their parents' children; -1 where either is -1."""
        start = self.pointers[level].take(np.maximum(parent, 0))
        return np.where((at >= 0) & (parent >= 0), at - start, -1)

    def child(self, level: int, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Position of each parent's child on a level (from 0), or -1: the parent's pointers bound a successor search."""
        width, out = self.width[level], np.full(len(parent), -1, dtype=np.int64)
        sound = np.flatnonzero((parent >= 0) & (child >= 0) & (child < width))
        own, keys = parent[sound], self.keys[level]
        lo, hi = self.pointers[level].take(own), self.pointers[level].take(own + 1)
        value = own * width + child[sound]
        at, same = keys.next_geq(lo, hi, value)
        out[sound[same]] = at[same]
        return out

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Position of each n-gram (rows of word numbers, in any order) on its level, or -1."""
        k = grams.shape[1]
        if k == 1:
            return grams[:, 0].astype(np.int64)
        parent = self.find(grams[:, :-1])
        return self.child(k - 2, parent, grams[:, -1].astype(np.int64) if k == 2 else self._relative(grams))
