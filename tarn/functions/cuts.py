"""Hashes of what is left of words without one or two letters, on arrays of words.

A text's hash is the sum of its letters' numbers times powers of BASE, so that of a text without some letters follows from sums of
the whole. Equal texts have equal hashes; pairs that meet by chance are told apart later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_BACK_2 = np.uint64(pow(_BASE, -2, 1 << 64))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Rows of keys made at once.
ROWS = 2048


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def cut_keys(words: list[str], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length: hashes of what is left of them without 0, 1 or 2 letters, and which word each is of. Of equal letters
    side by side the first ones go, which leaves the same texts."""
    n, m = len(words[0]), len(words)
    if letters > n:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    codes = np.array(words, f"<U{max(n, 1)}").view("<u4").reshape(m, -1)[:, :n].astype("u8")
    powers = np.array([pow(_BASE, i, 1 << 64) for i in range(n)], "u8")
    sums = np.zeros((m, n + 1), "u8")
    np.cumsum(mixed(codes + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
    first = np.ones((m, n), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    end = sums[:, n:]
    if letters == 0:
        h, kept = end, np.ones((m, 1), bool)
    elif letters == 1:
        h, kept = sums[:, :-1] + (end - sums[:, 1:]) * _BACK, first
    else:
        i, j = np.triu_indices(n, 1)
        h = sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _BACK + (end - sums[:, j + 1]) * _BACK_2
        kept = first[:, i] & (first[:, j] | (j == i + 1))
    return mixed(h + np.uint64(n - letters))[kept], np.nonzero(kept)[0]


def by_length(words: list[str | None], most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and words of each length up to `most`, at most ROWS at once."""
    sizes = np.array([-1 if w is None else len(w) for w in words])
    for n in np.unique(sizes[(sizes >= 0) & (sizes <= most)]):
        rows = np.flatnonzero(sizes == n)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, [words[r] for r in part]


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of 2^bits places in a filter."""
    return hashes & np.uint64((1 << bits) - 1), mixed(hashes) & np.uint64((1 << bits) - 1)


def held(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes a filter may hold: all that were put in, and a few others."""
    found = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        found &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & 1 == 1
    return found


def filling(most: int, bits: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places of whole words (one column) in a filter, as slice and place within it."""
    each = (1 << bits) // slices

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in by_length(batch.column(0).to_pylist(), most):
                at = np.unique(np.concatenate(places(cut_keys(words, 0)[0], bits))).astype("i8")
                yield pa.record_batch([pa.array((at // each).astype("i4")), pa.array((at % each).astype("i4"))], names=["slice", "at"])

    return filled


def slice_bits(each: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of one slice as bits."""

    def bits(rows: pa.Table) -> pa.Table:
        some = np.zeros(each, bool)
        some[rows["at"].to_numpy()] = True
        return pa.table({"slice": rows["slice"].slice(0, 1), "bits": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    return bits


def keyed(column: int, cuts: list[int], most: int, filters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with `meet`, for the word in a column: a key for each kind of cut (letters taken, by kind) and text that is left.
    filters: a broadcast of filter and bits, or None, for each kind: keys that it cannot hold are left out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in by_length(batch.column(column).to_pylist(), most):
                made = {}
                for kind, letters in enumerate(cuts):
                    if letters not in made:
                        made[letters] = cut_keys(words, letters)
                    h, of = made[letters]
                    if (known := filters[kind]) is not None:
                        bits, filled = known.value
                        kept = held(np.frombuffer(filled, "u1"), h, bits)
                        h, of = h[kept], of[kept]
                    if len(h):
                        meet = mixed(h + np.uint64((kind + 1) * int(_A) % (1 << 64))).view("i8")
                        yield pa.record_batch([*batch.take(pa.array(rows[of])).columns, pa.array(meet)], names=[*batch.schema.names, "meet"])

    return keys


def distance(a: str, b: str) -> int | None:
    """Edit distance with insertions and deletions of cost 1 and substitutions of cost 2, if it is 2 at most."""
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if a == b or gap > 2:
        return 0 if a == b else None
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if gap == 2:
        rest = iter(b[k:])
        return 2 if all(x in rest for x in a[k:]) else None
    if gap == 1:
        return 1 if a[k:] == b[k + 1 :] else None
    a, b = a[k:], b[k:]
    k = next(i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y)
    a, b = a[: len(a) - k], b[: len(b) - k]
    # the first letters differ, and so do the last: one of each goes at opposite ends
    return 2 if a[1:] == b[:-1] or a[:-1] == b[1:] else None


def judging(k: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows word, term, df: word, term, score of those at a distance of 2 at most with a Jaccard similarity of `least` or more."""

    def grams(text: str) -> list[str]:
        marked = f"^{text}$"
        return [marked[i : i + k] for i in range(len(marked) - k + 1)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, scores = [], []
            for row, (word, term, df) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if (d := distance(word, term)) is None:
                    continue
                own, bag = set(grams(word)), grams(term)
                shared = sum(g in own for g in bag)
                if not shared or (jaccard := shared / (len(own) + len(bag) - shared)) < least:
                    continue
                kept.append(row)
                scores.append(d / (max(df or 1, 1) * jaccard))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(scores, pa.float64())], names=["word", "term", "score"])

    return judged
