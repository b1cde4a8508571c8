"""Scoring texts with a trigram language model in Elias-Fano tries, with absolute discounting that backs off to bigrams
and then to discounted word frequencies, where unknown words are one class.

Scale: the model grows with the corpus and is never in one place. Word counts and tries are dealt to shards, tries by the
hash of a token's immediate context (the word before it), so that a shard has all bigrams and trigrams that end a context
with that word. There are as many shards as SHARD_TOKENS asks for, each in a task of its own. Texts' occurrences travel to the
shards in packed rows, where they are counted and tries are built in memory-mapped levels. A text's score is a sum of
what shards return for it. Held-out texts' n-grams are looked up by successor search among their context's children; those
of training texts stand at positions known from building. Contexts of more than SPLIT occurrences are dealt to
several shards by a hash of their next word, on which no score depends: logarithms are added up by text, so that
each is added where its counts are. c(t u) of a dealt context u is known where t's successors are; what the back-off of t u
and of u needs is summed from all of u's shards, beside the word counts, and asked for there by texts that back off.
Sent to all executors are only words of a share of TOP or more of the corpus, which are 1 / TOP at most.

What the model is, exactly, at any number of shards: with c(w), N, V from the training texts' tokens, D1 = n1 / (n1 + 2 n2)
from how many words occur once and twice, and D2, D3 parameters,
  P(w) = (c(w) - D1) / N, and D1 V / N for the class of unknown words;
  P(w | u) = (c(u w) - D2) / c(u) for a bigram of the training texts, else b(u) P(w), with
  b(u) = D2 * successors(u) / c(u) / (1 - sum of P over successors of u among the words sent to all): slightly less
  than the mass there is, never more;
  P(w | t u) = (c(t u w) - D3) / c(t u) for a trigram of the training texts, else b(t u) P(w | u), with
  b(t u) = D3 * successors(t u) / c(t u) / (1 - sum of P(. | u) over successors of t u).
An unknown context has b = 1. This holds for contexts of any size.
Probabilities and b are quantised on one grid of 1 / 2048 decade, so that a token is off by a thousandth of a decade at
most. (A shard is counted and looked up in pieces of its contexts, one after the other, so that only a piece is ever unpacked.)
"""

from __future__ import annotations


from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import LAST_ID, parts, remainder, ship, stored, table, words
from tarn.llm.elias_fano import NgramTrie, Quantised
from tarn.llm.packing import Numbers, by_group, pack, small, unpack

SHARD_TOKENS, PIECE_TOKENS, BATCH_TOKENS, SPLIT, TOP = 4_000_000, 400_000, 2_000_000, 400_000, 1e-5
#: Discounts of bigrams and trigrams.
D2, D3 = 0.8, 0.85
#: Begin and end of a text: hashes of strings that hold a blank and so are no words.
BEGIN, END = (xxhash.xxh64_intdigest(s) >> 1 for s in (b" begin", b" end"))
#: Instead of a batch: rows of what a shard tells of dealt contexts, and of word counts.
TOLD, COUNTS = -2, -1


def hashes_of(numbers: Numbers) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in numbers), dtype=np.int64, count=len(numbers))


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows shard, tokens (of all texts), docs, n, words, once, twice (of training texts) and data: sorted hashes and counts."""
    n = parts(texts.sparkSession)

    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def count(batches):
        numbers, got, every, docs, size = Numbers(), [], 0, 0, 0

        def flush():
            hashes = np.concatenate((hashes_of(numbers), [END]))
            counts = np.concatenate((np.bincount(np.concatenate([*got, np.zeros(0, dtype=np.int32)]), minlength=len(numbers)), [docs]))
            hashes, counts = hashes[counts > 0], counts[counts > 0]
            out = [(g, 0, 0, pack(hashes[at], small(counts[at]))) for g, at in by_group(hashes % n, n)]
            out.append((every % n, every, docs, pack(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["shard", "tokens", "docs", "data"])

        for batch in batches:
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held").to_pylist()):
                ws = words(text)
                every += len(ws) + 1
                if not held:
                    docs += 1
                    size += len(ws)
                    got.append(np.fromiter(map(numbers.__getitem__, ws), dtype=np.int32, count=len(ws)))
                    if size >= BATCH_TOKENS:
                        yield flush()
                        numbers, got, every, docs, size = Numbers(), [], 0, 0, 0
        yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [unpack(d) for d in pdf["data"]]
        hashes, inverse = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in pairs]), minlength=len(hashes)).astype(np.int64)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].values, "tokens": [pdf["tokens"].sum()], "docs": [pdf["docs"].sum()], "n": [counts.sum()], "words": [len(hashes)], "once": [(counts == 1).sum()], "twice": [(counts == 2).sum()], "data": [pack(hashes, small(counts))]})

    rows = texts.mapInArrow(count, "shard int, tokens long, docs long, data binary")
    return rows.groupBy("shard").applyInPandas(merge, "shard int, tokens long, docs long, n long, words long, once long, twice long, data binary")


class Words:
    """What every task knows: totals, and the words (and contexts) frequent enough to be sent to all."""

    def __init__(self, totals: dict, hashes: np.ndarray, counts: np.ndarray):
        self.n, self.v, self.docs = totals["n"], totals["words"], totals["docs"]
        self.shards = self.number(totals)
        self.discount = discount(totals["once"], totals["twice"])
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.unknown = np.log10(max(self.discount * self.v, 1e-9) / self.n) if self.n else 0.0
        contexts = np.concatenate((self.hashes, [BEGIN]))
        seen = np.concatenate((self.counts, [self.docs]))
        order = np.argsort(contexts)
        contexts, seen = contexts[order], seen[order]
        # the training texts' share of occurrences is what is known here; SPLIT is about all of them
        every = seen * max(1, totals["tokens"]) // max(1, self.n)
        split = (every > SPLIT) & (contexts != END)
        self.split, self.split_count, self.split_parts = contexts[split], seen[split], -(-every[split] // SPLIT)

    @staticmethod
    def number(totals: dict) -> int:
        """Of shards of contexts."""
        return max(1, -(-totals["tokens"] // SHARD_TOKENS))

    def split_at(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each context among those dealt to several shards, or -1."""
        if not len(self.split):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.split, hashes), len(self.split) - 1)
        return np.where(self.split[at] == hashes, at, -1)

    def dealt(self, hashes: np.ndarray) -> np.ndarray:
        """Over how many shards each context is dealt."""
        out, at = np.ones(len(hashes), dtype=np.int64), self.split_at(hashes)
        out[at >= 0] = self.split_parts[at[at >= 0]]
        return out

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts - self.discount) / max(1, self.n)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among those sent to all, and their probability (0 for others)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        return same, np.where(same, self.probability(self.counts[at]), 0.0)


def spread(hashes: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """A number for each context and part of it, the hash itself for part 0."""
    x = hashes.astype(np.uint64) + sub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def history_key(before: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A number for each pair of words."""
    x = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + context.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


class Batch:
    """Texts of one task, packed into a row for each shard that their occurrences (two words of context, next word) go to."""

    def __init__(self, common: Words):
        self.common = common
        self.numbers, self.texts, self.ids, self.held, self.tokens, self.digest = Numbers(), [], [], [], 0, xxhash.xxh3_64()

    def add(self, doc_id: int, text: str | None, held: bool) -> None:
        ws = words(text)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, ws), dtype=np.int32, count=len(ws)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.tokens += len(ws) + 1
        self.digest.update(repr((doc_id, held)).encode() + (text or "").encode("utf-8", "surrogatepass"))

    def rows(self, place: int):
        """Rows shard, batch, kind (0: occurrences, 1: the texts' ids and lengths), data. A batch is named by its place and
        what it holds, so that one whose rows come in another order when a task is run again is not taken for the same."""
        c, sent = self.common, 0
        self.digest.update(str(place).encode())
        batch_id = self.digest.intdigest() >> 1
        # training texts first, so that one number says which are
        order = np.argsort(self.held, kind="stable")
        texts, ids, trained = [self.texts[i] for i in order], np.array(self.ids, dtype=np.int64)[order], len(order) - sum(self.held)
        hashes = np.concatenate((hashes_of(self.numbers), [BEGIN, END]))
        begin, end = len(hashes) - 2, len(hashes) - 1
        size = np.array([len(t) + 1 for t in texts])
        last = np.cumsum(size) - 1
        nxt = np.full(self.tokens, end, dtype=np.int32)
        inside = np.ones(self.tokens, dtype=bool)
        inside[last] = False
        nxt[inside] = np.concatenate(texts)
        cur = np.empty(self.tokens, dtype=np.int32)
        cur[1:] = nxt[:-1]
        first = last - size + 1
        cur[first] = begin
        prev = np.empty(self.tokens, dtype=np.int32)
        prev[1:] = cur[:-1]
        prev[first] = begin
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        dealt, shard = c.dealt(hashes), np.empty(self.tokens, dtype=np.int32)
        for at in range(0, self.tokens, 1 << 17):  # in steps, as hashes of all occurrences take much memory
            u, w = cur[at : at + (1 << 17)], nxt[at : at + (1 << 17)]
            shard[at : at + (1 << 17)] = spread(hashes[u], hashes[w] % dealt[u]) % np.uint64(c.shards)
        for g, at in by_group(shard, c.shards):
            sent += 1
            cw, ci = np.unique(cur[at], return_inverse=True)
            ow, oi = np.unique(np.concatenate((prev[at], nxt[at])), return_inverse=True)
            yield g, batch_id, 0, pack(hashes[cw], small(ci), hashes[ow], small(oi[: len(at)]), small(oi[len(at) :]), small(np.diff(doc[at], prepend=0)), np.array([trained]))
        yield int(batch_id % c.shards), batch_id, 1, pack(ids, np.array([trained, sent]), small(size))


def occurrences(texts: DataFrame, common) -> DataFrame:
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        batch = Batch(common.value)
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]

        def flush():
            nonlocal batch, seq
            if batch.ids:
                for row in batch.rows((task << 24) + seq):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["shard", "batch", "kind", "data"])
            batch, seq = Batch(common.value), seq + 1

        for part in batches:
            for at in range(0, part.num_rows, 200):
                piece = part.slice(at, 200)
                for doc_id, text, held in zip(*(piece.column(c).to_pylist() for c in ("own", "text", "held"))):
                    batch.add(doc_id, text, held)
                    if batch.tokens >= BATCH_TOKENS:
                        yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "shard int, batch long, kind int, data binary")


PARTIAL = "batch long, target int, data binary"


def back_off(discount: float, more: np.ndarray, left: np.ndarray) -> np.ndarray:
    return np.log10(discount * more / left)


def back_off_history(more: np.ndarray, after: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 of b(t u) c(t u) / c(u), from the successors of t u and the sum of c(u w) over them."""
    return back_off(D3, more, np.maximum(count - after + D2 * more, 1e-9 * count))


class BackOffs:
    """Of contexts dealt to several shards and of histories that end in them, from what the shards tell."""

    def __init__(self, told: list[list[np.ndarray]], c: Words):
        # keys are sorted; some at a time, as sums of all take much memory
        pieces = -(-sum(len(t[0]) for t in told) // PIECE_TOKENS)
        inner = np.array([(i << 63) // pieces for i in range(1, pieces)], dtype=np.int64)
        edges = [[0, *np.searchsorted(t[0], inner), len(t[0])] for t in told]
        all_keys, codes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint16)]
        for i in range(pieces):
            keys, of, more, after = (np.concatenate([t[k][e[i] : e[i + 1]] for t, e in zip(told, edges)]) for k in range(4))
            keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            more, after = (np.bincount(inverse, weights=x, minlength=len(keys)) for x in (more, after))
            all_keys.append(keys)
            codes.append(Quantised(back_off_history(more, after, c.split_count[of[first]])).codes)
        self.keys, self.histories = np.concatenate(all_keys), Quantised(np.zeros(0))
        self.histories.codes = np.concatenate(codes)
        at, more2, taken = (np.concatenate([np.zeros(0, dtype=np.int64), *(t[k] for t in told)]) for k in (4, 5, 6))
        # in a fixed order, so that a repeated run gives the same bits
        order = np.lexsort((taken, at))
        at, more2, taken = (np.bincount(at[order], weights=x[order], minlength=len(c.split)) for x in (np.ones(len(at)), more2, taken))
        with np.errstate(divide="ignore"):
            self.contexts = Quantised(np.where(at > 0, back_off(D2, more2, c.split_count * np.maximum(1 - taken, 1e-9)), 0.0))

    def of_histories(self, keys: np.ndarray) -> np.ndarray:
        """0 for those that no training text has."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.histories.take(at), 0.0)


def piece_scores(prev: np.ndarray, cur: np.ndarray, nxt: np.ndarray, train: np.ndarray, c: Words) -> tuple[np.ndarray, ...]:
    """For occurrences of some contexts, all there are: count their bigrams and trigrams in training texts, build the trie,
    look each occurrence up. Returns log10 score, log10 (count of the context as a word + 1), whether that count is above 0
    (both 0 for the begin of a text), whether the next word's frequency is still to be added to the score, the key of the
    history and the place of the dealt context whose back-off is (-1: none); and what is told of dealt contexts."""
    contexts, cur = np.unique(cur, return_inverse=True)
    prevs, prev = np.unique(prev, return_inverse=True)
    nexts, nxt = np.unique(nxt, return_inverse=True)
    dealt, split = c.dealt(contexts), c.split_at(contexts)
    most = int(dealt.max())
    # a node is a context, or the part of its next words that came here
    nodes, node = np.unique(cur * most + nexts[nxt] % dealt[cur], return_inverse=True)
    owner = nodes // most
    n_prev, n_node, n_next = len(prevs), len(nodes), len(nexts)
    count = lambda which, n: np.bincount(which, weights=train, minlength=n).astype(np.int64)
    pair, in_pair = np.unique(node * n_next + nxt, return_inverse=True)
    history, in_history = np.unique(prev * n_node + node, return_inverse=True)
    triple, first, in_triple = np.unique(in_history * n_next + nxt, return_index=True, return_inverse=True)
    c2, ch, c3, total = count(in_pair, len(pair)), count(in_history, len(history)), count(in_triple, len(triple)), count(node, n_node).astype(float)
    of2, succ2, of3, suffix = pair // n_next, pair % n_next, triple // n_next, in_pair[first]
    own = count(cur, len(contexts))
    own[split >= 0] = c.split_count[split[split >= 0]]
    part = split[owner] >= 0
    total[part] = own[owner[part]]
    seen2, seen3, seen_h = c2 > 0, c3 > 0, ch > 0
    d2, d3 = D2, D3
    # bigrams
    same, p = c.known(nexts)
    more2 = np.bincount(of2[seen2], minlength=n_node)
    taken = np.bincount(of2[seen2], weights=p[succ2[seen2]], minlength=n_node)
    left = np.maximum(1 - taken, 1e-9)
    p2 = np.where(seen2, (c2 - d2) / np.maximum(total[of2], 1), 0.0)
    # trigrams; values are relative to the context's count, and its ratio to the history's is added to them
    of_h = history % n_node
    more3 = np.bincount(of3[seen3], minlength=len(history))
    after3 = np.bincount(of3[seen3], weights=c2[suffix[seen3]], minlength=len(history))
    with np.errstate(divide="ignore", invalid="ignore"):
        back2 = np.where(more2 > 0, back_off(d2, more2, total * left), 0.0)
        back3 = np.where(part[of_h], 0.0, back_off_history(more3, after3, total[of_h]))[seen_h]
        value2, value3 = np.log10(p2[seen2]), np.log10((c3 - d3) / total[of_h[of3]])[seen3]
        ratio = np.where(seen_h & ~part[of_h], np.log10(total[of_h] / ch), 0.0)
        # of a history that ends in a dealt context, the ratio is known here, where its last word is the next one
        ends = c.split_at(nexts)[succ2]
        ending = np.where((ends >= 0) & seen2, np.log10(c.split_count[ends] / c2), 0.0) if len(c.split) else np.zeros(len(pair))
    back2[part] = 0.0
    # numbers in the trie: words before, then nodes, then next words; its second level has pairs of either kind
    before = np.stack((history // n_node, n_prev + of_h), 1)
    after = np.stack((n_prev + of2, n_prev + n_node + succ2), 1)
    whole = np.concatenate((before[of3], (n_prev + n_node + triple % n_next)[:, None]), 1)
    back1 = np.zeros(n_prev + n_node + n_next)
    back1[n_prev : n_prev + n_node] = back2
    trie = NgramTrie(len(back1), [np.concatenate((before[seen_h], after[seen2])), whole[seen3]], [np.concatenate((np.zeros(len(back3)), value2)), value3], [back1, np.concatenate((back3, np.zeros(len(value2))))])
    # positions of the training texts' n-grams are known from building; held-out texts' are searched for
    asked2, asked3, asked_h = np.zeros(len(pair), dtype=bool), np.zeros(len(triple), dtype=bool), np.zeros(len(history), dtype=bool)
    asked2[in_pair[~train]] = asked3[in_triple[~train]] = asked_h[in_history[~train]] = True
    at_h = np.where(seen_h & ~asked_h, np.cumsum(seen_h) - 1, -1)
    at_h[asked_h] = trie.find(before[asked_h])
    at2 = np.where(seen2 & ~asked2, len(back3) + np.cumsum(seen2) - 1, -1)
    at2[asked2] = trie.find(after[asked2])
    at3 = np.where(seen3 & ~asked3, np.cumsum(seen3) - 1, -1)
    node3, at_pair = after[suffix[asked3], 0], at2[suffix[asked3]]
    at3[asked3] = trie.child(1, at_h[of3[asked3]], trie.place(0, node3, at_pair))
    # frequent words' own probability is known here; for others it is added where their counts are
    score = trie.backoff[0].take(after[:, 0]) + np.where(same, np.log10(np.where(same, p, 1.0)), 0.0)[succ2]
    ask = ((at2 < 0) & ~same[succ2])[suffix] & (at3 < 0)
    if seen2.any():
        score = np.where(at2 >= 0, trie.probability[0].take(np.maximum(at2, 0)), score)[suffix]
        score = score + np.where(at_h >= 0, trie.backoff[1].take(np.maximum(at_h, 0)), 0.0)[of3]
        score = np.where(at3 >= 0, trie.probability[1].take(np.maximum(at3, 0)), score)
    else:
        score = score[suffix]
    score = score + ratio[of3] + ending[suffix]
    key = history_key(prevs[history // n_node], contexts[owner[of_h]])
    backs = part[of_h[of3]] & (at3 < 0)
    ask3, ask2 = np.where(backs, key[of3], -1), np.where(backs & (at2[suffix] < 0), split[owner[of_h[of3]]], -1)
    at, here = np.flatnonzero(seen_h & part[of_h]), np.flatnonzero(part & (more2 > 0))
    told = key[at], split[owner[of_h[at]]], more3[at], after3[at].astype(np.int64), split[owner[here]], more2[here], taken[here]
    is_word = contexts != BEGIN
    return score[in_triple], np.where(is_word, np.log10(own + 1.0), 0.0)[cur], (is_word & (own > 0))[cur], ask[in_triple], ask3[in_triple], ask2[in_triple], told


def by_groups(hashes: list[np.ndarray], groups: int):
    """Each group that occurs among some of the hashes, with its places in each."""
    found, none = [dict(by_group(h % groups, groups)) for h in hashes], np.zeros(0, dtype=np.int32)
    for g in sorted(set().union(*found)):
        yield g, [f.get(g, none) for f in found]


def shard_model(rows: list[tuple[int, bytes]], c: Words, word_shards: int):
    """Score a shard's occurrences, piece by piece. Yields rows batch, target, data: target -1 has sums for texts, from 0 on
    occurrences whose next word's frequency, or whose back-off, that word shard has to add; batch TOLD what it adds them from."""
    rows = [(b, *unpack(d)) for b, d in rows]
    pieces = max(1, -(-sum(len(r[2]) for r in rows) // PIECE_TOKENS))
    state, told = [], []
    for b, cw, ci, ow, pi, ni, step, trained in rows:
        sub = ow[ni] % c.dealt(cw)[ci]
        piece = (spread(cw[ci], sub) // np.uint64(c.shards) % np.uint64(pieces)).astype(np.int32)
        order = np.argsort(piece, kind="stable").astype(np.int32)
        edges = np.searchsorted(piece[order], np.arange(pieces + 1))
        # texts are numbered among those that have occurrences here, so that memory grows with these alone
        ids, new = np.cumsum(step, dtype=np.int64).astype(np.int32), step > 0
        new[0] = True
        ids, doc = ids[new], np.cumsum(new, dtype=np.int32) - 1
        state.append((order, edges, doc, ids < trained[0], np.zeros((3, len(ids))), ids, []))
    for p in range(pieces):
        at = [s[0][s[1][p] : s[1][p + 1]] for s in state]
        if not sum(map(len, at)):
            continue
        cur = np.concatenate([r[1][r[2][i]] for r, i in zip(rows, at)])
        prev = np.concatenate([r[3][r[4][i]] for r, i in zip(rows, at)])
        nxt = np.concatenate([r[3][r[5][i]] for r, i in zip(rows, at)])
        train = np.concatenate([s[3][s[2][i]] for s, i in zip(state, at)])
        score, base, known, ask, ask3, ask2, tell = piece_scores(prev, cur, nxt, train, c)
        told.append(tell)
        lo = 0
        for s, i in zip(state, at):
            hi, doc, ids = lo + len(i), s[2][i], s[5]
            for k, w in enumerate((score, base, known)):
                s[4][k] += np.bincount(doc, weights=w[lo:hi], minlength=s[4].shape[1])
            wanted, keys, places = np.flatnonzero(ask[lo:hi]), np.flatnonzero(ask3[lo:hi] >= 0), np.flatnonzero(ask2[lo:hi] >= 0)
            s[6].append((nxt[lo:hi][wanted], ids[doc[wanted]], ask3[lo:hi][keys], ids[doc[keys]], ask2[lo:hi][places], ids[doc[places]]))
            lo = hi
    for (b, *_), (*_, sums, ids, asked) in zip(rows, state):
        yield b, -1, pack(small(np.diff(ids.astype(np.int64), prepend=0)), sums[0], sums[1], small(sums[2].astype(np.int64)))
        asked = [np.concatenate(x) for x in zip(*asked)]
        for g, at in by_groups(asked[::2], word_shards):
            yield b, g, pack(*(x for h, doc, i in zip(asked[::2], asked[1::2], at) for x in (h[i], small(doc[i]))))
    keys, of, more, after, *contexts = (np.concatenate(x) for x in zip(*told))
    keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    more, after = (np.bincount(inverse, weights=x, minlength=len(keys)).astype(np.int64) for x in (more, after))
    of, (place, more2, taken) = of[first], contexts
    for g, (i, k) in by_groups([keys, place], word_shards):
        yield TOLD, g, pack(keys[i], small(of[i]), small(more[i]), small(after[i]), small(place[k]), small(more2[k]), taken[k])


def word_model(asked: bytes, hashes: np.ndarray, log: Quantised | None, backs: BackOffs, c: Words) -> bytes:
    """The log frequency of the words, and the back-offs, that a batch's texts asked for, summed by text."""
    wanted, doc, keys, doc3, places, doc2 = unpack(asked)
    value = np.full(len(wanted), c.unknown)
    if log:
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        same = hashes[at] == wanted
        value[same] = log.take(at[same])
    value = np.concatenate((value, backs.of_histories(keys), backs.contexts.take(places)))
    ids, where = np.unique(np.concatenate((doc, doc3, doc2)), return_inverse=True)
    zero = np.zeros(len(ids))
    return pack(small(np.diff(ids.astype(np.int64), prepend=0)), np.bincount(where, weights=value), zero, small(zero.astype(np.int64)))


def total_scores(pdf: pd.DataFrame, c: Words) -> pd.DataFrame:
    """One batch's sums."""
    own = next((d for t, d in zip(pdf["target"], pdf["data"]) if t == -2), None)
    ids, (trained, sent), size = unpack(own) if own else ([], (0, -1), [])
    if sent != (pdf["target"] == -1).sum():
        raise RuntimeError("a batch lacks sums of shards: its input came in another order when a task was run again")
    held = np.arange(len(ids)) >= trained
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.full(len(ids), int(c.docs > 0), dtype=np.int64)
    # sums are added in a fixed order, so that a repeated run gives the same bits
    for d in sorted(d for t, d in zip(pdf["target"], pdf["data"]) if t != -2):
        step, s, b, k = unpack(d)
        at = np.cumsum(step, dtype=np.int64)
        score[at] += s
        base[at] += b
        known[at] += k.astype(np.int64)
    tokens = size.astype(np.int64)
    base += np.log10(c.docs + 1.0) - tokens * np.log10(c.n + c.v + 1.0)
    return pd.DataFrame({"own": ids, "held_out": held, "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})


def language_model_scores(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    held: a condition; rows for which it holds are only scored, the others are learnt from too. A null text is empty: one
    end token. Repeated rows are each learnt from and scored; null ids are kept. Without training texts every token is
    of the unknown class, whose probability is then 1. Extra columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    texts = docs.select(own.alias("own"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    counts = stored(word_counts(texts), "word-counts")
    totals = {k: v or 0 for k, v in counts.agg(*(F.sum(k).alias(k) for k in ("tokens", "docs", "n", "words", "once", "twice"))).first().asDict().items()}
    least = max(1, int(totals["n"] * TOP))

    def frequent(batches):
        for batch in batches:
            for d in batch.column("data").to_pylist():
                h, n = unpack(d)
                yield pa.RecordBatch.from_arrays([pa.array(h[n >= least]), pa.array(n[n >= least].astype(np.int64))], ["h", "n"])

    top = counts.select("data").mapInArrow(frequent, "h long, n long").toPandas()  # 1 / TOP rows at most
    common = spark.sparkContext.broadcast(Words(totals, top["h"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)))
    n = parts(spark)
    types = [pa.int64(), pa.int32(), pa.binary()]

    def together(rows):
        """Record batches of some rows each."""
        while some := list(islice(rows, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), types)], ["batch", "target", "data"])

    def score(batches):
        rows = []
        for batch in batches:
            for b, kind, data in zip(*(batch.column(k).to_pylist() for k in ("batch", "kind", "data"))):
                if kind:
                    yield from together(iter([(b, -2, data)]))
                else:
                    rows.append((b, data))
        if rows:
            yield from together(shard_model(rows, common.value, n))

    def added_up(batches):
        hashes, log, told, backs, c = np.zeros(0, dtype=np.int64), None, [], None, common.value
        for batch in batches:  # what is told and the shard's counts come first
            for b, data in zip(batch.column("batch").to_pylist(), batch.column("data").to_pylist()):
                if b == TOLD:
                    told.append(unpack(data))
                elif b == COUNTS:
                    hashes, count = unpack(data)
                    log = Quantised(np.log10(c.probability(count.astype(np.int64)))) if len(hashes) else None
                else:
                    backs, told = backs or BackOffs(told, c), []
                    yield b, -3, word_model(data, hashes, log, backs, c)

    dealt = occurrences(texts, common).repartitionById(Words.number(totals), "shard")
    partial = stored(dealt.mapInArrow(score, PARTIAL), "partial")
    asked = partial.where("target >= 0").select("target", "batch", "data").union(counts.selectExpr("shard target", f"{COUNTS}L batch", "data"))
    added = asked.repartitionById(n, "target").sortWithinPartitions("batch").mapInArrow(lambda batches: together(added_up(batches)), PARTIAL)
    summed = partial.where("target < 0").union(added).groupBy("batch").applyInPandas(lambda pdf: total_scores(pdf, common.value), "own long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return summed.select(F.when(F.col("own") != LAST_ID, F.col("own")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op1_ngram_lm(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)
