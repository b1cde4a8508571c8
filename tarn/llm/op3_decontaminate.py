"""Benchmark decontamination. Pairs of words that stand at most two places apart in a test item and in a document are
seeds; a passage that holds enough seeds of an item is a candidate, and a Smith-Waterman alignment of item and passage
scores it, so that paraphrased and edited copies are found too.

Nothing that scores the threshold is lost. An alignment of s matches and of penalties c between neighbouring matches
scores 2 s - sum(c), and a pair of neighbouring matches that lie further than two places apart costs c >= 2. So the
pairs that are seeds (2 points where the words are neighbours on both sides, else 1) gather 2 * threshold * m - 2
points or more for an item of m words (`need`), and they begin at threshold * m - 1 places of the item or more: any
larger set of the item's other places has one of them. The rarest such set triggers a comparison (`choose`).

Scale: documents are read twice (to count in how many documents each pair occurs, and to align) and never shuffled;
each document is judged where it is read, so a passage that a third of all documents hold costs no task more than
another. Test items are taken in blocks of ITEM_CHARS characters, and only a block's pairs are sent to executors.
Which pairs are rare is relative to the other pairs of the same item: an item that is everywhere keeps its seeds.
"""

from __future__ import annotations

import math
import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ship, table

APART, MATCH, MISMATCH, GAP, THRESHOLD, ITEM_CHARS = 2, 2, -1, 1, 0.5, 8_000_000
#: Items of up to so many words are looked up word for word: one word of two would score the threshold by itself.
BRIEF = 2
_SPACED = bytes(32 if chr(c) in string.punctuation or c < 32 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score and its end in item and passage (exclusive). Row by row; a running maximum gives
    the gaps along the passage."""
    slope = GAP * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        row = np.zeros_like(above)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] - GAP))
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
        above = row
    return best


class Items:
    """A block of test items: ids of their words, pairs of words, and which pairs trigger a comparison with which items."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        """rows: id, copies and text of items whose words differ."""
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.copies, self.words, brief = [], [], [], []
        for item_id, copies, text in rows:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], dtype=np.int64)
            if len(words) <= BRIEF:
                brief.append((words, item_id, copies))
                continue
            self.ids.append(item_id)
            self.copies.append(copies)
            self.words.append(words)
        self.base = len(self.vocabulary) + 1
        # a brief item is a number: its word, or its pair of words
        self.brief = [{int(w[0] if n == 1 else w[0] * self.base + w[1]): (i, c) for w, i, c in brief if len(w) == n} for n in (1, 2)]
        found = [self.codes(w, d) for w in self.words for d in range(1, APART + 1)]
        self.grams = np.unique(np.concatenate([*found, np.zeros(0, dtype=np.int64)]))
        found = [np.searchsorted(self.grams, f) for f in found]
        self.of = [found[at : at + APART] for at in range(0, len(found), APART)]  # an item's pairs by distance and place

    def codes(self, ids: np.ndarray, apart: int) -> np.ndarray:
        return ids[:-apart] * self.base + ids[apart:]

    def choose(self, seen: np.ndarray, threshold: float) -> None:
        """The places of an item whose pairs the fewest documents hold, just so many that no alignment of `threshold`
        or more can do without all of them."""
        owners, triggers = [], []
        for i, own in enumerate(self.of):
            held = seen[own[0]].copy()
            for d in range(1, APART):
                held[: len(own[d])] += seen[own[d]]
            places = np.argsort(held, kind="stable")[: len(held) - max(1, math.ceil(threshold * len(self.words[i]) - 1 - 1e-9)) + 1]
            mine = np.unique(np.concatenate([o[places[places < len(o)]] for o in own]))
            triggers.append(mine)
            owners.append(np.full(len(mine), i))
        triggers, owners = np.concatenate([*triggers, np.zeros(0, dtype=np.int64)]), np.concatenate([*owners, np.zeros(0, dtype=np.int64)])
        order = np.argsort(triggers, kind="stable")
        self.owners = owners[order]
        self.first = np.searchsorted(triggers[order], np.arange(len(self.grams) + 1))
        self.seed = np.diff(self.first) > 0

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)

    def pairs(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each distance, the pair of the block that begins at each place of a document; -1: none."""
        out = []
        for d in range(1, APART + 1):
            gram = np.full(len(ids), -1, dtype=np.int64)
            if len(ids) > d and len(self.grams):
                at = np.nonzero((ids[:-d] > 0) & (ids[d:] > 0))[0]
                code = ids[at] * self.base + ids[at + d]
                where = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
                same = self.grams[where] == code
                gram[at[same]] = where[same]
            out.append(gram)
        return out

    def points(self, i: int, pairs: list[np.ndarray]) -> np.ndarray:
        """The most that a seed of item i can add at each place of a passage."""
        own = np.concatenate(self.of[i])
        out = np.zeros(len(pairs[0]), dtype=np.int64)
        for gram in pairs:
            out[np.isin(gram, own)] = 1
        out[np.isin(pairs[0], self.of[i][0])] = 2
        return out

    def stand(self, ids: np.ndarray) -> list[tuple]:
        """Brief items that stand in a document word for word, as matches() returns them."""
        out = []
        for n, items in enumerate(self.brief, 1):
            if items and len(ids) >= n:
                codes = ids if n == 1 else np.where((ids[:-1] > 0) & (ids[1:] > 0), self.codes(ids, 1), -1)
                here, first = np.unique(codes, return_index=True)
                out += [(*items[c], 1.0, a, a + n - 1, n) for c, a in zip(here.tolist(), first.tolist()) if c in items]
        return out

    def matches(self, text: str | None, threshold: float) -> list[tuple]:
        """item, copies, score, first and last word in the document, aligned words: the best passage of each item."""
        ids = self.encode(text)
        pairs = self.pairs(ids)
        by: dict[int, list] = {}
        for gram in pairs:
            for a in np.nonzero(self.seed[gram] & (gram >= 0))[0].tolist() if len(self.seed) else []:
                for i in self.owners[self.first[gram[a]] : self.first[gram[a] + 1]].tolist():
                    by.setdefault(i, []).append(a)
        out = self.stand(ids)
        for i, found in by.items():
            item, m = self.words[i], len(self.words[i])
            found.sort()
            need = 2 * threshold * m - 2 - 1e-9
            reach = max(1, math.ceil((3 - 2 * threshold) * m))  # words of a passage that scores the threshold, at most
            best = (0,)
            start = 0
            for k in range(1, len(found) + 1):  # runs of triggers whose passages overlap
                if k < len(found) and found[k] - found[k - 1] <= reach:
                    continue
                lo, hi = max(0, found[start] - reach), min(len(ids), found[k - 1] + reach + 1)
                start = k
                total = np.concatenate(([0], np.cumsum(self.points(i, [g[lo:hi] for g in pairs]))))
                if (total[reach:] - total[:-reach] if len(total) > reach else total[-1:]).max() < need:
                    continue
                score, end_i, end_j = align(item, ids[lo:hi])
                if score > best[0]:
                    best = (score, lo, end_i, end_j)
            if best[0] and best[0] >= threshold * MATCH * m:
                score, lo, end_i, end_j = best
                back = align(item[:end_i][::-1], ids[lo : lo + end_j][::-1])
                out.append((self.ids[i], self.copies[i], score / (MATCH * m), lo + end_j - back[2], lo + end_j - 1, back[1]))
        return out


def merged(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """i, n, t: items of equal words as one, with their smallest id, their number and their words."""

    def read(batches):
        for batch in batches:
            found = [tokens(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(ws).decode("utf-8", "surrogatepass") for ws in found], pa.string()), pa.array([len(ws) for ws in found], pa.int64())], ["i", "t", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    return rows.mapInArrow(read, "i long, t string, words long").where("words > 0").groupBy("t").agg(F.min("i").alias("i"), F.count("*").alias("n")).select("i", "n", "t")


def blocks(items: DataFrame, item_id: str, item_text: str, limit: int):
    part, size = [], 0
    for r in merged(items, item_id, item_text).orderBy("i", "t").toLocalIterator():
        part.append((r["i"], r["n"], r["t"]))
        size += len(r["t"])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def ready_blocks(texts: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float, item_chars: int):
    """A broadcast block of items after the other, with the triggers chosen by how many of the texts hold each pair."""
    spark = texts.sparkSession
    for part in blocks(items, item_id, item_text, item_chars):
        block = Items(part)
        sent = spark.sparkContext.broadcast(block)

        def count(batches, sent=sent):
            b = sent.value
            seen = np.zeros(len(b.grams), dtype=np.int64)
            for batch in batches:
                for text in batch.column(0):
                    held = np.unique(np.concatenate(b.pairs(b.encode(text.as_py()))))
                    seen[held[held >= 0]] += 1
            some = np.nonzero(seen)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], ["gram", "docs"])

        counted = texts.select("text").mapInArrow(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
        seen = np.zeros(len(block.grams), dtype=np.int64)
        for r in counted.toLocalIterator():  # a row for each pair of the block at most
            seen[r["gram"]] = r["docs"]
        sent.destroy()
        block.choose(seen, threshold)
        yield spark.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Returns doc_id, item_id, item_copies, score, first_word, last_word, item_words: a row for each document and
    item whose alignment scores `threshold` or more (1: the item stands there word for word). Of several passages of the
    same score the first is reported.

    Items of equal words are one item, under their smallest id. Items of BRIEF words or fewer match where they stand word
    for word (score 1). Items without words, id or text match nothing; null and empty documents match nothing. A longer item
    for which a single word would score the threshold (threshold * words of 1 or less) still takes a pair of words. An
    alignment takes time as the item's words times the passage's, which are about twice as many. Repeated rows are
    each judged. Extra columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, item_copies long, score double, first_word long, last_word long, item_words long"
    found = []
    for ready in ready_blocks(texts, items, item_id, item_text, threshold, item_chars):

        def judge(batches, ready=ready):
            b = ready.value
            for batch in batches:
                rows = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1)) for m in b.matches(t.as_py(), threshold)]
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "item_copies", "score", "first_word", "last_word", "item_words"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        found.append(texts.mapInArrow(judge, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, item_chars: int = ITEM_CHARS) -> DataFrame:
    """docs without the rows for whose text contaminated() has a row. Rows are judged where they are read, each by its own
    text, so that nothing is shuffled and ids play no part."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    for ready in ready_blocks(docs.select(F.col(text_col).alias("text")), items, item_id, item_text, threshold, item_chars):

        def clean(batches, ready=ready):
            b = ready.value
            for batch in batches:
                yield batch.filter(pa.array([not b.matches(t.as_py(), threshold) for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
