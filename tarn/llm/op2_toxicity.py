"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Fitting takes a bounded sample (LIMIT labelled rows of each class, weighted back to the classes' real shares): hashed
n-grams are counted by class in distributed passes, the FEATURES with the largest chi-square against the label are
kept, scaled by r = log of the smoothed ratio of their class frequencies, and a logistic regression is fitted on
presence * r. Scoring reads every text whole, in one pass without a shuffle; what is sent to the executors has a fixed
size (2^BUCKET_BITS weights).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import remainder, ship, stored, table
from tarn.llm.sampling import bounded_sample

LIMIT, FEATURES, BUCKET_BITS, ORDERS, THRESHOLD = 4000, 6000, 21, (5, 6, 7, 8), 0.3
#: Counts are smoothed by this much, so that rare n-grams have small ratios; a feature's chi-square is at least LEAST.
SMOOTH, LEAST = 5.0, 15.0
_BLANKS = re.compile(r"\s+")


def buckets(text: str | None) -> list[np.ndarray]:
    """Hash bucket of each n-gram of each order, of the lower-cased text with blanks collapsed and one at each end."""
    raw = np.frombuffer((" " + _BLANKS.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    out, rolled = [], raw
    for n in range(2, max(ORDERS) + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in ORDERS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(((mixed + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BUCKET_BITS))
    return out


def present(text: str | None, slot: np.ndarray) -> np.ndarray:
    """The model's features (slots from 1) that a text holds, each once."""
    found = [s[s > 0] for s in (slot[b] for b in buckets(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=slot.dtype)


class Model:
    """slot: feature of each bucket, 0 for none; weight: of each feature, weight[0] is the bias."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray):
        self.slot, self.weight = slot, weight

    def score(self, text: str | None) -> float:
        z = self.weight[0] + self.weight[present(text, self.slot)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _chi_square(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    n, seen = n_pos + n_neg, pos + neg
    top = n * (pos * (n_neg - neg) - neg * (n_pos - pos)) ** 2
    return top / np.maximum(seen * (n - seen) * n_pos * n_neg, 1)


def logistic(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, scale: np.ndarray, penalty: float = 1.0, rounds: int = 600) -> np.ndarray:
    """Weights (bias first) of an L2-penalised logistic regression on presence * scale, by accelerated gradients."""
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    col = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), np.diff(start))
    value = scale[col]
    # diagonal preconditioning: each weight's own curvature
    curve = 0.25 * np.concatenate(([weight.sum()], np.bincount(col, weights=weight[owner] * value**2, minlength=len(scale))[1:])) + penalty
    w, ahead, t = np.zeros(len(scale)), np.zeros(len(scale)), 1.0
    most = np.bincount(owner, minlength=len(rows)).max(initial=1)
    step = 1.0 / np.sqrt(most)

    def loss_grad(w):
        z = w[0] + np.bincount(owner, weights=w[col] * value, minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        e = weight * (p - label)
        g = np.bincount(col, weights=e[owner] * value, minlength=len(scale)) + penalty * w
        g[0] = e.sum()
        loss = -(weight * (label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12))).sum() + penalty / 2 * (w[1:] ** 2).sum()
        return loss, g

    best, best_w = np.inf, w
    for _ in range(rounds):
        loss, g = loss_grad(ahead)
        if loss < best:
            best, best_w = loss, ahead
        elif loss > 1.5 * best + 1:
            step, ahead, w, t = step / 2, best_w, best_w, 1.0
            continue
        new = ahead - step * g / curve
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return best_w


def fit(labelled: DataFrame, limit: int = LIMIT, features: int = FEATURES) -> Model:
    """Learn from columns text and label (0/1) of a bounded sample, whose `weight` column says what share a row stands for."""
    ship(labelled.sparkSession)
    size = 1 << BUCKET_BITS

    def count(batches):
        seen = np.zeros((2, size), dtype=np.int32)
        n = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = buckets(text)
                n[label] += 1
                if found:
                    seen[label][np.unique(np.concatenate(found))] += 1
        if n[0] + n[1]:
            yield pa.RecordBatch.from_pydict({"n": [n], "seen": [seen.tobytes()]}, schema=pa.schema([("n", pa.list_(pa.int64())), ("seen", pa.binary())]))

    seen, n = np.zeros((2, size), dtype=np.int64), np.zeros(2)
    for r in labelled.coalesce(6).mapInArrow(count, "n array<bigint>, seen binary").toLocalIterator():
        seen += np.frombuffer(r["seen"], dtype=np.int32).reshape(2, size)
        n += r["n"]
    if not n[0] or not n[1]:  # one class alone: its share is the score
        return Model(np.zeros(size, dtype=np.int16), np.array([40.0 if n[1] else -40.0]))
    chi = np.where(seen.sum(0) >= 2, _chi_square(seen[1], seen[0], n[1], n[0]), 0)
    chosen = np.argsort(-chi, kind="stable")[:features]
    chosen = chosen[chi[chosen] >= min(LEAST, chi[chosen].max(initial=0) / 2)]
    chosen = chosen[chi[chosen] > 0]
    ratio = np.log((seen[1][chosen] + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((seen[0][chosen] + SMOOTH) / (n[0] + 2 * SMOOTH))
    slot = np.zeros(size, dtype=np.int16)
    slot[chosen] = np.arange(1, len(chosen) + 1)
    sent = labelled.sparkSession.sparkContext.broadcast(slot)

    def look(batches):
        for batch in batches:
            ids = [present(t, sent.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(ids, pa.binary())], ["label", "weight", "ids"])

    rows = labelled.mapInArrow(look, "label int, weight double, ids binary").collect()
    sets = [np.frombuffer(r["ids"], dtype=np.int16) for r in rows]
    scale = np.concatenate(([1.0], ratio))
    w = logistic(sets, np.array([r["label"] for r in rows], dtype=float), np.array([r["weight"] for r in rows]), scale)
    return Model(slot, w * scale)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """At most `limit` labelled texts of each class: text, label, weight. Several labels of one id: the highest counts."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("label"))
    picked, counts = bounded_sample(marked, "label", "k", limit)
    weight = F.when(F.col("label") == 1, max(1.0, counts.get(1, 0) / limit)).otherwise(max(1.0, counts.get(0, 0) / limit))
    # 2 * limit ids at most, so they can be sent to where the texts are read
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(picked), "k").select("text", "label", weight.alias("weight"))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Returns doc_id, score, predicted for each row of docs. Null and empty texts have the score of no feature but the
    blanks around them. Repeated rows are each scored; extra columns are left out; an empty table gives an empty result."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            score = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held)
    model = fit(stored(training_rows(docs, labels, "toxic"), "toxicity-sample"))
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
