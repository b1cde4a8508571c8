"""Exact top-k inner products over norm-sorted vectors. Vectors are rotated by the right singular vectors of the whole
table, so that the first coordinates carry most of each product. Candidates are visited by descending length; a query
stops as soon as |q| * |c| cannot reach its k-th score, and otherwise a partial sum over the first coordinates plus
the Cauchy-Schwarz bound of the rest decides which pairs get their exact integer product.

Scale: vectors are written once, range-partitioned and sorted by descending length, so that a task holds a band of lengths
and reads it from its longest vector on; vectors of one length are split by id. Queries are a fixed share of the rows, so
they are taken in blocks of QUERY_BYTES: a block is what is sent to the executors, reads the bands once, and its result is
written before the next block is sent. The rotation comes from a d x d matrix that is summed on the executors. The SEEDS
longest vectors give each query a first bound on its k-th score, so bands of short vectors stop at their first vector,
and tasks return few rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import parts, ship, stored, table

K, QUERY_BYTES, SEEDS, CHUNK, HEAD, VISIT = 5, 32 << 20, 1024, 512, 0.25, 50_000
_NONE = np.iinfo(np.int64).min


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v = floor(256 * x); vectors that are null or hold null, NaN or infinite components are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where("vec_id is not null and x is not null")
    sound = F.forall("x", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(sound).select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if len(size) and (size == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim), dtype=np.int64)
    for i, (a, n) in enumerate(zip(offsets, size)):
        out[i, :n] = flat[a : a + n]
    return out


class Searcher:
    """A block of queries, their rotation, and the best k rows found so far for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.ints, self.k = ids, vectors, k
        self.rotation, self.head = rotation, max(1, int(rotation.shape[0] * HEAD))
        turned = vectors @ rotation
        self.first = np.ascontiguousarray(turned[:, : self.head])
        self.length = np.linalg.norm(turned, axis=1)
        self.rest = np.linalg.norm(turned[:, self.head :], axis=1)
        self.bound = np.full(len(ids), float("-inf")) if bound is None else bound.astype(float)
        self.score = np.full((len(ids), k), _NONE)
        self.best = np.full((len(ids), k), _NONE)

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates into account. Pruning is strict, so that ties are never lost."""
        length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            reach = length[part[0]]
            alive = np.nonzero(self.length * reach * (1 + 1e-9) + 1e-3 >= self.bound)[0]
            if not len(alive):
                return  # all further candidates are shorter
            turned = vectors[part] @ self.rotation
            rest = np.linalg.norm(turned[:, self.head :], axis=1)
            for lo in range(0, len(alive), 2048):
                q = alive[lo : lo + 2048]
                most = self.first[q] @ turned[:, : self.head].T + self.rest[q][:, None] * rest
                slack = 1e-3 + 1e-9 * self.length[q][:, None] * reach
                qi, cj = np.nonzero(most + slack >= self.bound[q][:, None])
                keep = self.ids[q[qi]] != ids[part[cj]]
                if keep.any():
                    self._take(q[qi[keep]], part[cj[keep]], ids, vectors)

    def _take(self, qi: np.ndarray, cj: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = np.concatenate([np.einsum("ij,ij->i", self.ints[qi[i : i + 65536]], vectors[cj[i : i + 65536]]) for i in range(0, len(qi), 65536)])
        good = score >= self.bound[qi]
        qi, score, found = qi[good], score[good], ids[cj[good]]
        touched = np.unique(qi)
        if not len(touched):
            return
        old_q = np.repeat(touched, self.k)
        q = np.concatenate((old_q, qi))
        s = np.concatenate((self.score[touched].ravel(), score))
        c = np.concatenate((self.best[touched].ravel(), found))
        real = s != _NONE
        q, s, c = q[real], s[real], c[real]
        order = np.lexsort((c, -s, q))
        q, s, c = q[order], s[order], c[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[touched], self.best[touched] = _NONE, _NONE
        self.score[q[top], rank[top]], self.best[q[top], rank[top]] = s[top], c[top]
        full = self.score[:, -1] != _NONE
        self.bound = np.where(full, np.maximum(self.bound, self.score[:, -1].astype(float)), self.bound)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, largest first, from the d x d matrix of second moments."""

    def moments(batches):
        total = np.zeros((dim, dim))
        n = 0
        for batch in batches:
            m = matrix(batch.column("v"), dim).astype(float)
            total, n = total + m.T @ m, n + len(m)
        if n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([np.random.default_rng(n).integers(32)], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m).reshape(dim, dim) for m in pdf["m"])
        return pd.DataFrame({"m": [total.tobytes()]})

    parts = rows.select("v").mapInArrow(moments, "slot int, m binary").groupBy("slot").applyInPandas(add, "m binary").collect()
    total = sum((np.frombuffer(r["m"]).reshape(dim, dim) for r in parts), np.zeros((dim, dim)))
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K, query_block: int | None = None) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, the k largest
    integer inner products with rows of other ids; ties go to the smaller id.

    Null ids and unsound vectors take no part; shorter vectors count as filled up with zeros. Repeated rows are
    candidates of their own, equal query rows are one query. Without queries or candidates the result is empty.
    Products must fit in 63 bits. query_block: queries of a block (default: as many as take QUERY_BYTES).
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = integers(vectors, id_col, vector_col).withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(rows.repartitionByRange(parts(spark), F.desc("n2"), "vec_id").sortWithinPartitions(F.desc("n2"), "vec_id"), "bands")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    n = asked.count()
    schema = "block int, query int, query_id long, vec_id long, score long"
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, dim)
    longest = rows.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).toPandas()
    seed_ids, seed_rows = longest["vec_id"].to_numpy(), np.array([np.pad(v, (0, dim - len(v))) for v in longest["v"]], dtype=np.int64)
    blocks = -(-n // (query_block or max(1, QUERY_BYTES // (8 * dim))))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "v").toPandas()
        if block.empty:
            continue
        ids = block["vec_id"].to_numpy()
        ints = np.array([np.pad(v, (0, dim - len(v))) for v in block["v"]], dtype=np.int64)
        first = Searcher(ids, ints, turn, k)
        first.visit(seed_ids, seed_rows)
        sent = spark.sparkContext.broadcast((ids, ints, turn, first.bound))

        def search(batches, sent=sent, b=b):
            ids, ints, turn, bound = sent.value
            s = Searcher(ids, ints, turn, k, bound)
            held, size = [], 0
            for batch in batches:  # some batches together, so that their order by length is worth more
                held.append((batch.column("vec_id").to_numpy(), matrix(batch.column("v"), turn.shape[0])))
                size += batch.num_rows
                if size >= VISIT:
                    s.visit(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
            if held:
                s.visit(*(np.concatenate(x) for x in zip(*held)))
            q, r = np.nonzero(s.score != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), b, dtype=np.int32)), pa.array(q.astype(np.int32)), pa.array(ids[q]), pa.array(s.best[q, r]), pa.array(s.score[q, r])], ["block", "query", "query_id", "vec_id", "score"])

        order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
        best = rows.select("vec_id", "v").mapInArrow(search, schema).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        found.append(stored(best.select("query_id", "rank", "vec_id", "score"), "top"))
        sent.destroy()
    return reduce(DataFrame.unionAll, found)


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
