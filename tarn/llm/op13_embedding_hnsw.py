"""Near-duplicate vectors by cosine. Vectors are dealt to shards, each with a hierarchical navigable small-world graph of its
own; every shard is searched for every vector, beams are widened until an audit against all vectors of the shard passes,
found neighbours are verified in double precision, and links are united into components.

Scale: equal vectors are one node, however many rows hold them. A shard has SHARD_ROWS nodes at most and is one packed
row. Each two shards meet in a task of their own, once: the vectors of the one are searched in the graph of the other, and
within a shard each vector is searched for those after it, so that both ends of a link count it alike. A task keeps a
count and a label for each of its nodes, never pairs, and emits one row for each node that has a link: a crowd of m near
copies costs m * m cosines in blocks, but m rows. Labels are joined by rounds of a distributed components search. Nothing
but the number of nodes comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ship, stored, table
from tarn.llm.components import connected_components
from tarn.llm.packing import pack, small, unpack
from tarn.llm.small_worlds import STEP, Graph, layer_sizes

LEAST, SHARD_ROWS, SMALL_SHARD, MOST_TASKS = 0.95, 100_000, 1024, 10_000
#: Beams: the width to begin with; vectors of each two shards whose links are compared with all; the recall asked for.
BEAM, AUDIT, RECALL, SCAN = 16, 256, 0.99, 128
#: Cosines of single precision are this much off at most.
SLACK = 1e-4


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = raw.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def packed(nodes: np.ndarray, copies: np.ndarray, raw: np.ndarray, seed: int) -> bytes:
    """A shard: its nodes in the graph's order, their numbers of rows, their vectors, and the graph's links."""
    order = np.random.default_rng(seed).permutation(len(nodes))
    raw = raw[order]
    short = raw.astype(np.float32)
    raw = short if (short == raw).all() else raw
    layers = Graph(unit(raw).astype(np.float32)).layers
    return pack(nodes[order], copies[order], raw.ravel(), np.array([raw.shape[1]]), *(small(k.ravel() + 1) for k in layers))


class Shard:
    def __init__(self, data: bytes):
        self.nodes, self.copies, raw, dim, *links = unpack(data)
        self.units = unit(raw.reshape(-1, int(dim[0])))
        self.short = self.units.astype(np.float32)
        self.n, self.links = len(self.nodes), links

    def graph(self) -> Graph:
        return Graph(self.short, [k.astype(np.int32).reshape(size, -1) - 1 for k, size in zip(self.links, layer_sizes(self.n))])


class Labels:
    """Groups of nodes as the smallest place that is known for each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            apart = self.of[a] != self.of[b]
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = self.of[a], self.of[b]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(jump := self.of[self.of], self.of):
                self.of = jump


def neighbours(asked: Shard, lo: int, hi: int, other: Shard, graph: Graph | None, width: int, least: float, same: bool):
    """Pairs (place in asked, place in other) of cosine `least` or more, for the places lo .. hi - 1 of asked. A vector whose
    whole beam is near is searched again with a wider one; a beam of 1 / SCAN of the shard costs as much as all of the shard, and
    becomes that. graph=None compares with all."""
    todo, found = np.arange(lo, hi), []
    while len(todo):
        if graph is None or SCAN * width >= other.n:
            q, v = np.nonzero(asked.short[todo] @ other.short.T >= least - SLACK)
            rest = todo[:0]
        else:
            ids, score = graph.search(asked.short[todo], width)
            near = (ids >= 0) & (score >= least - SLACK)
            full = near.all(axis=1)
            q, c = np.nonzero(near & ~full[:, None])
            v, rest = ids[q, c], todo[full]
        q = todo[q]
        ok = np.einsum("ij,ij->i", asked.units[q], other.units[v]) >= least
        if same:
            ok &= v > q
        found.append((q[ok], v[ok]))
        todo, width = rest, 4 * width
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def audited_width(asked: Shard, other: Shard, graph: Graph, least: float, same: bool) -> tuple[int, float]:
    """The first width from BEAM on, doubled each time, whose links of an even sample are RECALL of the true ones."""
    sample, width = np.unique(np.linspace(0, asked.n - 1, min(AUDIT, asked.n)).astype(np.int64)), BEAM
    few = Shard.__new__(Shard)
    few.units, few.short, few.n = asked.units[sample], asked.short[sample], len(sample)

    def links(graph, width):
        return {(a, b) for lo in range(0, few.n, STEP) for a, b in zip(*(x.tolist() for x in neighbours(few, lo, min(lo + STEP, few.n), other, graph, width, least, False))) if not same or b > sample[a]}

    truth = links(None, width)
    while True:
        recall = len(truth & links(graph, width)) / len(truth) if truth else 1.0
        if recall >= RECALL or SCAN * width >= other.n:
            return width, recall
        width *= 2


def meet(asked: Shard, other: Shard, least: float, same: bool):
    """For nodes of either shard that have a link to the other: node, its links by rows, and a node that it is linked to."""
    graph = other.graph()
    width, _ = audited_width(asked, other, graph, least, same)
    base = 0 if same else asked.n
    nodes = asked.nodes if same else np.concatenate((asked.nodes, other.nodes))
    degree, labels = np.zeros(len(nodes), dtype=np.int64), Labels(len(nodes))
    for lo in range(0, asked.n, STEP):
        q, v = neighbours(asked, lo, min(lo + STEP, asked.n), other, graph, width, least, same)
        np.add.at(degree, q, other.copies[v])
        np.add.at(degree, v + base, asked.copies[q])
        labels.join(q, v + base)
    linked = np.flatnonzero(degree)
    return nodes[linked], degree[linked], nodes[labels.of[linked]]


def sound_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles), null where the vector is null, zero, or holds null, NaN or infinite components."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).select("vec_id", F.when(fine, F.col("v")).alias("v"))


def shard_count(nodes: int, cores: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of shard_rows nodes at most, and so many that their pairs give each core a task: each vector is searched in
    half of the shards, so that more of them are more work."""
    return max(1, -(-nodes // shard_rows), min(-(-nodes // SMALL_SHARD), math.ceil((math.sqrt(8 * cores + 1) - 1) / 2)))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Returns vec_id, n_links (other rows whose vectors have a cosine of `least` or more with the row's), component_id (the
    smallest vec_id reachable over links), kept (vec_id = component_id); one row for each input row.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Shorter vectors count as filled up
    with zeros. Every row is a vector of its own: rows of equal vectors are linked, repeated ids too. Rows without an id
    are linked like the others; component_id leaves them out, and is null where no row of the component has one. Extra
    columns are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = sound_vectors(vectors, id_col, vector_col)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    full = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    rows = rows.withColumn("v", F.when(F.col("v").isNotNull(), full))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))})
    nodes = rows.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shards = shard_count(nodes.count(), spark.sparkContext.defaultParallelism, shard_rows)

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            raw = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
            shard = t.column("shard")[0].as_py()
            data = packed(t.column("node").to_numpy(), t.column("copies").to_numpy(), raw, shard)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])

    dealt = nodes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("h1", "h2")
    graphs = stored(dealt.select("shard", "node", "copies", "v").mapInArrow(build, "shard int, data binary"), "graphs")

    def search(batches):
        held = None
        for batch in batches:
            for a, b, role, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "role", "data"))):
                shard = Shard(data)
                if role == 0 and a != b:
                    held = (a, b, shard)
                    continue
                if a != b and (held is None or held[:2] != (a, b)):
                    continue  # a shard without nodes
                columns = meet(shard if a == b else held[2], shard, least, a == b)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "degree", "root"])

    asks = graphs.select(F.col("shard").alias("a"), F.explode(F.sequence("shard", F.lit(shards - 1))).alias("b"), F.lit(0).alias("role"), "data")
    answers = graphs.select(F.explode(F.sequence(F.lit(0), "shard")).alias("a"), F.col("shard").alias("b"), F.lit(1).alias("role"), "data").where("a <> b")
    tasks = min(MOST_TASKS, shards * (shards + 1) // 2)
    place = F.expr(f"cast((a * {shards}L - a * (a - 1L) div 2 + b - a) % {tasks} as int)")
    met = asks.union(answers).repartitionById(tasks, place).sortWithinPartitions("a", "b", "role")
    links = stored(met.mapInArrow(search, "node long, degree long, root long"), "links")

    labels = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = links.groupBy("node").agg(F.sum("degree").alias("degree"))
    named = nodes.drop("v").join(degrees, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "component").select("h1", "h2", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"), "lowest")
    found = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_hnsw(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
u AS (SELECT row, vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM s),
l AS (SELECT a.row AS a, b.row AS b, b.vec_id FROM u a JOIN u b ON a.row <> b.row AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.95),
r AS (SELECT row, row AS seen FROM v UNION SELECT r.row, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT r.row, min(v.vec_id) AS component_id FROM r JOIN v ON v.row = r.seen GROUP BY r.row),
d AS (SELECT a AS row, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.row = c.row LEFT JOIN d ON v.row = d.row
"""
