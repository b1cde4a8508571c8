"""Sharding along a Hilbert curve. Several metadata dimensions are quantised at their quantiles; rows are ordered by
their cell's index on the curve, and runs of that order are cut into shards, so that each shard's files span a small
box of every dimension and can be pruned by min/max of any of them.

Scale: a global order without a global sort. Texts are read once, for their size and checksum; the small rows that are
left are written and read from there. They are counted by (curve index, sub-cell); cumulative counts give each group's
first position, and a row's position is that plus its number within the group. Sub-cells are hashes of id and text, as
many as keep a cell that holds all rows to about SUB_ROWS rows a window group. Texts are quantised by their order as a whole, from counts of their distinct values. The curve is a table of 2^(bits *
dimensions) numbers in the plan. Only ids and sizes are shuffled, not texts.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.llm.common import stored, table
from tarn.plans.numbering import running_sums

BITS, SUB, SUB_ROWS, MOST_CELLS = 4, 64, 200_000, 1 << 16


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of cells in [0, 2^bits)^d, by Gray-code rotation from the top bit down."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in cells]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def text_quantiles(rows: DataFrame, name: str, cells: int) -> list[str]:
    """The text at which a column's rows, in order of whole texts, pass each k / cells of their number; a text that passes
    several stands as often. cells - 1 at most.

    Texts are counted and range-partitioned, and running sums of counts give each one's place, so that no task orders them
    all. Only the texts at the bounds come to the driver."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    placed = stored(running_sums(counted, name, amount="n", total="upto"), "text-places")
    every = placed.agg(F.max("upto")).first()[0] or 0
    band = lambda at: F.expr(f"cast((cast({at} as decimal(20, 0)) * {cells}) div {max(every, 1)} as int)")
    edges = placed.select(name, band("upto - n").alias("first"), band("upto").alias("last")).where("last > first").orderBy(name).collect()
    return [r[name] for r in edges for _ in range(r["first"], min(r["last"], cells - 1))]


def shard_plan(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, curve; one row for each input row.

    dimensions: columns to quantise, numbers or texts; by default lang, source and size. Law `rows`: shard counts differ by
    one at most. Null texts have size 16 and crc32 0; null metadata is in cell 0; rows with equal ids and texts take
    neighbouring positions in either order. Extra columns are left out. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": size} if dimensions is None else dimensions
    if 1 << bits * len(dims) > MOST_CELLS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits make more than {MOST_CELLS} cells")
    names = [f"dim{i}" for i in range(len(dims))]
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).alias("text_crc32"), *(c.alias(n) for n, c in zip(names, dims.values())))
    texts = [n for n in names if isinstance(rows.schema[n].dataType, StringType)]
    rows = stored(rows.select(*(F.col(c) if c not in names or c in texts else F.col(c).cast("long").alias(c) for c in rows.columns)), "shard-rows")
    cut = [k / 2**bits for k in range(1, 2**bits)]
    seen = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(n, cut, 10_000).alias(n) for n in names if n not in texts)).first().asDict()
    total = seen["n"]
    seen |= {n: text_quantiles(rows, n, 1 << bits) for n in texts}
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * len(dims), indexing="ij"), -1).reshape(-1, len(dims))
    curve = F.from_json(F.lit(json.dumps(hilbert_index(list(cells.T), bits).tolist())), "array<int>")

    def cell(name: str) -> Column:
        out = F.lit(0)
        for edge in seen[name] or []:
            out = out + F.when(F.col(name) > edge, 1).otherwise(0)
        return out

    group, subs = ["curve", "sub"], max(SUB, -(-total // SUB_ROWS))
    number = F.lit(0)
    for name in names:
        number = number * (1 << bits) + cell(name)
    placed = rows.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int").alias("sub"), F.element_at(curve, number + 1).alias("curve"))
    counted = placed.groupBy(*group).agg(F.count("*").alias("rows"))
    inside = Window.partitionBy("curve").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy("curve").agg(F.sum("rows").alias("rows"))  # 2^(bits * dims) rows at most: one window is enough
    first = cells.select("curve", F.coalesce(F.sum("rows").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = counted.select(*group, F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("within")).join(first, "curve").select(*group, (F.col("before") + F.col("within")).alias("start"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("text_crc32", "doc_id", "size")) - 1).join(starts, group).withColumn("at", F.col("at") + F.col("start"))
    # integer arithmetic in decimal: a position times the number of shards may pass 2^63
    shard = F.expr(f"cast((cast(at as decimal(20,0)) * {shards}) div {max(total, 1)} as int)")
    begin = F.expr(f"cast((cast(shard as decimal(20,0)) * {total} + {shards - 1}) div {shards} as bigint)")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 40, file_rows: int = 100_000, **options) -> DataFrame:
    """Writes docs below path in folders shard=N, as files of at most file_rows rows that are runs of the shard's slots, and
    returns the manifest: for each shard and run its rows, bytes and the range of each metadata column. doc_id must
    identify rows here; null or repeated ids raise a ValueError."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        raise ValueError("doc_id is null or repeats")
    plan = stored(shard_plan(docs, shards, **options).select("doc_id", "size", "shard", "slot", F.floor(F.col("slot") / file_rows).alias("run")), "shard-plan")
    files = max(1, plan.select("shard", "run").distinct().count())
    full = docs.join(plan.select("doc_id", "shard", "slot", "run"), "doc_id")
    full.repartition(files, "shard", "run").sortWithinPartitions("shard", "slot").drop("slot", "run").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
    kept = [c for c in ("lang", "source") if c in docs.columns]
    facts = plan.join(docs.select("doc_id", *kept), "doc_id")
    return facts.groupBy("shard", "run").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), *(f(c).alias(f"{k}_{c}") for c in kept for k, f in (("min", F.min), ("max", F.max))))


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))
