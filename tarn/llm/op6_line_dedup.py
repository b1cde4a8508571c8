"""Line deduplication: explode normalised lines, hash, count distinct documents for each hash, drop lines over the
threshold, and reassemble the rest by position.

Scale: hashes of 128 bits stand for lines, so line texts are never shuffled. Counting is by (hash, document) and then by
hash, each combined map-side, so that a line that a third of all documents hold is counted by many tasks. Dropped
positions come from a join on hash and salt. Texts are shuffled once, to meet
their dropped positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import BLANKS, LAST_ID, fold, stored, table

MIN_CHARS, MIN_DOCS, SALTS = 10, 2, 16


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Returns the columns of docs, with text_col as it is after dropping, and n_lines, n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of min_chars code points or more, in at
    least min_docs documents, lose all lines except in the smallest document that holds them. Null and empty texts are
    one empty line and stay "". Rows of one doc_id are one document; a null doc_id is a document after all others.
    Columns named n_lines or n_dropped are replaced.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    body = F.coalesce(F.col(text_col), F.lit(""))
    flat = docs.select(own.alias("did"), F.xxhash64(body).alias("th"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    long = flat.where(F.length("line") >= min_chars).select("did", "th", "pos", fold(F.trim(F.col("line"), F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    # read twice below: hashes are kept, so that texts are split and folded once
    lines = stored(long.select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")), "lines")
    if min_docs == 2:
        counted = lines.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").drop("last")
    else:
        counted = lines.select("h1", "h2", "did").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("did").alias("first")).where(F.col("docs") >= min_docs).drop("docs")
    # a line that a third of all documents hold meets its count in SALTS groups, which adaptive execution can split further
    counted = counted.select("*", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("did", "pos"), F.lit(SALTS)).cast("int"))
    gone = salted.join(counted, ["h1", "h2", "salt"]).where("did != first").groupBy("did", "th").agg(F.collect_set("pos").alias("gone"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept_columns)).alias("row"), own.alias("did"), F.xxhash64(body).alias("th"))
    split = row.join(gone, ["did", "th"], "left").select("row", F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n", -1).alias("lines"), "gone")
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    text = F.when(F.col("gone").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept_columns]
    return split.select(*out, F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, (d.key IS NOT NULL AND k.doc_id <> d.first) AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
