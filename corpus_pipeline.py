"""A corpus from raw documents, in stages that each call one operator of tarn.llm: what language ID rejects goes, lines
that several documents hold stay in the first alone, one document of each group of near copies stays, documents that
hold a benchmark item go, and what is left is encoded.

Each stage takes the table that the one before has written. A row is judged by its own text: rows without a doc_id, and
rows of one doc_id with several texts, stay or go each by itself. Repeated rows (equal doc_id and text) become one row in
the near-duplicate stage. Columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, stored, table
from tarn.llm.op3_decontaminate import without_items
from tarn.llm.op5_simhash_bktree import without_copies
from tarn.llm.op6_line_dedup import line_dedup
from tarn.llm.op9_sentencepiece import default_model, sentencepiece_round_trip
from tarn.llm.op10_language import identify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letter) go; a missing lang is filled in with the predicted one."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = identify(docs, docs.where("lang is not null and text is not null"), keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first alone; texts change, no document goes."""
    return line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one of the smallest doc_id stays."""
    small_batches(spark)
    return without_copies(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with a benchmark item go."""
    return without_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian uint32, with begin and end) of every text, and a digest of their decoded text."""
    small_batches(spark)
    coded = sentencepiece_round_trip(docs, default_model())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("SentencePiece", encode_stage),
]
#: Cross-parsing, min-hashes, alignment and encoding have no SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
