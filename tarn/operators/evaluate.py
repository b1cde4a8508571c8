"""Evaluation of ranked lists. judgments: run_id, rank (from 1), doc, rel (0 to 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Recall's fixed number of relevant documents.
RELEVANT = 100


def precision_recall(judgments: DataFrame, relevant: int = RELEVANT) -> DataFrame:
    """run_id, retrieved, relevant, precision, recall; relevant is rel above 0."""
    hit = F.sum((F.col("rel") > 0).cast("long"))
    found = judgments.groupBy("run_id").agg(F.count("*").alias("retrieved"), hit.alias("relevant"))
    return found.select("run_id", "retrieved", "relevant", (F.col("relevant") / F.col("retrieved")).alias("precision"), (F.col("relevant") / float(relevant)).alias("recall"))


def precision_recall_at(judgments: DataFrame, step: int = 10, relevant: int = RELEVANT) -> DataFrame:
    """run_id, k, precision, recall after each `step` results. A run is one result list, so a window holds it."""
    upto = Window.partitionBy("run_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = judgments.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("rank")).alias("k"), F.sum((F.col("rel") > 0).cast("long")).over(upto).alias("hits"))
    return running.where(F.col("k") % step == 0).select("run_id", "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / float(relevant)).alias("recall"))


def _gain(rank: str) -> Column:
    return F.col("rel") / F.log2(F.col(rank) + 1)


def dcg(judgments: DataFrame) -> DataFrame:
    """run_id, dcg: sum of rel / log2(rank + 1)."""
    return judgments.groupBy("run_id").agg(F.sum(_gain("rank")).alias("dcg"))


def ndcg(judgments: DataFrame, k: int = 50) -> DataFrame:
    """run_id, ndcg of the first k results; the ideal is those same results sorted. Nothing relevant: NaN."""
    first = judgments.where(F.col("rank") <= k)
    ideal = first.withColumn("best", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("rel"), "rank")))
    both = ideal.groupBy("run_id").agg(F.sum(_gain("rank")).alias("got"), F.sum(_gain("best")).alias("most"))
    return both.select("run_id", F.when(F.col("most") > 0, F.col("got") / F.col("most")).otherwise(F.lit(float("nan"))).alias("ndcg"))


def override(judgments: DataFrame, doc: str, rel: int = 0) -> DataFrame:
    """judgments with another relevance for the first place of each run where `doc` stands."""
    first = Window.partitionBy("run_id", "doc").orderBy("rank")
    changed = (F.col("doc") == doc) & (F.col("__at") == 1)
    return judgments.withColumn("__at", F.row_number().over(first)).withColumn("rel", F.when(changed, F.lit(rel)).otherwise(F.col("rel"))).drop("__at")


def precision_recall_lines(judgments: DataFrame, relevant: int = RELEVANT) -> DataFrame:
    """value: a line for each run with precision and recall to two decimals, in order of runs."""
    found = precision_recall(judgments, relevant).orderBy("run_id")
    return found.select(F.format_string("Run %s: precision %.2f, recall %.2f", F.col("run_id").cast("string"), "precision", "recall").alias("value"))


def curve(judgments: DataFrame, step: int = 10, relevant: int = RELEVANT) -> DataFrame:
    """run_id, recall, precision: the points of each run's precision-recall curve, in order of recall."""
    return precision_recall_at(judgments, step, relevant).select("run_id", "recall", "precision").orderBy("run_id", "recall", F.desc("precision"))
