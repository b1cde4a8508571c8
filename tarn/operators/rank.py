"""Ranked retrieval: tf-idf, PageRank, their combination, and HITS."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.graph import root_scores
from tarn.operators.index import Index, placed
from tarn.operators.query import Query, by_position, empty_results, matches, matches_any, may_hold_any, postings_of
from tarn.plans.skew import split_join
from tarn.plans.storage import stored


class Normalization(Enum):
    NONE = "none"
    NUMBER_OF_WORDS = "words"
    EUCLIDEAN = "euclid"


def hits_of(index: Index, query: Query) -> DataFrame:
    """Postings of the query's terms with `weight`: term, doc_id, tf, doc_len, weight."""
    weight = F.lit(0.0)
    for t, w in zip(query.terms, query.weights):
        weight = weight + F.when(matches(t), w).otherwise(0.0)
    rows = index.counts(matches_any(query.terms), lambda text: may_hold_any(query.terms, text))
    return rows.select("term", "doc_id", "tf", "doc_len", weight.alias("weight"))


def ranked_tfidf(index: Index, query: Query, norm: Normalization = Normalization.NUMBER_OF_WORDS) -> DataFrame:
    """doc_id, score: sum over the query's terms of tf * ln(N / df) * weight, if above 0, then normalised.

    The postings of the query's terms are written out, so that documents are tokenized once for both the count of documents for
    each term and the scores. The counts, a row for each term of the query, go to where the postings are; those of wildcards,
    which may be many, by split_join. Euclidean norms are worked out for the documents found.
    """
    if norm is Normalization.EUCLIDEAN and index.norms is None:
        index.bags()
    rows = stored(hits_of(index, query), "hits")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    counted = split_join(rows, stored(df, "hits-df"), "term", "df") if query.wild else rows.join(F.broadcast(df), "term")
    return normalised(index, scores_of(index, counted), norm)


def scores_of(index: Index, rows: DataFrame) -> DataFrame:
    """doc_id, score, doc_len from rows term, doc_id, tf, doc_len, weight, df."""
    score = F.sum(F.col("tf") * F.log(F.lit(float(index.n)) / F.col("df")) * F.col("weight")).alias("score")
    return rows.groupBy("doc_id").agg(score, F.first("doc_len").alias("doc_len")).where("score > 0")


def normalised(index: Index, scored: DataFrame, norm: Normalization) -> DataFrame:
    if norm is Normalization.NUMBER_OF_WORDS:
        return scored.select("doc_id", (F.col("score") / F.col("doc_len")).alias("score"))
    if norm is Normalization.EUCLIDEAN:
        scored = stored(scored.select("doc_id", "score"), "scored")
        return scored.join(index.euclidean(scored), "doc_id").select("doc_id", (F.col("score") / F.col("norm")).alias("score"))
    return scored.select("doc_id", "score")


def ranked_weighted(index: Index, weights: DataFrame, norm: Normalization = Normalization.NUMBER_OF_WORDS) -> DataFrame:
    """As ranked_tfidf, for a query that is a table of term, weight (after relevance feedback): of any size."""
    weights = stored(weights.groupBy("term").agg(F.sum("weight").alias("weight")), "weights")
    # tokens of other terms are left out before anything is grouped
    kept = placed(index.tokens).join(weights, "term")
    rows = kept.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"), F.first("weight").alias("weight"))
    rows = stored(rows, "weighted-rows")
    df = stored(rows.groupBy("term").agg(F.count("*").alias("df")), "weighted-df")
    return normalised(index, scores_of(index, split_join(rows, df, "term", "df")), norm)


def occurrences(index: Index, query: Query) -> DataFrame:
    """doc_id, times: how many of the query's term places (each expansion of a wildcard by itself) a document matches."""
    times = F.lit(0)
    for t in query.terms:
        times = times + F.when(matches(t), 1).otherwise(0)
    return postings_of(index, query.terms).select("doc_id", times.alias("times")).groupBy("doc_id").agg(F.sum("times").alias("times"))


def ranked_pagerank(index: Index, query: Query, ranks: DataFrame) -> DataFrame:
    """doc_id, score: the document's PageRank (ranks: node, pr) for each matching term place; weights don't count."""
    found = occurrences(index, query).join(ranks, F.col("doc_id") == F.col("node"))
    return found.select("doc_id", (F.col("times") * F.col("pr")).alias("score")).where("score > 0")


TFIDF_SHARE, PAGERANK_SHARE = 1.0, 750.0


def ranked_combination(index: Index, query: Query, ranks: DataFrame, norm: Normalization = Normalization.NUMBER_OF_WORDS) -> DataFrame:
    """doc_id, score: tf-idf plus 750 times PageRank, for documents with a tf-idf above 0."""
    text = ranked_tfidf(index, query, norm)
    joined = text.join(ranks.select(F.col("node").alias("doc_id"), "pr"), "doc_id", "left")
    return joined.select("doc_id", (TFIDF_SHARE * F.col("score") + PAGERANK_SHARE * F.coalesce("pr", F.lit(0.0))).alias("score"))


def ranked_hits(index: Index, query: Query, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, score: for each term, hub plus authority within the base set of the term's documents; summed over terms.
    All terms' base sets are iterated together. Without terms the result is empty."""
    if not query.terms:
        return empty_results(index).select("doc_id", F.lit(0.0).alias("score"))
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    roots = by_position(postings_of(index, query.terms), query).select(F.col("ord").alias("key"), F.col("doc_id").alias("node"))
    return root_scores(edges, roots, rounds).groupBy(F.col("node").alias("doc_id")).agg(F.sum("score").alias("score"))
