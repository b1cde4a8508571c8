"""One entry to all kinds of search."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame

from tarn.operators.index import Index
from tarn.operators.query import Query, intersection, phrase
from tarn.operators.rank import Normalization, ranked_combination, ranked_hits, ranked_pagerank, ranked_tfidf


class Kind(Enum):
    INTERSECTION = "intersection"
    PHRASE = "phrase"
    RANKED = "ranked"


class Ranking(Enum):
    TFIDF = "tfidf"
    PAGERANK = "pagerank"
    COMBINATION = "combination"
    HITS = "hits"


def search(index: Index, query: Query, kind: Kind = Kind.RANKED, ranking: Ranking = Ranking.TFIDF, norm: Normalization = Normalization.NUMBER_OF_WORDS, ranks: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame | None:
    """doc_id, score (and offsets for the unranked kinds) as one lazy DataFrame. None where an unknown term means that
    there is no result list (see intersection and phrase). Wildcards work in every kind."""
    if kind is Kind.INTERSECTION:
        return intersection(index, query)
    if kind is Kind.PHRASE:
        return phrase(index, query)
    if ranking is Ranking.TFIDF:
        return ranked_tfidf(index, query, norm)
    if ranking is Ranking.PAGERANK:
        return ranked_pagerank(index, query, ranks)
    if ranking is Ranking.COMBINATION:
        return ranked_combination(index, query, ranks, norm)
    return ranked_hits(index, query, edges)
