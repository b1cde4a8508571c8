"""Boolean, phrase and wildcard queries over postings, and helpers for queries.

Terms are conditions on the `term` column, wildcards included, so that all kinds of query filter postings the same way,
before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.index import Index, kgram_intersect


@dataclass
class Query:
    """Terms with weights, in order; repeated terms stay."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Query:
        """Words between white space, with weight 1; lower-cased, not tokenized."""
        terms = text.strip().lower().split()
        return cls(terms, [1.0] * len(terms))

    def size(self) -> int:
        return len(self.terms)

    def length(self) -> float:
        """Manhattan length: the sum of weights."""
        return sum(self.weights)

    def copy(self) -> Query:
        return replace(self, terms=list(self.terms), weights=list(self.weights))

    @property
    def wild(self) -> bool:
        return any("*" in t for t in self.terms)


def parsed(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """queries with `terms` and `weights` as Query.parse has them, for a table of queries."""
    terms = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), lambda t: t != "")
    return queries.withColumn("terms", terms).withColumn("weights", F.transform("terms", lambda t: F.lit(1.0)))


def sizes(terms: str) -> Column:
    return F.size(terms).cast("long")


def lengths(weights: str) -> Column:
    """Manhattan lengths."""
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)


def matches(term: str, column: str = "term") -> Column:
    """The condition that a term of a query stands for. A leading * means a suffix, else a trailing one a prefix, else
    the first one splits prefix and suffix, which may overlap; further * are literal."""
    t = F.col(column)
    if "*" not in term:
        return t == term
    if term == "*":
        raise ValueError("a lone * matches no k-gram")
    if term.startswith("*"):
        return t.endswith(term[1:])
    if term.endswith("*"):
        return t.startswith(term[:-1])
    before, _, after = term.partition("*")
    return t.startswith(before) & t.endswith(after)


def matches_any(terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(t) for t in sorted(set(terms))), F.lit(False))


def fixed_parts(term: str) -> list[str]:
    """What every token that matches a term holds; see matches()."""
    if "*" not in term:
        return [term]
    if term.startswith("*"):
        return [term[1:]]
    if term.endswith("*"):
        return [term[:-1]]
    before, _, after = term.partition("*")
    return [before, after]


def may_hold_any(terms: Iterable[str], text: Column) -> Column:
    """True of every folded text with a token that matches a term: as a token is a stretch of the text, its parts are in the text. It
    is true of other texts too, for `mit` of one with `permit`."""
    held = (reduce(lambda a, b: a & b, map(text.contains, fixed_parts(t))) for t in sorted(set(terms)))
    return reduce(lambda a, b: a | b, held, F.lit(False))


def postings_of(index: Index, terms: Iterable[str]) -> DataFrame:
    """Postings of a query's terms; documents whose texts can't hold any of them are not tokenized."""
    terms = set(terms)
    return index.matching(matches_any(terms), lambda text: may_hold_any(terms, text))


def expand(index: Index, term: str) -> DataFrame:
    """The vocabulary's terms that a wildcard stands for.

    On a saved index each kind is a filter on the column that its table is sorted by, so that the scan takes the row
    groups that can match: prefixes on terms, suffixes on reversed terms, and those with both ends on k-grams, of which a term
    must hold all, before it is compared with the wildcard itself.
    """
    if term.startswith("*") and term != "*":
        return index.reversed.where(F.col("backwards").startswith(term[:0:-1])).select("term")
    before, star, after = term.partition("*")
    if star and after and index.saved_kgrams is not None:
        return kgram_intersect(index.saved_kgrams, end_grams(before, after)).where(matches(term))
    return index.terms.where(matches(term))


def end_grams(before: str, after: str, k: int = 2) -> list[str]:
    """k-grams of every ^term$ that starts with `before` and ends with `after`."""
    return [x[i : i + k] for x in ("^" + before, after + "$") for i in range(len(x) - k + 1)]


def by_position(rows: DataFrame, query: Query) -> DataFrame:
    """rows with `ord`: a row for each position of the query that its term matches."""
    places = F.filter(F.array(*(F.when(matches(t), F.lit(i)) for i, t in enumerate(query.terms))), lambda x: x.isNotNull())
    return rows.where(matches_any(query.terms)).select("*", F.explode(places).alias("ord"))


def empty_results(index: Index) -> DataFrame:
    return index.postings.sparkSession.createDataFrame([], "doc_id long, score long, offsets array<int>")


def known_positions(index: Index, query: Query) -> set[int]:
    """Which terms of the query match anything: a row for each position at most."""
    return {r["ord"] for r in by_position(postings_of(index, query.terms).select("term"), query).select("ord").distinct().collect()} if query.terms else set()


def intersection(index: Index, query: Query) -> DataFrame | None:
    """Documents that hold all terms: doc_id, score (sum of tf), offsets. A repeated term counts each time.

    Without wildcards, None (not an empty result) if the first term is unknown, and later unknown terms are ignored.
    With wildcards each position must match.
    """
    if not query.terms:
        return empty_results(index)
    need = query.size()
    if not query.wild:
        known = known_positions(index, query)
        if 0 not in known:
            return None
        need = len(known)
    rows = by_position(postings_of(index, query.terms), query)
    found = rows.groupBy("doc_id").agg(F.sum("tf").alias("score"), F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.count_distinct("ord").alias("n"))
    return found.where(F.col("n") == need).select("doc_id", "score", "offsets")


def union_postings(index: Index, terms: list[str]) -> DataFrame:
    """Postings of several terms as one list: doc_id, score (sum of tf), offsets."""
    return postings_of(index, terms).groupBy("doc_id").agg(F.sum("tf").alias("score"), F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets"))


def phrase(index: Index, query: Query, apart: int = 1, within: int | None = None) -> DataFrame | None:
    """Documents that hold the terms one after another: doc_id, score, offsets (of the last term). apart=k: each term
    stands exactly k places behind the one before; within=k: at any of the 1 to k places behind it.

    One grouping by document and start (position minus the term's place) serves any number of terms. With h(i) the
    number of starts where the first i terms match: score = tf(1) + sum over i > 1 of (tf(i) + h(i) - 1). One unknown
    term: None; among several: an empty result. A single term is its postings.
    """
    n = query.size()
    if not n:
        return empty_results(index)
    if n == 1:
        if not query.wild and not known_positions(index, query):
            return None
        return union_postings(index, query.terms)
    at = by_position(postings_of(index, query.terms).select("doc_id", "term", F.explode("offsets").alias("pos")), query)
    if within is not None:
        return chained(at, n, within)
    starts = at.groupBy("doc_id", (F.col("pos") - F.col("ord") * apart).alias("start")).agg(F.collect_set("ord").alias("ords"))
    starts = starts.withColumn("run", F.size(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: F.forall(F.sequence(F.lit(0), i - 1), lambda j: F.array_contains("ords", j)))))
    tf = [F.sum(F.array_contains("ords", i).cast("long")) for i in range(n)]
    hits = [F.sum((F.col("run") > i).cast("long")) for i in range(n)]
    score = tf[0]
    for i in range(1, n):
        score = score + tf[i] + hits[i] - 1
    last = F.sort_array(F.collect_list(F.when(F.col("run") == n, (F.col("start") + (n - 1) * apart).cast("int"))))
    return starts.groupBy("doc_id").agg(score.alias("score"), last.alias("offsets")).where(F.size("offsets") > 0)


def chained(at: DataFrame, n: int, within: int) -> DataFrame:
    """phrase() over rows doc_id, pos, ord: a place is a hit of the i-th term if one of the `within` places before it is a
    hit of the one before. A window over a document's places, in their order, finds that for one term after another;
    all windows share one shuffle and one sort, and no pairs of places are made."""
    if within < 1:
        raise ValueError("a term stands at least one place behind the one before")
    rows = at.groupBy("doc_id", "pos").agg(F.collect_set("ord").alias("ords"))
    before = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-within, -1)
    rows = rows.withColumn("h0", F.array_contains("ords", 0))
    for i in range(1, n):
        rows = rows.withColumn(f"h{i}", F.array_contains("ords", i) & F.coalesce(F.max(f"h{i - 1}").over(before), F.lit(False)))
    tf = [F.sum(F.array_contains("ords", i).cast("long")) for i in range(n)]
    hits = [F.sum(F.col(f"h{i}").cast("long")) for i in range(n)]
    score = tf[0]
    for i in range(1, n):
        score = score + tf[i] + hits[i] - 1
    last = F.sort_array(F.collect_list(F.when(F.col(f"h{n - 1}"), F.col("pos"))))
    return rows.groupBy("doc_id").agg(score.alias("score"), last.alias("offsets")).where(F.size("offsets") > 0)


def kgram_side_lookup(index: Index, query: Query, k: int = 2) -> tuple[int, list[str]]:
    """Terms of length k read as k-grams: how many vocabulary terms hold them all, and the first ten."""
    from tarn.operators.index import kgram_index, kgram_report, term_dictionary

    grams = [t for t in query.terms if len(t) == k]
    return kgram_report(kgram_index(index.terms, k), term_dictionary(index.tokens), " ".join(grams), k) if grams else (0, [])


def document_vector(index: Index, doc_id: int) -> DataFrame:
    """term, tf of one document."""
    return index.tokens.where(F.col("doc_id") == doc_id).select(F.explode("toks").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


ALPHA, BETA = 0.2, 0.8


def rocchio(index: Index, query: Query, relevant: list[int], alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """The query after relevance feedback: ord (-1 for added terms), term, weight.

    With R relevant documents, weights become weight * alpha / R, and each word of a relevant document adds
    beta * tf / R to the first equal term, or is added. R = 0 leaves the query as it is.
    """
    spark = index.tokens.sparkSession
    r = len(relevant)
    first = {t: i for i, t in reversed(list(enumerate(query.terms)))}
    rows = [(i, t, w * alpha / r if r else w, first[t] == i) for i, (t, w) in enumerate(zip(query.terms, query.weights))]
    own = spark.createDataFrame(rows, "ord int, term string, weight double, takes boolean")
    if not r:
        return own.select("ord", "term", "weight")
    words = index.tokens.where(F.col("doc_id").isin(relevant)).select(F.explode("toks").alias("word")).groupBy("word").agg((F.count("*") * (beta / r)).alias("add"))
    both = own.join(words, (F.col("term") == F.col("word")) & F.col("takes"), "full")
    return both.select(F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("term", "word").alias("term"), (F.coalesce("weight", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("weight"))


def page(results: DataFrame, first: int = 0, size: int = 10, order: tuple[str, ...] = ("score",)) -> DataFrame:
    """A page of ranked results, with rank from 1: by score descending, then doc_id. Only first + size rows are ordered."""
    best = results.orderBy(*(F.desc(c) for c in order), "doc_id").limit(first + size)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*(F.desc(c) for c in order), "doc_id")))
    return ranked.where(F.col("rank") > first)


def preview(docs: DataFrame, doc_id: int) -> DataFrame:
    """A document's lines without blanks around them: line_no (from 1), line."""
    lines = docs.where(F.col("doc_id") == doc_id).select(F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select((F.col("n") + 1).alias("line_no"), F.trim("line").alias("line"))
