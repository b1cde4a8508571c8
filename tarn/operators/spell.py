"""Spelling correction by shared k-grams, Jaccard similarity and edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import cuts
from tarn.functions.text import edit_distance_within_2, kgram_bag
from tarn.operators.index import Index
from tarn.operators.query import Query, intersection, phrase
from tarn.plans.shipping import ship
from tarn.plans.storage import stored

JACCARD, DISTANCE, LIMIT = 0.4, 2, 10


def term_grams(term: str, k: int = 2) -> list[str]:
    marked = f"^{term}$"
    return list(dict.fromkeys(marked[i : i + k] for i in range(len(marked) - k + 1)))


def candidates(terms: DataFrame, term: str, k: int = 2) -> DataFrame:
    """term, jaccard for vocabulary terms that share a k-gram with ^term$, with terms' other columns. terms should be a table that
    is written out: on a lazy vocabulary the filter goes below its grouping and judges every token.

    The query side counts distinct k-grams, the vocabulary's side counts them with repeats, so it can exceed 1. The
    query's k-grams are a short list, so each term is judged in its own row, without a join.
    """
    grams = term_grams(term, k)
    bag = kgram_bag(F.col("term"), k)
    inside = F.size(F.filter(F.col("bag"), lambda g: g.isin(grams)))
    rows = terms.select("*", bag.alias("bag")).select(*terms.columns, F.size("bag").alias("n"), inside.alias("shared")).where("shared > 0")
    return rows.select(*terms.columns, (F.col("shared") / (F.lit(len(grams)) + F.col("n") - F.col("shared"))).alias("jaccard"))


def near_terms(index: Index, term: str, k: int = 2) -> DataFrame:
    """candidates() in the vocabulary of an index. A saved one's k-grams are looked up, so that only terms which share one
    are read; it holds 2-grams."""
    if index.saved_kgrams is None or k != 2:
        return candidates(index.terms, term, k)
    shared = index.saved_kgrams.where(F.col("kgram").isin(term_grams(term, k))).select("term").distinct()
    return candidates(shared, term, k)


def corrections(counts: DataFrame, term: str, k: int = 2, near: DataFrame | None = None) -> DataFrame:
    """term, score (lower is better) for one unknown term; counts: term, df. score = distance / (df * jaccard). near: its
    candidates, where they are known; else counts are read once, and each term is judged in its row."""
    near = candidates(counts.select("term", "df"), term, k) if near is None else near.join(counts.select("term", "df"), "term")
    near = near.where(F.col("jaccard") >= JACCARD)
    near = near.withColumn("distance", edit_distance_within_2(F.lit(term), F.col("term"))).where("distance is not null")
    return near.select("term", (F.col("distance") / (F.greatest("df", F.lit(1)) * F.col("jaccard"))).alias("score"))


#: Words up to this length meet by what is left of them without one or two letters, longer ones by thirds.
LONG = 24
#: Letters taken from the word and from the term, for each kind of meeting; together they are the distance.
CUTS = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))


#: Bits of a filter for each text that it holds, and of all of it at most; rows of its slices.
BITS_EACH, MOST_BITS, SLICES = 16, 28, 64


def filter_of(words: DataFrame, most: int):
    """A broadcast of bits and a Bloom filter that holds the words (one column) of up to `most` letters. Its slices are made by
    the tasks; it has 32 MB at most, and beyond that lets more through."""
    spark = words.sparkSession
    bits = min(max(words.count() * BITS_EACH - 1, 1 << 10).bit_length(), MOST_BITS)
    each = (1 << bits) // SLICES
    at = words.mapInArrow(cuts.filling(most, bits, SLICES), "slice int, at int")
    found = {r["slice"]: bytes(r["bits"]) for r in at.groupBy("slice").applyInArrow(cuts.slice_bits(each), "slice int, bits binary").collect()}
    return spark.sparkContext.broadcast((bits, b"".join(found.get(k, bytes(each // 8)) for k in range(SLICES))))


def short_keys(words: DataFrame, column: str, side: int, others: DataFrame) -> DataFrame:
    """words with `meet`: hashes under which a word and a term of two edits at most meet, side 0 for words and 1 for terms.
    For each kind of cut both sides give what is left after their part of it, so only such pairs meet. others: the other side's
    words (one column); what is left of a word where the other side stays whole is kept only if it may be one of them."""
    most = LONG + 2
    known = filter_of(others, most)
    filters = [known if cut[side] and not cut[1 - side] else None for cut in CUTS]
    made = cuts.keyed(words.columns.index(column), [cut[side] for cut in CUTS], most, filters)
    return words.mapInArrow(made, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", meet long")


def long_keys(words: DataFrame, column: str, side: int, others: DataFrame | None = None) -> DataFrame:
    """As short_keys, for words of more than LONG letters: of a term's thirds, two edits leave one as it is, at most two
    places from where it was. Terms give their thirds, words what lies at those places for each length that a term can have."""
    w, n = F.col(column), F.length(column)
    size = lambda length: F.floor(length / 3).cast("int")
    last = lambda length, k: length - 2 * size(length) if k == 2 else size(length)

    def key(k: int, length, at) -> Column:
        return F.xxhash64(F.lit(k), length, F.call_function("substring", w, at, last(length, k)))

    if side:
        keys = F.array(*(key(k, n, k * size(n) + 1) for k in range(3)))
    else:
        keys = F.array(*(F.when(n + d > LONG, key(k, n + d, k * size(n + d) + 1 + move)) for d in range(-2, 3) for k in range(3) for move in range(-2, 3)))
    return words.where(n > LONG).select("*", F.explode(F.array_distinct(F.filter(keys, lambda x: x.isNotNull()))).alias("meet"))


def correct_words(words: DataFrame, counts: DataFrame, k: int = 2) -> DataFrame:
    """word, term, score for every correction of many words at once; words: word (distinct), counts: term, df. A word's
    corrections and scores are those of corrections(counts, word).

    A similarity join: words and terms meet under keys that two edits leave in common, then distance and Jaccard decide. No
    word scans the vocabulary, and pairs that meet are few beyond those that are near. A pair of which the shorter has
    LONG letters at most meets by short keys, any other by long ones. What is left of words without two letters, most of all
    keys, need not travel: a filter of the other side's words tells which of it is none of them."""
    words, counts = words.select("word"), counts.select("term", "df")
    ship(words.sparkSession)
    near = None
    for keys, part in ((short_keys, F.least(F.length("word"), F.length("term")) <= LONG), (long_keys, F.least(F.length("word"), F.length("term")) > LONG)):
        # a word has up to hundreds of keys, of which a planner that knows the size of the words' file alone takes no notice: it
        # would send all of them to the driver
        met = keys(words, "word", 0, counts.select("term")).hint("merge").join(keys(counts, "term", 1, words), "meet").where(part).select("word", "term", "df").distinct()
        near = met if near is None else near.unionByName(met)
    return near.mapInArrow(cuts.judging(k, JACCARD), "word string, term string, score double")


def best_corrections(words: DataFrame, counts: DataFrame, k: int = 2) -> DataFrame:
    """word, term, score: each word with its best correction (ties: the first in order), nulls where it has none."""
    best = correct_words(words, counts, k).groupBy("word").agg(F.min(F.struct("score", "term")).alias("best"))
    return words.select("word").hint("merge").join(best, "word", "left").select("word", "best.term", "best.score")


def suggest(index: Index, query: Query, limit: int = LIMIT, k: int = 2, digits: int | None = None) -> DataFrame:
    """phrase, score: the best `limit` corrections of a query. Known terms stand for themselves with score 1. Terms are
    combined from the left, scores multiplied; from the second term on only the best `limit` go on. digits: the order is that of
    scores rounded to so many, ties by phrase; scores are given unrounded."""
    spark = index.tokens.sparkSession
    counts = index.doc_freqs()
    beam: DataFrame | None = None
    shown = F.col("score") if digits is None else F.round("score", digits)
    for at, term in enumerate(query.terms):
        if not counts.where(F.col("term") == term).isEmpty():
            options = spark.createDataFrame([(term, 1.0)], "term string, score double")
        elif index.saved_kgrams is None or k != 2:
            options = corrections(counts, term, k)
        else:
            options = corrections(counts, term, k, near_terms(index, term, k))
        if digits is None:
            # products of positive scores: the best `limit` pairs are made of the best `limit` of each side
            options = options.orderBy("score", "term").limit(limit)
        if beam is None:
            beam = options.select(F.col("term").alias("phrase"), "score")
            continue
        beam, options = stored(beam, "phrases"), stored(options, "options")
        right = options.select("term", F.col("score").alias("s"))
        if digits is not None:
            # rounded, further pairs tie with the best: those up to the last of the best as rounded, with all that rounding can add
            most, first = _products(beam, right, limit).agg(F.max(shown)).first()[0], beam.agg(F.min("score")).first()[0]
            least = right.agg(F.min("s")).first()[0]
            if most is not None:
                bound = most + 10.0**-digits
                beam, right = beam.where(F.col("score") * F.lit(least) <= bound), right.where(F.col("s") * F.lit(first) <= bound)
        pairs = beam.crossJoin(right)
        beam = pairs.select(F.concat_ws(" ", "phrase", "term").alias("phrase"), (F.col("score") * F.col("s")).alias("score")).orderBy(shown, "phrase").limit(limit)
    if beam is None:
        return spark.createDataFrame([], "phrase string, score double")
    return beam.orderBy(shown, "phrase").limit(limit)


def _products(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """score: the `limit` smallest products, which are made of the `limit` smallest of each side."""
    pairs = left.select("score").orderBy("score").limit(limit).crossJoin(right.select("s").orderBy("s").limit(limit))
    return pairs.select((F.col("score") * F.col("s")).alias("score")).orderBy("score").limit(limit)


def search_with_suggestions(index: Index, query: Query, as_phrase: bool = False, limit: int = LIMIT, digits: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(results, None), or (None, suggestions) where a search gives no list at all: an unknown first term of an
    intersection, or a single unknown term of a phrase."""
    results = phrase(index, query) if as_phrase else intersection(index, query)
    return (results, None) if results is not None else (None, suggest(index, query, limit, digits=digits))


def shorten(text: str, most: int = 50) -> str:
    """A suggestion as it is shown."""
    return text if len(text) <= most else text[:most] + "..."
