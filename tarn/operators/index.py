"""The positional inverted index and the k-gram index as DataFrames.

tokenized(doc_id, toks): a row for each document, tokens in order; postings(term, doc_id, tf, offsets, doc_len): a row for
each term and document. Postings carry the document's length, so ranking needs no join for it. All are lazy: a query's
filter on `term` goes below the grouping, so that only its terms' tokens are shuffled; save() keeps an index whose
files are sorted by term, where the same filter prunes row groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import folded, kgrams, tokenize
from tarn.plans.skew import HEAVY_KEYS, split_join
from tarn.plans.storage import stored


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, toks. options: see functions.text.tokenize."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenize(F.col(text_col), **options).alias("toks"))


def placed(tokens: DataFrame) -> DataFrame:
    """doc_id, doc_len, pos (from 0), term.

    Exploded as outer, since for a plain explode Spark adds a filter that the array isn't empty, takes it below the column that
    makes the array, and so tokenizes each document once more for it. The length stands in the row before, so that the array
    isn't carried along with each token."""
    rows = tokens.select("doc_id", F.size("toks").alias("doc_len"), "toks")
    return rows.select("doc_id", "doc_len", F.posexplode_outer("toks").alias("pos", "term")).where(F.col("pos").isNotNull())


def token_rows(tokens: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), term."""
    return placed(tokens).select("doc_id", "pos", "term")


def postings(tokens: DataFrame) -> DataFrame:
    """term, doc_id, tf, offsets (ascending), doc_len."""
    return placed(tokens).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("offsets"), F.first("doc_len").alias("doc_len"))


def ids_differ(rows: DataFrame) -> bool:
    """Whether each row has a doc_id of its own, and none is null."""
    seen = rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    return seen["rows"] == seen["ids"]


def whole_postings(tokens: DataFrame) -> DataFrame:
    """postings() of everything. Where each document is one row, its postings are made in that row, and nothing is shuffled; a
    filter on `term` is not taken below that, so lookups in what isn't saved are for postings()."""
    if not ids_differ(tokens.select("doc_id")):
        return postings(tokens)
    by_term = F.sort_array(F.transform("toks", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    ordered = tokens.select("doc_id", F.size("toks").alias("doc_len"), by_term.alias("t"))
    starts = F.expr("case when size(t) > 0 then filter(sequence(0, size(t) - 1), i -> i = 0 or get(t, i - 1).term <> t[i].term) else array() end")
    part = F.expr("transform(s, (at, k) -> struct(t[at].term as term, slice(t, at + 1, coalesce(get(s, k + 1), size(t)) - at).pos as offsets))")
    rows = ordered.withColumn("s", starts).select("doc_id", "doc_len", F.explode(part).alias("p"))
    return rows.select("p.term", "doc_id", F.size("p.offsets").cast("long").alias("tf"), "p.offsets", "doc_len")


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("toks").alias("doc_len"))


def term_counts(tokens: DataFrame) -> DataFrame:
    """term, df (documents), cf (occurrences). A document's tokens are sorted in its own row, where the first of equal
    ones is marked, so one grouping by term counts both, map-side combined."""
    ordered = tokens.select(F.array_sort("toks").alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.try_element_at("t", i) == x), 0).otherwise(1).alias("first")))
    return ordered.select(F.explode(marked).alias("m")).groupBy("m.term").agg(F.sum("m.first").alias("df"), F.count("*").alias("cf"))


def term_dfs(tokens: DataFrame) -> DataFrame:
    """term, df."""
    return tokens.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode(F.array_distinct("toks")).alias("term")).distinct()


def term_dictionary(tokens: DataFrame) -> DataFrame:
    """term_id (from 0, in order of first occurrence), term.

    Terms are numbered within the document of their first occurrence. Documents are range-partitioned by id, which may be of
    any type; running sums within a partition and over partitions' sums, of which there are as many as shuffle partitions,
    give each document's first number, so no task orders all terms or documents.
    """
    # distinct tokens of a document are in order of first occurrence
    rows = tokens.select("doc_id", F.posexplode(F.array_distinct("toks")).alias("pos", "term")).groupBy("term")
    if ids_differ(tokens.select("doc_id")):
        first = rows.agg(F.min("doc_id").alias("doc_id"), F.min_by("pos", "doc_id").alias("pos"))
    else:
        first = rows.agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("term", "at.doc_id", "at.pos")
    first = stored(first, "first-places")
    new = first.groupBy("doc_id").agg(F.count("*").alias("n"))
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = stored(new.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "new-terms")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = new.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = new.select("doc_id", "part", before(Window.partitionBy("part").orderBy("doc_id")).alias("within")).join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return ranked.join(starts, "doc_id").select((F.col("start") + F.col("rank")).cast("long").alias("term_id"), "term")


def bags(tokens: DataFrame) -> DataFrame:
    """doc_id, doc_len, bag: a document's distinct terms with their tf, counted in the document's own row."""
    ordered = tokens.select("doc_id", F.size("toks").alias("doc_len"), F.array_sort("toks").alias("t"))
    starts = F.expr("case when size(t) > 0 then filter(sequence(0, size(t) - 1), i -> i = 0 or get(t, i - 1) <> t[i]) else array() end")
    bag = F.expr("transform(s, (at, k) -> struct(t[at] as term, coalesce(get(s, k + 1), size(t)) - at as tf))")
    return ordered.withColumn("s", starts).select("doc_id", "doc_len", bag.alias("bag"))


#: Row groups of a saved index: small, as a lookup reads whole ones.
BLOCK_BYTES = 8 << 20
def doc_freqs(bagged: DataFrame) -> DataFrame:
    """term, df."""
    return bagged.select(F.explode("bag.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bag_norms(bagged: DataFrame, df: DataFrame, n: int, heavy_terms: int = HEAVY_KEYS) -> DataFrame:
    """doc_id, norm of the documents of bagged (all, or those that a query found); df, n: of the whole corpus.

    No task holds a stop word's postings: they stay with their documents, and the word's df comes to them."""
    rows = bagged.select("doc_id", F.explode("bag").alias("b")).select("doc_id", "b.term", "b.tf")
    weight = F.pow(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 2)
    return split_join(rows, df, "term", "df", heavy_terms).groupBy("doc_id").agg(F.sqrt(F.sum(weight)).alias("norm"))


def doc_norms(tokens: DataFrame) -> DataFrame:
    """doc_id, norm: sqrt of the sum over terms of (tf * ln(N / df)) squared. Documents are tokenized once."""
    kept = stored(bags(tokens), "bags")
    return bag_norms(kept, stored(doc_freqs(kept), "df"), kept.count())


def merge_postings(*partial: DataFrame) -> DataFrame:
    """One index from partial ones: postings of the same term and document become one, offsets ascending."""
    rows = partial[0]
    for p in partial[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.max("doc_len").alias("doc_len"))


def merge_written(*partial: DataFrame) -> DataFrame:
    """merge_postings() of partial indexes that are written out, each with one row a term and document: only the postings of
    documents that are in several of them are shuffled."""
    ids = None
    for p in partial:
        own = p.select("doc_id").distinct()
        ids = own if ids is None else ids.union(own)
    both = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared")), "shared-ids")
    rows = partial[0]
    for p in partial[1:]:
        rows = rows.unionByName(p)
    if both.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    return rows.join(both, same, "left_anti").unionByName(merge_postings(rows.join(both, same, "left_semi")))


def kgram_index(terms: DataFrame, k: int = 2) -> DataFrame:
    """kgram, term; terms: a column `term` of distinct terms."""
    return terms.select(F.explode(kgrams(F.col("term"), k)).alias("kgram"), "term")


def kgram_lookup(index: DataFrame, kgram: str) -> DataFrame:
    return index.where(F.col("kgram") == kgram).select("term")


def kgram_intersect(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Terms that hold all the k-grams."""
    wanted = sorted(set(wanted))
    found = index.where(F.col("kgram").isin(wanted)).groupBy("term").agg(F.count_distinct("kgram").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("term")


def kgram_report(index: DataFrame, dictionary: DataFrame, wanted: str, k: int, show: int = 10) -> tuple[int, list[str]]:
    """Number of terms that hold all of the k-grams named in `wanted`, and the first few by number. A wrong length is an error."""
    grams = wanted.split()
    if bad := [g for g in grams if len(g) != k]:
        raise ValueError(f"not {k}-grams: {bad}")
    found = kgram_intersect(index, grams)
    return found.count(), [r["term"] for r in found.join(dictionary, "term").orderBy("term_id").limit(show).collect()]


def reversed_terms(terms: DataFrame) -> DataFrame:
    return terms.select(F.reverse("term").alias("backwards"), "term")


@dataclass
class Index:
    """What queries read. norms may be None until Euclidean normalisation is asked for. source: documents, their columns of ids
    and texts, and tokenize()'s options, where tokens are made from texts as they are read."""

    tokens: DataFrame
    postings: DataFrame
    n: int
    norms: DataFrame | None = None
    saved_terms: DataFrame | None = None
    saved_docs: DataFrame | None = None
    saved_kgrams: DataFrame | None = None
    saved_reversed: DataFrame | None = None
    kept_bags: DataFrame | None = None
    kept_df: DataFrame | None = None
    source: tuple[DataFrame, str, str, dict] | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> Index:
        tokens = tokenized(docs, id_col, text_col, **options)
        return cls(tokens, postings(tokens), docs.count(), source=(docs, id_col, text_col, options))

    @property
    def terms(self) -> DataFrame:
        if self.saved_terms is not None:
            return self.saved_terms
        return vocabulary(self.tokens) if self.kept_df is None else self.kept_df.select("term")

    @property
    def docs(self) -> DataFrame:
        """doc_id, name (null where none was saved), doc_len."""
        if self.saved_docs is not None:
            return self.saved_docs
        return doc_lengths(self.tokens).select("doc_id", F.lit(None).cast("string").alias("name"), "doc_len")

    @property
    def kgrams(self) -> DataFrame:
        """kgram, term of the vocabulary's 2-grams."""
        return self.saved_kgrams if self.saved_kgrams is not None else kgram_index(self.terms)

    @property
    def reversed(self) -> DataFrame:
        """backwards, term: the vocabulary by its terms' letters from the last to the first."""
        return self.saved_reversed if self.saved_reversed is not None else reversed_terms(self.terms)

    def bags(self) -> DataFrame:
        """doc_id, doc_len, bag; written out the first time, so that documents are tokenized once."""
        if self.kept_bags is None:
            self.kept_bags = stored(bags(self.tokens), "bags")
        return self.kept_bags

    def doc_freqs(self) -> DataFrame:
        """term, df; written out the first time. Where no bags are kept, documents are tokenized for it, and nothing of theirs is
        written."""
        if self.kept_df is None:
            self.kept_df = stored(term_dfs(self.tokens) if self.kept_bags is None else doc_freqs(self.kept_bags), "df")
        return self.kept_df

    def counts(self, condition: Column, of_text: Callable[[Column], Column] | None = None) -> DataFrame:
        """term, doc_id, tf, doc_len of the terms that the condition picks: from bags where there are any, else postings; see
        matching()."""
        if self.kept_bags is None:
            return self.matching(condition, of_text).select("term", "doc_id", "tf", "doc_len")
        rows = self.kept_bags.select("doc_id", "doc_len", F.explode("bag").alias("b"))
        return rows.select("b.term", "doc_id", F.col("b.tf").cast("long").alias("tf"), "doc_len").where(condition)

    def euclidean(self, of: DataFrame | None = None) -> DataFrame:
        """doc_id, norm; of the documents in `of` (doc_id) alone, where given."""
        if self.norms is not None:
            return self.norms
        bagged = self.bags()  # before df, which are counted from them
        rows = bagged if of is None else bagged.join(of.select("doc_id"), "doc_id", "left_semi")
        return bag_norms(rows, self.doc_freqs(), self.n)

    def stored(self) -> Index:
        """This index with its tokens written to the shared folder, for work that reads them more than once."""
        tokens = stored(self.tokens, "tokens")
        return replace(self, tokens=tokens, postings=postings(tokens), source=None)

    def everything(self) -> DataFrame:
        """All postings, for work that reads the whole index."""
        return self.postings if self.saved_terms is not None else whole_postings(self.tokens)

    def matching(self, condition: Column, of_text: Callable[[Column], Column] | None = None) -> DataFrame:
        """Postings of the terms that the condition picks. of_text: what is true of the folded text (and may be of others) of every
        document with such a term; where tokens are made from texts, the other documents are not tokenized."""
        if of_text is None or self.source is None:
            return self.postings.where(condition)
        docs, id_col, text_col, options = self.source
        some = docs.where(of_text(folded(F.col(text_col), **options)))
        return postings(tokenized(some, id_col, text_col, **options)).where(condition)

    def save(self, path: str, partitions: int | None = None, names: DataFrame | None = None) -> None:
        """Write the index below path, so that lookups read few row groups: postings, terms (with df) and k-grams
        range-partitioned and sorted by what they are looked up by, terms once more by their reversal; tokens, norms and
        documents (with names: doc_id, name) beside them. Documents are tokenized once. Overwrites nothing."""
        spark = self.tokens.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

        def write(rows: DataFrame, name: str, *by: str) -> None:
            rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by) if by else rows
            rows.write.option("parquet.block.size", BLOCK_BYTES).option("parquet.bloom.filter.enabled#term", name == "postings").parquet(f"{path}/{name}")

        write(self.tokens, "tokens")
        kept = replace(self, tokens=spark.read.parquet(f"{path}/tokens"), source=None)
        # doc_id too, so that a frequent term's postings fall into several files
        write(whole_postings(kept.tokens), "postings", "term", "doc_id")
        write(kept.euclidean(), "norms")
        write(kept.doc_freqs(), "terms", "term")
        terms = spark.read.parquet(f"{path}/terms")
        write(reversed_terms(terms), "reversed", "backwards")
        write(kgram_index(terms), "kgrams", "kgram", "term")
        docs = kept.docs
        if names is not None:
            docs = docs.drop("name").join(names.select("doc_id", "name").dropDuplicates(["doc_id"]), "doc_id", "left").select("doc_id", "name", "doc_len")
        write(docs, "docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        tokens, postings_, norms, terms, docs, kgrams_, backwards = (spark.read.parquet(f"{path}/{name}") for name in ("tokens", "postings", "norms", "terms", "docs", "kgrams", "reversed"))
        return cls(tokens, postings_, docs.count(), norms, terms.select("term"), docs, kgrams_, backwards, kept_df=terms)
