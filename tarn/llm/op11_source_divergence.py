"""Which terms set a source apart from its language, and how far sources of one language are from each other, by a
divergence of smoothed term shares in whole numbers.

Two passes of one kind: repartition by (lang, term), sort each partition by (lang, term, source, document), and scan its
runs. The first scan adds up document frequencies and counts and lets the terms through that enough documents of the
language hold; the second, over these with their shares, emits the partial sums of pairs and the terms of each run.

Scale: a task adds up its own documents by (lang, source, term) before anything is shuffled, so that a word that every
document holds travels as one row for each task and source, and no run is longer than tasks x sources. Scans keep the
sums of one term's sources at most. A pair's sum covers all kept terms, but only terms that both sources hold are met in pairs, one
run at a time and summed within the task: the rest follows from each source's histogram of shares and the share of a term
that it doesn't hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import parts, ship, stored, table
from tarn.llm.packing import Numbers

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Pairs of document and term, and distinct terms, that a task adds up before it passes them on.
HELD_PAIRS, HELD_TERMS = 4_000_000, 600_000
#: Partial sums of pairs that a task holds, and rows that a scan takes at once.
HELD_SUMS, SCAN_ROWS = 2_000_000, 50_000
#: Everything but ASCII letters and what lies beyond ASCII separates terms; A-Z are lower-cased.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PARTIAL = "lang string, term string, source string, document long, docs long, n long"
COUNTS = "lang string, term string, source string, n long, total long, lead long"
FOUND = "lang string, source string, part string, item string, high long, low long"


def term_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def tally(batches):
    """Each task's documents, added up by group and term: the smallest document, documents and occurrences. A group (lang,
    source) also has a row of the empty term, with its documents, so that groups without terms are known."""
    groups, terms, held, size = Numbers(), Numbers(), [], 0

    def rows():
        group, term, doc, docs, n = (np.concatenate(x) for x in zip(*held))
        key = (group << 32) | term
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low, docs, n = np.minimum.reduceat(doc[order], starts), np.add.reduceat(docs[order], starts), np.add.reduceat(n[order], starts)
        names = pa.array(list(terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        for at in range(0, len(starts), 50_000):
            k = key[starts[at : at + 50_000]]
            g = pa.array(k >> 32)
            yield pa.RecordBatch.from_arrays([langs.take(g), names.take(pa.array(k & 0xFFFFFFFF)), sources.take(g), *(pa.array(x[at : at + 50_000]) for x in (low, docs, n))], ["lang", "term", "source", "document", "docs", "n"])

    empty = terms[b""]
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("document").to_numpy(zero_copy_only=False)
        group = np.array([groups[g] for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], dtype=np.int64)
        number = terms.__getitem__
        lists = [term_list(t) for t in texts]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((number(w) for ws in lists for w in ws), dtype=np.int64, count=int(sizes.sum()))
        key, n = np.unique((np.repeat(np.arange(len(lists)), sizes) << 32) | flat, return_counts=True)
        row, term = key >> 32, key & 0xFFFFFFFF
        one = np.ones(len(lists), dtype=np.int64)
        held.append((group[row], term, ids[row], np.ones(len(row), dtype=np.int64), n.astype(np.int64)))
        held.append((group, one * empty, ids, one, one * 0))
        size += len(row) + len(lists)
        if size > HELD_PAIRS or len(terms) > HELD_TERMS:
            yield from rows()
            groups, terms, held, size = Numbers(), Numbers(), [], 0
            empty = terms[b""]
    if held:
        yield from rows()


def _breaks(table_: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    new = np.zeros(table_.num_rows, dtype=bool)
    new[:1] = True
    for c in columns:
        col = table_.column(c)
        if table_.num_rows > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, table_.num_rows - 1)).to_numpy(zero_copy_only=False)
    return new


def _whole_runs(batches, columns: list[str], shrink=lambda rows: rows):
    """Tables of SCAN_ROWS rows or so that end where a run of `columns` ends; shrink() is applied to the rows that wait."""
    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= SCAN_ROWS:
            whole = pa.concat_tables(held).combine_chunks()
            cut = int(np.flatnonzero(_breaks(whole, columns))[-1])
            if cut:
                yield whole.slice(0, cut)
            held, size = [shrink(whole.slice(cut))], 0
    whole = pa.concat_tables(held).combine_chunks() if held else None
    if whole is not None and whole.num_rows:
        yield whole


def count_runs(min_docs: int):
    """Scan of sorted tally rows: (lang, term, source) with its occurrences, and those of the term in the language, for terms
    that min_docs documents of the language hold; `lead` is 1 in one row of each such term. Rows of the empty term pass."""

    def collapse(t: pa.Table) -> pa.Table:
        starts = np.flatnonzero(_breaks(t, ["lang", "term", "source"]))
        sums = {c: np.add.reduceat(t.column(c).to_numpy(), starts) for c in ("docs", "n")}
        heads = t.select(["lang", "term", "source"]).take(pa.array(starts))
        return heads.append_column("docs", pa.array(sums["docs"])).append_column("n", pa.array(sums["n"]))

    def run(batches):
        for t in _whole_runs(batches, ["lang", "term"], collapse):
            t = collapse(t)
            new = _breaks(t, ["lang", "term"])
            starts, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            docs, total = (np.add.reduceat(t.column(c).to_numpy(), starts) for c in ("docs", "n"))
            marker = pc.equal(t.column("term"), "").to_numpy(zero_copy_only=False)
            keep = marker | (docs[run_of] >= min_docs)
            kept = t.select(["lang", "term", "source", "n"]).append_column("total", pa.array(total[run_of])).append_column("lead", pa.array((new & ~marker).astype(np.int64)))
            yield from kept.filter(pa.array(keep)).to_batches()

    return run


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_runs(batches):
    """Scan of sorted shares: for each two sources of a run, what the run adds to their sum beyond what the histograms say,
    summed within the task as 2^32 * high + low; and the source's terms of more than the language's share."""
    names, held, size = Numbers(), [], 0

    def sums():
        key, value = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, high, low = key[starts], np.add.reduceat(value >> 32, starts), np.add.reduceat(value & 0xFFFFFFFF, starts)
        listed = list(names)
        langs, sources = (pa.array([x[k] for x in listed], pa.string()) for k in (0, 1))
        a, b = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([langs.take(a), sources.take(a), pa.array(["pair"] * len(key)), sources.take(b), pa.array(high), pa.array(low)], ["lang", "source", "part", "item", "high", "low"])

    for t in _whole_runs(batches, ["lang", "term"]):
        group = np.array([names[g] for g in zip(t.column("lang").to_pylist(), t.column("source").to_pylist())], dtype=np.int64)
        p, p0, q = (t.column(c).to_numpy() for c in ("p", "p0", "q"))
        starts = np.flatnonzero(_breaks(t, ["lang", "term"]))
        sizes = np.diff(np.concatenate((starts, [t.num_rows])))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        # row i meets the k-th row of its run: one step for each k, all runs that are long enough together
        for k in range(int(sizes.max())):
            i = np.flatnonzero(sizes[run_of] > k)
            j = starts[run_of[i]] + k
            i, j = i[i != j], j[i != j]
            held.append(((group[i] << 32) | group[j], _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])))
            size += len(i)
            if size > HELD_SUMS:
                yield sums()
                held, size = [], 0
        over = np.flatnonzero(p > q)
        if len(over):
            own = t.take(pa.array(over))
            f = _f(p[over], q[over])
            columns = [own.column("lang"), own.column("source"), pa.array(["term"] * len(over)), own.column("term"), pa.array(f >> 32), pa.array(f & 0xFFFFFFFF)]
            yield from pa.Table.from_arrays(columns, ["lang", "source", "part", "item", "high", "low"]).to_batches()
        if len(names) > HELD_SUMS and size:
            yield sums()
            names, held, size = Numbers(), [], 0
    if size:
        yield sums()


def share(n: str, of: str) -> Column:
    """1 + floor(SCALE * (n + 1) / of), exact for counts of any size."""
    return F.expr(f"1 + cast(({SCALE} * cast({n} + 1 as decimal(20, 0))) div cast({of} as decimal(20, 0)) as bigint)")


def gap(p: str, q: str) -> Column:
    return F.expr(f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(20, 0))")


def sorted_runs(rows: DataFrame, *then: str) -> DataFrame:
    """rows with all of a (lang, term) in one partition, sorted. The hash in front settles most comparisons."""
    keyed = rows.withColumn("key", F.xxhash64("lang", "term"))
    return keyed.repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key", "lang", "term", *then)


def source_divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Returns lang, source, part, item, value, rank. part `pair`: item is another source of the language, value the sum of
    floor((p - q)^2 / q) over all kept terms, p and q being the shares in source and item. part `term`: item is a kept term
    that the source holds with a larger share than the language's, value that term's; the first `top` of each source.

    Terms are stretches of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that
    min_docs of its documents hold, V of them; a share is 1 + floor(10^9 * (count + 1) / (N + V)), N being the kept
    terms' occurrences in the source (or the language). Nulls in text, lang and source count as ''. Every row is a document
    of its own, whatever its id, so repeated rows count as often as they stand there. Ranks order by value
    descending, then item. A language without kept terms has pairs of value 0; one with a single source has none.
    Extra columns are left out.
    """
    ship(docs.sparkSession)
    text, lang, source = (F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("document"), text, lang, source)
    runs = sorted_runs(rows.mapInArrow(tally, PARTIAL), "source", "document")
    counts = stored(runs.drop("key", "document").mapInArrow(count_runs(min_docs), COUNTS), "counts")
    kept = counts.where("term <> ''")

    langs = counts.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("n_lang"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.expr("int(term <> '')")).alias("held")).join(langs, "lang")
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n_group + v"))), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "n_group + v"), "q": share("total", "n_lang + v")})
    shares = stored(shares.select("lang", "term", "source", "p", "p0", "q"), "shares")
    found = stored(sorted_runs(shares, "source").drop("key").mapInArrow(pair_runs, FOUND), "found")

    # pairs: what both sources' histograms and the terms that neither holds add
    one, other = groups.select("lang", "source", "p0", "held", "v"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("held2"))
    neither = one.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.expr("cast(v - held - held2 as decimal(20, 0))") * gap("p0", "q0")).otherwise(0).cast("decimal(38, 0)").alias("value"))
    bars = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    met = bars.join(other.select("lang", "item", "q0"), "lang").where("source <> item")
    k = F.col("k").cast("decimal(20, 0)")
    sides = met.select("lang", F.explode(F.array(F.struct("source", "item", (k * gap("p", "q0")).cast("decimal(38, 0)").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (k * gap("q0", "p")).cast("decimal(38, 0)").alias("value")))).alias("s")).select("lang", "s.*")
    both = found.where("part = 'pair'").select("lang", "source", "item", F.expr("cast(high as decimal(20, 0)) * 4294967296 + low").cast("decimal(38, 0)").alias("value"))
    pairs = neither.unionByName(sides).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", F.expr("high * 4294967296 + low").alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM k GROUP BY lang),
q AS (SELECT k.lang, k.term, 1 + 1000000000 * (k.c + 1) // (l.n + l.v) AS q FROM k JOIN l ON k.lang = l.lang),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
n AS (SELECT s.lang, s.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (n.n + l.v) AS p
      FROM n JOIN l ON n.lang = l.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
g AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
