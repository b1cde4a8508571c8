"""How work is laid out: joins split by frequency, many root sets at once, lookups that read few row groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import graph
from tarn.operators.index import Index, bag_norms, bags, doc_freqs, postings, token_rows, tokenized
from tarn.operators.query import Query, end_grams, expand, matches, matches_any, postings_of
from tarn.operators.rank import Normalization, ranked_combination, ranked_hits, ranked_tfidf
from tarn.plans.skew import split_join
from tarn.plans.storage import stored
from tarn.operators.spell import best_corrections, candidates, correct_words, corrections, near_terms, suggest


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    docs = [(i, " ".join(rng.choices(made, k=40)) + " the" * (i % 3 + 1)) for i in range(60)] + [(60, None), (61, "")]
    return spark.createDataFrame(docs, "doc_id long, text string")


def values(df, *cols):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_df_joins_are_the_same_however_they_are_split(spark, words):
    bagged = bags(tokenized(words))
    df, rows = stored(doc_freqs(bagged), "df"), bagged.select("doc_id", F.explode("bag").alias("b")).select("doc_id", "b.term", "b.tf")
    plain = values(rows.join(df, "term"), "doc_id", "term", "tf", "df")
    for heavy in (1, 5, 40, 10**9):
        assert values(split_join(rows, df, "term", "df", heavy), "doc_id", "term", "tf", "df") == plain
    assert values(bag_norms(bagged, df, 62, 3), "doc_id", "norm") == values(bag_norms(bagged, df, 62), "doc_id", "norm")
    assert split_join(rows.limit(0), df.limit(0), "term", "df").collect() == []
    # terms of at least total / heavy documents alone are sent to all
    total = df.agg(F.sum("df")).first()[0]
    assert df.where(F.col("df") >= total // 5 + 1).count() <= 5


def test_bags_count_terms(spark, words):
    for r in bags(tokenized(words)).collect():
        text = words.where(F.col("doc_id") == r["doc_id"]).first()["text"] or ""
        assert {b["term"]: b["tf"] for b in r["bag"]} == {t: text.split().count(t) for t in text.split()} and r["doc_len"] == len(text.split())


def test_norms_of_found_documents_alone(spark, words):
    index = Index.build(words)
    query = Query.parse("the")
    query.terms[0] = words.first()["text"].split()[0]
    whole = values(ranked_tfidf(Index.build(words, "doc_id", "text"), query, Normalization.NONE), "doc_id", "score")
    norm = dict(values(index.euclidean(), "doc_id", "norm"))
    assert values(ranked_tfidf(index, query, Normalization.EUCLIDEAN), "doc_id", "score") == [(d, pytest.approx(s / norm[d])) for d, s in whole]


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("rounds", [5, None])
def test_many_root_sets_at_once(spark, rounds):
    rng = random.Random(2)
    edges = spark.createDataFrame(list({(rng.randrange(40), rng.randrange(40)) for _ in range(150)}) + [(90, 91)], "src long, dst long")
    sets = {"a": [1, 2, 3], "b": [7], "d": [200]} | ({"c": list(range(40)), "e": [90]} if rounds else {})
    roots = spark.createDataFrame([(k, n) for k, ns in sets.items() for n in ns], "key string, node long")
    got = values(graph.root_scores(edges, roots, rounds), "key", "node", "score")
    want = []
    for k, ns in sets.items():
        one = graph.hits_scores(edges, spark.createDataFrame([(n,) for n in ns], "node long"), rounds)
        want += [(k, n, s) for n, s in values(one, "node", "score")]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=1e-7)
    assert [g[2] for g in got if g[0] == "d"] == [0.0]


def test_jobs_of_hits_do_not_grow_with_terms(spark, words):
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60)] + [(i, (i * 11 + 2) % 60) for i in range(60)], "src long, dst long")
    index, some = Index.build(words).stored(), words.first()["text"].split()
    counts = []
    for n in (2, 6):
        query = Query(some[:n], [1.0] * n)
        _, used = jobs(spark, f"hits-{n}", lambda query=query: ranked_hits(index, query, edges, rounds=8).collect())
        counts.append(used)
    assert counts[0] > 0 and abs(counts[1] - counts[0]) <= 3  # adaptive execution may merge a job or two
    assert ranked_hits(index, Query(), edges).collect() == []


def scan_rows(df):
    """Rows that the file scans of a plan gave, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    todo, seen = [plan], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            seen += p.metrics().get("numOutputRows").get().value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
    return seen


@pytest.fixture(scope="module")
def saved(spark, words, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved") / "index")
    Index.build(words).save(path, 6)
    return Index.load(spark, path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_push_filters_to_sorted_tables(spark, words, saved):
    fresh = Index.build(words)
    for term, pushed in [("ab*", "StringStartsWith(term,ab)"), ("*de", "StringStartsWith(backwards,ed)"), ("a*e", "In(kgram, [^a,e$])"), ("ab*ba", "In(kgram, [")]:
        found = expand(saved, term)
        assert pushed in plan_of(found)
        assert values(found, "term") == values(fresh.terms.where(matches(term)), "term")
        assert scan_rows(expand(saved, term)) < (saved.kgrams if "kgram" in pushed else saved.terms).count()
    assert end_grams("", "x") == ["x$"] and end_grams("ab", "") == ["^a", "ab"]
    with pytest.raises(ValueError):
        expand(saved, "*")


def test_spelling_reads_the_saved_kgrams(spark, words, saved):
    fresh = Index.build(words)
    for term in ("abce", "zzz", "a"):
        near = near_terms(saved, term)
        assert "PushedFilters: [In(kgram" in plan_of(near) or "EqualTo(kgram" in plan_of(near)
        assert values(near, "term", "jaccard") == values(candidates(fresh.terms, term), "term", "jaccard")
    assert values(corrections(saved.doc_freqs(), "abced", near=near_terms(saved, "abced")), "term", "score") == values(corrections(fresh.doc_freqs(), "abced"), "term", "score")
    query = Query.parse("abced cba the")
    assert values(suggest(saved, query), "phrase", "score") == values(suggest(fresh, query), "phrase", "score")


def test_absent_terms_read_no_row_group(spark, words, saved):
    everything = saved.postings.count()
    here = words.first()["text"].split()[0]
    assert 0 < scan_rows(saved.matching(F.col("term") == here)) < everything
    for term in ("aaaab", "ccccccc", "m", "zz"):
        assert scan_rows(saved.matching(F.col("term") == term)) == 0


def test_words_are_corrected_together_as_one_by_one(spark):
    rng = random.Random(11)
    made = lambda n: "".join(rng.choice("abcd") for _ in range(n))

    def edited(w):
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice((w[:at] + rng.choice("abcd") + w[at:], w[:at] + w[at + 1 :]))
        return w

    terms = {made(rng.choice([1, 2, 3, 5, 8, 22, 23, 24, 25, 26, 27, 28, 40])) for _ in range(120)} | {"aaaa", "abab", "x" * 60}
    terms = sorted(terms | {edited(t) for t in sorted(terms)} - {""})
    words = sorted({edited(t) for t in rng.sample(terms, 60)} | {"a", "zz", "x" * 58, "x" * 61, "aaaaa"} - {""})
    counts = spark.createDataFrame([(t, rng.randint(1, 9)) for t in terms], "term string, df long")
    got = values(correct_words(spark.createDataFrame([(w,) for w in words], "word string"), counts), "word", "term", "score")
    df = {r["term"]: r["df"] for r in counts.collect()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    want = []
    for w in words:
        grams = {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
        for t in terms:
            distance = len(w) + len(t) - 2 * lcs(w, t)
            bag = [f"^{t}$"[i : i + 2] for i in range(len(t) + 1)]
            shared = sum(g in grams for g in bag)
            if distance <= 2 and shared and shared / (len(grams) + len(bag) - shared) >= 0.4:
                want.append((w, t, round(distance / (df[t] * shared / (len(grams) + len(bag) - shared)), 9)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])
    one = "aaaaa"
    assert [g[1:] for g in got if g[0] == one] == values(corrections(counts, one), "term", "score")
    best = {r["word"]: r["term"] for r in best_corrections(spark.createDataFrame([(one,), ("zz",)], "word string"), counts).collect()}
    assert best == {one: min((g[2], g[1]) for g in got if g[0] == one)[1], "zz": None}


def test_suggestions_in_the_order_of_rounded_scores(spark, words):
    index, limit, digits = Index.build(words), 10, 1
    counts = index.doc_freqs()
    some = sorted((r["term"] for r in counts.collect()), key=lambda t: (-len(t), t))
    first, second = "z" + some[0], "z" + some[1]
    a, b = corrections(counts, first), corrections(counts, second).withColumnsRenamed({"term": "t", "score": "s"})
    for unknown in (first, second):
        assert counts.where(F.col("term") == unknown).isEmpty() and not corrections(counts, unknown).isEmpty()
    pairs = a.crossJoin(b).select(F.concat_ws(" ", "term", "t").alias("phrase"), (F.col("score") * F.col("s")).alias("score"))
    want = [r["phrase"] for r in pairs.orderBy(F.round("score", digits), "phrase").limit(limit).collect()]
    assert [r["phrase"] for r in suggest(index, Query.parse(f"{first} {second}"), limit, digits=digits).collect()] == want
    # many of equal rounded score, more than the best of each side can make
    near = spark.createDataFrame([("abcdefg" + c, 5000 - i) for i, c in enumerate("zyxwvutsrqponmlk")], "term string, df long")
    made = Index(index.tokens, index.postings, index.n, kept_df=near)
    got = [r["phrase"] for r in suggest(made, Query.parse("abcdefg abcdefg"), limit, digits=6).collect()]
    assert got == [f"abcdefgk abcdefg{c}" for c in "klmnopqrst"]


def test_keys_of_words_are_not_sent_to_the_driver(spark, words, tmp_path):
    path = str(tmp_path / "df")
    Index.build(words).doc_freqs().write.parquet(path)
    counts = spark.read.parquet(path)
    found = best_corrections(counts.where("df = 1").select(F.col("term").alias("word")), counts.where("df > 1"))
    assert "Broadcast" not in plan_of(found)
    assert "Join" not in plan_of(corrections(counts, "abced"))


def test_a_vocabulary_is_written_out_before_it_is_judged(spark, words):
    index = Index.build(words)
    counts = index.doc_freqs()
    assert index.kept_bags is None and "Generate" not in plan_of(index.terms) and "Generate" not in plan_of(candidates(counts, "abced"))
    assert values(counts, "term", "df") == values(doc_freqs(bags(tokenized(words))), "term", "df")


def test_whole_indexes_shuffle_no_tokens(spark, words):
    from tarn.operators.index import merge_postings, merge_written, postings, term_dictionary, whole_postings

    tokens = tokenized(words)
    cols = ("term", "doc_id", "tf", "offsets", "doc_len")
    want = values(postings(tokens), *cols)
    assert values(whole_postings(tokens), *cols) == want and "Exchange" not in plan_of(whole_postings(tokens))
    twice = tokens.union(tokens.where("doc_id = 3"))
    assert values(whole_postings(twice), *cols) == values(postings(twice), *cols)
    a, b, c = (stored(whole_postings(tokens.where(w)), "part") for w in ("doc_id < 20", "doc_id >= 20", "doc_id = 7 or doc_id = 30"))
    assert values(merge_written(a, b), *cols) == want and "Exchange" not in plan_of(merge_written(a, b))
    assert values(merge_written(a, b, c), *cols) == values(merge_postings(a, b, c), *cols)
    seen = list(dict.fromkeys(t for r in tokens.orderBy("doc_id").collect() for t in r["toks"]))
    assert values(term_dictionary(tokens), "term_id", "term") == list(enumerate(seen))


ODD = [(0, "Permit the MIT license; a.b.mit 12thmit 1/2mit http://a*bc/mit"), (1, "submit limits"), (2, None), (3, ""), (4, "Élan élan ÉLAN."), (5, "x-mit mit-x the"), (6, "http://a*zz apaches"), (7, "the-an mit"), (8, "12th"), (9, "mitten * *"), (9, "the mit again")]


@pytest.mark.parametrize("options", [{}, {"case": False}, {"strip_diacritics": True}, {"patterns": None}, {"patterns": [r"\bm\w+"]}, {"keep_punctuation": True}, {"drop_trailing_chunk": True}])
def test_documents_that_cannot_hold_a_term_are_left_out_unseen(spark, options):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    index = Index.build(docs, **options)
    kept = index.stored()  # of all documents
    cols = ("term", "doc_id", "tf", "offsets", "doc_len")
    for terms in (["mit"], ["http://a*b*"], ["elan", "élan", "*th", "m*n", "mit"]):
        assert values(postings_of(index, terms), *cols) == values(kept.postings.where(matches_any(terms)), *cols), terms
    assert "Contains(" in (plan := plan_of(postings_of(index, ["mit"]))) and plan.index("posexplode") < plan.index("Contains(")


def test_each_document_is_tokenized_once(spark, words):
    tokens, index = tokenized(words), Index.build(words)
    for rows in (postings(tokens), token_rows(tokens), index.matching(F.col("term") == "the"), postings_of(index, ["the"])):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert sum("RLIKE" in line for line in plan.split("\n")) == 1, plan
    ranks = words.select(F.col("doc_id").alias("node"), F.lit(0.5).alias("pr"))
    for text in ("the abc", "the ab*"):
        query = Query.parse(text)
        for found in (ranked_tfidf(index, query), ranked_combination(index, query, ranks)):
            assert "posexplode" not in plan_of(found)  # of postings that are written out


def test_scores_are_those_of_plain_counts(spark, words):
    texts = {r["doc_id"]: (r["text"] or "").split() for r in words.collect()}
    for text in ("a the", "ab* *d", "nowhere"):
        query = Query.parse(text)
        fits = lambda t: sum(t == q or q.endswith("*") and t.startswith(q[:-1]) or q.startswith("*") and t.endswith(q[1:]) for q in query.terms)
        df = {t: sum(t in x for x in texts.values()) for t in {t for x in texts.values() for t in x if fits(t)}}
        want = {d: sum(fits(t) * math.log(len(texts) / df[t]) for t in x if t in df) / max(len(x), 1) for d, x in texts.items()}
        assert values(ranked_tfidf(Index.build(words), query), "doc_id", "score") == [(d, pytest.approx(s, abs=1e-9)) for d, s in sorted(want.items()) if s > 0]


def test_cuts_and_distances_are_those_of_plain_text():
    from itertools import combinations

    from tarn.functions import cuts

    rng = random.Random(3)
    some = sorted({"".join(rng.choice("aabcé😀") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    left = lambda w, n: {"".join(x for i, x in enumerate(w) if i not in gone) for gone in combinations(range(len(w)), n)}
    known = {}
    for n in (0, 1, 2):
        for w in some:
            got = set(cuts.cut_keys([w, w], n)[0].tolist())
            assert got == set(cuts.cut_keys([w], n)[0].tolist()) and len(got) == len(left(w, n))
            for text in left(w, n) - {""}:
                known[text] = cuts.cut_keys([text], 0)[0].tolist()[0]
                assert known[text] in got
    assert len(set(known.values())) == len(known)
    for a in some:
        for b in some:
            want = next((i + j for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)) if left(a, i) & left(b, j)), None)
            assert cuts.distance(a, b) == want, (a, b)


def test_keys_that_meet_nothing_do_not_travel(spark):
    from tarn.operators.spell import short_keys

    rng = random.Random(4)
    made = lambda n: [("".join(rng.choice("abcdefghij") for _ in range(16)),) for _ in range(n)]
    words, terms = (spark.createDataFrame(made(400), f"{c} string") for c in ("word", "term"))
    # of 16 letters: one key for each of three kinds, 16 for one letter of each, and few of the other 136
    assert short_keys(words, "word", 0, terms).count() < 400 * 24
    assert short_keys(terms, "term", 1, words).count() < 400 * 24
