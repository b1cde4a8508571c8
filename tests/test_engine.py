import math

import pytest
from pyspark.sql import functions as F

from tarn.operators import evaluate, graph
from tarn.operators.index import Index, kgram_index, merge_postings, postings, term_dictionary, tokenized
from tarn.operators.query import Query, intersection, kgram_side_lookup, matches, page, phrase, rocchio
from tarn.operators.rank import Normalization, ranked_tfidf
from tarn.operators.spell import search_with_suggestions, shorten
from tarn.plans.search import Kind, search
from tarn.sources import files
from tarn.streaming import incremental


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame([(0, "a b a c"), (1, "b c"), (2, "a b c a b"), (3, None)], "doc_id long, text string"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_phrase_scores(index):
    assert rows(phrase(index, Query.parse("a b")), "doc_id", "score", "offsets") == [(0, 3, [1]), (2, 5, [1, 4])]
    assert phrase(index, Query.parse("zzz")) is None
    assert rows(phrase(index, Query.parse("a zzz")), "doc_id") == []
    assert rows(phrase(index, Query.parse("c")), "doc_id", "score") == [(0, 1), (1, 1), (2, 1)]


def test_intersection_rules(index):
    assert intersection(index, Query.parse("zzz a")) is None
    assert rows(intersection(index, Query.parse("a zzz")), "doc_id", "score", "offsets") == rows(intersection(index, Query.parse("a")), "doc_id", "score", "offsets")
    assert rows(intersection(index, Query.parse("a zz*")), "doc_id") == []
    assert rows(intersection(index, Query.parse("")), "doc_id") == []
    assert rows(search(index, Query.parse("b b"), Kind.INTERSECTION), "doc_id", "score")[2] == (2, 4)


def test_idf_of_terms_everywhere(spark):
    ix = Index.build(spark.createDataFrame([(0, "a b"), (1, "b")], "doc_id long, text string"))
    assert rows(ranked_tfidf(ix, Query.parse("b")), "doc_id") == []
    (doc, score), = rows(ranked_tfidf(ix, Query.parse("a b a"), Normalization.NONE), "doc_id", "score")
    assert doc == 0 and score == pytest.approx(2 * math.log(2))


def test_wildcards(spark):
    words = spark.createDataFrame([("abc",), ("abbc",), ("xab",)], "term string")
    found = lambda t: rows(words.where(matches(t)), "term")
    assert found("ab*bc") == [("abbc",), ("abc",)] and found("*ab") == [("xab",)] and found("ab*") == [("abbc",), ("abc",)] and found("*b*") == []
    with pytest.raises(ValueError):
        matches("*")


def test_rocchio_feeds_the_first_copy(index):
    fed = {r["ord"]: (r["term"], r["weight"]) for r in rocchio(index, Query.parse("a a"), [0, 2]).where("ord >= 0").collect()}
    assert fed[0] == ("a", pytest.approx(0.1 + 0.8 * 4 / 2)) and fed[1] == ("a", pytest.approx(0.1))
    assert rows(rocchio(index, Query.parse("a"), []), "ord", "term", "weight") == [(0, "a", 1.0)]


def test_query_helpers(index):
    q = Query.parse("  A b ")
    copy = q.copy()
    copy.terms.append("c")
    assert q.terms == ["a", "b"] and q.size() == 2 and q.length() == 2.0
    assert kgram_side_lookup(index, Query.parse("^a a$")) == (1, ["a"])
    assert shorten("x" * 51) == "x" * 50 + "..." and shorten("x") == "x"
    assert [r["rank"] for r in page(ranked_tfidf(index, Query.parse("a")), 1, 5).collect()] == [2]


def test_suggestions(spark):
    ix = Index.build(spark.createDataFrame([(0, "the cat sat"), (1, "then that")], "doc_id long, text string"))
    results, options = search_with_suggestions(ix, Query.parse("thhe cat"))
    assert results is None and options.first()["phrase"] == "the cat"
    results, options = search_with_suggestions(ix, Query.parse("the"))
    assert options is None and rows(results, "doc_id") == [(0,)]


def test_save_load_merge(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"), 2)
    back = Index.load(spark, str(tmp_path / "ix"))
    assert rows(back.postings, "term", "doc_id", "tf") == rows(index.postings, "term", "doc_id", "tf") and back.n == 4
    assert rows(back.kgrams, "kgram", "term") == rows(kgram_index(index.terms), "kgram", "term") and {r["name"] for r in back.docs.collect()} == {None}
    names = index.tokens.select("doc_id", F.concat(F.lit("name "), "doc_id").alias("name"))
    index.save(str(tmp_path / "named"), 2, names)
    named = Index.load(spark, str(tmp_path / "named")).docs
    assert rows(named, "doc_id", "name") == rows(names, "doc_id", "name") and rows(named, "doc_id", "doc_len") == rows(index.docs, "doc_id", "doc_len")
    docs = index.tokens
    whole = merge_postings(postings(docs.where("doc_id < 2")), postings(docs.where("doc_id >= 1")).where("doc_id > 1"))
    assert rows(whole, "term", "doc_id", "offsets") == rows(index.postings, "term", "doc_id", "offsets")
    lines = files.export_postings(index.postings)
    assert rows(files.import_postings(lines), "term", "doc_id", "tf", "offsets") == rows(index.postings, "term", "doc_id", "tf", "offsets")


def test_terms_of_documents_with_text_ids_are_numbered(spark):
    docs = spark.createDataFrame([("b", "y x"), ("a", "z y z"), ("c", "x w")], "doc_id string, text string")
    assert sorted((r["term_id"], r["term"]) for r in term_dictionary(tokenized(docs)).collect()) == [(0, "z"), (1, "y"), (2, "x"), (3, "w")]


def test_formatted_results_and_curves(spark, tmp_path):
    judged = spark.createDataFrame([(1, k, f"d{k}", int(k % 2)) for k in range(1, 21)], "run_id int, rank int, doc string, rel int")
    assert [r["value"] for r in evaluate.precision_recall_lines(judged).collect()] == ["Run 1: precision 0.50, recall 0.10"]
    assert [tuple(r) for r in evaluate.curve(judged).collect()] == [(1, 0.05, 0.5), (1, 0.1, 0.5)]
    files.write_top(spark.createDataFrame([(7, 0.123456789), (8, 0.5)], "node long, pr double"), "pr", str(tmp_path / "top"), pattern="%s: %.5g")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "top")).collect()] == ["8: 0.50000", "7: 0.12346"]


def test_streamed_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(incremental.merged(spark, str(tmp_path / "out")), "term", "doc_id", "tf") == rows(postings(tokenized(docs)), "term", "doc_id", "tf")


def test_bucketed_index_merges_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{k % m} the" for m in range(1, 9))) for k in range(60)] + [(60, ""), (61, None)], "doc_id long, text string")
    want = rows(postings(tokenized(docs)), "term", "doc_id", "tf", "offsets", "doc_len")
    index = incremental.BucketedIndex.open(spark, "partial_indexes", f"file://{tmp_path}/o'ne", 3)
    try:
        assert rows(index.merged(), "term") == [] and index.buckets == 3
        for number in (0, 1, 2, 1):  # a batch that is run again takes its own place
            index.add(docs.where(f"doc_id % 3 = {number}"), number)
        whole = index.merged()
        assert rows(whole, "term", "doc_id", "tf", "offsets", "doc_len") == want
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        assert {r["n"] > 0 for r in whole.where("term = 'the'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} == {True}
        assert whole.where("term = 'the'").select(F.spark_partition_id()).distinct().count() == 3  # a frequent term lies in all buckets
        docs.where("doc_id > 40").write.parquet(str(tmp_path / "in"))  # these come a second time, as a batch of a stream
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        index.add(docs.limit(0), 0)
        index.add(docs.limit(0), 1)
        index.add(docs.where("doc_id <= 40"), 2)
        index.stream(stream, str(tmp_path / "cp")).awaitTermination()
        assert rows(index.merged(), "term", "doc_id", "tf", "offsets", "doc_len") == want
        spark.sql("DROP TABLE partial_indexes")  # the files stay, and a session that does not know them finds them
        again = incremental.BucketedIndex.open(spark, "partial_indexes", f"file://{tmp_path}/o'ne", 3)
        assert rows(again.merged(), "term", "doc_id", "tf", "offsets", "doc_len") == want
    finally:
        spark.sql("DROP TABLE IF EXISTS partial_indexes")


def test_pagerank_loses_dangling_mass(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (1, 2)], "src long, dst long")
    one = {r["node"]: r["pr"] for r in graph.pagerank(edges, rounds=2, normalise=False).collect()}
    assert one[0] == pytest.approx(0.05 + 0.85 * (0.05 + 0.85) / 2) and one[2] == pytest.approx(one[0])
    assert sum(one.values()) < 1
    done = {r["node"]: r["pr"] for r in graph.pagerank(edges).collect()}
    assert sum(done.values()) == pytest.approx(1)
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.pagerank(empty).count() == 0


def test_random_walks_agree_with_pagerank(spark):
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 20) for i in range(20)] + [(i, (i * 3 + 1) % 20) for i in range(0, 20, 2)], "src long, dst long")
    want = graph.pagerank(edges, epsilon=1e-6)
    for cyclic, complete in ((False, False), (True, False), (True, True), (False, True)):
        got = graph.random_walks(edges, 8000, cyclic, complete)
        assert got.agg({"pr": "sum"}).first()[0] == pytest.approx(1, abs=1e-6)
        assert graph.squared_loss(want, got).first()["loss"] < 2e-3


def test_hits(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (5, 6)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "node long")
    at = {r["node"]: (r["hub"], r["auth"]) for r in graph.hits(edges, graph.base_set(edges, root)).collect()}
    assert set(at) == {0, 1, 2} and at[0] == pytest.approx((1, 0)) and at[1] == pytest.approx((0, 2**-0.5))
    assert rows(graph.hits_scores(edges, root), "node") == [(0,)]


def test_files(spark, tmp_path):
    (tmp_path / "links").write_text("1;2,3,2\n2;\n4\n3;1\n")
    assert rows(files.read_links(spark, str(tmp_path / "links")), "src", "dst") == [(1, 2), (1, 3), (3, 1)]
    assert rows(files.read_link_nodes(spark, str(tmp_path / "links")), "node") == [(1,), (2,), (3,), (4,)]
    (tmp_path / "titles").write_text("1;x/y/One;two\n")
    assert rows(files.read_titles(spark, str(tmp_path / "titles")), "node", "title") == [(1, "One;two")]
    (tmp_path / "scores").write_text("7: 0,5: a.f\n8: 0.25\n")
    assert rows(files.read_scores(spark, str(tmp_path / "scores")), "node", "score") == [(7, 0.5), (8, 0.25)]
    (tmp_path / "judged").write_text("// run doc rel\n1 a.f 3\n1 b.f 0\n2 a.f 1\n")
    judged = files.read_judgments(spark, str(tmp_path / "judged"))
    assert rows(judged, "run_id", "rank", "doc", "rel") == [(1, 1, "a.f", 3), (1, 2, "b.f", 0), (2, 1, "a.f", 1)]
    (tmp_path / "patterns").write_text("// all\n\n[0-9]+\n")
    assert files.read_patterns(str(tmp_path / "patterns")) == ["[0-9]+"]
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("A b")
    (tmp_path / "docs" / "sub" / "c.txt").write_text("c")
    docs = files.read_documents(spark, str(tmp_path / "docs"))
    assert [t for _, t in rows(docs, "doc_id", "text")] == ["A b", "c"]
    assert [r["value"] for r in files.token_dump(tokenized(docs)).collect()] == ["a", "b", "c"]
    files.write_top(spark.createDataFrame([(1, 0.5), (2, 0.0)], "node long, pr double"), "pr", str(tmp_path / "top"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "top")).collect()] == ["1: 0.5"]


def test_evaluation_of_a_judged_list(spark):
    rel = [3, 2, 0, 1]
    judged = spark.createDataFrame([(1, i + 1, f"d{i}", r) for i, r in enumerate(rel)], "run_id int, rank int, doc string, rel int")
    gain = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs))
    assert evaluate.dcg(judged).first()["dcg"] == pytest.approx(gain(rel))
    assert evaluate.ndcg(judged).first()["ndcg"] == pytest.approx(gain(rel) / gain([3, 2, 1, 0]))
    assert evaluate.ndcg(judged, 2).first()["ndcg"] == pytest.approx(1)
    assert evaluate.ndcg(evaluate.override(judged, "d0")).first()["ndcg"] == pytest.approx(gain([0, 2, 0, 1]) / gain([2, 1, 0, 0]))
    assert rows(evaluate.precision_recall(judged), "retrieved", "relevant", "precision", "recall") == [(4, 3, 0.75, 0.03)]


def test_ndcg_of_nothing(spark):
    judged = spark.createDataFrame([(1, 1, "a", 0)], "run_id int, rank int, doc string, rel int")
    assert math.isnan(evaluate.ndcg(judged).first()["ndcg"])
    assert rows(evaluate.precision_recall_at(judged, 1), "k", "precision") == [(1, 0.0)]


def test_registered_walks_are_as_many_as_the_reference_takes(spark, tiny, monkeypatch):
    """10 walks a node is the smallest of the reference's settings."""
    from tarn import queries
    from tarn.operators import graph

    taken, n = [], graph.nodes_of(queries.part_edges(spark, tiny)).count()
    monkeypatch.setattr(queries.graph, "random_walks", lambda edges, walks, *rest: taken.append(walks))
    for name in ("pagerank_mc1", "pagerank_mc2", "pagerank_mc4", "pagerank_mc5"):
        queries.QUERIES[name](spark, tiny)
    assert len(taken) == 4 and min(taken) >= 10 * n
