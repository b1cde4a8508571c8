"""python -m tarn: tokens, kgrams, index, search, pagerank and hits from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import PATTERNS
from tarn.operators import graph
from tarn.operators.index import Index, kgram_index, kgram_report, term_dictionary, tokenized, vocabulary
from tarn.operators.query import Query, page
from tarn.operators.rank import Normalization
from tarn.operators.spell import shorten, suggest
from tarn.plans.search import Kind, Ranking, search
from tarn.sources import files


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarn", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text, description=text)
        if name in ("tokens", "kgrams", "index"):
            c.add_argument("-p", "--patterns", help="file of patterns, one a line (default: the built-in eleven; 'none': no patterns)")
        return c

    c = command("tokens", "a file's or folder's tokens, one a line")
    c.add_argument("-f", "--file", required=True)
    c.add_argument("-rp", "--remove-punctuation", action="store_true")
    c.add_argument("-cf", "--case-folding", action="store_true")
    c.add_argument("-rd", "--remove-diacritics", action="store_true")
    c = command("kgrams", "terms of a file or folder that hold all of some k-grams")
    c.add_argument("-f", "--file", required=True)
    c.add_argument("-k", type=int, default=3)
    c.add_argument("-kg", "--kgrams", required=True, help="k-grams between blanks")
    c = command("index", "index the files below folders")
    c.add_argument("-d", "--dir", action="append", required=True)
    c.add_argument("-o", "--out", required=True, help="folder of the index")
    c = command("search", "search an index")
    c.add_argument("-i", "--index", required=True)
    c.add_argument("query")
    c.add_argument("--kind", choices=[k.value for k in Kind], default="ranked")
    c.add_argument("--ranking", choices=[r.value for r in Ranking], default="tfidf")
    c.add_argument("--norm", choices=[n.value for n in Normalization], default="words")
    c.add_argument("--links", help="link file, for the rankings by links; its nodes are document numbers")
    c.add_argument("-n", type=int, default=10)
    for name, text in (("pagerank", "the nodes with the largest PageRank"), ("hits", "the largest hubs and authorities")):
        c = command(name, text)
        c.add_argument("links")
        c.add_argument("--titles")
        c.add_argument("-n", type=int, default=30)
        if name == "pagerank":
            c.add_argument("--walks", type=int, help="estimate it by so many random walks")
            c.add_argument("--cyclic", action="store_true")
            c.add_argument("--complete", action="store_true")
    return top


def chosen_patterns(name: str | None) -> list[str] | None:
    return PATTERNS if name is None else None if name == "none" else files.read_patterns(name)


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    if args.command in ("tokens", "kgrams", "index"):
        options = {"patterns": chosen_patterns(args.patterns)}
    if args.command == "tokens":
        options |= {"case": args.case_folding, "strip_diacritics": args.remove_diacritics, "keep_punctuation": not args.remove_punctuation}
        return [r["value"] for r in files.token_dump(tokenized(files.read_documents(spark, args.file), **options)).toLocalIterator()]
    if args.command == "kgrams":
        tokens = tokenized(files.read_documents(spark, args.file), **options)
        n, terms = kgram_report(kgram_index(vocabulary(tokens), args.k), term_dictionary(tokens), args.kgrams, args.k)
        return [f"{n} terms", *terms]
    if args.command == "index":
        docs = files.read_documents(spark, args.dir)
        Index.build(docs, **options).save(args.out, names=docs.select("doc_id", "name"))
        return [f"{docs.count()} documents"]
    if args.command == "search":
        index, q = Index.load(spark, args.index), Query.parse(args.query)
        edges = files.read_links(spark, args.links) if args.links else None
        ranks = graph.served(graph.pagerank(edges)) if edges is not None and args.ranking in ("pagerank", "combination") else None
        found = search(index, q, Kind(args.kind), Ranking(args.ranking), Normalization(args.norm), ranks, edges)
        if found is None:
            return ["No match. Did you mean:", *(shorten(r["phrase"]) for r in suggest(index, q).collect())]
        best = page(found.select("doc_id", "score"), 0, args.n).join(index.docs.select("doc_id", "name"), "doc_id").orderBy("rank")
        return [f"{r['rank']}. {r['name']}   {r['score']:.5f}" for r in best.collect()]
    edges = files.read_links(spark, args.links)
    nodes = files.read_link_nodes(spark, args.links)
    titles = files.read_titles(spark, args.titles) if args.titles else None

    def lines(scores, value: str) -> list[str]:
        best = graph.top_scores(scores, value, args.n)
        if titles is not None:
            best = graph.with_titles(best, titles)
        return [f"{r['node']}: {r[value]:.5g}" + (f": {r['title']}" if titles is not None else "") for r in best.orderBy(F.desc(value), "node").collect()]

    if args.command == "pagerank":
        return lines(graph.random_walks(edges, args.walks, args.cyclic, args.complete) if args.walks else graph.pagerank(edges, nodes), "pr")
    at = graph.hits(edges, nodes)
    return ["hubs", *lines(at, "hub"), "authorities", *lines(at, "auth")]


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("tarn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for line in run(spark, args):
        print(line)


if __name__ == "__main__":
    main()
