"""Operators 6, 7 and 8."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import op6_line_dedup, op7_url_rules, op8_hilbert_shards
from tests.compare import plain, sql_rows


@pytest.mark.parametrize("module", [op6_line_dedup, op7_url_rules])
@pytest.mark.parametrize("size", ["tiny", "small"])
def test_equals_sql(spark, request, module, size):
    d = request.getfixturevalue(size)
    name = module.__name__.rpartition(".")[2]
    assert plain(getattr(module, name)(spark, d).toPandas()) == plain(sql_rows(module.ORACLE, d))


def kept_lines(rows):
    """Brute force; a null id is a document after all others."""
    last = 1 << 63
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 10:
                first.setdefault(key, set()).add(last if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            docs = first.get(key, {0})
            if len(docs) < 2 or min(docs) == (last if i is None else i):
                keep.append(line)
        out.append((str(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return Counter(out)


def test_lines_of_messy_rows(messy, none, messy_rows):
    done = op6_line_dedup.line_dedup(messy)
    assert {"score", "n_lines", "lang"} <= set(done.columns)
    assert Counter((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect()) == kept_lines(messy_rows)
    assert op6_line_dedup.line_dedup(none).count() == 0
    three = op6_line_dedup.line_dedup(messy, min_docs=4)
    assert three.agg({"n_dropped": "sum"}).first()[0] == 4  # the line in documents 1, 2, 10 and the one without id: rows 2, 2, 10 and null


URLS = ["http://a.example.net/en/x", "http://EXAMPLE.net/en/", "http://example.net/fr", "http://net/", "http://net", "http://xnet/", "https://b.org/fr/1?u=http://q.net/", "http://example.com/de/1", "http://badexample.com/de/1", None, "", "no scheme", "://net/x", "http://x.y/a/cheap-pills.html", "http://cheap-pillsx.com/", "http://u@example.net/en/", "ftp://example.net:80/en/", "http://a.net/\nx"]


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule in sorted(op7_url_rules.HOST_RULES, key=lambda r: -len(r.name)):
        h, _, p = rule.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = rule
            break
    if best:
        return host, path, best.name, best.action
    import re

    bad = any(re.search(rf"(^|[^a-z0-9]){r.name}($|[^a-z0-9])", (host + path).lower()) for r in op7_url_rules.WORD_RULES)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, subject string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op7_url_rules.url_filter(pages).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(URLS + URLS[:3])}
    assert op7_url_rules.url_filter(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in op7_url_rules.url_filter(pages, rules=[]).collect()} == {"allow"}
    free = op7_url_rules.Rule("x", "block", "example", (), 1)  # no literal: runs for every url
    assert op7_url_rules.url_filter(pages, rules=[free]).where("verdict = 'block'").count() == sum("example" in (u or "").lower() for u in URLS + URLS[:3])


def test_ties_blocks_of_rules_and_letters_beyond_ascii(spark, monkeypatch):
    urls = ["http://a.b/casino\u212a", "http://a.b/\u212acasino/", "http://a.b/" + "x/" * 50_000 + "casino", "http://a.b/porn-casino", "http://a.b/xxxx"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = op7_url_rules.WORD_RULES + [op7_url_rules.word_rule("allow", "x" * 4), op7_url_rules.word_rule("block", "x" * 4), op7_url_rules.Rule("yyyy", "block", "xxxx", (), 1)]
    whole = [(r["verdict"], r["pattern"]) for r in op7_url_rules.url_filter(pages, rules=rules).orderBy("page_id").collect()]
    assert whole == [("block", "casino")] * 4 + [("block", "yyyy")]  # the Kelvin sign is no letter of a token; the longest wins, then the last by name
    monkeypatch.setattr(op7_url_rules, "MAX_RULES", 2)
    assert [(r["verdict"], r["pattern"]) for r in op7_url_rules.url_filter(pages, rules=rules).orderBy("page_id").collect()] == whole


def test_candidates_come_from_rare_tokens(spark):
    from pyspark.sql import functions as F

    urls = spark.createDataFrame([("example.com/a",)] * 5 + [("example.net/b",)], "subject string")
    rule = op7_url_rules.host_path_rule("block", "example.net/b/")
    assert op7_url_rules.rarest_tokens(urls.select(F.col("subject")), [rule])[rule] in ("b", "net")


def test_hilbert_curve_is_a_walk():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = op8_hilbert_shards.hilbert_index(list(cells.T), bits)
        assert sorted(order) == list(range(len(cells)))
        walk = cells[np.argsort(order)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(spark, small, messy, none):
    got = op8_hilbert_shards.op8_hilbert_shards(spark, small).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert set(got["doc_id"]) == set(docs) and len(got) == len(docs)
    assert all(s == len(docs[i].encode()) + 16 and c == zlib.crc32(docs[i].encode()) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    count = got.groupby("shard")["slot"]
    assert set(got["shard"]) == set(range(40)) and count.count().max() - count.count().min() <= 1
    assert (count.max() + 1 == count.count()).all() and (count.nunique() == count.count()).all()
    walk = got.sort_values(["shard", "slot"])["curve"].to_numpy()
    assert (np.diff(walk) >= 0).all()
    rows = op8_hilbert_shards.shard_plan(messy, shards=5).collect()
    assert len(rows) == 12 and max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(16, 0)}
    assert op8_hilbert_shards.shard_plan(none).count() == 0


def test_positions_equal_a_plain_sort_along_the_curve(spark, small, monkeypatch):
    """Quantise, sort by curve, sub-cell, checksum and id, cut into runs."""
    monkeypatch.setattr(op8_hilbert_shards, "SUB_ROWS", 10)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    dims = {"site": F.concat(F.lit("https://www."), "source"), "size": F.octet_length("text").cast("long")}
    got = {r["doc_id"]: (r["shard"], r["slot"], r["curve"]) for r in op8_hilbert_shards.shard_plan(docs, 7, dimensions=dims, bits=3).collect()}
    rows = docs.select("doc_id", F.crc32("text").alias("crc"), *(c.alias(k) for k, c in dims.items()), F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(100)).alias("sub")).toPandas()
    cells = []
    for k in dims:  # with so few rows quantiles are exact: the smallest value that a share of k / 8 doesn't exceed
        ranked = sorted(rows[k])
        edges = [ranked[-(-len(ranked) * i // 8) - 1] for i in range(1, 8)]
        cells.append(sum(np.array([v > e for v in rows[k]]).astype(int) for e in edges))
    rows["curve"] = op8_hilbert_shards.hilbert_index(cells, 3)
    rows = rows.sort_values(["curve", "sub", "crc", "doc_id"]).reset_index(drop=True)
    n, want, slots = len(rows), {}, Counter()
    for at, r in enumerate(rows.itertuples()):
        shard = at * 7 // n
        want[r.doc_id] = (shard, slots[shard], r.curve)
        slots[shard] += 1
    assert got == want
    with pytest.raises(ValueError):
        op8_hilbert_shards.shard_plan(docs, dimensions={str(i): F.lit(1) for i in range(5)})


def test_texts_that_begin_alike_fall_into_cells_of_their_own(spark):
    """Sixteen sources of one beginning: each has the documents of one shard."""
    docs = spark.createDataFrame([(i, "x", "en", f"https://example.org/{i % 16:02d}") for i in range(320)], "doc_id long, text string, lang string, source string")
    plan = op8_hilbert_shards.shard_plan(docs, 16).join(docs.select("doc_id", "source"), "doc_id")
    assert {r["n"] for r in plan.groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()} == {1}


def test_written_shards(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    manifest = op8_hilbert_shards.write_shards(docs, str(tmp_path / "shards"), 8).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    with pytest.raises(ValueError):
        op8_hilbert_shards.write_shards(docs.union(docs.limit(1)), str(tmp_path / "no"))
    assert back.count() == docs.count() == sum(r["rows"] for r in manifest)
    assert hashlib.sha256("".join(sorted(r["text"] for r in back.collect())).encode()).digest() == hashlib.sha256("".join(sorted(r["text"] for r in docs.collect())).encode()).digest()
