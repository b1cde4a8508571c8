"""Operators 11, 12 and 13 against plain versions and SQL."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import op11_source_divergence as op11
from tarn.llm import op12_periodic_runs as op12
from tarn.llm import op13_embedding_hnsw as op13
from tarn.llm.small_worlds import Graph
from tests.compare import plain, sql_rows


@pytest.mark.parametrize("module,name", [(op11, "op11_source_divergence"), (op12, "op12_periodic_runs"), (op13, "op13_embedding_hnsw")])
def test_queries_equal_sql(spark, tiny, module, name):
    assert plain(getattr(module, name)(spark, tiny).toPandas()) == plain(sql_rows(module.ORACLE, tiny))


# operator 11


def plain_divergence(rows, min_docs=3, top=200):
    """rows: (text, lang, source). Straight from the definition, over all kept terms."""
    df, count, lang_count = collections.Counter(), collections.Counter(), collections.Counter()
    groups = collections.defaultdict(set)
    for text, lang, source in ((t or "", lg or "", s or "") for t, lg, s in rows):
        groups[lang].add(source)
        terms = op11.term_list(text)
        df.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
        lang_count.update((lang, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (lg, t), n in df.items() if lg == lang and n >= min_docs)
        share = {}
        for s in [*sources, None]:
            c = {t: lang_count[lang, t] if s is None else count[lang, s, t] for t in kept}
            of = sum(c.values()) + len(kept)
            share[s] = {t: 1 + 10**9 * (n + 1) // of for t, n in c.items()}
        for s in sources:
            f = lambda other, terms: {t: (share[s][t] - share[other][t]) ** 2 // share[other][t] for t in terms}  # noqa: B023, E731
            pairs = {o: sum(f(o, kept).values()) for o in sources if o != s}
            terms = f(None, [t for t in kept if count[lang, s, t] and share[s][t] > share[None][t]])
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0] if isinstance(x[0], bytes) else x[0].encode("utf-8")))
                out += [(lang, s, part, k.decode() if isinstance(k, bytes) else k, v, r + 1) for r, (k, v) in enumerate(ranked[:most])]
    return sorted(out)


def divergence_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence_of_messy_rows(spark, messy, messy_rows, none):
    got = divergence_rows(op11.source_divergence(messy, min_docs=1))
    assert got == plain_divergence([(t, lg, s) for _, t, lg, s, _ in messy_rows], min_docs=1)
    assert divergence_rows(op11.source_divergence(messy)) == plain_divergence([(t, lg, s) for _, t, lg, s, _ in messy_rows])
    assert op11.source_divergence(none).collect() == []


def test_divergence_of_many_sources_and_a_hot_one(spark):
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "É", "ſ", "the", "THE"]
    rows = []
    for d in range(400):
        source = "hot" if d % 3 == 0 else f"s{int(rng.integers(0, 12))}"
        text = "the " + " ".join(rng.choice(words, rng.integers(0, 40), p=None)) + "-x1y," * (d % 2)
        rows.append((d, text, ("aa", "bb", None)[d % 7 % 3], source))
    rows += [(None, "lone words only here", "cc", "one"), (7, "", "dd", "p"), (8, None, "dd", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    want = plain_divergence([r[1:] for r in rows], top=5)
    assert divergence_rows(op11.source_divergence(docs, top=5)) == want
    assert {r[:4] + r[5:] for r in want if r[0] == "dd"} == {("dd", "p", "pair", "q", 1), ("dd", "q", "pair", "p", 1)}


def test_tally_and_scans_in_small_steps(monkeypatch):
    """Passing sums on early, and scanning few rows at a time, changes nothing."""
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "ee"], 6)), "x", f"s{i % 3}") for i in range(60)]
    batches = lambda: (pa.RecordBatch.from_pylist([dict(zip(("document", "text", "lang", "source"), r)) for r in docs[k : k + 10]]) for k in range(0, 60, 10))

    def counts(rows):
        t = pa.Table.from_batches(rows).sort_by([(c, "ascending") for c in ("lang", "term", "source", "document")]).drop(["document"])
        out = pa.Table.from_batches(op11.count_runs(3)(iter(t.to_batches(max_chunksize=7))))
        return sorted(map(tuple, (r.values() for r in out.to_pylist())))

    whole = list(op11.tally(batches()))
    want = counts(whole)
    monkeypatch.setattr(op11, "HELD_PAIRS", 20)
    monkeypatch.setattr(op11, "SCAN_ROWS", 5)
    parts = list(op11.tally(batches()))
    assert sum(b.num_rows for b in parts) > sum(b.num_rows for b in whole) and counts(parts) == want


def test_shares_are_exact_for_large_counts(spark):
    n, of = 9_000_000_000_000_007, 90_000_000_000_000_001
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(of).alias("of")).select(op11.share("n", "of").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // of


# operator 12


def plain_runs(w, repeats=4, least=6):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    texts = []
    for k in range(300):
        size = int(rng.integers(0, 90))
        words = rng.integers(0, int(rng.integers(1, 5)) + 1, size).tolist()
        if k % 3 == 0 and size > 20:
            block = words[: int(rng.integers(1, 9))]
            at = int(rng.integers(0, 10))
            words[at:at] = block * int(rng.integers(3, 9)) + block[: int(rng.integers(0, len(block)))]
        texts.append([str(x) for x in words])
    texts += [["a"] * 500, ["a", "b"] * 300, [], ["a"] * 5, ["a"] * 6]
    for repeats, least in ((4, 6), (2, 2), (3, 1), (5, 6)):
        got = op12.find_runs(texts, repeats, least)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(w, repeats, least) for w in texts]


def test_strongest_run_is_exact():
    big = 1 << 40
    runs = np.array([(0, 4 * big + 1, big), (5, 4 * (big + 1) + 1, big + 1), (9, 8, 2), (11, 12, 3)])
    assert op12.strongest(runs) == (0, 4 * big + 1, big)
    assert op12.strongest(runs[2:]) == (9, 8, 2)


def test_runs_of_messy_rows(spark, messy, messy_rows, none):
    rows = op12.periodic_runs(messy.withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))).collect()
    assert len(rows) == len(messy_rows)
    kept = collections.Counter((r["doc_id"], r["collapsed"]) for r in rows)
    assert kept == collections.Counter((d, " ".join((t or "").encode().decode("ascii", "ignore").split()) if d != 9 else "Ünïcödé ▁ text with gaps \x00 and 日本語") for d, t, *_ in messy_rows)
    assert op12.periodic_runs(none).collect() == []
    text = "start " + "go on and " * 5 + "go\nend  x " + "z " * 5
    row = op12.periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 16, 3)] and tuple(row["strongest"]) == (1, 16, 3)
    assert row["collapsed"] == "start go on and end x z z z z z"


def test_planted_runs_and_digests(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    planted = {r["doc_id"]: r["text"] for r in op12.with_planted_runs(docs).collect()}
    import zlib

    for r in docs.collect():
        words = (r["text"] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert planted[r["doc_id"]].split() == words
    got = {r["doc_id"]: r for r in op12.op12_periodic_runs(spark, small).collect()}
    for d, text in planted.items():
        runs = plain_runs(text.split()) if len(text) < 8000 else None
        if runs is not None:
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            assert got[d]["n_runs"] == len(runs) and got[d]["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


# operator 13


def crowd(rng, n, dim, spread):
    base = rng.normal(size=dim)
    return base + spread * np.linalg.norm(base) / np.sqrt(dim) * rng.normal(size=(n, dim))


def plain_groups(rows, least=0.95):
    """rows: (vec_id, vector or None)."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    sound = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([np.pad(np.array(v, dtype=float), (0, dim - len(v))) if ok else np.zeros(dim) for (_, v), ok in zip(rows, sound)])
    size = np.linalg.norm(x, axis=1)
    u = x / np.where(size > 0, size, 1)[:, None]
    near = (u @ u.T >= least) & np.array(sound)[:, None] & np.array(sound)
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        low = np.where(near, label, len(rows)).min(axis=1, initial=len(rows))
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    lowest = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label.tolist())}
    return sorted(((r[0], int(d), lowest[k], r[0] == lowest[k]) for r, d, k in zip(rows, near.sum(axis=1), label.tolist())), key=repr)


def group_rows(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_graph_finds_what_brute_force_does():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3000, 32)), crowd(rng, 300, 32, 0.05), *(crowd(rng, 4, 32, 0.1) for _ in range(150))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)[rng.permutation(len(x))]
    graph = Graph(x)
    true = x @ x.T >= 0.95
    hit = np.zeros_like(true)
    for lo in range(0, len(x), 256):
        ids, sims = graph.search(x[lo : lo + 256], 32)
        r, c = np.nonzero(ids >= 0)
        assert np.allclose(sims[r, c], (x[lo + r] * x[ids[r, c]]).sum(axis=1), atol=1e-5)
        hit[lo + r, ids[r, c]] = True
    few = true.sum(axis=1) <= 32
    assert (hit & true)[few].sum() >= 0.99 * true[few].sum() and (hit & true)[~few].any(axis=1).all()


def test_vectors_of_crowds_copies_and_shards(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 16)), crowd(rng, 400, 16, 0.08), *(crowd(rng, int(k), 16, 0.2) for k in rng.integers(2, 9, 60))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0), x[5:9] * 3])
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, [float(v) for v in row]) for i, row in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = plain_groups(rows)
    for shard_rows in (100_000, 250):
        assert group_rows(op13.embedding_groups(df, shard_rows=shard_rows)) == want


def test_unsound_vectors_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [2.0, 1e-3]), (3, [0.0, 1.0]), (4, [0.0, 5.0]), (None, [0.0, 2.0]), (None, [-1.0, -1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1e200, 0.0]), (12, [1e-300, 0.0]), (13, [-0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("v", "h1", "h2", "node", "low", "component", "label", "links", "degree"):
        df = df.withColumn(c, F.lit("clash"))
    x = [(i, v if v is None or i not in (11, 12) else [1.0, 0.0]) for i, v in rows]
    assert group_rows(op13.embedding_groups(df)) == plain_groups(x)
    assert op13.embedding_groups(df.limit(0)).collect() == []
    assert group_rows(op13.embedding_groups(df.where("embedding is null"))) == [(5, 0, 5, True)]


def test_widening_beams_lose_no_link():
    """A beam that is full of near vectors is searched again; an audit compares a sample with all."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(4000, 24)), crowd(rng, 900, 24, 0.05)])
    shard = op13.Shard(op13.packed(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, 3))
    graph = shard.graph()
    width, recall = op13.audited_width(shard, shard, graph, 0.95, True)
    assert recall >= op13.RECALL
    got = {p for lo in range(0, shard.n, 256) for p in zip(*(a.tolist() for a in op13.neighbours(shard, lo, min(lo + 256, shard.n), shard, graph, width, 0.95, True)))}
    true = np.triu(shard.units @ shard.units.T >= 0.95, 1)
    want = set(zip(*(a.tolist() for a in np.nonzero(true))))
    assert got <= want and len(got) >= 0.99 * len(want) > 400_000
