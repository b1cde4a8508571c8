"""Operators 3, 4 and 5, and the pipeline."""

import collections

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import op3_decontaminate, op4_exact_topk, op5_simhash_bktree
from tarn.llm.components import connected_components
from tests.compare import plain, sql_rows


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        score, i, j = op3_decontaminate.align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert a[i - 1] == b[j - 1]


def test_benchmark_passages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op3_decontaminate.op3_decontaminate(spark, tiny).collect()}
    text = {r["doc_id"]: op3_decontaminate.tokens(r["text"]) for r in docs.collect()}
    number: dict = {}
    ids = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64)
    want = {}
    for r in items.collect():
        item = ids(op3_decontaminate.tokens(r["text"]))
        for d, ws in text.items():
            s = op3_decontaminate.align(item, ids(ws))[0] / (2 * len(item))
            if s >= 0.5:
                want[d, r["item_id"]] = s
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_items_of_one_or_two_words(spark):
    docs = spark.createDataFrame([(1, "say Alpha, beta now"), (2, "alpha then beta"), (3, "beta alpha"), (4, "solo"), (5, None), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta"), (8, "Solo!"), (9, "alpha BETA."), (10, "?"), (11, "absent"), (12, "alpha absent")], "item_id long, text string")
    rows = [(r["doc_id"], r["item_id"], r["item_copies"], r["score"], r["first_word"], r["last_word"]) for r in op3_decontaminate.contaminated(docs, items).collect()]
    assert sorted(rows) == [(1, 7, 2, 1.0, 1, 2), (4, 8, 1, 1.0, 0, 0)]
    assert sorted(r["doc_id"] for r in op3_decontaminate.without_items(docs, items).collect()) == [2, 3, 5, 6]


def test_copies_keep_their_columns(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "b", "mine", 3), (1, text, "a", "yours", 2), (2, text, "c", "theirs", 1), (3, "another text of its own", None, "ours", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, h2 string, own int")
    assert sorted(tuple(r) for r in op5_simhash_bktree.without_copies(docs).collect()) == [rows[1], rows[3]]


def test_edited_copies_and_messy_rows(spark, messy, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    words = item.split()
    edited = " ".join("changed" if i % 7 == 3 else w for i, w in enumerate(words))
    half = " ".join(words[:8])
    docs = spark.createDataFrame([(1, f"before {edited.upper()}, after"), (2, half), (3, None), (4, ""), (5, item + " " + item), (5, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (None, item), (10, "too short")], "item_id long, text string")
    rows = op3_decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["item_copies"]) for r in rows) == [(1, 7, 2), (5, 7, 2), (5, 7, 2)]
    one = next(r for r in rows if r["doc_id"] == 1)
    assert 0.5 <= one["score"] < 1 and (one["first_word"], one["last_word"]) == (1, 24)
    assert op3_decontaminate.contaminated(messy, items).count() == 0
    assert op3_decontaminate.contaminated(none, items).count() == 0 and op3_decontaminate.contaminated(docs, items.limit(0)).count() == 0
    more = items.union(spark.createDataFrame([(11, half), (12, "Alpha, beta gamma! delta epsilon zeta eta theta"), (13, "omega psi chi phi upsilon")], items.schema))
    for text in (items, more):
        whole = sorted(map(str, op3_decontaminate.contaminated(docs, text).collect()))
        assert sorted(map(str, op3_decontaminate.contaminated(docs, text, item_chars=1).collect())) == whole
    kept = op3_decontaminate.without_items(docs.withColumn("extra", F.lit(1)), more, item_chars=1)
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert op3_decontaminate.without_items(messy, items).count() == 12 and op3_decontaminate.without_items(none, items).count() == 0


def test_graded_edits_are_all_found(spark, tiny):
    """Every third word replaced aligns just above the threshold; full alignment says which copies count."""
    items = [(r["item_id"], [w.decode() for w in op3_decontaminate.tokens(r["text"])]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rng = np.random.default_rng(6)
    docs = []
    for i, ws in items:
        for share in (0.1, 0.2, 0.3, 0.34, 0.4):
            docs.append((i, " ".join(x for w in ws for x in ([w] if rng.random() > share else [[], ["new"], [w, "more"]][rng.integers(3)]))))
    block = op3_decontaminate.Items([(i, 1, " ".join(ws)) for i, ws in items])
    want = set()
    for n, (i, text) in enumerate(docs):
        own = block.words[block.ids.index(i)]
        if op3_decontaminate.align(own, block.encode(text))[0] / (2 * len(own)) >= 0.5:
            want.add((n, i))
    rows = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(docs)], "doc_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontaminate.contaminated(rows, frame).collect()}
    assert want <= got and len(want) > 60
    thirty_one = " ".join(f"w{k}" for k in range(31))
    copy = " ".join("x" if k % 3 == 2 else f"w{k}" for k in range(31))
    one = op3_decontaminate.contaminated(spark.createDataFrame([(1, copy)], rows.schema), spark.createDataFrame([(1, thirty_one)], frame.schema)).collect()
    assert len(one) == 1 and one[0]["score"] == pytest.approx(0.516, abs=0.001)


@pytest.mark.parametrize("every", [4, 5, 6])
def test_single_edited_copies(spark, tiny, every):
    """No whole copy stands anywhere, and each item's edited copy once."""
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    texts = {r["item_id"]: [w.decode() for w in op3_decontaminate.tokens(r["text"])] for r in items.collect()}
    edited = [(i, " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(ws))) for i, ws in texts.items()]
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    got = {r["item_id"] for r in op3_decontaminate.contaminated(docs, items).collect() if r["doc_id"] == r["item_id"]}
    assert got == set(texts)


def test_edited_copies_of_short_items(spark):
    """Copies of short items that share a single trigram with their item, or none."""
    items = [(1, "red orange yellow green blue violet"), (2, "one two three four five six seven eight nine"), (3, "north south east west up")]
    docs = [(1, "red orange x green blue violet"), (1, "red orange yellow x blue violet"), (2, "one two x four five six x eight nine"), (3, "north south x west up"), (4, "red two x west blue")]
    found = op3_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = [(1, 1, 0.75), (1, 1, 0.75), (2, 2, 2 / 3), (3, 3, 0.7)]
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in found.collect()) == want


def test_every_alignment_of_the_threshold_is_found():
    rng = np.random.default_rng(12)
    hits = 0
    for threshold in (0.4, 0.5, 0.7):
        for _ in range(60):
            n = int(rng.integers(5, 40))
            items = [(i, 1, " ".join(f"w{k}" for k in rng.integers(0, n, rng.integers(3, 14)))) for i in range(4)]
            docs = []
            for *_, t in items:
                ws = [f"x{k}" for k in rng.integers(0, 9, 6)]
                for w in t.split():
                    ws += [[w], [w], [w], ["x0"], [], [w, "x1"], ["x2", w]][rng.integers(7)]
                docs.append(" ".join([*ws, *(f"w{k}" for k in rng.integers(0, n, 15))]))
            block = op3_decontaminate.Items(items)
            seen = np.zeros(len(block.grams), dtype=np.int64)
            for t in docs:
                held = np.unique(np.concatenate(block.pairs(block.encode(t))))
                seen[held[held >= 0]] += 1
            block.choose(seen, threshold)
            for t in docs:
                got = {m[0]: m[2] for m in block.matches(t, threshold)}
                scores = {i: smith_waterman(block.words[k], block.encode(t)) / (2 * len(block.words[k])) for k, i in enumerate(block.ids)}
                want = {i: s for i, s in scores.items() if s >= threshold}
                hits += len(want)
                assert got == pytest.approx(want)
    assert hits > 300


@pytest.mark.parametrize("size", ["tiny", "small"])
def test_top_k_equals_sql(spark, request, size):
    d = request.getfixturevalue(size)
    assert plain(op4_exact_topk.op4_exact_topk(spark, d).toPandas()) == plain(sql_rows(op4_exact_topk.ORACLE, d))


def test_top_k_of_messy_vectors(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    data += [(100, data[100][1]), (301, None), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (305, [0.0] * 6), (306, [9.0, 9.0]), (350, []), (307, data[7][1]), (308, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 score", "'x' v")
    got = collections.defaultdict(list)
    for r in op4_exact_topk.top_k(df, query_block=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    sound = [(i, np.floor(256 * np.pad(np.array(v), (0, 6 - len(v)))).astype(int)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in sound:
        if q % 50 == 0:
            want = sorted(((int(v @ c), i) for i, c in sound if i != q), key=lambda t: (-t[0], t[1]))[:5]
            assert got[q] == want
    assert op4_exact_topk.top_k(df.limit(0)).count() == 0


def brute_prints(rows):
    out = {}
    for i, text in rows:
        ws = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        shingles = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out[i] = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))
    return out


def components(prints, radius=3):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_groups(spark, small):
    prints = brute_prints([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    want = {i: (format(prints[i], "016x"), c) for i, c in components(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash_bktree.op5_simhash_bktree(spark, small).collect()} == want


def test_simhash_of_messy_rows(messy, none):
    rows = op5_simhash_bktree.simhash_groups(messy).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["fingerprint"] for i in (3, 4, 5)} == {"0" * 16} and {by[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[None]["component_id"] is None
    assert op5_simhash_bktree.simhash_groups(none).count() == 0
    assert op5_simhash_bktree.near_copies(messy).count() == 12 and op5_simhash_bktree.near_copies(none).count() == 0


NULL_IDS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight"),
    (7, "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest"),
    (None, "an unrelated text about gardens and the many kinds of flowers that grow there in spring"),
    (None, "another unrelated text about ships that sail between the islands of the southern sea all year"),
    (5, "a recipe for bread with flour and water and salt and a little time to rest before baking"),
    (5, "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight alone"),
    (6, "a clean text that shares nothing with all the others but a few of the small words"),
    (6, "a clean text that shares nothing with all the others but a few of the small words"),
]


def test_null_and_repeated_ids_link_nothing(spark):
    docs = spark.createDataFrame([(*r, "x") for r in NULL_IDS], "doc_id long, text string, h1 string")
    kept = op5_simhash_bktree.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, {NULL_IDS[k] for k in (0, 3, 4, 5, 7)}))
    prints = brute_prints(enumerate(t for _, t in NULL_IDS))
    want = components(prints)
    lowest = {c: min((i for k, (i, _) in enumerate(NULL_IDS) if want[k] == c and i is not None), default=None) for c in want.values()}
    got = op5_simhash_bktree.simhash_groups(docs).collect()
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == sorted(str((i, format(prints[k], "016x"), lowest[want[k]])) for k, (i, _) in enumerate(NULL_IDS))


def test_tree_links_dense_groups():
    rng = np.random.default_rng(8)
    prints = {int(b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))): None for b in rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(25)}
    prints = {i: p for i, p in enumerate(prints)}
    tree, links = op5_simhash_bktree.ShardTree(3), []
    for i, p in prints.items():
        links += [(i, j) for j in tree.add(p)]
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b)  # a forest: no link is more than needed
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {i: find(i) for i in prints} == components(prints)


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(op5_simhash_bktree, "SPLIT", 20)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 4)
    prints = list({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) & (1 << 63) - 1 for b in base for _ in range(100)})
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, fp long")
    labels = connected_components(op5_simhash_bktree.shard_links(op5_simhash_bktree.bit_shards(nodes, 3), 3))
    got = {i: i for i in range(len(prints))} | {r["node"]: r["component"] for r in labels.collect()}
    assert got == components(dict(enumerate(prints)))


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_near_copies_find_similar_texts(spark, small):
    """Against exact similarity: pairs well above 0.8 are together, pairs well below are not linked by themselves."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    group = {r["doc_id"]: r["component_id"] for r in op5_simhash_bktree.near_copies(docs).collect()}
    sets = {}
    for r in docs.collect():
        ws = r["text"].lower().split()
        sets[r["doc_id"]] = {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = collections.Counter((a, b) for l in by.values() for a in l for b in l if a < b)
    like = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    high = [p for p, j in like.items() if j >= 0.87]
    assert len(high) > 20 and all(group[a] == group[b] for a, b in high)
    linked = collections.defaultdict(set)
    for (a, b), j in like.items():
        if j >= 0.7:
            linked[a].add(b)
            linked[b].add(a)
    for i, c in group.items():
        if i != c:  # a document that would go has a document like it in its group
            assert any(group[j] == c for j in linked[i]), i


def five_words(text):
    ws = text.lower().split()
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}


def similarity(a, b):
    return len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b))


def linked_pairs(spark, pairs):
    """Of texts and their copies, each pair apart from all others: which are in one group."""
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    group = {r["doc_id"]: r["component_id"] for r in op5_simhash_bktree.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [group[2 * i] == group[2 * i + 1] for i in range(len(pairs))]


def test_near_copies_decide_at_the_similarity_exactly(spark):
    rng = np.random.default_rng(21)
    pairs = []
    while len(pairs) < 400:
        ws = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(60, 250))]
        edited = [f"edit{rng.integers(10**6)}" if rng.random() < 0.023 else w for w in ws]
        pair = " ".join(ws), " ".join(edited)
        if 0.74 <= similarity(*pair) < 0.86:
            pairs.append(pair)
    pairs += [("a b c d e f g h", "a b c d e f g h i")] + [(" ".join(map(str, range(n + 4))), " ".join([*map(str, range(n + 3)), "x"])) for n in (8, 9)]
    like, got = [similarity(*p) for p in pairs], linked_pairs(spark, pairs)
    assert like[-3] == 0.8 and 0.79 > like[-2] and 0.8 <= like[-1] and min(like) < 0.76
    assert not [j for j, g in zip(like, got) if g and j < 0.8]
    assert sum(g for j, g in zip(like, got) if j >= 0.8) >= 0.97 * sum(j >= 0.8 for j in like)


def test_near_copies_with_repeated_passages(spark):
    """Sets of shingles are alike, however often a passage stands in one of the texts; short texts as well."""
    rng = np.random.default_rng(22)
    pairs = []
    for _ in range(60):
        ws = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(150, 400))]
        pairs.append((" ".join(ws), " ".join(ws + ws[40:70] * 20)))
    for k in range(300):
        ws = [f"v{x}" for x in rng.integers(0, 10**6, 9 + k % 5)]
        pairs.append((" ".join(ws), " ".join(ws[:-1])))
    assert min(similarity(*p) for p in pairs) >= 0.8
    got = linked_pairs(spark, pairs)
    assert all(got[:60]) and sum(got[60:]) >= 298  # bands miss a pair at 0.8 with a chance of 0.002


def test_pipeline(spark, tiny):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == pipeline.COLUMNS, name
    assert 0 < docs.count() < n
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert op3_decontaminate.contaminated(docs, spark.read.parquet(f"{tiny}/benchmark.parquet")).count() == 0
    assert len({t for t in kept.values()}) == len(kept)
    rows = pipeline.run(spark, tiny).collect()
    assert {r["doc_id"] for r in rows} == set(kept) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_pipeline_of_messy_rows(spark, messy, none, tiny):
    import corpus_pipeline as pipeline

    for docs in (messy, none):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, tiny)
        rows = docs.collect()
        assert len(rows) == len({(r["doc_id"], r["ids"]) for r in rows})


def test_pipeline_stages_against_plain_ones(spark, tiny):
    """Each stage on null and repeated ids, repeated rows, and copies, against a plain version of what it should keep."""
    import corpus_pipeline as pipeline

    bench = spark.read.parquet(f"{tiny}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(i, t, None, "s", len(t)) for i, t in NULL_IDS] + [(20, bench, "en", "s", 1), (None, "before it " + bench, "en", "s", 1), (21, "1234", "en", "s", 4), (None, None, None, None, None), (22, "x\nshared line of text\ny", "en", "s", 1), (23, "SHARED line of text\nz", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain_rows = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    lettered = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    lang = pipeline.language_stage(spark, docs, tiny)
    assert plain_rows(lang) == sorted(str(r[:2]) for r in lettered) and {r["lang"] for r in lang.collect()} == {"en"}
    seen = collections.defaultdict(set)
    last = 1 << 63
    for i, t, *_ in lettered:
        for line in t.split("\n"):
            seen[line.strip().lower()].add(last if i is None else i)
    drop = lambda i, line: len(k := line.strip().lower()) >= 10 and len(seen[k]) > 1 and min(seen[k]) != (last if i is None else i)
    lined = [(i, "\n".join(x for x in t.split("\n") if not drop(i, x))) for i, t, *_ in lettered]
    lines = pipeline.line_stage(spark, lang, tiny)
    assert plain_rows(lines) == sorted(map(str, lined))
    group = list(range(len(lined)))
    for a in range(len(lined)):
        for b in range(a):
            if not lined[a][1] and not lined[b][1] or lined[a][1] and lined[b][1] and similarity(lined[a][1], lined[b][1]) >= 0.8:
                group = [group[b] if g == group[a] else g for g in group]
    kept = []
    for g in set(group):
        own = [r for r, x in zip(lined, group) if x == g]
        kept.append(min(own, key=lambda r: last if r[0] is None else r[0]))
    copies = pipeline.near_copy_stage(spark, lines, tiny)
    assert plain_rows(copies) == sorted(map(str, kept))
    clean = pipeline.benchmark_stage(spark, copies, tiny)
    assert plain_rows(clean) == sorted(str(r) for r in kept if bench not in r[1])


def test_a_group_of_a_third_of_all_rows_meets_in_parts(spark, monkeypatch):
    """Components are the same whether groups are whole or parted; no tree holds more than two parts."""
    rng = np.random.default_rng(12)
    base = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.002 else f"x{rng.integers(1 << 30)}" for w in base)) for i in range(60)]
    docs += [(100 + i, " ".join(f"own{i}_{k // (1 + i % 2)}" for k in range(30))) for i in range(60)]
    docs += [(200 + i, docs[60 + i][1] + " end") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {}
    for part in (1_000, 7):
        monkeypatch.setattr(op5_simhash_bktree, "PART", part)
        monkeypatch.setattr(op5_simhash_bktree, "SET_PART", part)
        near = op5_simhash_bktree.near_copies(df)
        plain = op5_simhash_bktree.simhash_groups(df, radius=8)
        got[part] = sorted((r["doc_id"], r["component_id"], r["stays"]) for r in near.collect()), sorted((r["doc_id"], r["component_id"]) for r in plain.collect())
    assert got[7] == got[1_000]
    assert max(collections.Counter(c for _, c, _ in got[7][0]).values()) > 40
    rows = spark.range(100).selectExpr("7L as key", "id as node", "100L as n").union(spark.range(3).selectExpr("8L", "id + 200", "3L"))
    dealt = op5_simhash_bktree.parted(rows, 10).collect()
    keys = collections.defaultdict(set)
    for r in dealt:
        keys[r["key"]].add(r["node"])
    assert max(map(len, keys.values())) < 60 and keys[8] == {200, 201, 202}
    assert {(a, b) for s in keys.values() for a in s for b in s if a < b < 100} == {(a, b) for a in range(100) for b in range(a + 1, 100)}
