"""Operators 1, 2, 9 and 10."""

import collections
import hashlib
import math
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import op1_ngram_lm, op2_toxicity, op9_sentencepiece, op10_language
from tarn.llm.common import words
from tarn.llm.elias_fano import EliasFano, NgramTrie, Quantised
from tarn.llm.packing import pack, small, unpack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 50), max_size=1500))
def test_elias_fano(values):
    values = np.sort(np.array(values, dtype=np.int64))
    ef = EliasFano(values)
    assert (ef.decode(0, len(values)) == values).all()
    if len(values):
        at = np.random.default_rng(0).integers(0, len(values), 20)
        assert (ef.take(at) == values[at]).all()
        assert ef.get(0) == values[0] and (ef.take(np.arange(len(values))) == values).all()
        rng = np.random.default_rng(1)
        wanted = np.concatenate((values, values + 1, [0, 1 << 51], rng.integers(0, int(values[-1]) + 2, 50)))
        lo, hi = np.sort(rng.integers(0, len(values) + 1, (2, len(wanted))), axis=0)
        for k in np.arange(0, len(wanted), 40), np.arange(len(wanted)):  # few at once, and many
            want = np.clip(np.searchsorted(values, wanted[k]), lo[k], hi[k])
            at, same = ef.next_geq(lo[k], hi[k], wanted[k])
            assert (at == want).all() and (same == [i < h and values[i] == w for i, h, w in zip(want, hi[k], wanted[k])]).all()
        x = values[len(values) // 2]
        assert ef.next_geq([0], [len(values)], [x])[0] == np.searchsorted(values, x) and (ef.take(at := rng.integers(0, len(values), 1)) == values[at]).all()


def test_quantised():
    x = np.random.default_rng(1).uniform(Quantised.LOWEST, Quantised.LOWEST + 65535 * Quantised.STEP, 5000)
    assert np.abs(Quantised(x).take(np.arange(5000)) - x).max() <= Quantised.STEP / 2 + 1e-12
    assert Quantised(np.array([-99.0, 99.0])).take(np.array([0, 1])).tolist() == [Quantised.LOWEST, Quantised.LOWEST + 65535 * Quantised.STEP]


def test_trie_of_order_three():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 30, 4000)
    two = np.unique(np.stack((text[:-1], text[1:]), 1), axis=0)
    three = np.unique(np.stack((text[:-2], text[1:-1], text[2:]), 1), axis=0)
    p2, p3 = -rng.random(len(two)), -rng.random(len(three))
    trie = NgramTrie(30, [two, three], [p2, p3], [np.zeros(30), np.zeros(len(two))])
    assert trie.width[1] < 31  # children of level 3 are places among successors
    ask = rng.integers(0, 30, (3000, 3))
    known = {tuple(g): i for i, g in enumerate(three.tolist())}
    assert trie.find(ask).tolist() == [known.get(tuple(g), -1) for g in ask.tolist()]
    assert (trie.find(two) == np.arange(len(two))).all()
    assert np.abs(trie.probability[1].take(trie.find(three)) - p3).max() < 1 / 200


def brute_lm(texts, held):
    """The model as its docstring states it; returns counts, base and score by text."""
    T = [words(t) + [None] for t in texts]
    train = [t for t, h in zip(T, held) if not h]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    places = lambda t: [(t[i - 2] if i > 1 else 0, t[i - 1] if i else 0, t[i]) for i in range(len(t))]
    tri = collections.Counter(g for t in train for g in places(t))
    bi, hist, total = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b, w), k in tri.items():
        bi[b, w] += k
        hist[a, b] += k
        total[b] += k
    xs = list(c.values())
    d1, d2, d3 = op1_ngram_lm.discount(xs.count(1), xs.count(2)), op1_ngram_lm.D2, op1_ngram_lm.D3
    p = lambda w: (c[w] - d1) / n if c[w] else d1 * v / n
    sent = {w for w in c if c[w] >= max(1, int(n * op1_ngram_lm.TOP))}
    taken, more, taken3, more3 = (collections.Counter() for _ in range(4))
    for b, w in bi:
        more[b] += 1
        if w in sent:
            taken[b] += p(w)
    for a, b, w in tri:
        more3[a, b] += 1
        taken3[a, b] += (bi[b, w] - d2) / total[b]

    def log_p(a, b, w):
        if tri[a, b, w]:
            return math.log10((tri[a, b, w] - d3) / hist[a, b])
        back = math.log10(d3 * more3[a, b] / hist[a, b] / max(1 - taken3[a, b], 1e-9)) if hist[a, b] else 0
        if bi[b, w]:
            return back + math.log10((bi[b, w] - d2) / total[b])
        return back + math.log10(p(w)) + (math.log10(d2 * more[b] / total[b] / max(1 - taken[b], 1e-9)) if total[b] else 0)

    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(log_p(*g) for g in places(t))) for t in T]


@pytest.mark.parametrize("sizes", [{}, {"SHARD_TOKENS": 9000, "PIECE_TOKENS": 700, "BATCH_TOKENS": 5000}, {"SHARD_TOKENS": 9000, "SPLIT": 1500}])
def test_language_model(spark, tiny, monkeypatch, sizes):
    """Scores are those of the plain model to within quantisation, in one shard or many, with frequent contexts dealt too."""
    for k, n in sizes.items():
        monkeypatch.setattr(op1_ngram_lm, k, n)
    got = op1_ngram_lm.op1_ngram_lm(spark, tiny).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs["doc_id"]]
    assert got["held_out"].tolist() == held and held.count(True) > 5
    for row, (tokens, known, n, base, score) in zip(got.itertuples(), brute_lm(docs["text"], held)):
        assert (row.n_tokens, row.n_known, row.train_tokens) == (tokens, known, n)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert abs(row.score - score) <= 1.5 * Quantised.STEP * tokens  # three values of half a step each
    seen = got[got["held_out"]]
    assert seen["score"].sum() > seen["base_score"].sum()


def test_contexts_of_any_size_follow_one_model(spark):
    """A word of half a million occurrences is scored by the formulas that hold for rare ones."""
    rng, k, texts = np.random.default_rng(5), 0, []
    for _ in range(105):
        ws = []
        for jump in rng.random(5000):
            k = (k + 1) % 2000 if jump < 0.7 else int(rng.integers(0, 2000))
            ws.append(f"the w{k}")
        texts.append(" ".join(ws))
    held = [i % 7 == 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = op1_ngram_lm.language_model_scores(docs, F.col("doc_id") % 7 == 2).toPandas().sort_values("doc_id")
    for row, (tokens, _, n, base, score) in zip(got.itertuples(), brute_lm(texts, held)):
        assert (row.n_tokens, row.train_tokens) == (tokens, n) and row.base_score == pytest.approx(base, rel=1e-9)
        assert abs(row.score - score) <= 1.5 * Quantised.STEP * tokens


def _batches(n, texts=1):
    """n batches of texts of two words each, and what all tasks know."""
    common = op1_ngram_lm.Words({"n": 3 * n * texts, "tokens": 3 * n * texts, "words": 2, "docs": n * texts, "once": 0, "twice": 0}, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    for k in range(n):
        batch = op1_ngram_lm.Batch(common)
        for i in range(texts):
            batch.add(i, f"a b{k}", i % 7 == 2)
        yield common, batch


def test_a_shard_holds_no_more_than_its_occurrences():
    """Rows of a few occurrences in batches of many texts take memory by the occurrences, not by the texts."""
    few = np.array([0, 1]), np.array([1, 2]), np.array([1])
    peak = {}
    for texts in (100, 100_000):
        rows = [(k, pack(few[0], small(np.array([0])), few[1], small(np.array([0])), small(np.array([1])), small(np.array([texts])), np.array([texts + 1]))) for k in range(300)]
        common = next(_batches(1))[0]
        tracemalloc.start()
        sums = [unpack(d) for b, t, d in op1_ngram_lm.shard_model(rows, common, 2) if t == -1]
        peak[texts] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(sums) == 300 and all(s[0].tolist() == [texts] for s in sums)
    assert peak[100_000] < 1.2 * peak[100] + 100_000


def test_a_batch_in_another_order_is_noticed():
    (c, one), (_, two) = _batches(2, texts=3)
    rows, other = list(one.rows(0)), list(two.rows(0))
    assert len({r[1] for r in rows}) == 1 and rows[0][1] != other[0][1] and rows[0][1] >= 0
    ids = [(-2, d) for *_, kind, d in rows if kind]
    sums = [(t, d) for _, t, d in op1_ngram_lm.shard_model([(b, d) for _, b, kind, d in rows if not kind], c, 2) if t == -1]
    frame = lambda rows: pd.DataFrame(rows, columns=["target", "data"])
    assert op1_ngram_lm.total_scores(frame(ids + sums), c)["own"].tolist() == [0, 1, 2]
    for broken in (sums, ids, ids + sums + sums):
        with pytest.raises(RuntimeError):
            op1_ngram_lm.total_scores(frame(broken), c)


def test_dealing_contexts_to_shards_changes_no_score(spark, tiny, monkeypatch):
    run = lambda: op1_ngram_lm.op1_ngram_lm(spark, tiny).toPandas().sort_values("doc_id")
    want = run()
    for k, n in {"SPLIT": 150, "SHARD_TOKENS": 9000}.items():
        monkeypatch.setattr(op1_ngram_lm, k, n)
    got = run()
    assert got["doc_id"].tolist() == want["doc_id"].tolist() and got["held_out"].any()
    assert got["score"].to_numpy() == pytest.approx(want["score"].to_numpy(), rel=1e-9)


def test_back_offs_are_equal_at_any_ranges_of_keys(monkeypatch):
    rng = np.random.default_rng(6)
    c = op1_ngram_lm.Words({"n": 0, "words": 0, "docs": 0, "tokens": 0, "once": 0, "twice": 0}, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    c.split, c.split_count = np.arange(2), np.array([5000, 70000])
    pool = np.unique(rng.integers(0, (1 << 63) - 1, 5000))
    told = []
    for _ in range(4):
        i = np.sort(rng.choice(len(pool), 2000, replace=False))
        told.append([pool[i], small(i % 2), small(rng.integers(1, 9, 2000)), small(rng.integers(9, 500, 2000)), small(np.array([0, 1])), small(np.array([3, 4])), np.array([0.1, 0.2])])
    want = op1_ngram_lm.BackOffs(told, c)
    monkeypatch.setattr(op1_ngram_lm, "PIECE_TOKENS", 700)
    got = op1_ngram_lm.BackOffs(told, c)
    assert (got.keys == want.keys).all() and (got.of_histories(pool) == want.of_histories(pool)).all() and (want.of_histories(pool) != 0).any()
    assert (op1_ngram_lm.BackOffs([], c).of_histories(pool) == 0).all()


def test_language_model_of_messy_rows(messy, none):
    scored = op1_ngram_lm.language_model_scores(messy, F.col("doc_id") == 8).collect()
    assert len(scored) == 12 and sum(r["doc_id"] is None for r in scored) == 1
    by = {r["doc_id"]: r for r in scored}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[3]["score"] == by[4]["score"] and by[8]["held_out"]
    assert by[7]["n_tokens"] == 40001 and all(math.isfinite(r["score"]) for r in scored)
    assert op1_ngram_lm.language_model_scores(none, F.lit(False)).count() == 0
    unlearnt = op1_ngram_lm.language_model_scores(messy, F.lit(True)).collect()
    assert {r["n_known"] for r in unlearnt} == {0} and {r["train_tokens"] for r in unlearnt} == {0}


def test_toxicity_on_held_out_rows(spark, small):
    got = op2_toxicity.op2_toxicity(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    right = got[got["predicted"] == 1]["toxic"].mean()
    found = got[got["toxic"] == 1]["predicted"].mean()
    assert right > 0.8 and found > 0.5


def test_toxicity_by_a_plain_fit(spark, monkeypatch):
    """n-grams as strings, chi-square, log-count ratios and Newton steps on a dense matrix."""
    monkeypatch.setattr(op2_toxicity, "LEAST", 2.0)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["awful", "rotten", "garden", "river", "stone"] if k % 2 else ["garden", "river", "stone", "gentle"], 6)) for k in range(24)]
    label = np.array([k % 2 for k in range(24)], dtype=float)
    rows = spark.createDataFrame([(t, int(y), 1.0) for t, y in zip(texts, label)], "text string, label int, weight double")
    model = op2_toxicity.fit(rows)
    asked = [*texts[:6], "a rotten stone", "nothing of the kind", "", None]
    got = [r["score"] for r in op2_toxicity.toxicity(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model).orderBy("doc_id").collect()]

    def grams(t):
        t = " " + " ".join((t or "").lower().split()) + " "
        return {t[i : i + n] for n in op2_toxicity.ORDERS for i in range(len(t) - n + 1)}

    sets = [grams(t) for t in texts]
    n1, n0 = label.sum(), (1 - label).sum()
    chi, ratio = {}, {}
    for g in set().union(*sets):
        a = sum(y for s, y in zip(sets, label) if g in s)
        b = sum(1 - y for s, y in zip(sets, label) if g in s)
        if a + b >= 2:
            chi[g] = 24 * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (24 - a - b) * n1 * n0) if a + b < 24 else 0
            ratio[g] = math.log((a + 5) / (n1 + 10)) - math.log((b + 5) / (n0 + 10))
    chosen = [g for g, x in chi.items() if x >= min(2.0, max(chi.values()) / 2)]
    x = np.array([[1.0] + [ratio[g] * (g in s) for g in chosen] for s in sets])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * len(chosen))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(w)), x.T @ (p - label) + penalty @ w)
    want = [1 / (1 + math.exp(-(w[0] + sum(w[1 + i] * ratio[g] for i, g in enumerate(chosen) if g in grams(t))))) for t in asked]
    assert len(chosen) > 20 and got == pytest.approx(want, abs=0.01)


def test_toxicity_of_messy_rows(spark, messy, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 0), (10, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = op2_toxicity.fit(op2_toxicity.training_rows(messy, labels, "toxic"))
    scored = op2_toxicity.toxicity(messy, model).collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (3, 4, 5)}) == 1
    assert op2_toxicity.toxicity(none, model).count() == 0
    alone = op2_toxicity.fit(op2_toxicity.training_rows(messy, labels.where("toxic = 0 and doc_id > 1"), "toxic"))
    assert {r["predicted"] for r in op2_toxicity.toxicity(messy, alone).collect()} == {0}


@pytest.fixture(scope="module")
def model():
    with open(op9_sentencepiece.default_model(), "rb") as f:
        return f.read()


def round_trip(texts, model, shards=3, limit=op9_sentencepiece.TABLE_BYTES):
    """The operator's steps by themselves."""
    s, batch = op9_sentencepiece.Segmenter(model, limit), op9_sentencepiece.Batch()
    for i, t in enumerate(texts):
        batch.add(i, t)
    (_, _, docs, numbers), *asked = batch.rows(0, shards)
    answers = []
    for _, shard, _, data in asked:
        ids = s.ids(zstandard.decompress(data).decode("utf-8", "surrogatepass").split(op9_sentencepiece.MARK))
        answers.append((shard, pack(small(np.array([len(i) // 4 for i in ids])), small(np.frombuffer(b"".join(ids), dtype="<u4")))))
    p = s.processor
    coded, decoded = op9_sentencepiece.assemble(docs, numbers, answers, p.decode, (p.bos_id(), p.eos_id()))
    return s, [np.frombuffer(c, dtype="<u4").tolist() for c in coded], decoded


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab é▁\n\t\x00日.<s>  "), max_size=60), min_size=1, max_size=4))
def test_chunks_encode_as_the_library_does(model, texts):
    s, coded, decoded = round_trip(texts, model)
    want = [s.processor.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert coded == want and decoded == [s.processor.decode(w) for w in want]


def test_each_distinct_chunk_is_segmented_once(model, monkeypatch):
    texts = ["the cat  and the dog", "the dog and the cat", "and"] * 5
    s, coded, _ = round_trip(texts, model)
    assert s.segmented == len({c for t in texts for c in op9_sentencepiece.chunks_of(t)} - {""})
    assert s.ids(["the", "dog"]) and s.segmented == 5  # the, cat, " and" after two blanks, and, dog
    monkeypatch.setattr(op9_sentencepiece, "SLICE", 2)
    assert round_trip(texts, model, shards=2, limit=0)[1] == coded  # a full table is begun anew
    with pytest.raises(RuntimeError):
        op9_sentencepiece.assemble([1], next(_one("a b").rows(0, 2))[3], [], None, None)


def test_a_model_that_normalises_is_refused(model, monkeypatch):
    import sentencepiece

    op9_sentencepiece.Segmenter(model)
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, t: op9_sentencepiece.MARK + t.strip().replace(" ", op9_sentencepiece.MARK))
    with pytest.raises(ValueError):
        op9_sentencepiece.Segmenter(model)


def _one(text):
    batch = op9_sentencepiece.Batch()
    batch.add(1, text)
    return batch


def test_sentencepiece_round_trip(spark, tiny, messy, none, model):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in op9_sentencepiece.op9_sentencepiece(spark, tiny).collect():
        ids = p.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()
    path = op9_sentencepiece.default_model()
    coded = op9_sentencepiece.digests(op9_sentencepiece.sentencepiece_round_trip(messy, path)).collect()
    assert len(coded) == 12 and {r["n_tokens"] for r in coded if r["doc_id"] in (3, 4)} == {2}
    many = op9_sentencepiece.digests(op9_sentencepiece.sentencepiece_round_trip(messy, path, shards=7, batch_tokens=3)).collect()
    assert sorted(map(str, many)) == sorted(map(str, coded))
    assert op9_sentencepiece.sentencepiece_round_trip(none, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(reference=st.text(alphabet="abc", min_size=1, max_size=40), text=st.text(alphabet="abcd", max_size=60))
def test_phrases_are_longest_matches(reference, text):
    p = op10_language.CrossParser({"x": reference})
    want = plain_phrases(reference, text)
    assert all(p.phrases([p.symbols(text)], block)[0, 0] == want for block in (1, 3, 8192))


def letters_only(text):
    """Lower case, each run of characters that aren't letters as one blank."""
    out = []
    for c in text.lower():
        if c.isalpha() or not (out and out[-1] == " "):
            out.append(c if c.isalpha() else " ")
    return "".join(out)


def plain_phrases(reference, text):
    known, s, i, phrases = letters_only(reference), letters_only(text), 0, 0
    while i < len(s):
        n = 1
        while i + n < len(s) and s[i : i + n + 1] in known:
            n += 1
        i += n
        phrases += 1
    return phrases


def test_languages_and_scores_by_plain_parsing():
    """Many languages, two of 500 ideographs each, and texts longer than a block."""
    rng = np.random.default_rng(4)
    letters = {"en": "abcdefghij", "fr": "abcdefghié", "de": "bcdefghijü", "x1": "".join(map(chr, range(0x4E00, 0x4E00 + 500))), "x2": "".join(map(chr, range(0x5200, 0x5200 + 500)))}
    known = {k: ["".join(rng.permutation([*a])[:4]) for _ in range(100)] for k, a in letters.items()}
    write = lambda k, n: " ".join(rng.choice(known[k], n))
    references = {k: write(k, 300) for k in letters}
    texts = [write(k, n) for k in letters for n in (2, 10, 100)] + ["".join(rng.choice([*"abc "], 12_000)), "abab" * 5000, references["x1"] * 12, "1 2", "", None]
    p = op10_language.CrossParser(references)
    lang, score = p.judge(texts)
    for t, got, s in zip(texts, lang, score):
        if not t or not op10_language.has_letter(t):
            assert (got, s) == ("und", 0.0)
            continue
        entropy = {k: plain_phrases(r, t) * math.log2(len(letters_only(r))) / len(letters_only(t)) for k, r in references.items()}
        first, second = sorted(entropy.items(), key=lambda e: (e[1], e[0]))[:2]
        assert got == first[0] and s == pytest.approx(second[1] / (first[1] + second[1]))
    assert lang[9:15] == ["x1"] * 3 + ["x2"] * 3 and all(s > 0.5 for s in score[9:15])


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 50), max_size=12), limit=st.integers(1, 600))
def test_texts_side_by_side_stay_within_bytes(sizes, limit):
    ranges = list(op10_language.side_by_side(sizes, 2, limit, block=8))
    assert [i for lo, hi in ranges for i in range(lo, hi)] == list(range(len(sizes)))
    for lo, hi in ranges:
        blocks = sum(-(-n // 8) for n in sizes[lo:hi])
        assert hi == lo + 1 or 6 * blocks * min(8, max(sizes[lo:hi])) <= limit


def test_ranges_of_texts_change_no_verdict(monkeypatch):
    p = op10_language.CrossParser({"en": "the house and the garden", "de": "das Haus und der Garten"})
    texts = ["the house", None, "und der Garten " * 900, "", "garden and", "Haus", "1"] * 3
    want = p.judge(texts)
    monkeypatch.setattr(op10_language, "GRID_BYTES", 100)
    assert p.judge(texts) == want


def test_references_are_spread_over_whole_texts(spark):
    rows = [(i, "x" * 100 + chr(97 + i) * 900 + "y" * 100, "en") for i in range(5)] + [(9, "short", "de"), (10, "1 2", "de")]
    found = op10_language.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", rows=4, chars=800)
    assert found["de"] == "short" and len(found["en"].split("\n")) == 16
    assert found["en"].count("x" * 50) == found["en"].count("y" * 50) == 4


def test_language_on_held_out_rows(spark, small):
    got = op10_language.op10_language(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_messy_rows(messy, none):
    found = op10_language.identify(messy, messy.where("lang is not null"), keep=["doc_id", "text", "k"]).collect()
    assert len(found) == 12
    by = {r["doc_id"]: r for r in found}
    assert {by[i]["lang_pred"] for i in (3, 4, 5, 6)} == {"und"} and by[3]["score"] == 0 and by[7]["lang_pred"] == "en" and by[9]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in op10_language.identify(messy, none).collect()} == {"und"}
    assert op10_language.identify(none, messy).count() == 0
    with pytest.raises(ValueError):
        op10_language.identify(messy, none, keep=["score"])


def test_identified_rows_keep_columns_of_any_name(spark):
    rows = [(1, "the house and the garden", "en", "x", "y"), (2, "das Haus und der Garten", "de", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __text string, `c0 d.e` string")
    got = op10_language.identify(docs, docs, keep=["__text", "doc_id", "c0 d.e", "text"]).collect()
    assert [tuple(r)[:5] for r in sorted(got, key=lambda r: r["doc_id"])] == [("x", 1, "y", rows[0][1], "en"), ("z", 2, None, rows[1][1], "de")]
