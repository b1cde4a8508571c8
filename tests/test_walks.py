"""Random walks against walks in plain Python that draw the same numbers."""

import math
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from tarn.operators import graph


def mixed(*values):
    """The 64-bit hash of longs and ints (given as (value, bytes)), each hashed with the one before as its seed."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q" if size == 8 else "<i", v), h)
    return h - (1 << 64) if h >> 63 else h


def chance(seed, walk, step, what):
    return (mixed((seed, 4), (walk, 8), (step, 4), (what, 4)) % (1 << 40)) / (1 << 40)


def plain_walks(edges, walks, cyclic, jumps, bands, seed=1, bored=0.15, block=1024):
    links = defaultdict(set)
    nodes = set()
    for a, b in edges:
        links[a].add(b)
        nodes |= {a, b}
    order = {a: sorted(bs, key=lambda b, n=math.ceil(len(bs) / block): (mixed((b, 8)) % n, b)) for a, bs in links.items()}
    # places: by hash part, then node
    place = sorted(nodes, key=lambda x: (mixed((x, 8)) % 4096, x))
    n, out = len(nodes), Counter()
    for walk in range(walks // n * n if cyclic else walks):
        at = place[walk % n] if cyclic else place[int(chance(seed, walk, 0, 3) * n)]
        band, whole, step = sum(walk >= b for b in bands), True, 0
        while True:
            step += 1
            if not chance(seed, walk, step, 1) > bored:
                out[at, graph.ENDED, band] += 1
                break
            if whole:
                out[at, graph.VISITED, band] += 1
            if at in order:
                at = order[at][int(chance(seed, walk, step, 2) * len(order[at]))]
            elif jumps:
                whole, at = False, place[int(chance(seed, walk, step, 3) * n)]
            else:
                break
    return out


def visits(df):
    return Counter({(r["node"], r["kind"], r["band"]): r["n"] for r in df.collect()})


@pytest.fixture(scope="module")
def edges(spark):
    """A hub of 70 links, to which many nodes link, nodes without links, and a repeated link."""
    rows = [(0, i) for i in range(1, 71)] + [(i, 0) for i in range(1, 60)] + [(i, (i * 7) % 60) for i in range(1, 60, 2)] + [(0, 5), (99, 0)]
    return spark.createDataFrame(rows, "src long, dst long"), rows


@pytest.mark.parametrize("cyclic", [False, True])
@pytest.mark.parametrize("jumps", [False, True])
def test_walks_equal_plain_ones(spark, edges, monkeypatch, cyclic, jumps):
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "SPREAD", 5)
    df, rows = edges
    got = visits(graph.walk_visits(df, 300, cyclic, jumps, [100, 300], seed=3))
    assert got == plain_walks(rows, 300, cyclic, jumps, [100, 300], seed=3, block=8)


def test_a_hub_lies_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "SPREAD", 5)
    df, rows = edges
    facts = graph.node_facts(df.distinct())
    hub = facts.where("node = 0").first()
    assert (hub["out"], hub["into"], hub["copies"]) == (70, 60, 2)
    blocks = graph.link_blocks(df.distinct(), facts).collect()
    mine = [b for b in blocks if b["node"] == 0]
    assert sorted((b["block"], b["copy"]) for b in mine) == [(k, c) for k in range(9) for c in range(2)]
    assert all(len(b["links"]) == (8 if b["block"] < 8 else 6) for b in mine)
    assert sorted(x["dst"] for b in mine if b["copy"] == 0 for x in b["links"]) == list(range(1, 71))


def test_estimates_come_from_the_walks(spark, edges):
    df, rows = edges
    n = len({x for r in rows for x in r})
    for cyclic, complete in ((False, False), (True, False), (True, True), (False, True)):
        left = plain_walks(rows, 2 * n, cyclic, not complete, [2 * n])
        kind = graph.VISITED if complete else graph.ENDED
        total = sum(c for (_, k, _), c in left.items() if k == kind) if complete else 2 * n
        got = {r["node"]: r["pr"] for r in graph.random_walks(df, 2 * n, cyclic, complete).collect()}
        assert len(got) == n and all(p == pytest.approx(left[x, kind, 0] / total) for x, p in got.items())
    assert graph.random_walks(df.limit(0), 10, True, True).collect() == []


def test_losses_of_nested_runs(spark, edges):
    df, rows = edges
    exact = graph.top_scores(graph.pagerank(df), "pr", 10)
    ranks, n = {r["node"]: r["pr"] for r in exact.collect()}, len({x for r in rows for x in r})
    got = {(r["estimator"], r["runs"]): r["loss"] for r in graph.walk_losses(df, exact, (2, 3, 6)).collect()}
    want = {}
    for cyclic, names in ((False, ("mc1", "mc5")), (True, ("mc2", "mc4"))):
        for runs in (2, 3, 6):
            left = plain_walks(rows, runs * n, cyclic, True, [runs * n])
            for name, kind in zip(names, (graph.ENDED, graph.VISITED)):
                total = runs * n if kind == graph.ENDED else sum(c for (_, k, _), c in left.items() if k == kind)
                want[name, runs] = sum((left[x, kind, 0] / total - p) ** 2 for x, p in ranks.items())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w) for k, w in want.items())


def test_a_round_moves_the_walks_alone(spark):
    from tarn.plans.storage import bucketed

    kept = bucketed(spark.range(50).selectExpr("id as place", "0L as part", "array(id) as ends"), "blocks", "place", "part")
    met = spark.range(200).selectExpr("id", "id % 50 as place", "id % 1 as part").hint("merge").join(kept, ["place", "part"])
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["id"], r["ends"]) for r in met.collect()) == [(i, [i % 50]) for i in range(200)]


def test_marks_of_one_kind(spark, edges):
    df, rows = edges
    got = visits(graph.walk_visits(df, 40, True, True, [40], seed=5, kinds=(graph.ENDED,)))
    assert got == Counter({k: c for k, c in plain_walks(rows, 40, True, True, [40], seed=5).items() if k[1] == graph.ENDED})


@pytest.mark.parametrize("jumps", [False, True])
def test_walks_through_many_parts_equal_plain_ones(spark, edges, monkeypatch, jumps):
    """Parts of a few nodes, copies of those that many links lead to, several rounds a job and one."""
    df, rows = edges
    monkeypatch.setattr(graph, "PART_BYTES", 1)
    monkeypatch.setattr(graph, "GROUP_WALKS", 40)
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "FEW_WALKS", 60)
    marks = graph.walk_marks(df, 150, (False, True), jumps, [50, 150], seed=7)
    for cyclic in (False, True):
        assert visits(marks.where(marks["cyclic"] == cyclic)) == plain_walks(rows, 150, cyclic, jumps, [50, 150], seed=7, block=8)


def test_walks_in_one_part_take_no_job_a_step(spark, edges):
    df, _ = edges
    used = []
    for walks in (10, 3000):  # the longest take about 15 and 50 steps
        spark.sparkContext.setJobGroup(f"walks-{walks}", "walks")
        graph.walk_visits(df, walks, False).collect()
        spark.sparkContext.setJobGroup("", "")
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walks-{walks}")))
    assert used[1] <= used[0] + 5
