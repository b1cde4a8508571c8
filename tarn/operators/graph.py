"""Link analysis: PageRank by power iteration and by random walks, HITS, and what reads and writes their graphs.

edges(src, dst) is a set of links. A round is joins and map-side combined sums; nodes' values are written to the
shared folder every few rounds, which cuts the lineage so that a lost executor costs only the rounds since.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tarn.functions import stepping
from tarn.plans.numbering import numbered
from tarn.plans.shipping import ship
from tarn.plans.skew import split_join
from tarn.plans.storage import bucketed, new_path, removed, stored

BORED, EPSILON, MOST_ROUNDS, KEEP_EVERY = 0.15, 1e-4, 1000, 4
HITS_EPSILON = 1e-3


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w: distinct links, each with 1 / out-degree of its source."""
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg((1.0 / F.count("*")).alias("w"))
    return links.join(out, "src")


@dataclass
class Iteration:
    """PageRank as far as it has come: values after the last round and before it (node, pr), not normalised."""

    last: DataFrame
    before: DataFrame
    rounds: int
    converged: bool

    def normalised(self) -> DataFrame:
        """node, pr: the last values divided by their sum."""
        total = self.last.agg(F.sum("pr")).first()[0]
        return self.last.select("node", (F.col("pr") / total).alias("pr"))

    def written(self) -> DataFrame:
        """Values as they are written out: normalised if the iteration has converged, else the last ones as they are."""
        return self.normalised() if self.converged else self.last

    def served(self) -> DataFrame:
        """Values as they are served to queries: normalised and rounded to 5 decimals if the iteration has converged, else
        those before the last round, as they are."""
        return served(self.normalised()) if self.converged else self.before


def iterate(edges: DataFrame, nodes: DataFrame | None = None, start=None, most: int = MOST_ROUNDS, epsilon: float = EPSILON, bored: float = BORED) -> Iteration:
    """PageRank until no node moves by more than epsilon in a round, or for `most` rounds (1 at least). All mass starts on
    node `start` (default: the smallest, which is 0 where nodes are numbered); each round pr'(p) = bored / N + (1 - bored) *
    sum over q -> p of pr(q) / out(q). What nodes without links hold isn't passed on. One number a round comes to the
    driver."""
    nodes, links, n, ranks = _start(edges, nodes, start)
    before, moved, k = ranks, None, 0
    for k in range(1, max(most, 1) + 1):
        new = stored(_round(links, ranks, n, bored), "ranks")
        moved = new.agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
        before, ranks = new.select("node", F.col("old").alias("pr")), new.select("node", "pr")
        if moved is None or moved <= epsilon:
            break
    return Iteration(ranks, before, k, moved is None or moved <= epsilon)


def _start(edges: DataFrame, nodes: DataFrame | None, start) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    nodes = nodes_of(edges) if nodes is None else nodes.select("node").distinct()
    nodes = stored(nodes, "nodes")
    links = stored(weighted(edges), "links")
    start = nodes.agg(F.min("node")).first()[0] if start is None else start
    return nodes, links, nodes.count(), nodes.select("node", F.when(F.col("node") == F.lit(start), 1.0).otherwise(0.0).alias("pr"))


def _round(links: DataFrame, ranks: DataFrame, n: int, bored: float) -> DataFrame:
    into = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("pr") * F.col("w")).alias("sent"))
    return ranks.join(into, ranks["node"] == into["dst"], "left").select("node", F.col("pr").alias("old"), (F.lit(bored / max(n, 1)) + (1 - bored) * F.coalesce("sent", F.lit(0.0))).alias("pr"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, start=None, rounds: int | None = None, epsilon: float = EPSILON, bored: float = BORED, normalise: bool = True) -> DataFrame:
    """node, pr; see iterate(). rounds=k runs exactly k rounds, without a job for each; None runs until it has converged, or
    MOST_ROUNDS. Then scores are divided by their sum (normalise)."""
    if rounds is None:
        done = iterate(edges, nodes, start, MOST_ROUNDS, epsilon, bored)
        return done.normalised() if normalise else done.last
    nodes, links, n, ranks = _start(edges, nodes, start)
    for k in range(1, rounds + 1):
        ranks = _round(links, ranks, n, bored).select("node", "pr")
        if k % KEEP_EVERY == 0 or k == rounds:
            ranks = stored(ranks, "ranks")
    return Iteration(ranks, ranks, rounds, True).normalised() if normalise else ranks


def served(ranks: DataFrame) -> DataFrame:
    """Scores as they are served to queries: rounded to 5 decimals."""
    return ranks.select("node", F.round("pr", 5).alias("pr"))


def top_scores(scores: DataFrame, value: str, k: int = 30) -> DataFrame:
    """The k nodes with the largest value above 0; ties to the smaller node."""
    return scores.where(F.col(value) > 0).orderBy(F.desc(value), "node").limit(k)


def with_titles(scores: DataFrame, titles: DataFrame) -> DataFrame:
    """scores with `title` (titles: node, title); "No title found" where there is none."""
    return scores.join(titles.select("node", "title"), "node", "left").withColumn("title", F.coalesce("title", F.lit("No title found")))


def squared_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """loss: sum over nodes in both of (a.pr - b.pr) squared."""
    both = a.select("node", F.col("pr").alias("x")).join(b.select("node", F.col("pr").alias("y")), "node")
    return both.agg(F.coalesce(F.sum(F.pow(F.col("x") - F.col("y"), 2)), F.lit(0.0)).alias("loss"))


# Random walks

#: Links of a block, and links into a node for each copy of its first block.
BLOCK, SPREAD = 1024, 4096
#: What a walk leaves behind: the node where it ended, or one that it visited before it first met a node without links.
ENDED, VISITED = 0, 1


def node_facts(edges: DataFrame) -> DataFrame:
    """node, out, into, copies for each node of edges (distinct links). Walks at a node are spread over its blocks of
    links and, where many links lead to it, over copies of these."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.col("src").alias("node"), one.alias("out"), zero.alias("into")).union(edges.select("dst", zero, one))
    facts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    blocks = F.greatest(F.ceil(F.col("out") / BLOCK), F.lit(1))
    return facts.withColumn("copies", F.greatest(F.ceil(F.col("into") / (blocks * SPREAD)), F.lit(1)).cast("int"))


def link_blocks(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """node, block, copy, links: a node's links in arrays of BLOCK, each link with what a walk needs to know of its end, and with
    its place, if facts have it. facts are read several times.

    A node's links are numbered by hash part and end. Most nodes have one part, which is put in order in its own row. Parts of
    hubs hold about BLOCK links, and running sums of their sizes give each part's first number, so that no task orders a
    hub's links."""
    end = F.struct(F.col("node").alias("dst"), "out", "copies", *(c for c in facts.columns if c == "place")).alias("end")
    ahead = split_join(edges.select("src", F.col("dst").alias("node")), facts.select("node", "into", end), "node", "into").select(F.col("src").alias("node"), "end")
    hubs = facts.where(F.col("out") > BLOCK).select("node", "out", "copies")
    some = not hubs.isEmpty()
    few = ahead.join(hubs, "node", "left_anti") if some else ahead
    few = few.groupBy("node").agg(F.sort_array(F.collect_list("end")).alias("links")).join(facts.select("node", "copies"), "node")
    blocks = few.select("node", F.lit(0).cast("long").alias("block"), "copies", "links")
    if some:
        rows = split_join(ahead, hubs, "node", "out")
        part = F.pmod(F.xxhash64("end.dst"), F.ceil(F.col("out") / BLOCK)).cast("int")
        rows = rows.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("node", "part").orderBy("end.dst")) - 1)
        rows = stored(rows, "ordered-links")
        sizes = rows.groupBy("node", "part").agg(F.count("*").alias("n"))
        starts = sizes.select("node", "part", F.coalesce(F.sum("n").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        rows = rows.join(starts, ["node", "part"]).select("node", "copies", "end", (F.col("start") + F.col("at")).alias("number"))
        rows = rows.groupBy("node", "copies", F.floor(F.col("number") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "end"))).alias("links"))
        blocks = blocks.unionByName(rows.select("node", "block", "copies", F.col("links.end").alias("links")))
    return blocks.select("node", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "links")


#: Bytes of a part of the graph with its counts, walks that a group holds at the start, fewest walks for a group of its own, and walks
#: stepped at once.
PART_BYTES, GROUP_WALKS, LEAST_WALKS, CHUNK = 64 << 20, 2_000_000, 10_000, 1 << 17
#: Rounds that a job has, when at most FEW_WALKS are left.
TAIL_ROUNDS, FEW_WALKS = 8, 1_000_000
#: Bits of a number behind the walk: its step, its kind of start, and whether it has met no node without links.
STEP_BITS = 18


def walk_marks(edges: DataFrame, walks: int, starts: tuple[bool, ...], jumps: bool = True, bands: list[int] | None = None, seed: int = 1, bored: float = BORED, steps_a_job: int = 6, kinds: tuple[int, ...] = (ENDED, VISITED)) -> DataFrame:
    """node, cyclic, kind, band, n: what random walks leave, counted, for each kind of start (starts: values of cyclic); see
    walk_visits.

    Nodes are numbered densely, so a jump needs no lookup, and their links lie in parts: ranges of numbers, packed. A graph of up to
    PART_BYTES is one part, of which there are copies, each with its share of the walks, that are done after one job. A larger one
    has parts enough for their bytes and the walks that start in them, and copies of those that many links lead to. A round
    joins parts with the walks that have come to them; these step until they end or leave the part. Walks travel packed by the
    group (part and copy) that they go to, the parts stay where they are. Rounds' tables are counted every few rounds and
    removed; the last walks take several rounds a job."""
    spark = edges.sparkSession
    ship(spark)
    edges = edges.select("src", "dst").distinct()
    facts = stored(node_facts(edges), "facts")
    n, links = facts.agg(F.count("*"), F.coalesce(F.sum("out"), F.lit(0))).first()
    if not n or not walks:
        return spark.createDataFrame([], "node long, cyclic boolean, kind int, band int, n long")
    facts = stored(numbered(facts, "node", "place"), "places")
    bands = bands or [walks]
    width = 4 if n < 1 << 31 else 8
    total = walks * len(starts)
    size = width * links + (8 + 32 * (len(bands) + 1)) * n
    parts = 1 if size <= PART_BYTES else max(-(-size // PART_BYTES), -(-total // GROUP_WALKS))
    each = -(-n // parts)
    part = F.floor(F.col("place") / F.lit(each)).cast("int").alias("part")
    # a row a part
    loads = {r["part"]: r["load"] for r in facts.groupBy(part).agg(F.sum(F.col("into") + 1).alias("load")).collect()}
    parts = -(-n // each)
    tasks = max(-(-total // GROUP_WALKS), min(3 * spark.sparkContext.defaultParallelism, -(-total // LEAST_WALKS)))
    copies = [max(1, round(tasks * loads[k] / (links + n))) for k in range(parts)]
    rules = stepping.Rules(n, each, copies, width, jumps, bored, seed, sorted(bands), kinds, STEP_BITS)

    lists = link_blocks(edges, facts).where("copy = 0").join(facts.select("node", "place"), "node").select(part, "place", "block", F.col("links.place").alias("ends"))
    packed = lists.groupBy("part").applyInArrow(stepping.packing(rules), "part int, offsets binary, ends binary")
    many = spark.createDataFrame([(k, rules.first[k] + c) for k in range(parts) for c in range(copies[k])], "part int, group int")
    graph = bucketed(stored(packed, "parts").join(F.broadcast(many), "part").select("group", "offsets", "ends"), "groups", "group")

    columns = "group int, states binary, places binary, place long, code int, n long"
    begun = spark.range(0, walks, 1, max(tasks, 1)).mapInArrow(stepping.beginning(rules, walks, starts), columns)
    step = stepping.stepping(rules, CHUNK)
    alive_now = F.coalesce(F.sum(F.octet_length("states")), F.lit(0)) / 8

    def moved(at: DataFrame) -> DataFrame:
        return at.groupBy("group").cogroup(graph.groupBy("group")).applyInArrow(step, columns)

    counted, rounds, paths, at, alive = [], [], [], begun, total
    while True:
        for _ in range(TAIL_ROUNDS if alive <= FEW_WALKS and parts > 1 else 1):
            at = moved(at)
        paths.append(new_path(spark, "walks"))
        seen = Observation()
        at = stored(at.observe(seen, alive_now.cast("long").alias("alive")), "walks", paths[-1])
        rounds.append(at)
        alive = seen.get["alive"]
        if len(rounds) >= max(steps_a_job, 1) or not alive:
            these = rounds[0]
            for r in rounds[1:]:
                these = these.union(r)
            counted.append(stored(these.where("n is not null").groupBy("place", "code").agg(F.sum("n").alias("n")), "visits"))
            for path in paths[: None if not alive else -1]:
                removed(spark, path)
            rounds, paths = [], paths[-1:]
        if not alive:
            break
        at = at.where("n is null")
    found = counted[0]
    for c in counted[1:]:
        found = found.union(c)
    found = found.groupBy("place", "code").agg(F.sum("n").alias("n")).join(facts.select("node", "place"), "place")
    width_of = len(bands) + 1
    code = F.col("code")
    return stored(found.select("node", (F.floor(code / (2 * width_of)) == 1).alias("cyclic"), (F.floor(code / width_of) % 2).cast("int").alias("kind"), (code % width_of).cast("int").alias("band"), "n"), "visits")


def walk_visits(edges: DataFrame, walks: int, cyclic: bool, jumps: bool = True, bands: list[int] | None = None, seed: int = 1, bored: float = BORED, steps_a_job: int = 6, kinds: tuple[int, ...] = (ENDED, VISITED)) -> DataFrame:
    """node, kind, band, n: what `walks` random walks leave, counted. cyclic: walks / N (rounded down) from each node, else
    from random nodes. At each node a walk ends with chance `bored` (kind ENDED), else has visited it (kind VISITED, until
    it first meets a node without links) and follows one of its links; from a node without links it jumps to a random
    one, or, with jumps=False, ends without counting. A walk is of the first band whose bound its number is below. Only
    marks of `kinds` are counted."""
    return walk_marks(edges, walks, (cyclic,), jumps, bands, seed, bored, steps_a_job, kinds).drop("cyclic")


def random_walks(edges: DataFrame, walks: int, cyclic: bool, complete: bool, seed: int = 1, bored: float = BORED, steps_a_job: int = 6) -> DataFrame:
    """node, pr estimated by `walks` random walks; see walk_visits. complete=False: shares of the walks that ended at a node
    (as in the cyclic case walks / N is rounded down, they may sum to less than 1). complete=True: shares of all visits."""
    kind = VISITED if complete else ENDED
    counted = walk_visits(edges, walks, cyclic, not complete, None, seed, bored, steps_a_job, (kind,))
    total = (counted.agg(F.sum("n")).first()[0] if complete else walks) or 1
    return nodes_of(edges).join(counted, "node", "left").select("node", (F.coalesce("n", F.lit(0)) / float(total)).alias("pr"))


RUNS = (10, 20, 50, 100)


def walk_losses(edges: DataFrame, ranks: DataFrame, runs: tuple[int, ...] = RUNS, seed: int = 1, bored: float = BORED) -> DataFrame:
    """estimator, runs, loss: the squared loss against `ranks` (node, pr) of four estimates, each by `runs` times as many walks
    as there are nodes. mc1, mc2 count end points, mc4, mc5 whole paths up to a node without links; mc2, mc4 start
    from each node in turn, mc1, mc5 at random.

    The runs are nested: one set of walks of each kind of start, numbered, gives the estimates of both kinds of count at
    every prefix, and one aggregation their losses. Both sets step in the same rounds."""
    edges, ranks, runs, out = stored(edges.select("src", "dst").distinct(), "edges"), stored(ranks.select("node", "pr"), "ranks"), sorted(runs), None
    n = nodes_of(edges).count()
    marks = walk_marks(edges, runs[-1] * n, (False, True), True, [r * n for r in runs], seed, bored)
    for cyclic, names in ((False, ("mc1", "mc5")), (True, ("mc2", "mc4"))):
        left = marks.where(F.col("cyclic") == cyclic)
        sums = [F.sum(F.when((F.col("kind") == kind) & (F.col("band") <= j), F.col("n")).otherwise(0)).alias(f"{name}_{r}") for kind, name in zip((ENDED, VISITED), names) for j, r in enumerate(runs)]
        visits = left.agg(*sums).first()
        total = {f"{name}_{r}": float((r * n if kind == ENDED else visits[f"{name}_{r}"]) or 1) for kind, name in zip((ENDED, VISITED), names) for r in runs}
        both = ranks.select("node", "pr").join(left.groupBy("node").agg(*sums), "node", "left")
        losses = both.agg(*(F.coalesce(F.sum(F.pow(F.coalesce(F.col(c), F.lit(0)) / t - F.col("pr"), 2)), F.lit(0.0)).alias(c) for c, t in total.items()))
        rows = F.array(*(F.struct(F.lit(c.split("_")[0]).alias("estimator"), F.lit(int(c.split("_")[1])).alias("runs"), F.col(c).alias("loss")) for c in total))
        table = losses.select(F.explode(rows).alias("r")).select("r.*")
        out = table if out is None else out.union(table)
    return out


# HITS


def base_set(edges: DataFrame, root: DataFrame) -> DataFrame:
    """node: the root, what it links to, and what links to it."""
    return base_sets(edges, root.select(F.lit(0).alias("key"), "node")).select("node")


def base_sets(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node: for each key its root set (roots: key, node), what that links to, and what links to it."""
    roots = roots.select("key", "node").distinct()
    out = edges.join(roots, edges["src"] == roots["node"]).select("key", F.col("dst").alias("node"))
    into = edges.join(roots, edges["dst"] == roots["node"]).select("key", F.col("src").alias("node"))
    return roots.union(out).union(into).distinct()


def hits(edges: DataFrame, base: DataFrame, rounds: int | None = None, epsilon: float = HITS_EPSILON) -> DataFrame:
    """node, hub, auth on the links within `base`; see hits_of_sets."""
    return hits_of_sets(edges, base.select(F.lit(0).alias("key"), "node"), rounds, epsilon).select("node", "hub", "auth")


def hits_of_sets(edges: DataFrame, bases: DataFrame, rounds: int | None = None, epsilon: float = HITS_EPSILON) -> DataFrame:
    """key, node, hub, auth: HITS on the links within each of many base sets (bases: key, node) at once.

    Both values start at 1 and are updated together from those before: auth(v) = sum of hub over links into v, hub(v) =
    sum of auth over links out of v, each divided by its 2-norm over the key's nodes (a zero vector stays zero). rounds=k:
    exactly k; None: each key until none of its nodes moves by more than epsilon.

    A round is a grouping by (key, node), so the number of jobs doesn't depend on the number of keys. Norms are a table of
    a row a key that is joined in the plan. As dividing all of a key's values by one number commutes with the sums, a
    fixed number of rounds takes norms at every KEEP_EVERY-th round and at the last alone.
    """
    bases = stored(bases.select("key", "node").distinct(), "bases")
    links = edges.select("src", "dst").distinct()
    links = links.join(bases.select("key", F.col("node").alias("src")), "src")
    links = stored(links.join(bases.select("key", F.col("node").alias("dst")), ["key", "dst"]).select("key", "src", "dst"), "base-links")
    none = F.lit(0.0)
    still = bases.select("key", "node", none.alias("hub"), none.alias("auth"))
    at = bases.select("key", "node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("auth"))

    def sums(at: DataFrame) -> DataFrame:
        into = links.join(at.select("key", F.col("node").alias("src"), "hub"), ["key", "src"]).select("key", F.col("dst").alias("node"), none.alias("hub"), F.col("hub").alias("auth"))
        out = links.join(at.select("key", F.col("node").alias("dst"), "auth"), ["key", "dst"]).select("key", F.col("src").alias("node"), F.col("auth").alias("hub"), none.alias("auth"))
        return into.union(out).union(still).groupBy("key", "node").agg(F.sum("hub").alias("hub"), F.sum("auth").alias("auth"))

    def scaled(at: DataFrame) -> DataFrame:
        at = stored(at, "hits")
        size = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"{c}_size")
        ratio = lambda c: F.when(F.col(f"{c}_size") > 0, F.col(c) / F.col(f"{c}_size")).otherwise(0.0).alias(c)
        return at.join(at.groupBy("key").agg(size("hub"), size("auth")), "key").select("key", "node", ratio("hub"), ratio("auth"))

    if rounds is not None:
        for k in range(1, rounds + 1):
            at = sums(at)
            if k == rounds or k % KEEP_EVERY == 0:
                at = scaled(at)
        return at
    done = None
    for _ in range(MOST_ROUNDS):
        before = at.select("key", "node", F.col("hub").alias("old_hub"), F.col("auth").alias("old_auth"))
        new = stored(scaled(sums(at)).join(before, ["key", "node"]), "moved")
        moves = F.max(F.greatest(F.abs(F.col("hub") - F.col("old_hub")), F.abs(F.col("auth") - F.col("old_auth"))))
        ended = stored(new.groupBy("key").agg(moves.alias("moved")).where(F.col("moved") <= epsilon).select("key"), "ended")
        now = new.select("key", "node", "hub", "auth")
        at = now.join(ended, "key", "left_anti")
        over = now.join(ended, "key", "left_semi")
        done = over if done is None else done.union(over)
        if at.isEmpty():
            return done
        links, still = links.join(ended, "key", "left_anti"), still.join(ended, "key", "left_anti")
    return done.union(at)


HUB_SHARE, AUTH_SHARE = 1.0, 1.0


def hits_scores(edges: DataFrame, root: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, score: hub plus authority of the root's nodes within their base set."""
    return root_scores(edges, root.select(F.lit(0).alias("key"), "node"), rounds).select("node", "score")


def root_scores(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """key, node, score: hub plus authority of each root's nodes (roots: key, node) within their base set, all at once."""
    roots = stored(roots.select("key", "node").distinct(), "roots")
    at = hits_of_sets(edges, base_sets(edges, roots), rounds)
    return at.join(roots, ["key", "node"], "left_semi").select("key", "node", (HUB_SHARE * F.col("hub") + AUTH_SHARE * F.col("auth")).alias("score"))
