"""Near-duplicate documents by SimHash fingerprints in BK-trees. Children of a tree's node are keyed by their integer
Hamming distance to it; a search follows only edges within the radius of the distance just measured.

Scale: no tree of all fingerprints is built or sent around. Fingerprints are dealt to shards such that two that are to
be linked always share a shard; each shard has its own small tree, built and searched in one go. For small radii r the
shards are exact: of r + 1 runs of bits, two fingerprints at distance r or less have one run in common. Shards with
more than SPLIT members are dealt again by the bits that are left, and what is still larger after LEVELS times is parted, each two
parts meeting in a tree of their own, so that no task holds a whole group. Equal fingerprints are one member, and within a tree
a subtree whose members are all linked to the searcher already is passed over, so a shard of n near copies costs about n
steps and gives n - 1 links, never all pairs. Links are joined by rounds of a distributed components search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import LAST_ID, parts, ship, stored, table, words
from tarn.llm.components import connected_components
from tarn.plans.skew import split_join

WIDTH, RADIUS, SPLIT, LEVELS = 3, 3, 4096, 2
#: Members of a shard that meet in one tree, at most twice as many: larger shards are parted, and each two parts have a tree.
PART = 4096
_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words: of all of them; none: nothing."""
    ws = words(text)
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)], dtype=np.uint64)
    line, digest = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ws) - width + 1
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if over half the hashes have it; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BYTE for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


class ShardTree:
    """A BK-tree of one shard that links each new member to every group of members within the radius, once."""

    def __init__(self, radius: int):
        self.radius = radius
        self.prints, self.kids, self.group, self.below = [], [], [], []

    def find(self, i: int) -> int:
        group = self.group
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def search(self, print_: int, like=None) -> list[int]:
        """A member of each group that has one within the radius (and for which like(member) holds)."""
        found, groups, todo, r = [], set(), [0] if self.prints else [], self.radius
        while todo:
            n = todo.pop()
            if groups and self.below[n] >= 0 and self.find(self.below[n]) in groups:
                continue
            d = (self.prints[n] ^ print_).bit_count()
            if d <= r and (g := self.find(n)) not in groups and (like is None or like(n)):
                groups.add(g)
                found.append(n)
            for k, kid in self.kids[n].items():
                if d - r <= k <= d + r:
                    todo.append(kid)
        return found

    def add(self, print_: int, like=None) -> list[int]:
        """Insert a member; returns what search() found, and joins those groups with it."""
        found = self.search(print_, like)
        i = len(self.prints)
        self.prints.append(print_)
        self.kids.append({})
        self.group.append(i)
        self.below.append(i)
        for n in found:
            self.group[self.find(n)] = i
        at = 0
        while at != i:
            if self.below[at] >= 0 and self.find(self.below[at]) != i:
                self.below[at] = -1  # members of several groups
            d = (self.prints[at] ^ print_).bit_count()
            nxt = self.kids[at].get(d)
            if nxt is None:
                self.kids[at][d] = i
                break
            at = nxt
        return found


def shard_links(rows: DataFrame, radius: int, column: str | None = None, read=None, like=None) -> DataFrame:
    """rows: key, node, fp. Returns links a, b within shards: a spanning forest of each.

    With `column`, members are linked only if like(read(x), read(y)) holds too, x and y being their values of that column.
    """
    n = parts(rows.sparkSession)
    names = ["key", "node", "fp", *([column] if column else [])]

    def run(batches):
        key, tree, nodes, held = None, None, [], []
        for batch in batches:
            a, b = [], []
            for k, node, fp, *value in zip(*(batch.column(c).to_pylist() for c in names)):
                if k != key:
                    key, tree, nodes, held = k, ShardTree(radius), [], []
                test = None
                if column:
                    own = read(value[0])
                    test = lambda m, own=own: like(held[m], own)  # noqa: B023, E731
                found = tree.add(fp & 0xFFFFFFFFFFFFFFFF, test)
                a += [node] * len(found)
                b += [nodes[m] for m in found]
                nodes.append(node)
                if column:
                    held.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select(*names).repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def parted(rows: DataFrame, part: int | None = None) -> DataFrame:
    """rows (key, node, n: the key's rows, ...) with keys of a bounded number of rows instead: those of at most `part` rows stay,
    others are parted by their nodes, and each two parts share a new key. Every two rows of a key still share one."""
    parts_ = F.ceil(F.col("n") / (part or PART)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(31), "node"), parts_).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts_ - 1), lambda p: p != own)
    keys = F.when(parts_ <= 1, F.array("key")).otherwise(F.transform(others, lambda p: F.xxhash64("key", F.least(p, own), F.greatest(p, own))))
    return rows.withColumn("key", F.explode(keys)).drop("n")


def bit_shards(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows key, node, fp such that nodes within the radius share a key; keys of one node are left out."""
    kept, rows = None, nodes.select("node", "fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"))
    for level in range(LEVELS + 1):
        # `used` has the bits that a shard's members have in common; the others fall into radius + 1 runs anew
        runs = []
        for r in range(radius + 1):
            if level == 0:
                lo, hi = 64 * r // (radius + 1), 64 * (r + 1) // (radius + 1)
                mask = F.lit(_signed(((1 << (hi - lo)) - 1) << lo))
            else:  # every (radius + 1)th bit of those left, by position
                stripe = sum(1 << b for b in range(64) if b % (radius + 1) == r)
                mask = F.lit(_signed(stripe)).bitwiseAND(F.bitwise_not("used"))
            runs.append(F.struct(F.xxhash64("key", F.lit(level * 100 + r), F.col("fp").bitwiseAND(mask)).alias("key"), F.col("used").bitwiseOR(mask).alias("used")))
        dealt = rows.select("node", "fp", F.explode(F.array(*runs)).alias("s")).select("node", "fp", "s.key", "s.used")
        counted = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = dealt.join(counted, "key")
        if level == LEVELS:
            done = dealt
        else:
            dealt = stored(dealt, "shards")
            done, rows = dealt.where(F.col("n") <= SPLIT), dealt.where(F.col("n") > SPLIT).drop("n")
        done = parted(done.select("key", "node", "fp", "n"))
        kept = done if kept is None else kept.union(done)
        if level < LEVELS and rows.isEmpty():
            break
    return kept


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links of fingerprints
    that differ in `radius` bits at most; one row for each input row.

    Texts without words (null too) have fingerprint zero and are linked like any other. Each row is judged by its own text:
    rows of one id with several texts may be in several components, and so may rows without an id. A component of
    such rows alone has a null id. Extra columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    prints = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long"), "fingerprints")
    # fingerprints are the nodes, so that ids that are null or repeat link nothing
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    labels = connected_components(shard_links(bit_shards(nodes.select(F.col("fp").alias("node"), "fp"), radius), radius))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


# Near copies of a lower similarity, as the pipeline removes them.

NEAR_WIDTH, SIMILARITY, NEAR_RADIUS, BANDS, BAND_ROWS, PERMUTATIONS = 5, 0.8, 28, 21, 6, 252
#: As PART, where members have sets of shingles.
SET_PART = 1024
#: Pairs whose estimate is below the similarity by more than this aren't decided exactly: 5.5 standard errors at 0.8.
SLACK = 0.14
_rng = np.random.default_rng(20)
_MULTIPLY = (_rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """Minimum of the shingles' hashes under each of PERMUTATIONS permutations, 16 bits of each kept."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)


def agree(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the min-hashes leave it open that the similarity is `least`."""
    return np.count_nonzero(a == b) >= (least - SLACK) * len(a)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes, each sorted and without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def resemble(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    return min(len(a), len(b)) / max(1, len(a), len(b)) >= least and jaccard(a, b) >= least


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """Returns doc_id, h1, h2 (two hashes of the text), component_id, stays: documents linked by a similarity of
    `similarity` or more of their sets of word shingles (Jaccard, exact) whose fingerprints, taken over these sets, are
    within `radius` bits; one row for each input row. component_id is the smallest id of a component (null, if no row of it
    has one). `stays` holds for one row of each component, with those equal to it in id and text: the row of the
    smallest id, rows without an id last, ties by the text's hashes.

    At this similarity fingerprints differ in about 10 bits, in more than NEAR_RADIUS with a chance of 2e-9 (4e-8 for texts
    of a dozen shingles, 1e-6 of four or five). That is too many for shards by runs of bits: the shards are
    BANDS bands of BAND_ROWS of the min-hashes here (a pair at 0.8 misses all bands with a chance of 0.002). Band mates
    whose min-hashes agree to within SLACK of the similarity are put together, and each group of documents so connected is
    a shard in which the shingle sets decide, in parts of bounded size; texts are read again for these documents alone. Texts without words are
    linked to each other. Each row is judged by its own text, whatever its id: null and repeated ids link nothing. Extra
    columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for t in part.column("text").to_pylist():
                    h = shingle_hashes(t, width)
                    distinct = np.unique(h)
                    sig = min_hashes(distinct)
                    keys = [xxhash.xxh64_intdigest(sig[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)]
                    same = xxhash.xxh64_intdigest(distinct.tobytes(), 42)
                    rows.append((fingerprint(distinct), same - (1 << 64) if same >> 63 else same, sig.tobytes(), np.array(keys, dtype=np.uint64).view(np.int64)))
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h1", "h2")), *own], ["doc_id", "h1", "h2", "fp", "sh", "sig", "keys"])

    def reread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.unique(shingle_hashes(t, width)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), part.column("node"), pa.array([fingerprint(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["key", "n", "node", "fp", "set"])

    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), body.alias("text"))
    sketch = texts.mapInArrow(run, "doc_id long, h1 long, h2 long, fp long, sh long, sig binary, keys array<long>")
    # a node is a set of shingles; one text stands for it
    sketch = stored(sketch.withColumn("node", F.xxhash64("fp", "sh")).drop("sh"), "sketches")
    nodes = sketch.groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("of"))
    firsts = sketch.join(nodes.select("node", "of.*"), ["node", "h1", "h2"]).dropDuplicates(["node"])
    firsts = stored(firsts.select("node", "h1", "h2", "fp", "sig", "keys"), "representatives")
    dealt = firsts.select("node", F.explode("keys").alias("key"))
    several = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    rows = parted(split_join(dealt, several, "key", "n")).join(firsts.select("node", "fp", "sig"), "node")
    near = stored(connected_components(shard_links(rows, radius, "sig", lambda s: np.frombuffer(s, dtype=np.uint16), lambda a, b: agree(a, b, similarity))).select("node", F.col("component").alias("key")), "near")
    sizes = stored(near.groupBy("key").agg(F.count("*").alias("n")), "near-sizes")
    # a text's set of shingles is made where its row is read, and goes to each tree that its group's parts have
    chosen = firsts.select("node", "h1", "h2").join(split_join(near, sizes, "key", "n"), "node")
    chosen = texts.select("h1", "h2", "text").join(chosen, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("key", "n", "node", "text")
    chosen = parted(chosen.mapInArrow(reread, "key long, n long, node long, fp long, set binary"), SET_PART)
    labels = connected_components(shard_links(chosen, radius, "set", lambda b: np.frombuffer(b, dtype=np.uint64), lambda a, b: resemble(a, b, similarity)))
    rows = sketch.select("doc_id", "h1", "h2", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows.drop("node"), "rows")
    best = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("own"), F.col("doc_id").alias("component_id"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))).alias("best"))
    best = stored(best.select("component", "n", "best.component_id", "best.b1", "best.b2"), "best")
    found = split_join(rows, best, "component", "n")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))
    return found.select("doc_id", "h1", "h2", "component_id", stays.alias("stays"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all its columns, with one row of each component of near_copies(). Rows that are equal in id and text become
    one: the first by the JSON text of their other columns, so which one is defined unless these are equal too."""
    gone = near_copies(docs, id_col, text_col, **options).where("not stays").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("own"), "h1", "h2").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("own"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"))
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (id_col, text_col)]
    first = F.to_json(F.struct(*others)) if others else F.lit("")
    left = keyed.join(gone, ["own", "h1", "h2"], "left_anti")
    return left.groupBy("own", "h1", "h2").agg(F.min_by("row", first).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
