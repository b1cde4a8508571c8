"""Periodic runs: stretches of words that repeat one period several times over, found exactly by power-of-two naming
(Karp, Miller and Rosenberg). A block of 2^k words gets a number such that equal blocks have equal numbers: numbers of
level k + 1 come from ranking the pairs of two adjoining numbers of level k. The longest common extension of two places
is read off by descending levels. A run of period p with `repeats` periods covers `repeats` neighbouring multiples of p, so
only these grid places are candidates; each is extended to both sides, without hashes and without sorting suffixes.

Scale: rows are judged one by one where they are read, nothing is shuffled. A batch's texts lie in one array, longest
first, so that NumPy takes each period's grid at once for all texts that are long enough; numbers are made only for texts
that still have a candidate. Candidates are extended CHUNK at a time; a text of n words has at most n log n of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import remainder, ship, table
from tarn.llm.packing import Numbers

REPEATS, LEAST, CHUNK = 4, 6, 1 << 18
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"


class Names:
    """Numbers of all blocks of 2^k words, level by level; `last` holds, for each place, the end of its text."""

    def __init__(self, words: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.first, self.last, self.levels = first, last, [words.astype(np.int64)]
        longest, at = int((last - first).max(initial=0)), np.arange(len(words))
        while 2 << (len(self.levels) - 1) <= longest:
            half, size = self.levels[-1], 1 << (len(self.levels) - 1)
            whole = np.flatnonzero(at + 2 * size <= last)
            # a block that would leave its text has a number of its own
            names = -1 - at
            pairs = half[whole] * (int(half.max(initial=0)) + 1) + half[whole + size]
            names[whole] = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(names)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are the same, a < b in one text."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = b + out + (1 << k) <= self.last[b]
            name = self.levels[k]
            same = name[np.where(fits, a + out, 0)] == name[np.where(fits, b + out, 0)]
            out += np.where(fits & same, 1 << k, 0)
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are the same, a < b in one text."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = a - out - (1 << k) >= self.first[a]
            name = self.levels[k]
            same = name[np.where(fits, a - out - (1 << k), 0)] == name[np.where(fits, b - out - (1 << k), 0)]
            out += np.where(fits & same, 1 << k, 0)
        return out


def grid(words: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that may lie in a run. Texts lie by descending size, so period p's grid ends with the last text
    of repeats * p words. A run that covers the grid places i, i + p, ... has equal words there, and also from any place of
    i .. i + (repeats - 2) * p to the one a period on, of which a few are looked at."""
    ends = np.cumsum(sizes)
    places, periods = [], []
    for p in range(1, (int(sizes[0]) // repeats if len(sizes) else 0) + 1):
        texts = int(np.searchsorted(-sizes, -repeats * p, side="right"))
        here = words[: ends[texts - 1] : p]
        same = here[:-1] == here[1:]
        hit = same[: len(same) - repeats + 2].copy()
        for r in range(1, repeats - 1):
            hit &= same[r : len(same) - repeats + 2 + r]
        i = np.flatnonzero(hit) * p
        i = i[i + (repeats - 1) * p < last[i]]
        for off in {1, p // 2, p - 1} - {0, p}:
            for r in range(repeats - 2 or 1):
                if len(i) and r * p + off <= (repeats - 2) * p:
                    i = i[words[i + r * p + off] == words[i + (r + 1) * p + off]]
        if len(i):
            places.append(i)
            periods.append(np.full(len(i), p, dtype=np.int64))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(periods)


def smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period. A stretch found for several periods holds two of each, so that the
    smallest divides the others (Fine and Wilf), and it is then maximal for all of them alike."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(texts: list[list], repeats: int = REPEATS, least: int = LEAST) -> list[np.ndarray]:
    """For each text, a list of words, its runs as rows (start, length, period) by start, then period."""
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    long = [t for t in range(len(texts)) if len(texts[t]) >= max(least, repeats)]
    long.sort(key=lambda t: -len(texts[t]))
    number = Numbers()
    words = np.fromiter((number[w] for t in long for w in texts[t]), dtype=np.int64)
    sizes = np.array([len(texts[t]) for t in long], dtype=np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(long)), sizes)
    place, period = grid(words, edges[owner], edges[owner + 1], sizes, repeats)
    if not len(place):
        return out
    # only texts with candidates are named
    alive = np.unique(owner[place])
    moved = np.concatenate(([0], np.cumsum(sizes[alive])))
    kept = np.concatenate([np.arange(edges[t], edges[t + 1]) for t in alive])
    own = np.repeat(np.arange(len(alive)), sizes[alive])
    names = Names(words[kept], moved[own], moved[own + 1])
    place = place - edges[owner[place]] + moved[np.searchsorted(alive, owner[place])]
    found = []
    for at in range(0, len(place), CHUNK):
        a, p = place[at : at + CHUNK], period[at : at + CHUNK]
        start, end = a - names.backward(a, a + p), a + p + names.forward(a, a + p)
        good = end - start >= np.maximum(least, repeats * p)
        found.append(smallest_periods(start[good], end[good], p[good]))
    start, end, period = smallest_periods(*(np.concatenate(x) for x in zip(*found)))
    for t in np.unique(own[start]):
        mine = own[start] == t
        rows = np.stack((start[mine] - moved[t], end[mine] - start[mine], period[mine]), axis=1)
        out[long[alive[t]]] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """The run of the greatest length / period, compared exactly; ties: the smallest start, then period."""
    best = None
    for run in map(tuple, runs.tolist()):  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside runs and those of each run's first period, one blank between them."""
    if not len(runs):
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """Returns doc_id, runs (start, length, period in words, by start, then period), strongest (the run of the greatest
    length / period; ties: smallest start, then period; null without runs) and collapsed (the text without all words that a
    run holds after its first period, one blank between words); one row for each input row.

    Words are stretches without [\\x20\\x09-\\x0D], compared as they stand. A run is a stretch of smallest period p and of
    max(least, repeats * p) words at least which no neighbouring word prolongs; repeats must be 2 or more. Null and blank
    texts have no words. Repeated rows and null ids are rows like any other; extra columns are left out.
    """
    if repeats < 2:
        raise ValueError("a run has two periods at least")
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            runs = find_runs(texts, repeats, least)
            own, kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
            rows = np.concatenate(runs) if runs else np.zeros((0, 3), dtype=np.int64)
            flat = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
            edges = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
            best = [dict(zip(("start", "length", "period"), strongest(r))) if len(r) else None for r in runs]
            text = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(edges, flat).cast(own), pa.array(best, kind), text], ["doc_id", "runs", "strongest", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of documents whose crc32 of the id is divisible by 10, the words from some place on repeat a period."""
    h = remainder(F.col("doc_id"), 1 << 32)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    cut = cut.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.when(F.col("n") > 0, F.expr("1 + (n - a) div (3 + g % 8)")))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    done = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


# crc32 is folded byte by byte from its polynomial. Runs are islands of places whose word stands again a period on.
ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, s: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
h AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: xor(c >> 8, t.crc[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM documents, t),
s AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM h),
n AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM s),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM n),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
o AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
r AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM r GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM c GROUP BY doc_id, start, length),
k AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM u GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM u),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
z AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.i = g.i WHERE g.i IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(k.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(k.listed, '')) AS runs_sha256, sha256(coalesce(z.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN b ON d.doc_id = b.doc_id AND b.place = 1 LEFT JOIN z ON d.doc_id = z.doc_id
"""
