"""Language identification by cross-parsing entropy. A suffix automaton of each language's labelled text yields the
longest match from each phrase's start; a text is parsed greedily into such phrases, and the language that needs the
fewest, normalised by log2 of its reference's length over the text's length, wins.

Scale: references come from a bounded sample (at most ROWS rows and CHARS characters a language, whatever the input's
size and the number of languages; texts longer than their share give evenly spaced windows). Automata are built on the
driver and sent as packed tables of about 0.75 MB a language, which no number of documents adds to. Scoring is one pass without a shuffle, vectorised over
many texts: one step follows a transition in every text and language at once. Texts are parsed whole: they are stepped
through in blocks of BLOCK characters side by side, as many texts at once as GRID_BYTES allows (a byte for each character
and language, and four for the character), and a second pass carries each block's open phrase over into the next
until both parses begin a phrase at the same place, from where on they are equal, so that the count is that of one parse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import remainder, ship, table
from tarn.llm.sampling import bounded_sample

#: Bounds of the fit: rows of a language, characters of its reference, windows of a text longer than its share.
ROWS, CHARS, WINDOWS = 48, 32_000, 4
BLOCK, BATCH, TRIES, GRID_BYTES = 8192, 1000, 40, 64 << 20


def side_by_side(sizes: list[int], languages: int, limit: int, block: int = BLOCK):
    """Ranges of texts whose blocks, laid side by side, take at most `limit` bytes; a text that takes more is alone."""
    start = wide = blocks = 0
    for i, n in enumerate(sizes):
        own = max(1, -(-n // block))
        wide, blocks = max(wide, min(n, block)), blocks + own
        if i > start and wide * blocks * (languages + 4) > limit:
            yield start, i
            start, wide, blocks = i, min(n, block), own
    if sizes:
        yield start, len(sizes)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class SuffixAutomaton:
    """Suffix automaton of a text: accepts exactly its substrings. next[s] maps symbols to states; state 0 is the root."""

    def __init__(self, text):
        self.next, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state


class Transitions:
    """Automata packed into arrays: the transition of state s by symbol c lies at base[s] + c, where `owner` holds s.
    States with several transitions are placed first, the others fill the gaps. State 0 has no transitions."""

    def __init__(self, width: int):
        self.width, self.base, self.used, self.slots = width, [0], bytearray(), []

    def add(self, automaton: SuffixAutomaton) -> int:
        """Returns the root's number."""
        moves, first = automaton.next, len(self.base)
        self.base += [0] * len(moves)
        used = self.used
        from_here = free = len(used)  # an automaton lies behind the one before
        for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
            symbols, tries = sorted(moves[s]), 0
            if len(symbols) > 1:
                b = from_here
                while any(b + c < len(used) and used[b + c] for c in symbols):
                    b, tries = b + 1, tries + 1
                    if tries == TRIES:  # crowded here: go to the end
                        b, from_here = max(b, len(used)), from_here + TRIES
            else:
                c = symbols[0] if symbols else 0
                while free < len(used) and used[free] or free < c:
                    free += 1
                b = free - c
            self.base[first + s] = b
            for c in symbols:
                used.extend(bytes(max(0, b + c + 1 - len(used))))
                used[b + c] = 1
                self.slots.append((b + c, first + s, first + moves[s][c]))
        return first

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(self.base) + self.width + 1
        owner, target = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        if self.slots:
            at, of, to = np.array(self.slots, dtype=np.int32).T
            owner[at], target[at] = of, to
        return np.array(self.base, dtype=np.int32), owner, target


class CrossParser:
    """Automata of all languages. Symbol 0 is any run of characters that aren't letters, each letter of a reference has a
    symbol of its own, and the last symbol is any letter that no reference has."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        texts = [references[k].lower() for k in self.languages]
        self.letters = np.array(sorted({ord(c) for t in texts for c in t if c.isalpha()}), dtype=np.uint32)
        self.other = len(self.letters) + 1
        refs = [self.symbols(t) for t in texts]
        table = Transitions(self.other + 1)
        self.roots = np.array([table.add(SuffixAutomaton(r.tolist())) for r in refs], dtype=np.int32)
        self.base, self.owner, self.target = table.packed()
        self.bits = np.array([np.log2(max(2, len(r))) for r in refs])

    def symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = np.zeros(len(code), dtype=np.int32)
        if len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
            s = np.where(self.letters[at] == code, at + 1, 0).astype(np.int32)
        blank = s == 0
        if blank.any():
            rare = np.unique(code[blank])
            for c in rare[[chr(x).isalpha() for x in rare]]:  # letters that no reference has
                s[code == c] = self.other
            blank = s == 0
            s = s[~(blank & np.concatenate(([True], blank[:-1])))]
        return s

    def _step(self, state: np.ndarray, symbol: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and where it began a phrase (no transition led on)."""
        at = self.base.take(state) + symbol
        begins = self.owner.take(at) != state
        to = self.target.take(at)
        if begins.any():
            # from the root anew; a symbol that a reference lacks is a phrase by itself: state 0
            own = np.broadcast_to(roots, state.shape)[begins]
            at = self.base.take(own) + np.broadcast_to(symbol, state.shape)[begins]
            to[begins] = np.where(self.owner.take(at) == own, self.target.take(at), 0)
        return to, begins

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Number of phrases of each text (columns) by each language (rows)."""
        owner = np.repeat(np.arange(len(texts)), [max(1, -(-len(t) // block)) for t in texts])
        blocks = [t[i : i + block] for t in texts for i in range(0, max(1, len(t)), block)]
        size = np.array([len(b) for b in blocks], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        n, most, k = len(blocks), int(size.max(initial=0)), len(self.languages)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        grid = np.zeros((n, most), dtype=np.int32)
        for row, i in enumerate(order):
            grid[row, : size[i]] = blocks[i]
        grid = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-size[order], -np.arange(most), side="left")  # blocks longer than the step
        begun = np.zeros((most, k, n), dtype=bool)
        state = np.zeros((k, n), dtype=np.int32)
        roots = self.roots.reshape(-1, 1)
        for step in range(most):
            m = live[step]
            state[:, :m], begun[step, :, :m] = self._step(state[:, :m], grid[step, :m], roots)
        counts = begun.sum(0, dtype=np.int64)
        # carry each open phrase over into the text's next block
        after = np.append(owner[1:] == owner[:-1], False)
        lang, here = (x.ravel() for x in np.meshgrid(np.arange(k), np.nonzero(after)[0], indexing="ij"))
        alone, more = state.copy(), np.zeros((k, n), dtype=np.int64)
        while len(here):
            into = place[here + 1]
            final, added = self._carry(lang, into, state[lang, place[here]], size[here + 1], grid, begun, alone)
            more[lang, into] = added
            other = final != state[lang, into]
            state[lang, into] = final
            again = other & after[here + 1]  # rare: the parses of a whole block never met
            lang, here = lang[again], here[again] + 1
        counts += more
        out = np.zeros((k, len(texts)), dtype=np.int64)
        for i in range(k):
            out[i] = np.bincount(owner[order], weights=counts[i], minlength=len(texts))
        return out

    def _carry(self, lang, col, state, size, grid, begun, alone) -> tuple[np.ndarray, np.ndarray]:
        """Parse blocks (columns of the grid) on from given states until a phrase begins where the block's own parse began
        one. Returns the states at the blocks' ends and how many phrases more than its own a block has."""
        final, added, which, step = alone[lang, col], np.zeros(len(col), dtype=np.int64), np.arange(len(col)), 0
        while len(which):
            state, begins = self._step(state, grid[step, col], self.roots[lang])
            own = begun[step, lang, col]
            added[which] += begins.astype(np.int64) - own
            step += 1
            apart = ~(begins & own)
            ended = apart & (size[which] == step)
            final[which[ended]] = state[ended]
            on = apart & ~ended
            state, lang, col, which = state[on], lang[on], col[on], which[on]
        return final, added

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the runner-up's share of both entropies (one language: 1)."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not rows or not self.languages:
            return lang, score
        for lo, hi in side_by_side([len(texts[i]) for i in rows], len(self.languages), GRID_BYTES):
            symbols = [self.symbols(texts[i]) for i in rows[lo:hi]]
            size = np.array([max(1, len(s)) for s in symbols])
            entropy = self.phrases(symbols) * self.bits[:, None] / size
            best = entropy.argmin(axis=0)
            for j, i in enumerate(rows[lo:hi]):
                own = entropy[best[j], j]
                rest = np.delete(entropy[:, j], best[j])
                lang[i], score[i] = self.languages[best[j]], float(rest.min() / (own + rest.min())) if len(rest) else 1.0
        return lang, score


def references(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, chars: int = CHARS) -> dict[str, str]:
    """Each language's reference text, from at most `rows` rows and of at most `chars` characters in equal shares: a text
    within its share is taken whole, a longer one gives WINDOWS windows at equal distances from its begin to its end."""
    lettered = F.regexp_like(text_col, F.lit(r"\p{IsAlphabetic}"))
    picked, counts = bounded_sample(labelled.where(lettered).select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "lang", "k", rows)
    share, size = F.lit(chars), F.length("text")
    for value, n in counts.items():
        share = F.when(F.col("lang") == value, max(WINDOWS, chars // min(n, rows))).otherwise(share)
    picked = picked.withColumn("share", share.cast("int"))
    width = F.floor(F.col("share") / WINDOWS).cast("int")
    windows = [F.substring("text", F.floor(k * (size - width) / (WINDOWS - 1)).cast("int") + 1, width) for k in range(WINDOWS)]
    taken = F.when(size <= F.col("share"), F.col("text")).otherwise(F.concat_ws("\n", *windows))
    found: dict[str, list] = {}
    for r in picked.select("lang", F.xxhash64(F.lit(17), "k").alias("h"), "k", taken.alias("text")).collect():
        if r["text"] and has_letter(r["text"]):
            found.setdefault(r["lang"], []).append((r["h"], r["k"], r["text"]))
    return {k: "\n".join(t for *_, t in sorted(v)) for k, v in found.items()}


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Returns the columns `keep` of docs (default: the id) with lang_pred and score.

    Learns from `labelled` alone. Texts that are null or have no letter are `und` with score 0. Ties go to the first
    language by name; without any labelled text everything is `und`. Repeated rows are each judged. An empty table
    gives an empty result. Columns lang_pred and score among `keep` raise a ValueError.
    """
    ship(docs.sparkSession)
    keep = keep or [id_col]
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"these columns are the result's own: {sorted(clash)}")
    learnt = docs.sparkSession.sparkContext.broadcast(CrossParser(references(labelled, id_col, text_col, lang_col)))
    # the text crosses once, last; columns cross under numbers, so that they may have any names
    others = [c for c in keep if c != text_col]
    kept = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        p = learnt.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lang, score = p.judge(part.column(part.num_columns - 1).to_pylist())
                columns = part.columns if text_col in keep else part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names[: len(columns)], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (kept.schema.fields if text_col in keep else kept.schema.fields[:-1]))
    judged = kept.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return judged.select(*(F.col("text" if c == text_col else f"c{others.index(c)}").alias(c) for c in keep), "lang_pred", "score")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    found = identify(docs, docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
