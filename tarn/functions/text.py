"""Tokenising columns: chunks, punctuation, non-standard words by pattern priority, case and diacritics.

Everything is one expression of built-in functions, so tokens stay in the row of their document: positions need no
shuffle, and a query can pick its terms out of a document before anything is exploded.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of non-standard words, in priority order.
PATTERNS = [
    r"https?://[^\s<>]+",
    r"\d+/\d+",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"[a-zA-Z0-9\-\.%_]+\.(docx|doc|xlsx|xls|pptx|ppt)",
    r"[$£€\+][0-9]+([.,][0-9]+)*",
    r"[0-9]+(th|s)",
    r"([0-9]+[,\-:.])+[0-9]+",
    r"\w+-\w+",
    r"^[a-zA-Z]+[0-9]+[a-zA-Z]*$",
    r"[a-zA-Z]\.[a-zA-Z]\.",
    r"^[a-zA-Z]*'[a-zA-Z]{1,2}$",
]
#: ASCII punctuation, and what separates chunks: anything but letters and visible ASCII characters.
PUNCTUATION = r"[ -/:-@\[-`{-~]"
SEPARATOR = r"[^\p{L}!-~]+"
#: What every non-standard word has: a digit, an apostrophe or an @, or one of - . : / with something behind it. Looked for
#: in whole texts, then in chunks, before the patterns themselves.
_SUSPECT = r"[0-9'@]|[-.:/][!-~\p{L}]"
#: Base letters of U+00C0..U+017E for characters that Unicode doesn't decompose.
_BASE = dict(zip("ÆæÐðØøÞþß×÷ĐđĦħıĲĳĸĿŀŁłŉŊŋŒœŦŧ", "EeDdOoTtS*/DdHhiIikLlLlnNnOoTt"))


def diacritics() -> tuple[str, str]:
    """Characters with diacritics, U+00C0 to U+017E, and the letters that stand for them."""
    source = "".join(map(chr, range(0xC0, 0x17F)))
    return source, "".join(_BASE.get(c) or unicodedata.normalize("NFD", c)[0] for c in source)


def fold_case(col: Column, case: bool = True, strip_diacritics: bool = False) -> Column:
    col = F.translate(col, *diacritics()) if strip_diacritics else col
    return F.lower(col) if case else col


def folded(text: Column, case: bool = True, strip_diacritics: bool = False, **_) -> Column:
    """A text as tokenize() cuts it up, with the same options: every token is a stretch of it."""
    return fold_case(F.coalesce(text, F.lit("")), case, strip_diacritics)


def split_punctuation(col: Column, keep: bool = False) -> Column:
    """What is between punctuation marks; with keep=True the marks too, each by itself."""
    if keep:
        return F.regexp_extract_all(col, F.lit(f"({PUNCTUATION}|[^ -/:-@\\[-`{{-~]+)"), F.lit(1))
    return F.filter(F.split(col, PUNCTUATION), lambda x: x != "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


#: A match of these patterns that starts behind a character which it could take in starts there too, so it needs to be looked
#: for only where no such character stands in front. That makes finding all matches linear in long runs of them.
_IN_FRONT = {PATTERNS[1]: "[0-9]", PATTERNS[2]: "[a-zA-Z0-9._%+-]", PATTERNS[3]: r"[a-zA-Z0-9\-.%_]", PATTERNS[5]: "[0-9]", PATTERNS[6]: "[0-9]", PATTERNS[7]: r"\w"}


#: The same matches by loops that give nothing back, as a loop over a group may overflow the matcher's stack in long texts.
_LOOPS = {PATTERNS[4]: r"[$£€\+][0-9]++(?:[.,][0-9]++)*+", PATTERNS[6]: r"[0-9]++(?:[,\-:.][0-9]++)++"}


def _sought(pattern: str) -> str:
    front = f"(?<!{_IN_FRONT[pattern]})" if pattern in _IN_FRONT else ""
    return front + _LOOPS.get(pattern, pattern)


#: Those of PATTERNS that stand for a whole chunk or for nothing.
_WHOLE = [p for p in PATTERNS if p.startswith("^") and p.endswith("$")]


def _is_free(pattern: str) -> bool:
    """Whether a pattern's matches depend on nothing around them: no ^, $, word bounds, back references or looks around."""
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern)
    return not re.search(r"\\[bBAGzZ0-9]|\(\?[=!<]", bare) and not re.search(r"[\^$]", re.sub(r"\\.", "", bare))


def extract_words(chunk: Column, patterns: list[str], keep: bool = False) -> Column:
    """Tokens of a chunk: the first pattern that is found anywhere gives a token as it stands; what is before it is split
    at punctuation, and what is after it is a chunk anew."""
    if patterns == PATTERNS or all(map(_is_free, patterns)):
        return _in_turn(chunk, [p for p in patterns if p not in _WHOLE], [p for p in patterns if p in _WHOLE], keep)
    return _step_by_step(chunk, patterns, keep)


def _in_turn(chunk: Column, free: list[str], whole: list[str], keep: bool) -> Column:
    """A pattern that isn't found in a text isn't found in what is left of it, so each is sought once: all its matches, one
    behind the other, are tokens, and what is behind the last goes to the next pattern. The work grows with the chunk's
    length, not with its square.

    Those of PATTERNS for whole chunks come last: the patterns before them cut all that they would match in, and what the
    one behind them (letters with full stops) matches, they do not."""

    def cut(state: Column, pattern: str) -> Column:
        def taken(found: Column) -> Column:
            def parted(pieces: Column) -> Column:
                token = lambda m, i: F.concat(split_punctuation(pieces[i], keep), F.array(m))
                return F.struct(F.element_at(pieces, -1).alias("rest"), F.concat(state["toks"], F.flatten(F.transform(found, token))).alias("toks"))

            return F.when(F.size(found) == 0, state).otherwise(_let(F.split(state["rest"], _sought(pattern), -1), parted))

        return _let(F.regexp_extract_all(state["rest"], F.lit(_sought(pattern)), F.lit(0)), taken)

    def ended(state: Column) -> Column:
        is_whole = state["rest"].rlike("|".join(f"(?:{p})" for p in whole)) if whole else F.lit(False)
        return F.concat(state["toks"], F.when(is_whole, F.array(state["rest"])).otherwise(split_punctuation(state["rest"], keep)))

    def onward(state: Column, left: list[str]) -> Column:
        return _let(cut(state, left[0]), lambda s: onward(s, left[1:])) if left else ended(state)

    return _let(F.struct(chunk.alias("rest"), F.array().cast("array<string>").alias("toks")), lambda s: onward(s, free))


def _step_by_step(chunk: Column, patterns: list[str], keep: bool) -> Column:
    """One match after another, each pattern looked for in what is left: for patterns that depend on what is around them."""
    start = F.struct(chunk.alias("rest"), F.array().cast("array<string>").alias("toks"), F.lit(False).alias("done"))

    def found_by(rest: Column, pattern: str) -> Column:
        match = F.regexp_extract(rest, pattern, 0)
        return F.when(match != "", F.struct(match.alias("match"), F.regexp_instr(rest, F.lit(pattern)).alias("at")))

    first = lambda rest: F.coalesce(*(found_by(rest, p) for p in patterns))

    def step(state: Column, _: Column) -> Column:
        def cut(hit: Column) -> Column:
            match, at = hit["match"], hit["at"]
            before = F.call_function("left", state["rest"], at - 1)
            after = F.call_function("substring", state["rest"], at + F.length(match))
            found = F.struct(after.alias("rest"), F.concat(state["toks"], split_punctuation(before, keep), F.array(match)).alias("toks"), F.lit(False).alias("done"))
            ended = F.struct(state["rest"].alias("rest"), state["toks"].alias("toks"), F.lit(True).alias("done"))
            return F.when(match.isNull(), ended).otherwise(found)

        return F.when(state["done"], state).otherwise(_let(first(state["rest"]), cut))

    # each step uses up a character at least
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(chunk), F.lit(1))), start, step, lambda s: F.concat(s["toks"], split_punctuation(s["rest"], keep)))


def tokenize(text: Column, patterns: list[str] | None = PATTERNS, case: bool = True, strip_diacritics: bool = False, keep_punctuation: bool = False, drop_trailing_chunk: bool = False) -> Column:
    """The tokens of a text in order, as an array; null texts have none.

    patterns=None or [] splits at punctuation alone. drop_trailing_chunk leaves out a chunk that touches the text's end.
    """
    body = folded(text, case, strip_diacritics)
    pieces = F.split(body, SEPARATOR)
    if drop_trailing_chunk:
        pieces = F.when(F.size(pieces) > 1, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    chunks = F.filter(pieces, lambda x: x != "")
    if keep_punctuation:
        plain = F.flatten(F.transform(chunks, lambda c: split_punctuation(c, True)))
    elif drop_trailing_chunk:
        plain = F.flatten(F.transform(chunks, lambda c: split_punctuation(c)))
    else:
        plain = F.filter(F.split(body, r"[^\p{L}0-9]+"), lambda x: x != "")
    if not patterns:
        return plain
    any_of = "|".join(f"(?:{_sought(p)})" for p in patterns)

    def suspect(col: Column) -> Column:
        return col.rlike(_SUSPECT) if patterns == PATTERNS else F.lit(True)

    slow = F.flatten(F.transform(chunks, lambda c: F.when(suspect(c) & c.rlike(any_of), extract_words(c, patterns, keep_punctuation)).otherwise(split_punctuation(c, keep_punctuation))))
    return F.when(suspect(body), slow).otherwise(plain)


def base_name(path: Column) -> Column:
    """The last component of a path with / or \\."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def kgrams(term: Column, k: int) -> Column:
    """Distinct k-grams of ^term$; terms of fewer than k - 2 characters have none."""
    return F.array_distinct(kgram_bag(term, k))


def kgram_bag(term: Column, k: int) -> Column:
    """All k-grams of ^term$ in order, repeats included."""
    marked, n = F.concat(F.lit("^"), term, F.lit("$")), F.length(term) + 3 - k
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("substring", marked, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def edit_distance_within_2(a: Column, b: Column) -> Column:
    """Edit distance with insertions and deletions of cost 1 and substitutions of cost 2, if it is 2 at most, else null.

    Such a distance is |a| + |b| - 2 lcs, so its parity is that of the length difference. Equal lengths: 2 if taking one
    character from each leaves the same text.
    """
    gap, lev = F.abs(F.length(a) - F.length(b)), F.levenshtein(a, b)

    def drops(s: Column) -> Column:
        n = F.length(s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.call_function("left", s, i - 1), F.call_function("substring", s, i + 1)))).otherwise(F.array().cast("array<string>"))

    same_length = F.when(a == b, 0).when((lev <= 2) & F.arrays_overlap(drops(a), drops(b)), 2)
    return F.when(gap == 0, same_length).when((gap == 1) & (lev == 1), 1).when((gap == 2) & (lev == 2), 2)
