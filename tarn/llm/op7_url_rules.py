"""URL filter. Pattern rules are indexed by their rarest literal token; a URL's tokens fetch candidate rules, and
only those run their regular expressions. DataFrame functions only.

Scale: each url is judged in its own row, so that no url is hot and no row is shuffled. The rules come from the driver,
where their number is known; their index is a hash table that is sent along as a constant, MAX_RULES rules at a time.
Before that, one pass counts the rules' literal tokens, combined map-side.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import LOWER, UPPER, fold, table

MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """action for what `pattern` finds in host + path; `tokens` are whole tokens that each match must contain."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    kind: int  # 0: host and path rule, 1: pattern rule of the method


def ascii_lower(text: str) -> str:
    return text.translate({ord(a): b for a, b in zip(UPPER, LOWER)})


def host_path_rule(action: str, rule: str) -> Rule:
    """`example.net/en/`: the host and its subdomains, where the path starts with /en/."""
    host, _, path = rule.partition("/")
    host = ascii_lower(host)
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    # the path's last token may go on in a url unless a separator ends it
    whole = re.split(r"[^a-z0-9]+", host) + re.split(r"[^a-z0-9]+", ascii_lower(path))[: None if not path or not path[-1].isalnum() else -1]
    return Rule(rule, action, pattern, tuple(dict.fromkeys(t for t in whole if t)), 0)


def word_rule(action: str, word: str) -> Rule:
    """A hyphenated or plain word that stands by itself in host or path."""
    pattern = rf"(?i)(?:^|[^A-Za-z0-9]){re.escape(word)}(?:$|[^A-Za-z0-9])"
    return Rule(word, action, pattern, tuple(t for t in re.split(r"[^a-z0-9]+", ascii_lower(word)) if t), 1)


#: The rules of the query.
HOST_RULES = [host_path_rule("block", "net/"), host_path_rule("allow", "example.net/en/"), host_path_rule("block", "example.com/de/"), host_path_rule("allow", "org/fr/")]
#: Where no host rule fits, the method's own patterns decide; without a match a url is allowed.
WORD_RULES = [word_rule("block", w) for w in ("cheap-pills", "spam-farm", "casino", "porn", "malware")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """host, path as the contract defines them; both empty for null or where :// is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = fold(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(fold(subject), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """Each rule's token that the fewest urls hold (ties: the first by name); '' for rules without a literal."""
    spark = urls.sparkSession
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {r: "" for r in rules}
    index = spark.createDataFrame([(t,) for t in known], "token string")
    hit = urls.select(F.explode(url_tokens(F.col("subject"))).alias("token")).join(F.broadcast(index) if len(known) <= MAX_RULES else index, "token")
    seen = {r["token"]: r["n"] for r in hit.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (seen.get(t, 0), t), default="") for r in rules}


def best_match(rules: list[Rule], chosen: dict[Rule, str], subject: Column, kind: int) -> Column:
    """size, name, action of the longest rule of a kind that matches (ties: the last by name); null if there is none. The
    subject's tokens fetch rules from a hash table of arrays, and those run their expressions."""
    best = []
    for at in range(0, len(rules), MAX_RULES):
        own = [r for r in rules[at : at + MAX_RULES] if r.kind == kind]
        if not own:
            continue
        spark, slots = SparkSession.active(), 2 * len(own)
        tokens = sorted({chosen[r] for r in own})
        hashed = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(slots)).alias("h")).collect()
        place, index = {r["t"]: r["h"] for r in hashed}, [[] for _ in range(slots)]
        for r in own:
            index[place[chosen[r]]].append({"token": chosen[r], "size": len(r.name), "name": r.name, "action": r.action, "regex": r.pattern})
        table = F.from_json(F.lit(json.dumps(index)), "array<array<struct<token:string,size:int,name:string,action:string,regex:string>>>")
        asked = F.array_union(url_tokens(subject), F.array(F.lit(""))) if "" in tokens else url_tokens(subject)
        fetched = F.flatten(F.transform(asked, lambda t: F.filter(F.element_at(table, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int") + 1), lambda r: r["token"] == t)))
        fits = F.filter(fetched, lambda r: F.regexp_like(subject, r["regex"]))
        best.append(F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["action"].alias("action")))))
    none = F.lit(None).cast("struct<size:int,name:string,action:string>")
    return F.when(subject != "", F.greatest(*best, none) if best else none)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """Returns id, host, path, rule (the longest host rule that fits, else null), verdict, pattern (the longest
    pattern rule that matched, else null); one row for each input row. Of equally long rules the last by name is taken.

    Null urls and urls without :// have empty parts, no rule, and the default verdict. Urls of any length are judged whole.
    Repeated rows are each judged; other columns are left out. An empty table gives an empty result.
    """
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).select(id_col, host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    chosen = rarest_tokens(rows.select(subject.alias("subject")), rules)
    found = rows.select("*", *(best_match(rules, chosen, subject, k).alias(f"best{k}") for k in (0, 1)))
    return found.select(
        id_col,
        "host",
        "path",
        F.col("best0.name").alias("rule"),
        F.coalesce("best0.action", "best1.action", F.lit(default)).alias("verdict"),
        F.col("best1.name").alias("pattern"),
    )


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same verdicts in SQL, by testing every rule on every url."""

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    ordered = sorted(HOST_RULES, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN {fits(r.name)} THEN '{r.name}'" for r in ordered) + " END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){r.name}($|[^a-z0-9])') THEN '{r.name}'" for r in sorted(WORD_RULES, key=lambda r: (-len(r.name), r.name), reverse=False)) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in ordered) + " ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT page_id, host, path, {rule} AS rule, {pattern} AS pattern FROM p)
SELECT page_id, host, path, rule, {action} AS verdict, pattern FROM m
"""


ORACLE = _oracle()
