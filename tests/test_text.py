import os

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import base_name, diacritics, edit_distance_within_2, kgram_bag, kgrams, tokenize

#: A text and its expected tokens, one a line: TARN_GOLDEN="text path:tokens path".
GOLDEN = os.environ.get("TARN_GOLDEN", "")


def one(spark, text, **options):
    return spark.createDataFrame([(text,)], "text string").select(tokenize(F.col("text"), **options)).first()[0]


@pytest.mark.skipif(not GOLDEN, reason="no golden file named")
def test_golden(spark):
    text, tokens = GOLDEN.split(":")
    want = [t.strip() for t in open(tokens, encoding="utf-8") if t.strip()]
    assert one(spark, open(text, encoding="utf-8", newline="").read()) == want


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("well-known/24/7", ["well", "known", "24/7"]),
        ("10something", ["10s", "omething"]),
        ("http://x.y/z,", ["http://x.y/z,"]),
        ("£5", ["5"]),
        ("England's A.D. 'em 4th $80", ["england's", "a.d.", "'em", "4th", "$80"]),
        ("cake.ppt jb21@williams.edu 7,919,900", ["cake.ppt", "jb21@williams.edu", "7,919,900"]),
        ("", []),
        (None, []),
        ("...", []),
        ("last", ["last"]),
    ],
)
def test_patterns(spark, text, tokens):
    assert one(spark, text) == tokens


def test_options(spark):
    assert one(spark, "a, b", patterns=None, keep_punctuation=True) == ["a", ",", "b"]
    assert one(spark, "Ärger ŁÓDŹ Žofín", patterns=None, strip_diacritics=True) == ["arger", "lodz", "zofin"]
    assert one(spark, "one two", patterns=None, drop_trailing_chunk=True) == ["one"]
    assert one(spark, "one", patterns=None, drop_trailing_chunk=True) == []
    assert one(spark, "One", case=False) == ["One"]


def test_tables():
    source, target = diacritics()
    assert len(source) == len(target) == 191
    assert target[source.index("Đ")] == "D" and target[source.index("Š")] == "S" and target[source.index("ž")] == "z"


def test_kgrams_and_distance(spark):
    row = spark.range(1).select(kgram_bag(F.lit("aaaa"), 2).alias("bag"), kgrams(F.lit("aaa"), 2).alias("set"), kgrams(F.lit(""), 4).alias("none"), base_name(F.lit("a\\b/c.txt")).alias("base")).first()
    assert row["bag"] == ["^a", "aa", "aa", "aa", "a$"] and row["set"] == ["^a", "aa", "a$"] and row["none"] == [] and row["base"] == "c.txt"
    pairs = [("ab", "ba", 2), ("abc", "bcd", 2), ("abc", "abd", 2), ("abc", "abcde", 2), ("abc", "xyz", None), ("abc", "abc", 0), ("abc", "abcd", 1), ("", "ab", 2), ("", "", 0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(edit_distance_within_2(F.col("a"), F.col("b"))).collect()] == [d for *_, d in pairs]
