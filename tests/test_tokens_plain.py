"""The tokenizer against plain Python that looks for one match after another."""

import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from tarn.functions import text
from tarn.functions.text import PATTERNS, extract_words, tokenize
from tarn.sources import files


def plain_chunk(chunk, patterns):
    out, compiled = [], [re.compile(p, re.ASCII) for p in patterns]
    split = lambda x: [t for t in re.split(r"[ -/:-@\[-`{-~]", x) if t]
    while True:
        m = next((m for c in compiled if (m := c.search(chunk)) and m.group()), None)
        if not m:
            return out + split(chunk)
        out += split(chunk[: m.start()]) + [m.group()]
        chunk = chunk[m.end() :]


def plain_tokens(body, patterns=PATTERNS):
    chunks = re.split(r"(?:[^!-~\w]|(?![!-~])[\d_])+", body.lower())
    return [t for c in chunks if c for t in plain_chunk(c, patterns)]


def spark_tokens(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r[1] for r in sorted(df.select("i", tokenize(F.col("text"), **options)).collect())]


def test_own_golden(spark):
    body = (Path(__file__).parent / "data_golden.txt").read_text(encoding="utf-8")
    (got,) = spark_tokens(spark, [body])
    assert got == plain_tokens(body)
    for token in ("24/7", "4th", "1980s", "7,919,900", "http://example.org/a?b=c,", "england's", "a.d.", "'em", "$80", "+13015550100", "n10", "cake.ppt", "112313.doc", "2.4.1-7:30", "212718-xxxx", "jb21@williams.edu"):
        assert token in got


def test_random_chunks(spark):
    rng = random.Random(3)
    bits = ["ab", "x", "12", "7", "-", ".", "/", ",", ":", "@", "'", "$", "+", "_", "%", "doc", "docx", "th", "s", "https://", "com", "é", "a.b.", "(", "<"]
    chunks = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)]
    assert spark_tokens(spark, chunks) == [plain_tokens(c) for c in chunks]


def test_other_patterns(spark):
    rng = random.Random(4)
    chunks = ["".join(rng.choices(["ab", "1", "x", "-", "."], k=rng.randint(1, 10))) for _ in range(300)]
    for patterns in ([r"\d+", r"[a-z]+-[a-z]+"], [r"^[a-z]+1x$", r"\d+"], [r"^ab", "x$"], [r"(?<=a)b", r"\bx"]):
        assert spark_tokens(spark, chunks, patterns=patterns) == [plain_tokens(c, patterns) for c in chunks]
    assert [text._is_free(p) for p in ("[^a]+", r"\$x\^", r"\w$", "^a", r"a\b", "(?=a)", r"(?:a|b)+", r"[\]^]x")] == [True, True, False, False, False, False, True, True]


def test_long_chunks_take_time_in_proportion(spark):
    """A chunk of 100,000 characters, of each kind that had to be looked through again for each token or digit."""
    for bit in ("ab-cd/", "1", "a", "12,", "a.", "x@", "'"):
        seconds = []
        for n in (25_000, 100_000):
            chunk = bit * (n // len(bit))
            df = spark.createDataFrame([(chunk,)], "text string").select(F.size(extract_words(F.col("text"), PATTERNS)).alias("n"))
            began = time.time()
            count = df.first()["n"]
            seconds.append(time.time() - began)
            few = bit * 40  # plain search takes the square of a chunk's length
            per = len(plain_chunk(few, PATTERNS))
            assert count == (per if per <= 1 else per * len(chunk) // len(few))
        assert seconds[1] < 12 * seconds[0] + 1 and seconds[1] < 10


def test_links_are_numbered_by_first_appearance(spark, tmp_path):
    rng = random.Random(8)
    lines = [f"n{rng.randrange(300)};" + ",".join(f"n{rng.randrange(900)}" for _ in range(rng.randint(0, 6))) for _ in range(2500)] + ["no links here", " a b ; c ,c", "z;"]
    (tmp_path / "links.txt").write_text("\n".join(lines) + "\n")
    number, want = {}, set()
    for line in lines:
        name, sep, outs = line.partition(";")
        if sep:
            src = number.setdefault(name.strip(), len(number))
            want |= {(src, number.setdefault(o.strip(), len(number))) for o in outs.split(",") if o.strip()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        links, nodes = files.read_numbered_links(spark, str(tmp_path / "links.txt"))
        assert spark.read.text(str(tmp_path / "links.txt")).rdd.getNumPartitions() > 4
        assert {r["name"]: r["node"] for r in nodes.collect()} == number
        got = [(r["src"], r["dst"]) for r in links.collect()]
        assert set(got) == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
