import pytest

LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(20000))
MESSY = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nA shared line of text here.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nA shared line of text here.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nA shared line of text here.", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, "   \n\n\t ", None, "b", 6),
    (None, "A text without an id stands here\n a SHARED line of text here. \nend", "en", None, 1),
    (6, "12345 %%% 777", "fr", "c", 3),
    (7, LONG, "en", "c", len(LONG)),
    (8, "x", "es", "c", 1),
    (9, "Ünïcödé ▁ text  with   gaps \x00 and 日本語", None, "d", 2),
    (10, "a SHARED line of text here.", "de", "d", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(MESSY, SCHEMA)
    for c in ("did", "th", "row", "lines", "gone", "key", "node", "fp", "own", "held", "batch", "shard", "score", "curve", "sub", "at", "h1", "n_lines", "k", "label", "weight", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def messy_rows():
    return MESSY
