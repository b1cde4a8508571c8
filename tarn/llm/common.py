"""Shared helpers: text folding, split rules, tables, code for the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.shipping import ship  # noqa: F401 - for the operators
from tarn.plans.storage import stored  # noqa: F401 - for the operators
from tarn.sources.tables import dealt, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: bytes.translate table: A-Z to a-z, nothing else (UTF-8 lead and trail bytes are above 0x7F).
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A null doc_id sorts after every other one.
LAST_ID = (1 << 63) - 1
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def fold(col: Column) -> Column:
    """A-Z to lower case; all other letters stay."""
    return F.translate(col, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than [\\x20\\x09-\\x0D], A-Z lower-cased. bytes.split() has just these separators."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query."""
    small_batches(spark)
    return dealt(read_table(spark, sf_dir, name))


def small_batches(spark: SparkSession) -> None:
    """For queries and pipeline stages, which own their session: texts come to Python in batches of BATCH_ROWS rows and
    BATCH_BYTES at most, as 10,000 texts of a page or two take much memory. Operators leave settings alone."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
