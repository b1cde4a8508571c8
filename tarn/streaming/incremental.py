"""Indexing documents as they arrive: each batch becomes a partial index, partial indexes merge to one.

A batch is known by its number and overwritten when it is run again, so a restart neither loses nor repeats postings.
Partial indexes lie in folders (index_stream, merged) or in one table bucketed by term and document (BucketedIndex), whose
merge moves no posting: what a bucket holds of all batches is read by one task, and adding a batch shuffles that batch alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.index import merge_postings, postings, tokenized, whole_postings


def index_stream(docs: DataFrame, path: str, checkpoint: str, **options):
    """Starts a query that writes the postings of each micro-batch of docs (doc_id, text) below path."""

    def write(batch: DataFrame, number: int) -> None:
        postings(tokenized(batch, **options)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The index of all batches so far."""
    return merge_postings(spark.read.parquet(path).drop("part"))


@dataclass
class BucketedIndex:
    """Partial indexes in a table partitioned by batch, bucketed and sorted by term and document.

    Buckets are of term and document, not of term alone, so that a stop word's postings fall into all of them; a lookup of a
    term reads the row groups of each bucket that may hold it. The number of buckets is fixed when the table is made: take as
    many as the whole index will need tasks. The catalog knows the table by its name; whoever makes it drops it.
    """

    spark: SparkSession
    table: str

    @classmethod
    def open(cls, spark: SparkSession, table: str, path: str, buckets: int, id_type: str = "bigint") -> BucketedIndex:
        """The table, made over the folder where the catalog does not know it; batches that lie there are found again."""
        if not spark.catalog.tableExists(table):
            location = path.replace("'", "\\'")
            spark.sql(f"""CREATE TABLE {table} (term STRING, doc_id {id_type}, tf BIGINT, offsets ARRAY<INT>, doc_len INT, part BIGINT)
                USING parquet PARTITIONED BY (part) CLUSTERED BY (term, doc_id) SORTED BY (term, doc_id) INTO {int(buckets)} BUCKETS LOCATION '{location}'""")
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return cls(spark, table)

    @property
    def buckets(self) -> int:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Num Buckets'")
        return int(rows.first()["data_type"])

    def add(self, docs: DataFrame, number: int, **options) -> None:
        """Write the postings of docs (doc_id, text) as batch `number`, over what that batch held. Rows are dealt as buckets
        are, so each bucket gets one file."""
        rows = whole_postings(tokenized(docs, **options)).withColumn("offsets", F.col("offsets").cast("array<int>"))
        dealt = rows.select("term", "doc_id", "tf", "offsets", "doc_len").repartition(self.buckets, "term", "doc_id")
        view = f"{self.table.replace('.', '_')}_batch_{int(number)}"
        dealt.createOrReplaceTempView(view)
        try:
            docs.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (part = {int(number)}) SELECT * FROM {view}")
        finally:
            docs.sparkSession.catalog.dropTempView(view)

    def stream(self, docs: DataFrame, checkpoint: str, **options):
        """Starts a query that adds each micro-batch of docs."""
        return docs.writeStream.foreachBatch(lambda batch, number: self.add(batch, number, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merged(self) -> DataFrame:
        """The index of all batches so far, without a shuffle."""
        return merge_postings(self.spark.table(self.table).drop("part"))
