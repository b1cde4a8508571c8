"""Tables in the folder that driver and executors share, to end a lineage or to keep an index."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


#: Bytes that a writer holds of a table before it puts them out.
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the context's checkpoint folder, or with a local master, where driver and
    executors are one machine, a folder of our own. A cluster without any such folder raises a RuntimeError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarn-checkpoint-"))
        base = jsc.getCheckpointDir().get()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the application ends."""
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (at path, a new_path() of the caller's, which may then be removed) and read it
    again: lineage ends there, and losing an executor loses nothing.

    zstd, as the default codec keeps buffers outside the heap that many small files add up."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """As stored(), hash-partitioned by the columns `by`: a join on all of these moves the other side alone. There are as many
    buckets as shuffle partitions. The catalog knows the table for as long as the application runs."""
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{path[-32:]}"
    df.repartition(n, *by).write.format("parquet").bucketBy(n, *by).option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).option("path", path).saveAsTable(table)
    return spark.table(table)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; the folder's owner clears it
            return


atexit.register(_clean)
