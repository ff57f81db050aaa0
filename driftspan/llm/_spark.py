"""Small Spark helpers of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a task hands to its Python worker, and Spark's own value.
BATCH_SETTING, BATCH_BYTES, SPARKS_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limits the session's Arrow batches by bytes, unless it has set a limit already.

    A worker holds a batch of long texts several times over, next to a heap of most of the memory.
    """
    if spark.conf.get(BATCH_SETTING, SPARKS_BYTES) == SPARKS_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so lost executors cost no recomputation.

    The folder is the one set on the context, or else spark.checkpoint.dir; only a session whose
    executors are threads of the driver (tests) may do without, and gets one of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; a ValueError on a cluster that names none."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(key: str, buckets: int, remainder: int):
    """True where crc32 of the key's text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % buckets == remainder, F.lit(False))
