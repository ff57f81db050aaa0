"""Logs in, exports out."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LABEL_TABLES = ("labels_tx", "labels_control", "labels_exempt", "labels_cluster", "exchange_agent", "label_counts")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoint folder that the context or session
    names. Only where executors are threads of the driver may it be unset, and one is made."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def read_logs(spark: SparkSession, paths: list[str], format: str = "parquet", schema: StructType | str | None = None, include: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet or (gzipped) JSON-lines files with source_file; JSON needs a schema.

    include: only files whose path holds this text. columns: only these, which Parquet prunes.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(paths) if format == "json" else reader.parquet(*paths)
    df = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("source_file"))
    return df.filter(F.col("source_file").contains(include)) if include else df


def label_counts(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(dataset, table, n): the rows of every label table that has a dataset; None without such a table."""
    parts = [df.groupBy("dataset").agg(F.count("*").alias("n")).select("dataset", F.lit(name).alias("table"), "n") for name, df in tables.items() if name in LABEL_TABLES and "dataset" in df.columns]
    return reduce(DataFrame.union, parts) if parts else None


def _files(spark: SparkSession, path: str):
    """(file system, path constructor) of a folder."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark._jsc.hadoopConfiguration()), new


def exports(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the exports published under a path, in order."""
    fs, new = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(new(path))] if fs.exists(new(path)) else []
    return sorted(int(n.removeprefix("export=")) for n in names if n.startswith("export="))


def write_export(tables: dict[str, DataFrame], path: str, notes: DataFrame | None = None, keep: int = 2) -> int:
    """Publishes every table as Parquet under its name, partitioned by dataset where it has one, with the
    counts of its labels as label_counts, the notes (dataset, name, n) as notes, and the digest trees
    of all of these as manifest; returns the export's number.

    Tables are written aside, read again and held against the digests of what was to be written; only
    then does one rename publish them all as the next export. A writer that ends half-way leaves the
    exports before it as they are. The last `keep` exports stay for readers that have opened them;
    of several writers at once one publishes a number and the others fail.
    """
    from driftspan.operators.digest import digest_tree

    extra = {"label_counts": label_counts(tables), "notes": notes}
    tables = tables | {n: t for n, t in extra.items() if t is not None}
    spark = next(iter(tables.values())).sparkSession
    fs, new = _files(spark, path)
    aside = f"{path.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    trees = [digest_tree(df, []).select(F.lit(name).alias("table"), "level", "node", "rows", "digest") for name, df in tables.items()]
    reduce(DataFrame.union, trees).write.parquet(f"{aside}/manifest")
    for name, df in tables.items():
        (df.write.partitionBy("dataset") if "dataset" in df.columns else df.write).parquet(f"{aside}/{name}")
    roots = {r["table"]: r["digest"] for r in spark.read.parquet(f"{aside}/manifest").filter("level = 0").collect()}
    for name, df in tables.items():
        root = digest_tree(spark.read.schema(df.schema).parquet(f"{aside}/{name}"), [], 0).select("digest").first()
        if (root and root["digest"]) != roots.get(name):
            fs.delete(new(aside), True)
            raise OSError(f"table {name} is not what was written; nothing is published")
    done = exports(spark, path)
    number = done[-1] + 1 if done else 0
    if fs.exists(new(f"{path}/export={number}")) or not fs.rename(new(aside), new(f"{path}/export={number}")):
        raise OSError(f"export {number} of {path} has been published by another writer")
    for old in [*done, number][: -max(keep, 1)]:
        fs.delete(new(f"{path}/export={old}"), True)
    return number


def read_export(spark: SparkSession, path: str, names: list[str], inputs_only: bool = False, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last export published under a path, or of the one with this number;
    inputs_only leaves out the labels, as a detector may see them."""
    found = exports(spark, path)
    if not found or number is not None and number not in found:
        raise FileNotFoundError(f"no export {'' if number is None else number} under {path}")
    at = f"{path}/export={found[-1] if number is None else number}"
    return {n: spark.read.parquet(f"{at}/{n}") for n in names if not (inputs_only and n in LABEL_TABLES)}
