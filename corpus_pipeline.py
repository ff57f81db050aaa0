"""Corpus pipeline: language, near duplicates, benchmark passages, packing.

Each stage takes the documents its predecessor kept and returns those that it keeps, with the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm import decontaminate, jaccard, langid, packing
from driftspan.llm._spark import bounded_batches, checkpointed, shared_folder
from driftspan.llm.entry import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Folders that stages have made and that nothing has removed yet.
made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    made.append(f"{shared_folder(bounded_batches(spark)).rstrip('/')}/pipeline-{uuid.uuid4().hex}")
    return made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them; lang of the rest becomes the predicted one.

    Learned from the documents' own labels. The score does not decide: it sets the label's whole
    prior against tempered evidence, so that it is low for short texts of a rare label. Where no
    document has a label, those with letters stay as und.
    """
    bounded_batches(spark)
    model = langid.train(docs, "text", "lang")
    found = langid.predict(docs, model, keep=[F.col("text"), F.col("source"), F.col("n_chars")])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) | F.col("text").rlike("\\p{L}")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: 5-word shingles, Jaccard of 0.8 or more.

    It is the row with the smallest id, null ids last, and of several with that id any one. Rows
    are told apart by a written number, so neither null nor repeated ids matter otherwise. Texts
    without words are in no group and stay.
    """
    at = f"{scratch(spark)}/rows"
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")).write.option("compression", "zstd").parquet(at)
    rows = spark.read.parquet(at)
    groups = jaccard.jaccard_groups(rows, "row", n=5, num=80, den=100).select("row", "component_id").join(rows.select("row", "doc_id"), "row")
    groups = checkpointed(groups)
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select("least.row")
    dropped = checkpointed(groups.select("row").join(kept, "row", "left_anti"))
    if dropped.count() <= jaccard.BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold 10 words in a row of a benchmark item, whatever their ids."""
    bounded_batches(spark)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, keep=COLUMNS)
    return found.filter("n_hit = 0").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, ids=False)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: SQL has neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage is written before the next reads it.

    When a stage's output stands, its input and what it wrote on the way are removed, so only the
    last stage's rows are left.
    """
    base = scratch(spark)
    made.remove(base)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        before, at = len(made), f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        for folder in [*made[before:], *([last] if last else [])]:
            remove(spark, folder)
        del made[before:]
        docs, last = spark.read.parquet(at), at
    return docs
