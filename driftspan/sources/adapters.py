"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conversations of one world. A world's agents only read each other.
WORLD_SIZE = 32


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns (world, agent, pos, role, text): each conversation is an agent of its world."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(F.expr(f"conv_id div {WORLD_SIZE}").alias("world"), F.col("conv_id").alias("agent"), F.col("turn").alias("pos"), "role", "text")


TURNS_SQL = f"turns as (select conv_id // {WORLD_SIZE} as world, conv_id as agent, turn as pos, role, text from conversations)"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accesses (id, agent, at, resource, op, rejected) from events: signups and purchases write."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.get_json_object("props", "$.k").alias("resource"),
        F.when(F.col("event_type").isin("signup", "purchase"), "write").otherwise("read").alias("op"), ((F.col("event_id") % 17) == 0).alias("rejected"), "event_type",
    )


ACCESS_SQL = """accesses as (select event_id as id, user_id as agent, epoch_us(ts) as tm, json_extract_string(props, '$.k') as resource,
    case when event_type in ('signup', 'purchase') then 'write' else 'read' end as op, event_id % 17 = 0 as rejected, event_type from events)"""
