"""Queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.operators import detect as D
from driftspan.sources.adapters import ACCESS_SQL, access_log
from driftspan.sources.io import checkpointed, shared_folder
from driftspan.streaming import online, pairing

from .detect_queries import TOOL_MATCHES_SQL, tool_turns
from .registry import query

#: Events come up to JITTER out of order of time, in FILES files; the stream waits DELAY for them.
FILES, JITTER, DELAY = 6, 3_600_000_000, "2 hours"
_SHIFT = f"(id * 7919 % 3600) * {JITTER // 3600}"
_FILE = f"least({FILES - 1}, ({{t}} + {_SHIFT} - lo) * {FILES} {{div}} (hi - lo + 1))"


def _arriving(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The accesses as files that come one after the other, in order of a time up to JITTER off;
    every 101st is held back to the last file, and a last row an age later says that all has come."""
    rows = access_log(spark, sf_dir).drop("event_type")
    ends = rows.agg(F.expr(f"min(at + {_SHIFT}) as lo"), F.expr(f"max(at + {_SHIFT}) as hi"))
    dealt = rows.join(F.broadcast(ends), F.lit(True)).withColumn("file", F.expr(f"case when id % 101 = 0 then {FILES - 1} else {_FILE.format(t='at', div='div')} end")).drop("lo", "hi")  # one row of ends
    dealt.write.partitionBy("file").parquet(f"{folder}/dealt")
    kept = spark.read.parquet(f"{folder}/dealt")
    for k in range(FILES):
        kept.filter(F.col("file") == k).select("id", "agent", "at", "resource", "op", "rejected").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    close = kept.agg(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("agent"), (F.max("at") + 86_400_000_000).alias("at"), F.lit("end of stream").alias("resource"), F.lit("end").alias("op"), F.lit(False).alias("rejected"))
    close.write.mode("append").parquet(f"{folder}/in")


@query(f"""with {ACCESS_SQL}, n as (select min(tm + {_SHIFT}) lo, max(tm + {_SHIFT}) hi from accesses), d as (select x.*, case when id % 101 = 0 then {FILES - 1} else {_FILE.format(t='tm', div='//')} end file from accesses x, n),
    m as (select max(tm) // 1000 * 1000 - 7200000000 mark from d where file < {FILES - 1}), ok as (select d.* from d, m where file < {FILES - 1} or tm >= mark),
    lw as (select *, last_value(case when op = 'write' and not rejected then id end ignore nulls) over (partition by resource order by tm, agent, id rows between unbounded preceding and 1 preceding) wid from ok where resource is not null)
    select 'pair' as kind, r.id read_id, w.id write_id, r.resource, r.agent reader, w.agent writer, r.tm // 86400000000 <> w.tm // 86400000000 cross_day from lw r join ok w on w.id = r.wid where r.op = 'read' and w.agent <> r.agent""")
def pairs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs come from the stream, written as its watermark moves; late rows have no part."""
    base = f"{shared_folder(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    _arriving(spark, sf_dir, base)
    stream = spark.readStream.schema(pairing.ACCESS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    pairing.pairs_stream(stream, f"{base}/out", DELAY).awaitTermination()
    return pairing.pairs_of(spark, f"{base}/out").select(F.lit("pair").alias("kind"), "*")


#: The batches of the detector's stream, by exchange.
ARRIVALS = ("ex <= 1", "ex = 2", "ex = 3", "ex between 4 and 5", "ex between 6 and 9", "ex between 10 and 199", "ex >= 200")


@query(f"with {TOOL_MATCHES_SQL} select * exclude (reread) from rr where not reread")
def detect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector over conversations with tool results that arrive in seven batches, one at a time."""
    base = f"{shared_folder(spark).rstrip('/')}/detect-{uuid.uuid4().hex}"
    turns, calls = tool_turns(spark, sf_dir)
    parts = D.parts_in_order(turns).withColumns({"tool": F.lit(None).cast("string"), "args": F.lit(None).cast("string")})
    first = parts.filter("kind = 'w'").groupBy("world", "agent").agg(F.min(F.struct("ex", "step")).alias("at"))
    asked = calls.join(first, ["world", "agent"]).select("world", "agent", "at.ex", "at.step", F.lit("c").alias("kind"), "pos", F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text"), "call_id", "tool", "args")
    named = [F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], online.PARTS).schema]
    parts = checkpointed(parts.unionByName(asked).select(*named))
    for arrived in ARRIVALS:
        parts.filter(arrived).write.mode("append").parquet(f"{base}/in")
        online.detect_stream(spark, f"{base}/in", f"{base}/out").awaitTermination()
    return online.matches_of(spark, f"{base}/out")
