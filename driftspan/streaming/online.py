"""The detector over growing tables.

A batch reads what earlier batches left of its own worlds (texts, spans, calls, deliveries), and writes its own under its number, so a batch that runs again replaces what it wrote.
The state is kept in levels (levels.py), so what a batch reads does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.operators import detect as D
from driftspan.sources.io import checkpointed
from driftspan.streaming.levels import StateTable, Worlds

#: What a stream of parts has: reads (kind r), writes (w) and tool calls (c, with the step of the write they belong to).
PARTS = "world long, agent long, ex long, step long, kind string, pos long, role string, text string, call_id string, tool string, args string"
STATE = {
    "texts": "world long, agent long, step long, at int, folded string",
    "spans": "world long, sagent long, sstep long, sat int, s int, e int, piece string, said array<struct<a:int,text:string>>, sender_ex long, sender_pos long",
    "calls": "world long, agent long, pos long, call_id string, tool string, args string",
    "delivered": "world long, sender long, sender_ex long, sender_pos long, rs int, re int, reader long, route string, first long",
    "steps": "world long, last long",
}
DELIVERY = ("world", "sender", "sender_ex", "sender_pos", "rs", "re", "reader", "route")


def detect_batch(parts: DataFrame, state: dict[str, DataFrame], k: int = T.K, min_word_chars: int = 20, max_postings: int = D.MAX_POSTINGS, min_decoded: int = 16) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(matches, rows that the state gains) of the next parts of every world in order of step.

    matches: as detect(), with reread, and class two_string_levels where only that explains a hit.
    """
    parts = parts.withColumn("step", F.col("step").cast("long"))
    calls = parts.filter("kind = 'c'").select("world", "agent", "pos", "call_id", "tool", "args")
    parts = parts.filter("kind in ('r', 'w')")
    pieces = checkpointed(D.folded_pieces(D.cut_pieces(parts, min_decoded)))
    own = pieces.select("world", "agent", "step", "kind", "at", "folded").filter("kind <> 'd'")
    writers = own.filter("kind = 'w'").select("world", "agent").distinct()
    had = state["texts"].join(writers, ["world", "agent"], "left_semi").withColumn("kind", F.lit("r"))  # read or written, it was there before
    spans = D.spans_of(D.seen_runs(own.unionByName(had), k), pieces, k, k, min_word_chars)
    wrote = parts.filter("kind = 'w'").select("world", F.col("step").alias("sstep"), F.col("ex").cast("long").alias("sender_ex"), F.col("pos").cast("long").alias("sender_pos"))
    spans = checkpointed(spans.join(wrote, ["world", "sstep"]))
    known = state["spans"].unionByName(spans)
    readers = pieces.filter("kind <> 'w'").select("world").distinct()
    runs = checkpointed(D.shared_runs(D.texts_read(pieces), D.texts_posted(known.join(readers, "world", "left_semi")), k, k, max_postings))
    found = D.routed(D.explained(runs, pieces, known, k, min_word_chars), parts, state["calls"].unionByName(calls))
    found = found.join(known.select("world", *D.SPAN, "sender_ex", "sender_pos").distinct().hint("merge"), ["world", *D.SPAN]).withColumnRenamed("agent", "reader").withColumnRenamed("sagent", "sender")
    found = checkpointed(found)
    near = found.filter("class <> 'two_string_levels' and startswith(route, 'channel:')")
    here = near.groupBy(*DELIVERY).agg(F.min("reader_ex").cast("long").alias("first"))
    new = here.join(state["delivered"].select(*DELIVERY), list(DELIVERY), "left_anti")
    first_read = here.union(state["delivered"].select(*here.columns)).groupBy(*DELIVERY).agg(F.min("first").alias("first"))
    matches = found.join(first_read, list(DELIVERY), "left").withColumn("reread", F.coalesce(F.col("reader_ex") > F.col("first"), F.lit(False)))
    matches = matches.select("world", "reader", "reader_ex", "read_pos", "a", "b", "class", "carrier", "route", "sender", "sender_ex", "sender_pos", F.col("rs").alias("s"), F.col("re").alias("e"), "reread")
    return matches, {"texts": own.drop("kind"), "spans": spans, "calls": calls, "delivered": new, "steps": parts.groupBy("world").agg(F.max("step").alias("last"))}


def state_tables(spark: SparkSession, out: str) -> dict[str, StateTable]:
    return {name: StateTable(spark, f"{out}/state/{name}", schema) for name, schema in STATE.items()}


def detect_stream(spark: SparkSession, parts_path: str, out: str, **options):
    """A query that writes out/matches and out/rejected as files of PARTS arrive; it ends when what is
    there has been read, in one batch, and goes on from there when started again.

    The files of a batch must not split an exchange, and batches come in order of step; parts at or
    before the last step seen of their world go to rejected. options: as detect_batch().
    """

    def step(df: DataFrame, batch: int) -> None:
        df = df.persist()
        tables, worlds = state_tables(spark, out), Worlds(df)
        state = {name: t.read(batch, worlds) for name, t in tables.items()}
        last = state["steps"].groupBy("world").agg(F.max("last").alias("last"))
        rows = df.join(last, "world", "left")
        matches, gained = detect_batch(rows.filter("last is null or step > last").drop("last"), state, **options)
        rows.filter("step <= last").drop("last").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch}")
        matches.write.mode("overwrite").parquet(f"{out}/matches/batch={batch}")
        for name, rows in gained.items():
            tables[name].append(batch, rows)
        df.unpersist()

    stream = spark.readStream.schema(PARTS).parquet(parts_path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def matches_of(spark: SparkSession, out: str) -> DataFrame:
    """The matches so far, as of detect(): in reach, and not read again."""
    return spark.read.parquet(f"{out}/matches").drop("batch").filter("class <> 'two_string_levels' and not reread").drop("reread")
