"""Reads paired with the latest earlier write of their resource, over a stream in event time.

Spark's watermark says up to which time a stream is complete. Each resource keeps the latest
accepted write up to there and the rows after it; a timer at its earliest waiting row lets it settle
rows once the watermark has passed them, so pairs come out while the stream runs and a resource
without waiting rows keeps one write. A row that comes after the watermark has passed it is late:
Spark drops those behind the watermark of the batch before (and counts them in its progress), the
others come out as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = ("id", "agent", "at", "op", "rejected")
WAITING = "id long, agent long, at long, op string, rejected boolean"
ACCESS = "id long, agent long, at long, resource string, op string, rejected boolean"
WRITE = "id long, agent long, at long"
OUT = "kind string, read_id long, write_id long, resource string, reader long, writer long, cross_day boolean"
DAY = 86_400_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PairWithLatestWrite(StatefulProcessor):
    """Per resource: value `last`, the latest settled write; list `waiting`, the rows after the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", WRITE)
        self._waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        earliest, late = None, []
        for frame in rows:
            new = [tuple(r) for r in frame[list(ROW)].itertuples(index=False, name=None)]
            late += [("rejected", r[0], None, key[0], r[1], None, None) for r in new if r[2] < passed]
            keep = [(int(i), int(a), int(t), o, bool(x)) for i, a, t, o, x in new if t >= passed]
            if keep:
                self._waiting.appendList(keep)
                earliest = min([r[2] for r in keep] + ([earliest] if earliest is not None else []))
        if earliest is not None and all(t > earliest // 1000 + 1 for t in self._handle.listTimers()):
            self._handle.registerTimer(earliest // 1000 + 1)
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r[2], r[1], r[0], r[3], r[4]) for r in (self._waiting.get() if self._waiting.exists() else ()))
        ready = [r for r in rows if r[0] < passed]
        if ready:
            last, out = self._last.get() if self._last.exists() else None, []
            for at, agent, i, op, rejected in ready:
                if op == "read" and last is not None and last[1] != agent:
                    out.append(("pair", i, last[0], key[0], agent, last[1], at // DAY != last[2] // DAY))
                elif op == "write" and not rejected:
                    last = (i, agent, at)
            if last is not None:
                self._last.update(last)
            left = [(i, agent, at, op, rejected) for at, agent, i, op, rejected in rows[len(ready) :]]
            if left:
                self._waiting.put(left)
                self._handle.registerTimer(left[0][2] // 1000 + 1)  # later than the one that has expired
            else:
                self._waiting.clear()
            yield _frame(out)
        else:
            yield _frame([])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = {"read_id": "Int64", "write_id": "Int64", "reader": "Int64", "writer": "Int64", "cross_day": "boolean"}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def paired(accesses: DataFrame, delay: str) -> DataFrame:
    """A streaming table (kind, read_id, write_id, resource, reader, writer, cross_day): pairs, and
    late rows as kind rejected, with their id and agent as read_id and reader.

    accesses: a stream of id, agent, at (microseconds), resource, op, rejected; rows may come
    `delay` (an interval) out of order of time. Rows without a resource, agent or time have no part.
    """
    rows = accesses.filter("resource is not null and agent is not null and at is not null and id is not null").select(*ROW, "resource", F.timestamp_micros("at").alias("time"))
    rows = rows.withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    return rows.withWatermark("time", delay).groupBy("resource").transformWithStateInPandas(PairWithLatestWrite(), OUT, "Append", "EventTime")


def pairs_stream(accesses: DataFrame, out: str, delay: str):
    """A running query that writes paired(...) to out/pairs; it ends when what is there has been read."""
    spark: SparkSession = accesses.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # the state store that keyed state with timers needs
    writer = paired(accesses, delay).writeStream.format("parquet").option("path", f"{out}/pairs").option("checkpointLocation", f"{out}/checkpoint")
    return writer.outputMode("append").trigger(availableNow=True).start()


def pairs_of(spark: SparkSession, out: str, kind: str = "pair") -> DataFrame:
    """What a stream has written so far: pairs, or the rows it rejected."""
    rows = spark.read.schema(OUT).parquet(f"{out}/pairs").filter(F.col("kind") == kind)
    return rows.drop("kind") if kind == "pair" else rows.select("read_id", "resource", "reader")
