"""State tables of a stream, written in batches and merged into levels, read by world.

Every batch writes its rows as one run of level 0. When a level has FANOUT runs they are merged
into one run of the next, so after n batches the runs are the digits of n in base FANOUT, and no
list of them is kept. A run lies in folders by the hash of the world, FANOUT times as many at each
level, so a folder holds about as much at every level; a batch reads its own worlds' folders only,
one for each run, and what it reads grows with the logarithm of the number of batches.

A batch that runs again finds the runs that it read before and writes its own anew: runs that a
merge has replaced are removed by a later batch, which starts after the merging one is committed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that make one of the next, and folders of a run of level 0.
FANOUT, FOLDERS = 4, 4
#: A batch of more worlds than this reads whole runs.
MOST_WORLDS = 20_000


def live_runs(batches: int) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold the first `batches` batches."""
    runs, start, level = [], 0, 0
    while FANOUT ** (level + 1) <= batches:
        level += 1
    while level >= 0:
        size = FANOUT**level
        while batches - start >= size:
            runs.append((level, start))
            start += size
        level -= 1
    return runs


def folder_of(world: str, level: int) -> Column:
    return F.pmod(F.xxhash64(world), F.lit(FOLDERS * FANOUT**level)).cast("int")


class Worlds:
    """The worlds of a batch, and the hashes of up to MOST_WORLDS of them; with more, hashes is None."""

    def __init__(self, rows: DataFrame, world: str = "world") -> None:
        self.frame = rows.select(world).distinct()
        found = self.frame.select(F.xxhash64(world).alias("h")).limit(MOST_WORLDS + 1).collect()
        self.hashes = [r["h"] for r in found] if len(found) <= MOST_WORLDS else None


@dataclass
class StateTable:
    """A table of rows with a column `world` under `path`."""

    spark: SparkSession
    path: str
    schema: str
    world: str = "world"
    read_paths: list[str] = field(default_factory=list)  #: what the last read() opened

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _run(self, level: int, start: int) -> str:
        return f"{self.path}/level={level}/from={start}"

    def read(self, batch: int, worlds: "Worlds | None" = None) -> DataFrame:
        """The rows that the batches before `batch` have written; those of `worlds` where given."""
        fs, new, paths = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path, []
        for level, start in live_runs(batch):
            run = self._run(level, start)
            if worlds is not None and worlds.hashes is not None:
                count = FOLDERS * FANOUT**level
                paths += [p for f in sorted({h % count for h in worlds.hashes}) if fs.exists(new(p := f"{run}/folder={f}"))]
            elif fs.exists(new(run)):
                paths.append(run)
        self.read_paths = paths
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self._open(*paths)
        return rows.join(worlds.frame, self.world, "left_semi") if worlds is not None else rows

    def bytes_read(self) -> int:
        fs, new = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        return sum(fs.getContentSummary(new(p)).getLength() for p in self.read_paths)

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _open(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _write(self, rows: DataFrame, level: int, start: int) -> None:
        rows = rows.select(*self._names(), folder_of(self.world, level).alias("folder"))
        rows.repartition("folder", self.world).write.mode("overwrite").partitionBy("folder").parquet(self._run(level, start))

    def append(self, batch: int, rows: DataFrame) -> None:
        """Writes a batch's rows, and merges every level that it fills."""
        self._remove_merged(batch)
        self._write(rows, 0, batch)
        level = 0
        while (batch + 1) % FANOUT ** (level + 1) == 0:
            size = FANOUT**level
            first = batch + 1 - size * FANOUT
            parts = [self._run(level, first + k * size) for k in range(FANOUT)]
            fs, new = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
            frames = [self._open(p) for p in parts if fs.exists(new(p))]
            level += 1
            self._write(reduce(DataFrame.union, frames), level, first)

    def _remove_merged(self, batch: int) -> None:
        """Removes the runs that the batch before this one merged."""
        fs, new, level = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path, 0
        while batch and batch % FANOUT ** (level + 1) == 0:
            size = FANOUT**level
            for k in range(FANOUT):
                fs.delete(new(self._run(level, batch - size * FANOUT + k * size)), True)
            level += 1
