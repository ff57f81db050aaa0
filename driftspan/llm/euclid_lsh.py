"""Near-duplicate vectors by p-stable hashing: quantised random projections, then exact cosines.

Vectors become unit vectors; equal ones with one label are one class from there on. In each of
several tables a class has a bucket, the integer parts of a few random projections over a bucket
width. A bucket's rows are dealt into blocks, and blocks meet in pairs, so a large bucket is many
tasks and its pairs are never rows. Two classes that share buckets of several tables are compared
in the first only. A meeting gives counts and a spanning set of links.

For unit vectors at distance r one projection of width w agrees with probability
p(r) = 1 - 2 N(-w/r) - 2 / (sqrt(2 pi) w/r) (1 - exp(-(w/r)**2 / 2)); TABLES tables of PROJECTIONS
each find a pair with probability 1 - (1 - p**PROJECTIONS)**TABLES. At a cosine of 0.93
(r = 0.374), w = 1, 4 projections and 24 tables that is 0.998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed
from .components import components

TABLES, PROJECTIONS, WIDTH, SEED = 24, 4, 1.0, 7
BLOCK_ROWS, PAIRS_AT_ONCE = 512, 16_384


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Double-precision vectors; None for null, empty, zero, non-finite or holding nulls."""
    out = []
    for i in range(len(column)):
        v = column[i].values
        if v is None or v.null_count or not len(v):
            out.append(None)
            continue
        v = pc.cast(v, pa.float64()).to_numpy(zero_copy_only=False)
        ok = np.isfinite(v).all() and (top := np.abs(v).max()) > 0
        out.append((v / top) / np.linalg.norm(v / top) if ok else None)
    return out


def _projections(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, size])
    return r.standard_normal((size, tables * projections)) / width, r.random(tables * projections)


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, tables: int, projections: int, width: float) -> DataFrame:
    """(id, label, key, unit, buckets): key is equal for equal vectors of one label, null for unusable ones."""

    def run(batches):
        for batch in batches:
            keys, units, buckets = [], [], []
            for v, label in zip(_vectors(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if v is None or label is None:
                    keys.append(None)
                    units.append(None)
                    buckets.append(None)
                    continue
                cells = _cells(v[None], tables, projections, width)
                keys.append(f"{label}".encode() + b"|" + v.tobytes())
                units.append(v.tobytes())
                buckets.append(cells.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(buckets, pa.binary())], names=["id", "label", "key", "unit", "buckets"])

    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    return picked.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, label string, key binary, unit binary, buckets binary").withColumn("key", F.sha2("key", 256))


def _cells(units: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """The bucket of each unit vector in each table. Row by row, so that a vector's buckets never depend on its neighbours."""
    directions, shifts = _projections(units.shape[1], tables, projections, width)
    return np.stack([np.floor(v @ directions + shifts) for v in units]).astype(np.int64).reshape(-1, tables, projections)


def _meet(rows: list[tuple], least: float, tables: int, projections: int, width: float, table: int) -> tuple[list, list]:
    """(counts (rep, linked vectors), links (u, v)) of one meeting; rows are (side, rep, copies, unit)."""
    side = np.array([r[0] for r in rows])
    reps, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    units = np.stack([np.frombuffer(r[3], "<f8") for r in rows])
    cells = _cells(units, tables, projections, width)
    two = bool(side.any())
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(rows)),) * 2
    if not len(a) or not len(b):
        return [], []
    close = units[a] @ units[b].T >= least - 1e-9
    if not two:
        close &= np.arange(len(a))[:, None] < np.arange(len(b))
    i, j = np.nonzero(close)
    i, j = a[i], b[j]
    good = np.zeros(len(i), bool)
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        x, y = i[lo : lo + PAIRS_AT_ONCE], j[lo : lo + PAIRS_AT_ONCE]
        same = (cells[x, : table + 1] == cells[y, : table + 1]).all(2)
        # exact cosines; a pair that an earlier table brings together is counted there
        good[lo : lo + PAIRS_AT_ONCE] = (np.einsum("ij,ij->i", units[x], units[y]) >= least) & same[:, table] & ~same[:, :table].any(1)
    i, j = i[good], j[good]
    counts = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    links = [(int(reps[x]), int(reps[r])) for x in range(len(rows)) if (r := find(x)) != x]
    return [(int(reps[k]), int(counts[k])) for k in np.flatnonzero(counts)], links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length whose cosine is at least `least` in double
    precision are linked when a table finds them; none below is linked. component_id is the
    smallest id reachable by links. Null, empty, zero and non-finite vectors, those that hold
    nulls, and rows with a null label link with nothing. Repeated rows are vectors of their own; a
    null id is in no component unless an equal vector has an id. Ids are integers. Other columns are ignored; no rows give none.
    """
    rows = checkpointed(unit_rows(vectors, id_col, vector_col, label_col, tables, projections, width))
    usable = rows.filter("key is not null and id is not null")
    classes = checkpointed(usable.groupBy("key").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"), F.first("buckets").alias("buckets"), F.first(F.octet_length("unit")).alias("size")))

    # buckets first, without the vectors, which only go to the meetings
    step = 2 * projections
    placed = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64("label", "size", t, F.col("buckets").substr(t * step + 1, F.lit(step))))).alias("t", "bucket"))
    counts = placed.groupBy("t", "bucket").agg(F.count("*").alias("c")).filter("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    dealt = placed.join(counts.drop("c"), ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    dealt = dealt.groupBy("rep").agg(F.collect_list(F.struct("t", "bucket", "blocks", "block")).alias("at"))  # `tables` entries at most
    dealt = classes.select("rep", "copies", "unit").join(dealt, "rep").select("rep", "copies", "unit", F.inline("at"))
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("block", b).alias("a"), F.greatest("block", b).alias("b"), F.when(F.col("block") > b, 1).otherwise(0).alias("side")))
    dealt = dealt.select("t", "bucket", "rep", "copies", "unit", F.explode(meetings).alias("m")).select("t", "bucket", "m.a", "m.b", "m.side", "rep", "copies", "unit")
    dealt = dealt.repartition("t", "bucket", "a", "b").sortWithinPartitions("t", "bucket", "a", "b")

    def run(batches):
        key, held = None, []

        def done():
            found, links = _meet(held, least, tables, projections, width, key[0]) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found] + [u for u, _ in links], pa.int64()), pa.array([n for _, n in found] + [None] * len(links), pa.int64()), pa.array([None] * len(found) + [v for _, v in links], pa.int64())], names=["rep", "n", "other"])

        for batch in batches:
            for t, bucket, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, bucket, a, b) != key:
                    if len(held) > 1:
                        yield done()
                    key, held = (t, bucket, a, b), []
                held.append(row)
        if len(held) > 1:
            yield done()

    found = checkpointed(dealt.mapInArrow(run, "rep long, n long, other long"))
    linked = found.filter("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other is not null").select("rep", "other"))
    facts = classes.join(linked, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("found"))
    out = rows.select("id", "key").join(facts, "key", "left")
    component = F.coalesce("found", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
