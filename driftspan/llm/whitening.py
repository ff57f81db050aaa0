"""Whitening of embeddings whose equal vectors are handled once.

Every vector becomes a vector x of integers, its entries in steps of 1/256. Rows are grouped by x,
so the table of distinct x with their multiplicities is what everything else works on: sums, the
covariance (a product of centred blocks, weighted by one or by multiplicity), the projection. The
whitened vectors then go back to all rows by a join on x. Only sums of one row per dimension, or
per pair of dimensions, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed

SCALE = 256
#: Entries are kept in the least of these widths that holds a vector's entries, after a byte for the
#: width, so equal vectors have equal bytes.
WIDTHS = ("<i1", "<i2", "<i4", "<i8")
#: Entries beyond this are not integers of steps of 1/256 any more.
LARGEST = float(1 << 53)
#: A component with less than this share of all variance has none.
NO_VARIANCE = 1e-12


@dataclass
class Fit:
    """n: fit weight of all vectors; sums: weighted, exact, per dimension; values and vectors:
    eigenvalues of x's covariance falling, and their unit eigenvectors as columns; trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def unpack_entries(packed: list[bytes]) -> np.ndarray:
    """Rows of integer entries of equal length."""
    return np.stack([np.frombuffer(p, WIDTHS[p[0]], offset=1).astype(np.int64) for p in packed])


def _usable(column: pa.Array, scale: int, largest: float) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(places, packed integer entries, lengths) of the usable vectors of a column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null entries become nan
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * scale)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(x) <= largest))])
    keep = np.flatnonzero((sizes > 0) & (bad[starts + sizes] == bad[starts]))
    packed: list[bytes] = [b""] * len(keep)
    for size in np.unique(sizes[keep]):
        own = np.flatnonzero(sizes[keep] == size)
        rows = x[starts[keep[own]][:, None] + np.arange(size)].astype(np.int64)
        low, high = rows.min(1), rows.max(1)
        left = np.ones(len(own), bool)
        for k, kind in enumerate(WIDTHS):
            fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
            left &= ~fits
            for i, row in zip(own[fits].tolist(), rows[fits].astype(kind), strict=True):
                packed[i] = bytes([k]) + row.tobytes()
    return keep, packed, sizes[keep]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, largest: float = LARGEST) -> DataFrame:
    """(id, x, size): x packed, of the rows whose vector is usable; size is its number of entries.

    A vector that is null, empty, holds null or non-finite entries, or entries whose integer would
    pass `largest`, is left out.
    """

    def run(batches):
        for batch in batches:
            keep, packed, sizes = _usable(batch.column(1), scale, largest)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "x", "size"])

    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col))
    return picked.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, x binary, size int")


def _weights(batch: pa.RecordBatch, weighted: bool) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False) if weighted else np.ones(batch.num_rows, np.int64)


def weighted_sums(distinct: DataFrame, weighted: bool) -> tuple[int, list[int]]:
    """(fit weight, weighted sum of each dimension), exact."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w, x = _weights(batch, weighted), unpack_entries(batch.column(0).to_pylist())
            small = int(np.abs(x).max()).bit_length() + int(w.sum()).bit_length() < 63
            part = w @ x if small else w.astype(object) @ x.astype(object)
            n += int(w.sum())
            total = [a + int(b) for a, b in zip(total or [0] * x.shape[1], part, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, len(total)), pa.int32()), "total": pa.array([str(v) for v in [n, *total]])})

    rows = distinct.select("x", "copies").mapInArrow(run, "dim int, total string")
    found = {r["dim"]: int(r["total"]) for r in rows.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).collect()}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def centred_products(rows: DataFrame, n: int, centre: np.ndarray, unpack, weighted: bool) -> np.ndarray:
    """The covariance of rows (vector, copies): the products of centred blocks, over the fit weight n.

    A task adds up its blocks, and Spark adds the tasks' sums by pair of dimensions.
    """
    size = len(centre)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                c = unpack(batch) - centre
                total += (c * _weights(batch, weighted)[:, None]).T @ c
        if total.any():
            yield pa.RecordBatch.from_pydict({"pair": pa.array(range(size * size), pa.int32()), "total": total.ravel()})

    out = np.zeros(size * size)
    for r in rows.mapInArrow(run, "pair int, total double").groupBy("pair").agg(F.sum("total").alias("total")).collect():
        out[r["pair"]] = r["total"]
    out = out.reshape(size, size) / max(n, 1)
    return (out + out.T) / 2


def fit(distinct: DataFrame, weights: str = "one") -> Fit | None:
    """The fit of the distinct vectors (x, copies), each weighing `one` or its `copies`; None without vectors."""
    weighted = {"one": False, "copies": True}[weights]
    n, sums = weighted_sums(distinct, weighted)
    if not n:
        return None
    centre = np.array([s / n for s in sums])
    cov = centred_products(distinct.select("x", "copies"), n, centre, lambda b: unpack_entries(b.column(0).to_pylist()), weighted)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    return Fit(n, sums, values, np.ascontiguousarray(vectors), float(np.trace(cov)))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """For each usable row and each of the first components: id_col, component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error.

    n is the fit weight: the distinct vectors, or with weights="copies" the usable rows. deviation,
    decimal(38,0), is the sum over dimensions of (n * x - S)**2, exact, null if it has more digits;
    whitened is x - S / n projected on the component, over the root of the eigenvalue; explained is
    the eigenvalue over the trace; identity_error is the largest absolute entry of whitened's
    covariance over the fit list less the identity, one value.

    Vectors that integer_rows() leaves out have no rows. Where vectors differ in length, the most
    frequent length counts, of several the largest, and the others have none. A component without
    variance (fewer distinct vectors than components, say) is not returned. Repeated rows and null
    ids come back once each. Other columns are ignored; an empty table gives none.
    """
    rows = checkpointed(integer_rows(vectors, id_col, vector_col, scale))
    groups = checkpointed(rows.groupBy("x", "size").agg(F.count("*").alias("copies")))
    sizes = groups.groupBy("size").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    distinct = groups.filter(F.col("size") == (sizes[0]["size"] if sizes else 0)).select("x", "copies")
    found = fit(distinct, weights)
    schema = "x binary, copies long, deviation decimal(38,0), " + ", ".join(f"w{k} double" for k in range(components))
    used = [] if found is None else [k for k in range(min(components, len(found.values))) if found.values[k] > NO_VARIANCE * found.trace]

    def project(batches):
        n, sums = found.n, np.array(found.sums, object)
        turn = found.vectors[:, used] / np.sqrt(found.values[used])
        centre = np.array([s / n for s in found.sums])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack_entries(batch.column(0).to_pylist())
            far = max(int(np.abs(x).max()) * n, max(map(abs, found.sums))) * 2
            own = x * n - sums.astype(np.int64) if far * far * x.shape[1] < 1 << 63 else x.astype(object) * n - sums
            deviations = [d if len(str(d)) <= 38 else None for d in map(int, (own * own).sum(1))]
            out = np.stack([row @ turn for row in x - centre])  # row by row, so that a vector's numbers do not depend on its batch
            columns = [pa.array(out[:, used.index(k)]) if k in used else pa.nulls(len(x), pa.float64()) for k in range(components)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deviations, pa.decimal128(38, 0)), *columns], names=["x", "copies", "deviation", *[f"w{k}" for k in range(components)]])

    if not used:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    whitened = checkpointed(distinct.mapInArrow(project, schema))
    blocks = whitened.select(F.struct(*[f"w{k}" for k in used]).alias("w"), "copies")
    cov = centred_products(blocks, found.n, np.zeros(len(used)), lambda b: np.stack([f.to_numpy(zero_copy_only=False) for f in b.column(0).flatten()], axis=1), weights == "copies")
    error = float(np.abs(cov - np.eye(len(used))).max())
    entries = [F.struct(F.lit(k + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", F.col(f"w{k}").alias("whitened"), F.lit(float(found.values[k] / found.trace)).alias("explained"), F.lit(error).alias("identity_error")) for k in used]
    out = rows.select(F.col("id").alias("__id"), "x").join(whitened.drop("copies"), "x")
    return out.select(F.col("__id").alias(id_col), F.inline(F.array(*entries)))
