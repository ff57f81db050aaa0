"""k-means over integer vectors with distance bounds that geometry keeps tight.

Each vector carries a lower bound on its distance to the nearest centroid but its own. When
centroids move, the bound need not fall by the whole way that another centroid moved: the vectors
of a cluster lie in a ball round its old centroid, and how much nearer a moved centroid can have
come to any point of a ball is a question in the plane through the ball's middle and the line of
the move. Vectors whose own centroid is nearer than their bound keep it; all others are compared
with every centroid. Distances are exact integers, so ties are exact, and the bounds, which are
floating point, leave a margin.

The drop in distance from a point y to a centroid that moves from a to b, |y - a| - |y - b|, is at
most |b - a| times the cosine of the angle at the middle of a and b between the move and y: y lies
on a branch of a hyperbola with foci a and b, inside the cone of its asymptotes. Over a ball the
angle is least at its tangent from that middle. Also the drop grows along the move and shrinks
across it, so the ball's box gives a second bound. The smaller one counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed
from .whitening import integer_rows, unpack_entries

#: Relative margin of the floating-point bounds.
MARGIN = 1e-9
#: Vectors with an entry beyond this, after scaling, are left out: their squared distances would not fit a long.
LARGEST_ENTRY = 1 << 27
#: Up to this entry products of rows are exact in double precision (64 * (2 * 2**22)**2 is below 2**53).
EXACT_ENTRY = 1 << 22


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as 64-bit integers."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) <= EXACT_ENTRY and x.shape[1] <= 64:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def greatest_drop(middle: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """At least how much nearer any point of the ball can be to b than to a; between 0 and |b - a|."""
    move = (b - a).astype(np.float64)
    length = float(np.linalg.norm(move))
    if not length:
        return 0.0
    along = float((middle - a) @ move) / length
    across = float(np.linalg.norm((middle - a) - along / length * move))
    reach = float(np.hypot(across, along - length / 2))
    if reach <= radius:
        cone = length
    else:
        angle = np.arctan2(across, along - length / 2) - np.arcsin(radius / reach)
        cone = length * max(0.0, float(np.cos(max(0.0, angle))))
    far, near = along + radius, max(0.0, across - radius)
    box = float(np.hypot(far, near) - np.hypot(far - length, near))
    return min(length * (1 + MARGIN), max(0.0, min(cone, box)) + MARGIN * (1 + reach + radius + length))


def bound_drops(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster how much the lower bound of its vectors must fall when centroids move."""
    k = len(old)
    return np.array([max([greatest_drop(old[i], radii[i], old[j], new[j]) for j in range(k) if j != i], default=0.0) for i in range(k)])


def _assign(x: np.ndarray, own: np.ndarray | None, lower: np.ndarray | None, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bound, scanned) of each row."""
    n, k = len(x), len(centroids)
    scan = np.ones(n, bool)
    cluster, distance, bound = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    if own is not None:
        cluster, distance, bound = own.copy(), ((x - centroids[own]) ** 2).sum(1), lower.copy()
        scan = np.sqrt(distance.astype(np.float64)) * (1 + MARGIN) >= np.maximum(bound, half[own])
    if scan.any():
        d = squared_distances(x[scan], centroids)
        best = d.argmin(1)  # the first of the nearest
        cluster[scan], distance[scan] = best, d[np.arange(len(d)), best]
        if k > 1:
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            bound[scan] = np.sqrt(d.min(1).astype(np.float64)) * (1 - MARGIN)
    return cluster, distance, bound, scan


def _half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half of each centroid's distance to the nearest other: a vector nearer than that is its own."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    gaps = np.sqrt(np.stack([((centroids - c) ** 2).sum(1) for c in centroids]).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(1) / 2 * (1 - MARGIN)


STATE = "x binary, cluster int, distance long, lower double, scanned boolean"


def assign(rows: DataFrame, centroids: np.ndarray, drops: np.ndarray | None = None) -> DataFrame:
    """rows (id, x, and of a former round cluster and lower) with their cluster, squared distance,
    lower bound, and whether they were compared with every centroid."""
    half = _half_gaps(centroids)
    kind = rows.schema["id"].dataType.simpleString()
    again = drops is not None

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unpack_entries(batch.column(1).to_pylist())
                own = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if again else None
                lower = batch.column(3).to_numpy(zero_copy_only=False) - drops[own] if again else None
                cluster, distance, bound, scanned = _assign(x, own, lower, centroids, half)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(bound, pa.float64()), pa.array(scanned)], names=["id", "x", "cluster", "distance", "lower", "scanned"])

    return checkpointed(rows.select("id", "x", *(("cluster", "lower") if again else ())).mapInArrow(run, f"id {kind}, {STATE}"))


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, radii round the old ones): exact floors of the means; an empty cluster's stays.

    Tasks add up their own vectors; Spark adds these sums by cluster and dimension.
    """
    size = centroids.shape[1]

    def run(batches):
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, cluster = unpack_entries(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(cluster):
                    sums[c] += x[cluster == c].sum(0)  # of a batch, below 2**63
                counts += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(counts)
        if len(used):
            values = [str(v) for c in used for v in [counts[c], *sums[c]]]
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(used, size + 1), pa.int32()), "dim": pa.array(np.tile(np.arange(-1, size), len(used)), pa.int32()), "total": values})

    rows = state.select("x", "cluster").mapInArrow(run, "cluster int, dim int, total string").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in rows.collect()}
    radii = np.zeros(len(centroids))
    for r in state.groupBy("cluster").agg(F.max("distance").alias("far")).collect():
        radii[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + MARGIN)
    new = centroids.copy()
    for c in range(len(centroids)):
        if n := found.get((c, -1)):
            new[c] = [found[c, k] // n for k in range(size)]
    return new, radii


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` components, none null or non-finite (nor so large that
    squared distances would not fit a long: beyond 2**27 after scaling); component c becomes the
    integer floor(scale * c). The first centroids are the kept vectors with the smallest
    sha256 of `seed:id`, in that order, of equal ids by their components; without so many vectors
    with an id there are fewer. In each round every vector goes to the nearest centroid, ties to
    the smaller number, and each centroid that has vectors becomes the floor of their mean; a last
    assignment follows. distance is squared; cluster_inertia and inertia are its sums, decimal(38,0).
    Repeated rows are vectors of their own, null ids too, which are never a first centroid. Other
    columns are ignored. Without a vector that has an id there are no centroids, and no rows.
    """
    spark = vectors.sparkSession
    rows = checkpointed(integer_rows(vectors, id_col, vector_col, scale, LARGEST_ENTRY).filter(F.col("size") == dims))
    first = rows.filter("id is not null").select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")).orderBy("h", "x").limit(clusters).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    centroids = unpack_entries([bytes(r["x"]) for r in first])
    state = assign(rows, centroids)
    for _ in range(rounds):
        new, radii = moved(state, centroids)
        drops, centroids = bound_drops(centroids, new, radii), new
        state = assign(state, centroids, drops)
    sums = {r["cluster"]: r["total"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(k, sums[k], sum(sums.values()), names[k]) for k in sorted(sums)], "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
