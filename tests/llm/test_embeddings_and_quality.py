"""Quality classes, whitening and clustering against brute force, with the edge cases of each."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftspan.llm import geometric_means as G
from driftspan.llm import subword_quality as Q
from driftspan.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, cluster int, component string"


def vectors(n=300, dims=64, seed=1, around=6):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((around, dims))
    return [(i, (middles[i % around] + r.standard_normal(dims) * 0.3).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 7, "c") for i, v in rows], SCHEMA).repartition(3)


ODD = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] * 64), (904, [None] + [0.1] * 63), (905, [1.0] * 3)]


# --- quality -----------------------------------------------------------------------------------


def texts(n, seed):
    r = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "straße", "señor", "of", "the"]
    rows = []
    for i in range(n):
        w = list(r.choice(words, int(r.integers(3, 40))))
        bad = i % 5 == 0
        if bad and i % 2:
            w = [f"{x}##" for x in w]
        elif bad:
            w = [x for x in w for _ in range(4)]
        rows.append((i, " ".join(w), 0 if bad else 1))
    return rows


@pytest.fixture(scope="module")
def quality(spark):
    rows = texts(600, 1)
    docs = spark.createDataFrame([(i, t, 3, "s") for i, t, _ in rows], "doc_id long, text string, label int, id string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    sample = Q.train_sample(docs, labels)
    return rows, docs, labels, sample, Q.train(sample, epochs=6)


def plain_probability(weights, text):
    """Word by word and n-gram by n-gram over the whole text."""
    before = {}
    column = pa.array([text], pa.string())
    ((_, families),) = Q.feature_cells(column)
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]
    gaps = []
    for k, w in enumerate(words):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        gaps.append(2 * (1 << Q.BITS) + ((k - before[w]).bit_length() if w in before else 0))
        before[w] = k
    assert families[1][0].tolist() == gaps
    n = len(text or "")
    assert [len(f[0][a:b]) for f in families[2:] for a, b in [(f[1][0], f[2][0])]] == [max(0, n - o + 1) for o in Q.ORDERS]
    cells = np.concatenate([f[0] for f in families])
    mean = weights.vectors[cells].astype(float).mean(0) if len(cells) else np.zeros(Q.DIM)
    odds = np.exp(weights.output.astype(float) @ mean + weights.bias)
    return odds / odds.sum()


def test_quality_scores_are_the_average_of_all_features(spark, quality):
    _, _, _, _, weights = quality
    texts_ = ["", None, "  \n ", "a", "alpha beta alpha alpha## ß", "Ünder the straße " * 40, "x" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["probabilities"] for r in Q.predict(docs, weights).collect()}
    for i, t in enumerate(texts_):
        np.testing.assert_allclose(got[i], plain_probability(weights, t), rtol=1e-6)
    alone = Q.predict(docs.filter("doc_id = 5"), weights).first()["probabilities"]
    assert alone == got[5]  # a text's neighbours do not matter


def test_quality_tells_held_out_texts(spark, quality):
    _, _, _, _, weights = quality
    rows = texts(300, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["probabilities"][1] for r in Q.predict(docs, weights).collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, _, q in rows]) > 0.97


def test_quality_sample_is_bounded_and_null_safe(spark, quality):
    _, docs, labels, sample, _ = quality
    assert sample.count() == 600
    assert Q.train_sample(docs, labels, rows=50).count() == 50
    few = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c"), (3, "d")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = sorted((r["id"], r["label"], r["text"] in ("a", "b", "")) for r in Q.train_sample(few, marks).collect())
    assert got == [(1, 0, True), (2, 1, True)]


def test_quality_without_rows(spark, quality):
    _, docs, labels, sample, weights = quality
    assert Q.predict(docs.limit(0), weights).count() == 0
    none = Q.train(sample.limit(0))
    assert abs(Q.predict(docs.limit(1), none).first()["probabilities"][1] - 0.5) < 0.05
    nulls = spark.createDataFrame([(None, "alpha"), (None, "alpha")], "doc_id long, text string")
    assert [r["doc_id"] for r in Q.predict(nulls, weights).collect()] == [None, None]


# --- whitening ---------------------------------------------------------------------------------


def plain_whitening(rows, weighted, components=4):
    x = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all()]
    fit = [t for _, t in x] if weighted else sorted({t for _, t in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(t, sums, strict=True)] for t in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, t in x:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(t, sums, strict=True)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(t, sums, strict=True)), (c @ axes[:, :components]) / np.sqrt(values[:components])))
    return n, out, values / values.sum()


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_whitening(spark, weights):
    rows = vectors(200) + [(500 + i, v) for i, v in vectors(40)] + [(3, vectors(4)[3][1])] + ODD
    n, want, share = plain_whitening(rows, weights == "copies")
    got = W.whiten(frame(spark, rows), weights=weights).collect()
    assert len(got) == 4 * sum(map(len, want.values())) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    turn = {}
    for r in got:
        deviation, white = want[r["vec_id"]][0]
        k = r["component"] - 1
        assert int(r["deviation"]) == deviation
        assert abs(r["explained"] / share[k] - 1) < 1e-9
        if abs(white[k]) > 1e-3:
            turn.setdefault(k, set()).add(np.sign(white[k]) * np.sign(r["whitened"]))
        assert abs(abs(r["whitened"]) - abs(white[k])) < 1e-8
    assert all(len(s) == 1 for s in turn.values())  # one sign for all rows


def test_whitening_large_entries_are_exact(spark):
    rows = [(i, [float((i * j * 7919) % 1000 - 500) * 1e9 for j in range(3)]) for i in range(20)]
    n, sums = 20, [sum(int(256 * v[k]) for _, v in rows) for k in range(3)]
    got = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(frame(spark, rows), components=1).collect()}
    assert got == {i: sum((n * int(256 * c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in rows}
    assert W.whiten(frame(spark, [*rows, (99, [1e300, 0.0, 0.0])]), components=1).count() == 20  # no integer of steps of 1/256


def test_whitening_edges(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, ODD[:5])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector: no variance
    got = W.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 3.0]), (1, [1.0, 2.0]), (4, [5.0])])).collect()
    assert sorted((r["vec_id"] or -1, r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in got) == [(-1, 1, 2, 1.0), (1, 1, 2, 1.0), (1, 1, 2, 1.0)]


# --- clusters ----------------------------------------------------------------------------------


def plain_clusters(rows, clusters=16, rounds=3, scale=64):
    x = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all()]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), W._usable(pa.array([[float(c) for c in v]]), 1, W.LARGEST)[1][0], v) for i, v in x if i is not None)[:clusters]
    centroids = [v for _, _, v in first]
    for k in range(rounds + 1):
        near = []
        for _, v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            near.append((d.index(min(d)), min(d)))
        if k < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), (n, _) in zip(x, near, strict=True) if n == c]
                if own:
                    centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {}
    for n, d in near:
        inertia[n] = inertia.get(n, 0) + d
    return sorted((i if i is not None else -1, n, d, inertia[n], sum(inertia.values()), names[n]) for (i, _), (n, d) in zip(x, near, strict=True))


def clusters_of(found):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], int(r["cluster_inertia"]), int(r["inertia"]), r["centroid_sha256"]) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters(spark, seed):
    rows = vectors(250, seed=seed, around=9) + ODD + [(None, vectors(1)[0][1])] + [(7, v) for _, v in vectors(3, seed=seed)]
    assert clusters_of(G.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)


def test_clusters_with_ties_and_large_entries(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(0, 2, 64) / 64).tolist()) for i in range(120)] + [(500 + i, [0.0] * 64) for i in range(40)]
    assert clusters_of(G.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)
    rows = [(i, (r.integers(-(1 << 20), 1 << 20, 64) * 1.5).tolist()) for i in range(60)]
    assert clusters_of(G.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)


def test_clusters_few_or_none(spark):
    assert G.cluster_vectors(frame(spark, [])).count() == 0
    assert G.cluster_vectors(frame(spark, ODD)).count() == 0
    assert G.cluster_vectors(frame(spark, [(1, [1e9] * 64)])).count() == 0
    rows = vectors(3)
    assert clusters_of(G.cluster_vectors(frame(spark, rows))) == plain_clusters(rows)


def test_drop_bounds_hold_and_are_tighter_than_the_drift():
    r = np.random.default_rng(8)
    tighter = 0
    for _ in range(300):
        dims = int(r.integers(2, 6))
        middle, a = r.standard_normal(dims) * 10, r.standard_normal(dims) * 10
        b, radius = a + r.standard_normal(dims) * r.choice([0.1, 1, 10]), float(r.choice([0.0, 0.5, 3, 20]))
        drop = G.greatest_drop(middle, radius, a, b)
        step = r.standard_normal((500, dims))
        points = middle + step / np.linalg.norm(step, axis=1)[:, None] * radius * r.random((500, 1)) ** 0.2
        fall = np.linalg.norm(points - a, axis=1) - np.linalg.norm(points - b, axis=1)
        drift = np.linalg.norm(b - a)
        assert fall.max() <= drop <= drift * (1 + 1e-6)
        tighter += drop < 0.7 * drift
    assert tighter > 100


def test_bounds_spare_scans(spark):
    rows = frame(spark, vectors(400, around=16))
    state = G.checkpointed(G.integer_rows(rows, "vec_id", "embedding", 64, G.LARGEST_ENTRY))
    centroids = W.unpack_entries([bytes(r["x"]) for r in state.orderBy("id").limit(16).collect()])
    one = G.assign(state, centroids)
    assert one.filter("not scanned").count() == 0
    new, radii = G.moved(one, centroids)
    two = G.assign(one, new, G.bound_drops(centroids, new, radii))
    assert two.filter("not scanned").count() > 200
    exact = G.assign(state, new)
    assert sorted(two.select("id", "cluster", "distance").collect()) == sorted(exact.select("id", "cluster", "distance").collect())
    assert two.filter(F.col("lower") > 0).count() > 0
