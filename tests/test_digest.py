"""Digest trees: every kind of altered table is told, and the altered ranges and rows are named."""

import datetime

from driftspan.operators import compare as C
from driftspan.operators import digest as D

S = "world long, a string, b string"


def problems(spark, one, two, schema=S):
    x, y = (spark.createDataFrame(r, schema) for r in (one, two))
    status = spark.createDataFrame([(str(w), "scored") for w in {r[0] for r in one + two}], "world string, status string")
    return sorted((r["world"], r["problem"]) for r in C.check_run(C.manifest({"t": x}), C.manifest({"t": y}), status).distinct().select("world", "problem").distinct().collect())


def test_altered_multisets_differ(spark):
    a, b = (1, "a", "x"), (1, "b", "x")
    assert problems(spark, [a, a], [b, b]) == [("1", "digest")]
    assert problems(spark, [a, a, b], [a, b, b]) == [("1", "digest")]
    assert problems(spark, [a, b], [b, a]) == []
    assert problems(spark, [(1, None, "a")], [(1, "a", None)]) == [("1", "digest")]
    assert problems(spark, [(1, "", None)], [(1, None, "")]) == [("1", "digest")]
    assert problems(spark, [(1, "ab", "c")], [(1, "a", "bc")]) == [("1", "digest")]
    assert problems(spark, [(1, "n", "v1:x")], [(1, None, "x")]) == [("1", "digest")]
    assert problems(spark, [a, (2, "q", "q")], [a]) == [("2", "missing")]
    assert problems(spark, [a], [a, a]) == [("1", "count")]


def test_every_type_counts(spark):
    kind = "world long, t timestamp, x binary, m map<string,int>, l array<struct<a: int, b: string>>, d double"
    now = datetime.datetime(2026, 1, 2, 3, 4, 5, 6)
    row = (1, now, b"\x00", {"a": 1, "b": None}, [(1, None)], 0.1)
    same = (1, now, b"\x00", {"b": None, "a": 1}, [(1, None)], 0.1)
    assert problems(spark, [row], [same], kind) == []
    for k, v in ((1, now.replace(microsecond=7)), (2, b"\x01"), (3, {"a": 1, "b": 0}), (4, [(None, "1")]), (5, float("nan")), (1, None)):
        assert problems(spark, [row], [tuple(v if i == k else x for i, x in enumerate(row))], kind) == [("1", "digest")]


def test_ranges_and_rows(spark):
    one = [(i % 3, f"a{i}", "x") for i in range(600)]
    two = [r for r in one if r[1] != "a7"] + [(1, "new", None), (2, "a8", "x")]
    x, y = (spark.createDataFrame(r, S).repartition(3) for r in (one, two))
    nodes = D.differing_nodes(D.digest_tree(x, ["world"]), D.digest_tree(y, ["world"]), ["world"])
    found = {(r["world"], r["node"], r["rows_a"] - r["rows_b"]) for r in nodes.collect()}
    assert len(found) == 3 and {(w, d) for w, _, d in found} == {(1, 1), (1, -1), (2, -1)}
    rows = {(r["world"], r["row"].split(";")[1], r["n_a"], r["n_b"]) for r in D.altered_rows(x, y, nodes, ["world"]).collect()}
    assert rows == {(1, "v2:a7v1:xv1:1", 1, 0), (1, "v3:newnv1:1", 0, 1), (2, "v2:a8v1:xv1:2", 1, 2)}


def test_trees_add_up(spark):
    x = spark.createDataFrame([(i % 2, f"a{i % 50}", None) for i in range(300)], S)
    parts = [x.filter(f"substring(a, 2, 1) {op} '3'") for op in ("<", ">=")]
    whole = D.merged(*(D.digest_tree(p, ["world"]) for p in parts), ["world"])
    key = lambda t: sorted(map(tuple, ((r["world"], r["level"], r["node"], r["rows"], tuple(r["digest"])) for r in t.collect())))
    assert key(whole) == key(D.digest_tree(x, ["world"]))
    assert D.digest_tree(x.limit(0), ["world"]).count() == 0
