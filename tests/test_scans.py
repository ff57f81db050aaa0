"""Running aggregates in slices against one window, and the operators on them with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from driftspan.operators import scans as S
from driftspan.operators import sequence as Q


def rows(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", None]), rng.randint(0, n // 3), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("backward", [False, True])
def test_slices_equal_windows(spark, backward):
    df = spark.createDataFrame(rows(2000), "k string, t int, i int, v int")
    columns = {"n": S.row_numbers(), "total": S.Running("sum", F.col("v")), "top": S.Running("max", F.col("v")), "seen": S.Running("last", F.struct("v", "i")), "valued": S.Running("last", F.when(F.col("v") > 3, F.col("v")), before=True), "sum0": S.Running("sum", F.col("v"), before=True)}
    one = S.running(df, ["k"], ["t", "i"], columns, backward)
    two = S.running(df, ["k"], ["t", "i"], columns, backward, hot_rows=10, slices=16)
    assert two.columns == one.columns
    key = lambda d: sorted(map(str, d.collect()))
    assert key(one) == key(two)


def test_a_hot_key_is_many_slices(spark):
    df = spark.range(40_000).selectExpr("case when id % 10 = 0 then id else -1 end as k", "id % 7 as t", "id")
    dealt = df.repartitionByRange(16, "k", "t", "id").withColumn("s", F.spark_partition_id()).filter("k = -1").groupBy("s").count().collect()
    assert len(dealt) >= 12 and max(r["count"] for r in dealt) < 40_000 // 8


def test_operators_with_hot_keys(spark, monkeypatch):
    rng = random.Random(7)
    acc = spark.createDataFrame([(i, rng.randint(0, 3), rng.randint(0, 300), rng.choice(["r"] * 6 + ["q", None]), rng.choice(["read", "write"]), rng.random() < 0.2) for i in range(600)], "id long, agent long, at long, resource string, op string, rejected boolean")
    ev, pr = acc.filter("op = 'write'").selectExpr("resource", "at", "id", "id as value"), acc.filter("op = 'read'").selectExpr("resource", "at", "id")
    posts, calls = acc.filter("op = 'write'").selectExpr("id", "agent % 2 as room", "agent", "at"), acc.filter("op = 'read'").selectExpr("id", "agent", "at")
    members = acc.selectExpr("agent % 2 as room", "agent").distinct().unionByName(acc.selectExpr("1 - agent % 2 as room", "agent").distinct())
    ex = acc.selectExpr("agent % 2 as world", "at", "agent", "id", "resource as session")
    every = {
        "pairs": lambda: Q.write_read_pairs(acc), "asof": lambda: Q.state_asof(ev, pr, "resource", -1), "next": lambda: Q.next_delivery(posts, calls, members, 40), "clock": lambda: Q.strictly_increasing(acc, ["agent"], "at", ["id"]).select("id", "agent"),
        "gaps": lambda: Q.gap_clock(acc.withColumnRenamed("at", "t"), ["agent"], ["t", "id"], "id"), "cut": lambda: Q.cut_sessions(acc, ["agent"], ["at", "id"], F.col("op") == "write"), "order": lambda: Q.exchange_order(ex, "at", "agent", "id", "session"),
    }
    plain = {n: sorted(map(str, f().collect())) for n, f in every.items()}
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    monkeypatch.setattr(S, "SLICES", 8)
    assert {n: sorted(map(str, f().collect())) for n, f in every.items()} == plain and all(plain.values())


def test_selection_by_counts(spark):
    data = rows(900)
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    own = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        own.setdefault(r[0], []).append(r[2])
    for n in (1, 7, 500):
        want = sorted(v[p] for v in own.values() for p in {i * len(v) // n for i in range(n)})
        assert sorted(r["i"] for r in S.spaced(df, ["k"], ["t", "i"], n, slices=16).collect()) == want
        got = S.first_of_each(df, ["k"], ["t", "i"], n, slices=16).collect()
        assert sorted((r["i"], r["place"]) for r in got) == sorted((i, p + 1) for v in own.values() for p, i in enumerate(v[:n]))
    assert S.spaced(df.limit(0), ["k"], ["t", "i"], 3).count() == 0
