"""Streams against the batch operators: state, watermarks, restarts, late rows."""

import random

from pyspark.sql import functions as F

from driftspan.operators import detect as D
from driftspan.operators import sequence as Q
from driftspan.streaming import levels, online, pairing


def accesses(n, seed=4):
    rng = random.Random(seed)
    return [(i, rng.randint(1, 6), 1_000_000 * i + rng.randint(0, 999), f"r{rng.randint(0, 3)}", rng.choice(["read", "read", "write"]), rng.random() < 0.1) for i in range(n)]


def put(spark, path, rows):
    spark.createDataFrame(rows, pairing.ACCESS).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path):
    stream = spark.readStream.schema(pairing.ACCESS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = pairing.pairs_stream(stream, f"{tmp_path}/out", "60 seconds")
    query.awaitTermination()
    return query.recentProgress


def test_pairs_come_while_the_stream_runs(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = accesses(300)
    late = (900, 3, rows[50][2], "r1", "write", False)  # 149 s behind the last row of the first half
    held = [r for r in rows if r[0] % 10 == 3]  # come 30 s after their time
    files = [[] for _ in range(6)]
    for r in rows:
        files[min(5, (r[0] + (30 if r in held else 0)) // 50)].append(r)
    files[4].append(late)
    for f in files[:3]:
        put(spark, f"{tmp_path}/in", f)
    run(spark, tmp_path)
    before = pairing.pairs_of(spark, f"{tmp_path}/out").count()
    for f in files[3:]:
        put(spark, f"{tmp_path}/in", f)
    put(spark, f"{tmp_path}/in", [(-1, -1, 10**12, "end", "end", False), (None, 1, 1, "r1", "read", None), (5, 1, 1, None, "read", None)])
    progress = run(spark, tmp_path)
    want = sorted(map(tuple, Q.write_read_pairs(spark.createDataFrame(rows, pairing.ACCESS)).collect()))
    got = pairing.pairs_of(spark, f"{tmp_path}/out").select("read_id", "write_id", "resource", "reader", "writer", "cross_day")
    assert sorted(map(tuple, got.collect())) == want
    assert 0 < before < len(want)
    dropped = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    assert dropped + pairing.pairs_of(spark, f"{tmp_path}/out", "rejected").count() == 1


def test_waiting_rows_leave_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    put(spark, f"{tmp_path}/in", [(i, i, 1_000_000 * i, f"r{i}", "read", False) for i in range(40)])
    put(spark, f"{tmp_path}/in", [(50, 1, 10**10, "end", "read", False)])
    totals = [s.numRowsTotal for p in run(spark, tmp_path) for s in p.stateOperators]
    assert max(totals) >= 40 and totals[-1] <= 2  # resources without a write and without waiting rows keep nothing


def test_runs_are_digits():
    assert levels.live_runs(0) == [] and levels.live_runs(3) == [(0, 0), (0, 1), (0, 2)]
    assert levels.live_runs(4 * 4 + 2 * 4 + 1) == [(2, 0), (1, 16), (1, 20), (0, 24)]


def test_state_read_by_world_does_not_grow(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    table = levels.StateTable(spark, str(tmp_path), "world long, v string")
    read = []
    for b in range(17):
        worlds = levels.Worlds(spark.createDataFrame([(0,), (b,)], "world long"))
        rows = table.read(b, worlds)
        assert sorted((r["world"], r["v"]) for r in rows.collect()) == sorted([(0, f"{i}.0.{j}") for i in range(b) for j in range(3)])
        read.append((table.bytes_read(), len(table.read_paths)))
        new = [(w, f"{b}.{w}.{j}") for w in (0, *range(1000 * b + 101, 1000 * b + 160)) for j in range(3)]
        table.append(b, spark.createDataFrame(new, table.schema))
        table.append(b, spark.createDataFrame(new, table.schema))  # a batch that runs again
    assert table.read(17).count() == 17 * 60 * 3
    assert max(n for n, _ in read[9:]) < 2 * max(n for n, _ in read[:6])
    assert all(paths <= 2 * len(levels.live_runs(b)) for b, (_, paths) in enumerate(read))


def test_detector_over_batches_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(9)
    text = "the wise old harbour master keeps lamp number %d lit until dawn"
    turns = []
    for w in range(6):
        for pos in range(0, 14, 2):
            for agent in range(3):
                said = text % rng.randint(0, 4)
                role, call = ("tool", f"c{agent}") if agent == 2 else ("user", None)
                turns.append((w, agent, pos, role, said if pos > 2 else f"hm {pos}", call))
                turns.append((w, agent, pos + 1, "assistant", text % rng.randint(0, 4) if rng.random() < 0.4 else "so", None))
    t = spark.createDataFrame(turns, "world long, agent long, pos long, role string, text string, call_id string")
    calls = spark.createDataFrame([(w, 2, 1, "c2", "fetch", '{"path": "/srv/log"}') for w in range(0, 6, 2)], "world long, agent long, pos long, call_id string, tool string, args string")
    want = D.detect(t, calls)
    parts = D.parts_in_order(t).withColumns({"tool": F.lit(None).cast("string"), "args": F.lit(None).cast("string")})
    named = [F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], online.PARTS).schema]
    parts = parts.select(*named).union(calls.selectExpr("world", "agent", "cast(1 as bigint) ex", "cast(9 as bigint) step", "'c' kind", "pos", "'assistant' role", "cast(null as string) text", "call_id", "tool", "args").select(*named)).persist()
    for cut in ("ex <= 1", "ex = 3", "ex = 5", "ex = 7", "ex = 9", "ex >= 11"):
        parts.filter(cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        online.detect_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out").awaitTermination()
    got = online.matches_of(spark, f"{tmp_path}/out")
    cols = want.columns
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, map(tuple, want.collect()))) and want.count() > 20
    every = spark.read.parquet(f"{tmp_path}/out/matches")
    assert every.filter("reread").count() > 0 and {"direct:user_turn", "direct:tool:unknown", "channel:file:/srv/log"} == {r["route"] for r in every.select("route").distinct().collect()}
    parts.filter("ex = 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # what has been seen already
    online.detect_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == parts.filter("ex = 5").count() and online.matches_of(spark, f"{tmp_path}/out").count() == want.count()
