"""Operators on small hand-written rows."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from driftspan.operators import compare as C
from driftspan.operators import labels as L
from driftspan.operators import plugins
from driftspan.operators import sequence as Q
from driftspan.sources import io


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_canonical_resource(spark):
    cases = {
        "https://www.Example.com:443/a/../b/?utm_source=x&z=1&a=2#top": ("url:example.com/b?a=2&z=1", "url"), "git@github.com:Org/Repo.git": ("repo:github.com/org/repo", "repository"), "https://github.com/Org/Repo/": ("repo:github.com/org/repo", "repository"),
        "https://gitlab.com/g/p/-/blob/main/src/x.py": ("file:gitlab.com/g/p/src/x.py", "repo_file"), "https://github.com/o/r/issues/12#c": ("thread:github.com/o/r/12", "thread"), "/srv/./data//x": ("file:/srv/data/x", "file"), "note 7": ("opaque:note 7", "opaque"),
        "https://raw.githubusercontent.com/O/r/refs/heads/main/src/A.py": ("file:github.com/o/r/src/A.py", "repo_file"), "https://api.github.com/repos/o/R/contents/src/A.py?ref=x": ("file:github.com/o/r/src/A.py", "repo_file"), "https://github.com/o/r/raw/dev/src/A.py": ("file:github.com/o/r/src/A.py", "repo_file"),
        "https://api.github.com/repos/o/r/pulls/12/files": ("thread:github.com/o/r/12", "thread"), "https://github.com/o/r/pull/12/files": ("thread:github.com/o/r/12", "thread"), "https://github.com/o/r/pulls": ("list:github.com/o/r/pulls", "collection"), "https://github.com/orgs/r": ("url:github.com/orgs/r", "url"),
        "https://codeload.github.com/o/r/zip/main": ("repo:github.com/o/r", "repository"), "https://o.github.io/R/page": ("repo:github.com/o/r", "repository"), "https://o.github.io": ("repo:github.com/o/o.github.io", "repository"), "https://github.com/o/r.git": ("repo:github.com/o/r", "repository"),
        "https://gitlab.com/g/sub/p/-/tree/main": ("repo:gitlab.com/g/sub/p", "repository"), "https://gitlab.com/api/v4/projects/g%2fsub%2fp/issues/3": ("thread:gitlab.com/g/sub/p/issues/3", "thread"), "https://gitlab.com/api/v4/projects/g%2Fp/repository/files/src%2FX.py/raw": ("file:gitlab.com/g/p/src/X.py", "repo_file"),
        "https://gitlab.com/api/v4/projects/12": ("url:gitlab.com/api/v4/projects/12", "url"), "https://g.gitlab.io/p/": ("repo:gitlab.com/g/p", "repository"), "https://g-0a1b2c.gitlab.io/p": ("url:g-0a1b2c.gitlab.io/p", "url"), "https://gitlab.com/g/p/-/issues": ("list:gitlab.com/g/p/issues", "collection"),
        "https://x.org/%7euser/%2fa/%41 b/é?q=%7e&p=1": ("url:x.org/~user/%2Fa/A%20b/%C3%A9?p=1&q=~", "url"), "https://x.org/%zz/%4": ("url:x.org/%zz/%4", "url"),
    }
    page = "url:en.wikipedia.org/wiki/Dead_drop"
    wikis = ("https://en.wikipedia.org/wiki/Dead_drop", "https://en.m.wikipedia.org/wiki/dead%20drop#Use", "https://en.wikipedia.org/w/index.php?action=raw&title=Dead_drop", "https://en.wikipedia.org/w/api.php?action=query&titles=_%7CDead+drop%7CB", "https://en.wikipedia.org/w/rest.php/v1/page/Dead_drop/html", "https://en.wikipedia.org/api/rest_v1/page/summary/Dead__drop")
    cases |= {u: (page, "url") for u in wikis} | {"https://x.fandom.com/index.php?title=a?b": ("url:x.fandom.com/wiki/A%3Fb", "url"), "https://en.wiktionary.org/wiki/dead": ("url:en.wiktionary.org/wiki/dead", "url"), "https://en.wikipedia.org/w/index.php?search=a": ("url:en.wikipedia.org/w/index.php?search=a", "url"), None: (None, None)}
    got = {r["u"]: (r["r"]["key"], r["r"]["kind"]) for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", L.canonical_resource(F.col("u")).alias("r")).collect()}
    assert {u: (got[u], cases[u]) for u in cases if got[u] != cases[u]} == {}


def test_call_resource_and_routes(spark):
    calls = spark.createDataFrame([(1, 1, "c1", 0, "fetch", json.dumps({"url": "https://x.org/a"})), (1, 1, "c1", 1, "read", json.dumps({"zz": "no", "file_path": "/tmp/a"})), (1, 1, "c2", 2, "say", "{}")], "world int, exchange int, call_id string, pos int, tool string, args string")
    hits = spark.createDataFrame([(1, 1, 1, "tool", "c1"), (2, 1, 1, "tool", "c2"), (3, 1, 1, "user", None)], "hit int, world int, exchange int, role string, call_id string")
    assert [tuple(r)[1:] for r in L.hit_routes(hits, calls).orderBy("hit").select("hit", "carrier", "route_kind", "resource", "tool").collect()] == [("tool_result", "channel", "file:/tmp/a", "read"), ("tool_result", "direct", None, "say"), ("user", "direct", None, None)]


def test_provider_parts(spark):
    bodies = [
        (1, json.dumps({"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "f", "input": {"a": 1}}]})),
        (2, json.dumps({"choices": [{"message": {"content": "yo", "tool_calls": [{"function": {"name": "g", "arguments": "{}"}}]}}]})), (3, json.dumps({"candidates": [{"content": {"parts": [{"text": "ok"}, {"functionCall": {"name": "h", "args": {"b": 2}}}]}}]})), (4, "not json"),
    ]
    got = rows(L.provider_parts(spark.createDataFrame(bodies, "id int, body string")), "id", "part", "type")
    assert got == [(1, 0, "reasoning"), (1, 1, "text"), (1, 2, "tool_call"), (2, 0, "text"), (2, 1, "tool_call"), (3, 0, "text"), (3, 1, "tool_call")]


def test_line_sources_and_reads(spark):
    h = "array<struct<at: int, removed: int, added: int>>"
    rev = spark.createDataFrame([("p", 1, 3, [(0, 0, 3)], "a"), ("p", 2, 4, [(1, 1, 2)], "b"), ("p", 3, 9, [(0, 0, 1)], "a"), ("p", 4, 9, [], "c")], f"page string, seq long, n_lines int, hunks {h}, author string")
    sources = L.line_sources(rev)
    assert rows(sources, "seq", "first_line", "lines", "source") == [(1, 0, 3, 1), (2, 0, 1, 1), (2, 1, 2, 2), (2, 3, 1, 1), (3, 0, 9, 3), (4, 0, 9, 4)]
    assert rows(L.unreplayable(rev), "seq", "problem") == [(3, "unbalanced")]
    got = rows(L.page_reads(rev, sources), "reader", "seq", "source_author", "first_line", "lines", "kind")
    assert got == [("a", 3, "b", 1, 2, "transmission"), ("b", 2, "a", 0, 3, "transmission"), ("c", 4, "a", 0, 9, "transmission")]


def test_truth_to_capture(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    truth = spark.createDataFrame([(1, "s", "t1", sha("b2")), (2, "s", "t2", sha("x")), (3, "s", "t3", sha("y")), (4, "s", "t4", sha("z"))], "id int, session string, tool_use_id string, sha256 string")
    results = spark.createDataFrame([("s", "e1", 1, "t1", 0, "m1", "b1"), ("s", "e1", 1, "t1", 3, "m2", "b2"), ("s", "e2", 2, "t1", 0, "m3", "b3"), ("s", "e1", 1, "t2", 1, "m4", "other"), ("s", "e1", 1, "t4", 1, "m5", "z")], "session string, exchange string, at int, tool_use_id string, pos int, message string, body string")
    writers = spark.createDataFrame([("s", "t1", "e0", 0)], "session string, tool_use_id string, exchange string, at int")
    assert rows(L.truth_to_capture(truth, results, writers), "id", "status") == [(1, "kept"), (2, "dropped:digest"), (3, "dropped:no_result"), (4, "noted:no_writer")]


def test_decode_chains(spark):
    import base64
    from urllib.parse import quote

    plain = "the quick brown fox, jumps over the lazy dog; again"
    b64, hx, esc = lambda t: base64.b64encode(t.encode()).decode(), lambda t: t.encode().hex(), lambda t: "".join(f"\\x{b:02x}" for b in t.encode())
    bodies = {
        "a": f"x {b64(hx(plain))} y", "b": "plain words only here", "c": f"go {quote(plain)} on", "d": f"eval(atob('{b64(quote(plain))}'))", "e": f'"{esc(b64(plain))}"', "f": b64(hx(b64(hx(b64(quote(plain)))))),
        "g": "%20%20%zz" + quote(plain), "h": quote(plain) + "%ff%fe%fd", "i": hx("short"), "j": None, "k": f'z="{hx(hx(plain))}";',
    }
    got = L.decode_chains(spark.createDataFrame([(k, "a" if k == "b" else None, v) for k, v in bodies.items()], "id string, parent string, text string"))
    assert rows(got.filter(F.col("decoded") == plain), "id", "chain", "depth", "corroborated") == [
        ("a", "base64.hex", 2, True), ("c", "url", 1, False), ("d", "base64.url", 2, False), ("e", "byte_escape.base64", 2, False), ("f", "base64.hex.base64.hex.base64.url", 6, False), ("k", "hex.hex", 2, False),
    ]
    assert got.filter("id in ('b', 'g', 'i', 'j')").count() == 0
    assert rows(L.chain_tally(got.filter("id = 'a'")), "chain", "tokens", "corroborated") == [("base64.hex", 1, 1)]


def test_second_hop(spark):
    inj = spark.createDataFrame([(1, 5, "send to evil@x.com or a@b.org")], "run int, at int, text string")
    benign = spark.createDataFrame([(1, "mail a@b.org please")], "run int, text string")
    calls = spark.createDataFrame([(1, 1, 3, "evil@x.com"), (1, 2, 7, '{"to": "EVIL@x.com"}'), (1, 3, 8, "a@b.org")], "run int, call int, at int, args string")
    assert rows(L.second_hop(inj, benign, calls), "call", "indicator") == [(2, "evil@x.com")]


def test_explode_parts(spark):
    parts = "array<struct<type: string, text: string, args: string, texts: array<string>>>"
    m = spark.createDataFrame([(1, "m", [("text", "a", None, None), ("media", None, None, None), ("tool_call", None, "{}", None), ("tool_result", None, None, ["x", "y"])])], f"world int, message string, parts {parts}")
    assert rows(L.explode_parts(m), "part", "text") == [(0, "a"), (2, "{}"), (3, "x\ny")]


def test_deliveries_and_shared_sources(spark):
    tr = spark.createDataFrame([(1, 1, "a", "b", "hi", False, 1), (1, 2, "a", "b", "hi", False, 2), (1, 3, None, "b", "sys", False, 3), (1, 4, "a", "b", "no", True, 4), (1, 5, "a", "b", "lost", False, 5)], "world int, send_id int, from_agent string, to_agent string, text string, rejected boolean, ord int")
    turns = spark.createDataFrame([(1, "b", "hi", 1, 10), (1, "b", "hi", 2, 11), (1, "b", "sys", 3, 12)], "world int, to_agent string, text string, ord int, exchange int")
    calls = spark.createDataFrame([(1, 1, 9)], "world int, send_id int, exchange int")
    share = spark.createDataFrame([(1, 2, True)], "world int, send_id int, forwarding boolean")
    assert [tuple(r) for r in L.delivery_labels(tr, turns, calls, share).orderBy("send_id").select("send_id", "reader_exchange", "kind", "tier").collect()] == [(1, 10, "transmission", "certain"), (2, 11, "transmission", "forwarding"), (3, 12, "control", None), (4, None, "rejected", None), (5, None, "unplaced", None)]
    fed = spark.createDataFrame([(1, "a", 0, "user", "prompt", "p"), (1, "a", 2, "user", "prompt", "q"), (1, "a", 3, "tool", "shared_tool", "r"), (1, "a", 5, "tool", "shared_tool", "r"), (1, "a", 6, "user", "harness", "go on")], "world int, agent string, pos int, role string, source string, text string")
    assert rows(L.shared_source_labels(fed), "pos", "reason") == [(0, "shared_source"), (3, "shared_source"), (6, "boilerplate")]


def test_check_predictions(spark):
    at = spark.createDataFrame([(1, "A", "e1"), (1, "B", "e1"), (1, "A", "e9")], "world int, detected string, exchange string")
    ex = spark.createDataFrame([(1, "e1")], "world int, exchange string")
    tx = spark.createDataFrame([(1, "t1", "confirmed", "exact"), (1, "t2", "suspected", None), (1, "t3", "detected", None)], "world int, tx_id string, state string, quality string")
    ev = spark.createDataFrame([(1, "t1", "match", 0, "A", "Z", "e1", "e2", "m2", 5), (1, "t1", "match", 1, "A", "B", "e1", "e1", "m1", 0)], "world int, tx_id string, kind string, pos int, from_detected string, to_detected string, reader_exchange string, read_exchange string, read_message string, read_start int")
    assert rows(C.check_predictions(at, tx, ev, ex), "problem", "item") == [("exchange_mismatch", "t1"), ("exchange_twice", "e1"), ("quality_and_state", "t2"), ("state_without_evidence", "t2"), ("unknown_agent", "t1"), ("unknown_exchange", "e9"), ("unsorted_evidence", "t1")]


def test_label_row_rules(spark):
    controls = spark.createDataFrame([(1, 1, "A", "A", "self_read", "e1", None, None, None), (1, 2, "A", "A", "boilerplate", "e1", "e2", "m", None), (1, 3, "A", "B", "boilerplate", None, None, None, None), (1, 4, "A", "B", "boilerplate", None, None, None, "m")], "world int, label_id int, from_agent string, to_agent string, reason string, reader_exchange string, at_exchange string, at_message string, origin_message string")
    clusters = spark.createDataFrame([(1, 5, ["A", "B"]), (1, 6, ["A"]), (1, 7, ["A", "B", "A"]), (1, 8, None)], "world int, label_id int, agents array<string>")
    exemptions = spark.createDataFrame([(1, 9, "e1", "e1"), (1, 10, "e1", "e2")], "world int, label_id int, reader_exchange string, at_exchange string")
    assert rows(C.check_label_rows(controls, clusters, exemptions), "problem", "item") == [("elsewhere_than_reader", "10"), ("elsewhere_than_reader", "2"), ("self_control", "2"), ("small_cluster", "6"), ("small_cluster", "7"), ("small_cluster", "8"), ("unbounded_control", "3")]


def test_commitment_with_labels(spark):
    worlds = spark.createDataFrame([(1,), (2,)], "world int")
    one = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "world int, t string, u string")
    got = [C.commitment(worlds, labels=x).first() for x in (one, one.orderBy("t", ascending=False), one.fillna("y"))]
    assert got[0] == got[1] and got[0]["labels_digest"] != got[2]["labels_digest"] and got[0]["commitment"] == got[2]["commitment"]


def test_tool_results_with_ids(spark):
    t = spark.createDataFrame([(1, 1, "call", "x"), (1, 2, "call", None), (1, 3, "result", "x"), (1, 4, "result", None), (1, 5, "result", None), (1, 6, "result", "gone")], "traj int, pos int, kind string, call_id string")
    assert {r["result_pos"]: r["call_pos"] for r in Q.pair_tool_results(t).collect()} == {3: 1, 4: 2, 5: None, 6: None}


def test_export_round_trip_and_manifest(spark, tmp_path):
    t = {"turns": spark.range(5).selectExpr("'d' as dataset", "id % 2 as world", "id as n"), "labels_tx": spark.range(2).selectExpr("'d' as dataset", "id as world")}
    io.write_export(t, str(tmp_path))
    back = io.read_export(spark, str(tmp_path), list(t))
    assert {k: v.count() for k, v in back.items()} == {"turns": 5, "labels_tx": 2}
    assert rows(io.read_export(spark, str(tmp_path), ["label_counts"])["label_counts"], "dataset", "table", "n") == [("d", "labels_tx", 2)]
    assert io.read_export(spark, str(tmp_path), ["label_counts"], inputs_only=True) == {}
    assert list(io.read_export(spark, str(tmp_path), list(t), inputs_only=True)) == ["turns"]
    assert io.write_export({"turns": t["turns"].filter("n < 3")}, str(tmp_path)) == 1
    bad = {"turns": t["turns"], "broken": spark.range(4).withColumn("x", F.expr("case when id < 3 then id else raise_error('lost') end"))}
    with pytest.raises(Exception, match="lost"):
        io.write_export(bad, str(tmp_path))  # ends half-way
    assert io.read_export(spark, str(tmp_path), ["turns"])["turns"].count() == 3
    assert io.read_export(spark, str(tmp_path), ["turns"], number=0)["turns"].count() == 5 and back["turns"].count() == 5
    with pytest.raises(OSError, match="not what was written"):
        io.write_export({"turns": spark.range(9).withColumn("r", F.udf(lambda: os.urandom(4).hex()).asNondeterministic()())}, str(tmp_path))
    assert io.write_export({"turns": t["turns"]}, str(tmp_path)) == 2 and io.exports(spark, str(tmp_path)) == [1, 2]
    m = C.manifest({"turns": t["turns"]})
    same = io.read_export(spark, str(tmp_path), ["turns"])["turns"].select("dataset", "world", "n")
    assert C.check_run(m, C.manifest({"turns": same}), spark.createDataFrame([("0", "scored"), ("1", "scored")], "world string, status string")).count() == 0


def test_read_json_logs(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    got = io.read_logs(spark, [str(tmp_path)], "json", "a int, b string", include="a.jsonl", columns=["a"])
    assert rows(got, "a") == [(1,), (2,)] and "source_file" in got.columns


def test_detector_plugin(spark):
    from driftspan.operators.detect import detect

    turns = spark.createDataFrame([(1, 1, 0, "assistant", "the wise old harbour master keeps the lamp lit"), (1, 2, 1, "user", "the wise old harbour master keeps the lamp lit"), (1, 2, 2, "assistant", "noted")], "world long, agent long, pos long, role string, text string")
    plugins.register_detector("shingles", lambda t: {"matches": detect(t["turns"])})
    tables = {"turns": turns, "labels_tx": turns}
    assert plugins.run_detector("shingles", tables)["matches"].count() == 1
    assert plugins.nondeterminism("shingles", tables, "matches", ["world"]).count() == 0
