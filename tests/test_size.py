"""What a query does once, moves or looks at, where tables or worlds are large."""

import pytest
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.llm import jaccard
from driftspan.operators import detect as D
from driftspan.operators import graph, labels, score, sequence
from driftspan.plans import score_queries
from driftspan.sources.adapters import table
from driftspan.streaming import online


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_worlds_of_any_size(spark):
    rows = spark.range(1200).select(F.col("id").cast("string").alias("agent"), F.lit("p").alias("page"))
    assert [tuple(r) for r in graph.plan_worlds(rows).collect()] == [("p", 1200, 1)]
    assert graph.plan_worlds(rows, most=1000).isEmpty()


def test_next_delivery_pairs_are_not_shuffled(spark):
    posts = spark.createDataFrame([(1, 7, 1, 100), (2, 7, 2, 5), (3, 7, 1, 109)], "id long, room long, agent long, at long")
    calls = spark.createDataFrame([(10, 2, 100), (11, 2, 100), (12, 2, 111), (13, 3, 99), (14, 3, 110), (15, 1, 15), (16, 4, 120)], "id long, agent long, at long")
    members = spark.createDataFrame([(7, a) for a in (1, 2, 3, 4)], "room long, agent long")
    found = sequence.next_delivery(posts, calls, members, 10)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 10), (1, 3, 14), (2, 1, 15), (3, 2, 12), (3, 3, 14)]
    above = plan(found).split("slot#")[0]  # what comes after posts have met calls
    assert "Exchange" not in above and "Window" not in above


def test_shingle_counts_shuffle_no_window(spark, monkeypatch):
    monkeypatch.setattr(T, "LONG_TEXT", 400)
    texts = [(1, "ab" * 60), (2, "x" * 23), (3, None), (4, "".join(chr(97 + i % 7) for i in range(900))), (5, "".join(map(str, range(130))))]
    found = T.shingle_counts(spark.createDataFrame(texts, "id long, text string"), "text", ["id"])
    want = [(i, len(t) - 23, len({t[j : j + 24] for j in range(len(t) - 23)})) for i, t in texts if t and len(t) > 23]
    assert sorted(tuple(r) for r in found.collect()) == want
    monkeypatch.setattr(T, "LONG_TEXT", 1000)
    short = T.shingle_counts(spark.createDataFrame(texts, "id long, text string"), "text", ["id"])
    assert plan(short).split("Union")[1].split("HashAggregate")[0].count("Exchange") == 0


def test_tokens_are_decoded_once(spark):
    token = spark.createDataFrame([("00",)], "t string")
    for decode, what in ((T.decode_hex, "unhex("), (T.decode_base64, "try_to_binary("), (T.decode_url, "url_decode(")):
        text = token.select(decode(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert text.lower().count(what) <= 1 and "lambda" in text


def test_candidates_are_peeled_once(spark):
    payloads = spark.createDataFrame([("a", None, "61" * 40)], "id string, parent string, text string")
    text = labels.decode_chains(payloads)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("unhex") <= 2  # of a byte-escaped and of a hexadecimal token


def test_resources_are_made_canonical_before_rows_meet(spark):
    p = spark.range(3).selectExpr("1 as world", "id as pred_id", "1 as from_agent", "2 as to_agent", "3 as reader_exchange", "'m' as read_message", "0 as read_part", "0 as read_start", "9 as read_end", "'channel' as route_kind", "array('A', 'b') as resource_keys")
    l = spark.range(2).selectExpr("1 as world", "id as label_ord", "'content' as expects", "'t' as tier", "1 as from_agent", "2 as to_agent", "3 as reader_exchange", "'channel' as route_kind", "'a' as resource_key", "'m' as loc_message", "0 as loc_part", "1 as loc_start", "2 as loc_end")
    found = score.align(p, l, F.lower)
    assert found.count() == 6
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert joins and not any("lower(" in x for x in joins)


@pytest.mark.parametrize("n", [40, 400])
def test_rows_that_say_the_same_meet_once(spark, n):
    """Predictions, labels and controls of one place each: pairs do not grow with their numbers."""
    where = "1 as world, 1 as from_agent, 2 as to_agent, 3 as reader_exchange".split(", ")
    p = spark.range(n).selectExpr(*where, "id as pred_id", "'m' as read_message", "0 as read_part", "0 as read_start", "9 as read_end", "'direct' as route_kind", "array('r') as resource_keys", "'exact' as class", "cast(null as string) as origin_message", "0 as origin_start", "0 as origin_end")
    l = spark.range(n).selectExpr(*where, "id as label_ord", "'content' as expects", "concat('t', id) as tier", "'direct' as route_kind", "'r' as resource_key", "'m' as loc_message", "0 as loc_part", "1 as loc_start", "2 as loc_end")
    c = spark.range(n).selectExpr(*where, "id as control_ord", "cast(null as string) as at_message", "0 as at_start", "0 as at_end", "cast(null as string) as origin_message", "0 as origin_start", "0 as origin_end", "concat('r', id) as reason", "'t' as tier")
    met = []

    def seen(f):
        def inner(*a):
            met.append(f(*a).count())
            return f(*a)

        return inner

    with pytest.MonkeyPatch.context() as m:
        m.setattr(score, "_aligned", seen(score._aligned))
        first = score.first_aligned(p, l).collect()
        found = score.label_outcomes(p, l).collect()
    assert met == [1, 1]
    assert sorted(r["pred_id"] for r in first) == list(range(n)) and {r["tier"] for r in first} == {"t0"}
    assert len(found) == n and all(r["found"] and not r["suspected"] for r in found)
    under = score.under_control(p, c).collect()
    assert len(under) == n and {(r["control_ord"], r["reason"]) for r in under} == {(0, "r0")}


def test_windows_are_never_broadcast(spark):
    """Windows are taken for as few as the texts they are made of, so their joins must not ask for sizes."""
    turns = spark.createDataFrame([(1, a, p, ("assistant", "user")[(a + p) % 2], f"text of {a} and {p} " * 5) for a in range(4) for p in range(4)], "world long, agent long, pos long, role string, text string")
    pieces = D.cut_pieces(D.parts_in_order(turns))
    windows = D.window_rows(pieces, 24)
    spans = D.spans_between(windows.filter("kind = 'w'").select("world", "step", "at", "off"), pieces, 24, 24, 20)
    posted = D.postings(windows, spans, 24)
    for df in (spans, posted, D.shingle_lookup(windows.filter("kind <> 'w'"), posted)):
        assert "Broadcast" not in plan(df)


def test_needles_are_looked_for_at_blanks(spark, monkeypatch):
    """No window of every place: needles long enough after a blank, before one or as one word."""
    found = []
    monkeypatch.setattr(T, "shingles", lambda *a: found.append(a) or pytest.fail("every window of the texts"))
    said = ["it is one that has a longer part behind", "considerably so", "unintelligibility", "x Straße über alles"]
    needles = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "needle_id int, needle string")
    texts = spark.createDataFrame([(1, " and ".join(said)), (2, "\\n".join(said).replace(" ", "\\n")), (3, "  İ  " + " or  ".join(x.upper() for x in said[:3])), (4, "inconsiderably sober unintelligibilitys"), (5, "nothing")], "text_id int, text string")
    rows = labels.find_occurrences(needles, texts).collect()
    assert not found
    text = {r["text_id"]: r["text"] for r in texts.collect()}
    got = {(r["needle_id"], r["text_id"], r["class"], text[r["text_id"]][r["start"] : r["stop"]]) for r in rows}
    want = {(i, 1, "exact", x) for i, x in enumerate(said)} | {(i, 2, "exact" if " " not in x else "decoded:json_string", x.replace(" ", "\\n")) for i, x in enumerate(said)}
    want |= {(i, 3, "normalized", x.upper()) for i, x in enumerate(said[:3])} | {(1, 4, "exact", said[1]), (2, 4, "exact", said[2])}
    assert got == want and len(rows) == len(want)


def test_places_of_escapes(spark):
    parts = ["ab", "\\n", " c\\\"d", "\\t", "é" * 300, "\\r\\n"] * 60
    text = "".join(parts)
    row = spark.createDataFrame([(text,)], "t string").select(T.unescape_once(F.col("t")).alias("u"), T.escape_places(F.col("t")).alias("e"), *[T.count_below(T.in_blocks(T.escape_places(F.col("t"))), F.lit(x)).alias(f"n{x}") for x in (0, 3, 5000, 10**6)]).first()
    undone = text.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace('\\"', '"')
    assert row["u"] == undone and row["e"] == [i for i, c in enumerate(undone) if c in '\n\t\r"']
    assert [row[f"n{x}"] for x in (0, 3, 5000, 10**6)] == [sum(e < x for e in row["e"]) for x in (0, 3, 5000, 10**6)]


def test_agents_are_told_apart_among_repeated_windows_only(spark):
    names = "world long, agent long, step long, kind string, at int, codec string, ts int, te int, h long, off int"
    rows = [(1, 1, 1, "w", 0, None, -1, -1, 7, 0), (1, 2, 2, "d", 4, "hex", 4, 60, 7, 3), (1, 2, 3, "r", 0, None, -1, -1, 7, 5), (1, 2, 3, "r", 0, None, -1, -1, 8, 6), (2, 2, 3, "r", 0, None, -1, -1, 7, 0)]
    found = D.repeated_windows(spark.createDataFrame(rows, names))
    columns = [*[c.split()[0] for c in names.split(", ")], "first"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == [(*rows[0], 1), (*rows[1], 3), (*rows[2], 3)]
    text = plan(found)
    assert text.index("Window [min(") < text.index("> 1)") < text.index("Window [count(")


def test_examples_are_all_false_positives_in_full(spark):
    sf = "/root/testdata/sf0.01"
    false = score_queries.judge(spark, sf).filter("outcome = 'false'").select("world", "pred_id")
    found = score_queries.examples(spark, sf).select("world", "pred_id", F.length("excerpt")).collect()
    whole = false.join(table(spark, sf, "documents", F.col("doc_id").alias("pred_id"), F.length("text")), "pred_id", "left").select("world", *[F.col(c) for c in ("pred_id", "length(text)")])
    assert len(found) > 25 and sorted(map(tuple, found)) == sorted(map(tuple, whole.collect()))
    assert max(r[2] for r in found) > 240


def some_turns(spark):
    said = ["the wise old harbour master keeps the lamp lit until dawn", "and nobody has ever asked that master why it is so", "hm"]
    rows = [(w, a, p, ("user", "assistant")[p % 2], " ".join(said[(w + a * p + i) % 3] for i in range(1 + (a + p) % 3))) for w in range(5) for a in range(4) for p in range(6)]
    return spark.createDataFrame(rows, "world long, agent long, pos long, role string, text string")


def test_texts_are_shuffled_and_windows_are_not(spark, monkeypatch):
    """No exchange above the rows of windows."""
    monkeypatch.setattr(D, "TASK_CHARS", 500)
    pieces = D.folded_pieces(D.cut_pieces(D.parts_in_order(some_turns(spark))))
    pieces = spark.createDataFrame(pieces.collect(), pieces.schema)
    marked, seen = D.marked_runs(pieces, 24), D.seen_runs(pieces, 24)
    spans = D.spans_of(seen, pieces, 24, 24, 20)
    posted = spark.createDataFrame(spans.select("world", *D.SPAN, F.expr("said[0].text").alias("text")).collect(), "world long, sagent long, sstep int, sat int, s int, e int, text string")
    shared = D.shared_runs(D.texts_read(pieces), posted, 24, 24, 50)
    for df in (marked, seen, shared):
        windows, texts = plan(df).rsplit("Generate", 1)
        assert "Exchange" not in windows and "Exchange hashpartitioning(" in texts and df.count() > 0


def test_worlds_of_many_characters_are_not_one_task(spark, monkeypatch):
    turns = some_turns(spark)
    want = sorted(map(str, D.detect(turns).collect()))
    joins = []
    monkeypatch.setattr(D, "TASK_CHARS", 500)
    for most in (900, 1):  # some worlds, or agents, and all of them
        monkeypatch.setattr(D, "MOST_CHARS", most)
        monkeypatch.setattr(D.T, "shingles", lambda *a, f=T.shingles: joins.append(a) or f(*a))
        assert sorted(map(str, D.detect(turns).collect())) == want
        monkeypatch.undo()
        monkeypatch.setattr(D, "TASK_CHARS", 500)
    assert len(want) > 20 and len(joins) == 8  # both passes, of the rest and of large worlds


def test_spans_keep_their_new_windows(spark):
    """What a span posts is its new windows: short runs of seen ones lie inside it."""
    pieces = spark.createDataFrame([(1, 7, 3, "w", 0, "abcdefghijklmnop"), (1, 7, 4, "r", 0, "abcdefghijklmnop")], "world long, agent long, step long, kind string, at int, piece string")
    seen = spark.createDataFrame([(1, 3, 0, lo, hi) for lo, hi in ((2, 2), (5, 6), (8, 11))], "world long, step long, at int, lo int, hi int")
    rows = D.spans_of(seen, pieces, 4, 4, 0).collect()
    assert sorted((r["s"], r["e"], sorted((x["a"], x["text"]) for x in r["said"])) for r in rows) == [(0, 11, [(0, "abcde"), (3, "defgh"), (7, "hijk")]), (12, 16, [(12, "mnop")])]


def test_postings_are_shuffled_once(spark, monkeypatch):
    """A token's postings are counted where they meet; they are not joined with their counts."""
    edges = []
    monkeypatch.setattr(jaccard, "components", lambda df, f=jaccard.components: edges.append(df) or f(df))
    texts = [(i, " ".join(f"w{j}" for j in range(i // 3 * 5, i // 3 * 5 + 40)) + (" x" if i % 3 == 2 else "")) for i in range(30)]
    found = jaccard.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i // 3 * 3) for i in range(30)}
    text = plan(edges[0])
    assert "hashpartitioning(token" in text and not any("Join" in x and "token" in x for x in text.splitlines())


def test_streams_keep_texts_and_no_windows(spark):
    assert not any(" h long" in schema for schema in online.STATE.values())
