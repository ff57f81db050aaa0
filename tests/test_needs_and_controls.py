"""What a label needs, controls by rule against controls by pair, ordinals of sessions."""

import itertools

import pytest
from pyspark.sql import functions as F

from driftspan.operators import labels as L
from driftspan.operators import score as S
from driftspan.operators import sequence as Q

SAID = 'say "a"\nnow'
ONCE, TWICE = r"say \"a\"\nnow", r"say \\\"a\\\"\\nnow"


@pytest.mark.parametrize(
    ("response", "read", "need"),
    [
        ("x abc def", "abc def", "exact"), ("abc def", "x abc def", "semantic"), ("", "", "exact"), ("abc", "", "exact"), ("abc", " \n", "semantic"), ("abc", None, "semantic"), (None, "abc", "semantic"),
        ("Abc  D", "abc d \n", "normalized"), (SAID, ONCE, "decoded"), (ONCE, SAID, "decoded"), (SAID, TWICE, "two_string_levels"), (TWICE, SAID, "two_string_levels"), (ONCE, TWICE, "decoded"),
        (SAID, r"say \\\\\\\"a\\\\\\\"\\\\\\nnow", "decoded"), ("SAY \"A\" NOW", ONCE, "decoded"), ("abc", "zzz", "semantic"), (r"C:\new", r"c:\NEW ", "normalized"), ("tab\there", r"tab\there", "decoded"), ("aéb", r"A\u00e9B", "decoded"),
    ],
)
def test_match_need(spark, response, read, need):
    row = spark.createDataFrame([(response, read)], "r string, n string").select(L.match_need(F.col("r"), F.col("n")).alias("g")).first()
    assert row["g"] == need


PREDICTION = "world int, pred_id int, from_agent string, to_agent string, reader_exchange int, route_kind string, class string, resource_keys array<string>, read_message string, read_part int, read_start int, read_end int, origin_message string, origin_start int, origin_end int"
CONTROL = "world int, control_ord int, from_agent string, to_agent string, reader_exchange int, at_message string, at_start int, at_end int, origin_message string, origin_start int, origin_end int, reason string, tier string"
LABEL = "world int, label_ord int, expects string, tier string, from_agent string, to_agent string, reader_exchange int, route_kind string, resource_key string, loc_message string, loc_part int, loc_start int, loc_end int"


def test_rules_judge_as_pairs_do(spark):
    members = [(w, a, g) for w in (1, 2) for a, g in (("a", "x"), ("b", "x"), ("c", "y"), ("d", None))]
    agents = spark.createDataFrame(members + members[:1], "world int, agent string, grp string")  # a repeated row
    exchanges = spark.createDataFrame([(w, a, 10 * i + w) for i, (w, a, _) in enumerate(members)] + [(1, "nobody", 99)], "world int, agent string, exchange int")
    planted = spark.createDataFrame([(1, "a", 11), (2, "c", 42)], "world int, sender string, reader_exchange int")
    pairs = [(w, s, t, x) for w, s, t in itertools.product((1, 2), "abcd", "abcd") for x in [10 * i + v for i, (v, r, _) in enumerate(members) if (v, r) == (w, t)]] + [(1, "a", "nobody", 99), (1, "a", "b", 5), (3, "a", "b", 11)]
    rows = [(w, n, s, t, x, "direct", ("exact", "discarded", "suspected")[n % 3], [], "m", 0, 0, 9, None, None, None) for n, (w, s, t, x) in enumerate(pairs)]
    predictions = spark.createDataFrame(rows, PREDICTION)
    fixed = [(1, 1, "b", "c", 21, None, None, None, None, None, None, "explicit", "likely"), (1, 2, "c", "b", None, None, None, None, None, None, None, "any", "likely"), (1, 3, "b", "a", 1, "m", 3, 4, None, None, None, "placed", "likely")]
    controls, labels = spark.createDataFrame(fixed, CONTROL), spark.createDataFrame([], LABEL)
    exemptions = spark.createDataFrame([(1, "d", 31, "m", 0, 5)], "world int, to_agent string, reader_exchange int, at_message string, at_start int, at_end int")
    coverage = spark.createDataFrame([(1, "structural"), (2, None), (3, None)], "world int, coverage_tier string")
    by_pair = Q.background_controls(agents.distinct(), exchanges, planted).join(exchanges.select("world", F.col("exchange").alias("reader_exchange"), F.col("agent").alias("to_agent")), ["world", "reader_exchange"])
    none = lambda kind: F.lit(None).cast(kind)
    by_pair = by_pair.select("world", F.lit(1000), F.col("sender"), "to_agent", "reader_exchange", none("string"), none("int"), none("int"), none("string"), none("int"), none("int"), "reason", F.lit("structural"))
    rules = S.background_rules(agents, exchanges, planted)
    assert rules.count() == 8 + 8 + 2
    out = lambda df: sorted(tuple(r) for r in df.select("pred_id", "outcome", F.coalesce("tier", F.lit("-")), F.coalesce("reason", F.lit("-"))).collect())
    ruled = out(S.judge(predictions, labels, controls, exemptions, coverage, rules=rules))
    assert ruled == out(S.judge(predictions, labels, controls.union(by_pair), exemptions, coverage))
    assert {r[3] for r in ruled} >= {"-", "explicit", "boilerplate", "shared_source"}
    empty = S.background_rules(agents.limit(0), exchanges.limit(0), planted.limit(0))
    assert out(S.judge(predictions, labels, controls, exemptions, coverage, rules=empty)) == out(S.judge(predictions, labels, controls, exemptions, coverage))


def test_ordinals_and_turns(spark):
    rows = [("s", 3, 30, 1), ("s", 1, 10, 0), ("s", 2, 10, 5), ("s", 4, 40, None), ("t", 9, 1, 7), (None, 8, 1, 7)]
    exchanges = spark.createDataFrame(rows, "session string, exchange int, at int, turn int")
    found = Q.session_ordinals(exchanges)
    assert sorted((r["session"], r["exchange"], r["ordinal"], r["mismatch"]) for r in found.collect()) == [("s", 1, 0, False), ("s", 2, 1, True), ("s", 3, 2, True), ("s", 4, 3, False), ("t", 9, 0, True)]
    owners = Q.session_owner(spark.createDataFrame([("s", "a", 1), ("s", "b", 0), ("u", "c", 0)], "session string, agent string, priority int"))
    assert sorted(tuple(r) for r in Q.turn_mismatches(exchanges, owners).collect()) == [("s", 2, 5, 1), ("s", 3, 1, 2)]
    assert Q.session_ordinals(exchanges.limit(0)).count() == 0
