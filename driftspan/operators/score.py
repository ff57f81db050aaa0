"""Scoring of a detector's predictions against labels, controls and exemptions.

predictions: world, pred_id, tx_id, from_agent, to_agent, reader_exchange, route_kind, carrier,
class, quality, resource_keys (array), read_message, read_part, read_start, read_end,
origin_message, origin_start, origin_end (null where unknown).
labels: world, label_ord, expects (content or access), from_agent, to_agent, reader_exchange,
route_kind, resource_key, carrier, need, tier, loc_message, loc_part, loc_start, loc_end.
controls: world, control_ord, from_agent, to_agent, reader_exchange, at_*, origin_*, reason, tier;
null means any. exemptions: world, to_agent, reader_exchange, at_*.
coverage: world, coverage_tier (null: partial).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCESS_CLASSES = ("suspected", "discarded")
#: From weakest to strongest.
CLASS_RANK = {"semantic": 0, "decoded": 1, "normalized": 2, "exact": 3}
COUNTS = ("expected", "found", "missed", "suspected", "predicted", "correct", "false_positive", "unjudged", "dismissed")


def is_content(c: Column) -> Column:
    return ~c.isin(*ACCESS_CLASSES)


#: Where a prediction and a label must be equal.
READ = ("world", "from_agent", "to_agent", "reader_exchange", "read_message", "read_part")


def _report(canon: Callable[[Column], Column]) -> Column:
    """What alignment compares of a prediction."""
    return F.struct(*READ, "read_start", "read_end", "route_kind", F.transform("resource_keys", canon).alias("resource_keys")).alias("report")


def _expected(canon: Callable[[Column], Column]) -> Column:
    """What alignment compares of a label."""
    place = [F.col("loc_message").alias("read_message"), F.col("loc_part").alias("read_part"), "loc_start", "loc_end"]
    return F.struct("world", "from_agent", "to_agent", "reader_exchange", *place, F.col("route_kind").alias("l_route"), canon(F.col("resource_key")).alias("l_resource")).alias("label")


def _aligned(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of reports (report, ...) beside the rows of expected (label, ...) that they report."""
    met = reports.select("*", "report.*").join(expected.select("*", "label.*"), list(READ))
    met = met.filter((F.col("read_start") < F.col("loc_end")) & (F.col("loc_start") < F.col("read_end")))
    shared = F.exists("resource_keys", lambda r: r == F.col("l_resource"))
    return met.filter((F.col("l_route") != "channel") | ((F.col("route_kind") == "channel") & shared))


def align(predictions: DataFrame, labels: DataFrame, canon: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(world, pred_id, label_ord, expects, tier): every pair of a prediction and a label it reports.

    Same sender, reader, reader exchange, message and part, overlapping ranges; a channel label
    needs one of the prediction's resources, both as canon() gives them. A location's own exchange,
    the class and the carrier do not matter. Resources are brought to canon() once a row, before rows meet.
    """
    met = _aligned(predictions.select("pred_id", _report(canon)), labels.select("label_ord", "expects", "tier", _expected(canon)))
    return met.select("world", "pred_id", "label_ord", "expects", "tier")


def first_aligned(predictions: DataFrame, labels: DataFrame, canon: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(world, pred_id, tier): the first label of each prediction that reports one.

    Predictions that say the same meet labels that say the same once, whatever their numbers.
    """
    each = predictions.select("world", "pred_id", _report(canon))
    one = labels.select(_expected(canon), F.struct("label_ord", "tier").alias("l")).groupBy("label").agg(F.min("l").alias("l"))
    best = _aligned(each.select("report").distinct(), one).groupBy("report").agg(F.min("l").alias("l"))
    return each.join(best, "report").groupBy("world", "pred_id").agg(F.min("l")["tier"].alias("tier"))


def under_control(predictions: DataFrame, controls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(world, pred_id, control_ord, reason, tier): the most specific control a prediction falls under.

    rules (background_rules) are controls of one exchange each, looked up by group; they have no
    control_ord and come after the controls of an exchange that have one.
    """
    # predictions and controls that say the same meet once, whatever their numbers
    each = predictions.select("world", "pred_id", F.struct("world", "from_agent", "to_agent", "reader_exchange", "read_message", "read_start", "read_end", "origin_message", "origin_start", "origin_end").alias("at"))
    c = controls.select("world", "from_agent", "to_agent", F.col("reader_exchange").alias("c_exchange"), "at_message", "at_start", "at_end", F.col("origin_message").alias("c_origin"), F.col("origin_start").alias("c_start"), F.col("origin_end").alias("c_end"), F.struct(F.col("control_ord").isNull().alias("ruled"), "control_ord", "reason", "tier").alias("c"))
    c = c.groupBy(*[x for x in c.columns if x != "c"]).agg(F.min("c").alias("c"))
    met = each.select("at").distinct().select("at", "at.*").join(c, ["world", "from_agent", "to_agent"])
    met = met.filter(
        (F.col("c_exchange").isNull() | (F.col("c_exchange") == F.col("reader_exchange")))
        & (F.col("at_message").isNull() | ((F.col("at_message") == F.col("read_message")) & (F.col("at_start") < F.col("read_end")) & (F.col("read_start") < F.col("at_end"))))
        & (F.col("c_origin").isNull() | F.coalesce((F.col("c_origin") == F.col("origin_message")) & (F.col("c_start") < F.col("origin_end")) & (F.col("origin_start") < F.col("c_end")), F.lit(False)))
    )
    rank = F.when(F.col("at_message").isNotNull(), 0).when(F.col("c_origin").isNotNull(), 1).when(F.col("c_exchange").isNotNull(), 2).otherwise(3)
    met = met.groupBy("at").agg(F.min(F.struct(rank.alias("rank"), "c.ruled", "c.control_ord", "c.reason", "c.tier")).alias("b"))
    met = each.join(met, "at").select("world", "pred_id", "b.*")
    if rules is not None:
        found = under_rules(predictions, rules)
        met = met.unionByName(found.select("world", "pred_id", F.lit(2).alias("rank"), F.lit(True).alias("ruled"), F.lit(None).cast(controls.schema["control_ord"].dataType).alias("control_ord"), "reason", "tier"))
    best = met.groupBy("world", "pred_id").agg(F.min(F.struct("rank", "ruled", "control_ord", "reason", "tier")).alias("b"))
    return best.select("world", "pred_id", "b.control_ord", "b.reason", "b.tier")


def background_rules(agents: DataFrame, exchanges: DataFrame, planted: DataFrame) -> DataFrame:
    """(world, kind, agent, exchange, grp): what sequence.background_controls says in pairs, in one
    row per agent (sender), exchange (reader, with its agent's group) and planted pair.

    A reader's exchange is a control for each other agent of its world: shared_source for senders of
    the reader's group, boilerplate for all others, and none for planted pairs. Rows are as many as
    agents, exchanges and planted pairs together. Repeated rows count once; exchanges of agents that
    are not in `agents` give none.
    """
    none = F.lit(None)
    s = agents.select("world", F.lit("sender").alias("kind"), "agent", none.cast(exchanges.schema["exchange"].dataType).alias("exchange"), "grp")
    r = exchanges.join(agents.select("world", "agent", "grp"), ["world", "agent"]).select("world", F.lit("reader").alias("kind"), "agent", "exchange", "grp")
    p = planted.select("world", F.lit("planted").alias("kind"), F.col("sender").alias("agent"), F.col("reader_exchange").alias("exchange"), none.cast(agents.schema["grp"].dataType).alias("grp"))
    return s.unionByName(r).unionByName(p).distinct()


def under_rules(predictions: DataFrame, rules: DataFrame, tier: str = "structural") -> DataFrame:
    """(world, pred_id, reason, tier) of predictions from one agent of a background world to another's exchange."""
    kind = lambda k: rules.filter(F.col("kind") == k)
    s = kind("sender").select("world", F.col("agent").alias("from_agent"), F.col("grp").alias("s_grp"))
    r = kind("reader").select("world", F.col("agent").alias("to_agent"), F.col("exchange").alias("reader_exchange"), F.col("grp").alias("r_grp"))
    p = kind("planted").select("world", F.col("agent").alias("from_agent"), F.col("exchange").alias("reader_exchange"))
    met = predictions.select("world", "pred_id", "from_agent", "to_agent", "reader_exchange").filter("from_agent <> to_agent")
    met = met.join(p, ["world", "from_agent", "reader_exchange"], "left_anti").join(r, ["world", "to_agent", "reader_exchange"]).join(s, ["world", "from_agent"])
    return met.select("world", "pred_id", F.when(F.col("s_grp") == F.col("r_grp"), "shared_source").otherwise("boilerplate").alias("reason"), F.lit(tier).alias("tier"))


def exempted(predictions: DataFrame, exemptions: DataFrame) -> DataFrame:
    """(world, pred_id) of predictions under an exemption; the sender is not compared."""
    e = exemptions.select(F.col("world").alias("w"), F.col("to_agent").alias("t"), F.col("reader_exchange").alias("x"), F.col("at_message").alias("m"), F.col("at_start").alias("a"), F.col("at_end").alias("b")).distinct()
    on = (F.col("world") == F.col("w")) & (F.col("to_agent") == F.col("t")) & (F.col("reader_exchange") == F.col("x")) & (F.col("read_message") == F.col("m")) & (F.col("a") < F.col("read_end")) & (F.col("read_start") < F.col("b"))
    return predictions.join(e, on, "left_semi").select("world", "pred_id")


def judge(predictions: DataFrame, labels: DataFrame, controls: DataFrame, exemptions: DataFrame, coverage: DataFrame, canon=lambda c: c, rules: DataFrame | None = None) -> DataFrame:
    """predictions with outcome (correct, dismissed, unjudged, false), tier and reason.

    In this order: an aligned label, discarded, an exemption, the most specific control, coverage.
    reason is the control's, also for dismissed predictions. rules are background_rules.
    """
    right = first_aligned(predictions, labels, canon).select("world", "pred_id", F.col("tier").alias("right_tier"), F.lit(True).alias("right"))
    under = under_control(predictions, controls, rules).select("world", "pred_id", F.col("reason").alias("c_reason"), F.col("tier").alias("c_tier"))
    free = exempted(predictions, exemptions).distinct().withColumn("free", F.lit(True))
    rows = predictions.join(right, ["world", "pred_id"], "left").join(under, ["world", "pred_id"], "left").join(free, ["world", "pred_id"], "left").join(coverage, "world", "left")
    outcome = F.when(F.col("right"), "correct").when(F.col("class") == "discarded", "dismissed").when(F.col("free"), "unjudged").when(F.col("c_reason").isNotNull() | F.col("coverage_tier").isNotNull(), "false").otherwise("unjudged")
    rows = rows.withColumn("outcome", outcome)
    tier = F.when(F.col("outcome") == "correct", F.col("right_tier")).when(F.col("outcome") == "false", F.coalesce("c_tier", "coverage_tier"))
    return rows.withColumn("tier", tier).withColumn("reason", F.when(F.col("outcome").isin("false", "dismissed"), F.col("c_reason"))).drop("right", "right_tier", "c_reason", "c_tier", "free", "coverage_tier")


def label_outcomes(predictions: DataFrame, labels: DataFrame, canon=lambda c: c) -> DataFrame:
    """labels with found, suspected: content finds content, access finds access, access marks content."""
    content = is_content(F.col("class"))
    reports = predictions.select(_report(canon), content.alias("content")).groupBy("report").agg(F.bool_or("content").alias("content"), F.bool_or(~F.col("content")).alias("access"))
    each = labels.select("world", "label_ord", "expects", _expected(canon))
    # labels that say the same meet reports that say the same once
    met = _aligned(reports, each.select("label").distinct()).groupBy("label").agg(F.bool_or("content").alias("content"), F.bool_or("access").alias("access"))
    wants = F.col("expects") == "content"
    own = each.join(met, "label").groupBy("world", "label_ord").agg(F.bool_or((wants & F.col("content")) | ((F.col("expects") == "access") & F.col("access"))).alias("found"), F.bool_or(wants & F.col("access")).alias("suspected"))
    return labels.join(own, ["world", "label_ord"], "left").fillna(False, ["found", "suspected"])


def score_rows(judged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The nine counts, precision and recall by dataset, route, carrier, class and tier."""
    one = lambda c: F.when(c, 1).otherwise(0)
    zero = F.lit(0)
    key = ["dataset", "route_kind", "carrier"]
    p = judged.select(*key, "class", "tier", zero.alias("expected"), zero.alias("found"), zero.alias("missed"), zero.alias("suspected"), F.lit(1).alias("predicted"), one(F.col("outcome") == "correct").alias("correct"), one(F.col("outcome") == "false").alias("false_positive"), one(F.col("outcome") == "unjudged").alias("unjudged"), one(F.col("outcome") == "dismissed").alias("dismissed"))
    need = F.when(F.col("expects") == "content", F.col("need")).otherwise("suspected")
    l = outcomes.select(*key, need.alias("class"), "tier", F.lit(1).alias("expected"), one(F.col("found")).alias("found"), one(~F.col("found")).alias("missed"), one(~F.col("found") & F.col("suspected")).alias("suspected"), zero.alias("predicted"), zero.alias("correct"), zero.alias("false_positive"), zero.alias("unjudged"), zero.alias("dismissed"))
    rows = p.union(l).groupBy(*key, "class", "tier").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_rates(rows)


def with_rates(rows: DataFrame) -> DataFrame:
    judged = F.col("correct") + F.col("false_positive")
    return rows.withColumn("precision", F.try_divide(F.col("correct").cast("double"), judged)).withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("expected")))


def score_cube(rows: DataFrame) -> DataFrame:
    """Totals of every selector: a dimension that is `*` is any; a class of `*` is content only."""
    dims = ["dataset", "route_kind", "carrier", "class", "tier"]
    sets = rows.withColumn("tier", F.coalesce("tier", F.lit("none")))
    content = sets.filter(is_content(F.col("class"))).withColumn("class", F.lit("*"))
    both = sets.union(content.select(sets.columns))
    cubed = both.cube("dataset", "route_kind", "carrier", "tier", "class").agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("class").alias("g")).filter("g = 0").drop("g")
    return with_rates(cubed.select(*[F.coalesce(d, F.lit("*")).alias(d) for d in dims], *COUNTS))


def tx_verdicts(judged: DataFrame) -> DataFrame:
    """genuine, false_detection and unlabeled transmissions by dataset, first route and quality."""
    tx = judged.groupBy("dataset", "world", "tx_id").agg(F.min(F.struct("pred_id", "route_kind", "quality")).alias("f"), F.bool_or(F.col("outcome") == "correct").alias("good"), F.bool_or(F.col("outcome") == "false").alias("bad"))
    return tx.groupBy("dataset", F.col("f.route_kind").alias("route_kind"), F.col("f.quality").alias("quality")).agg(F.count_if("good").alias("genuine"), F.count_if(F.col("bad") & ~F.col("good")).alias("false_detection"), F.count_if(~F.col("bad") & ~F.col("good")).alias("unlabeled"))


def violations(judged: DataFrame) -> DataFrame:
    """Charged controls by dataset and reason for content (class null), recorded ones by access class."""
    content = is_content(F.col("class"))
    hit = judged.filter(F.col("reason").isNotNull() & (content & (F.col("outcome") == "false") | ~content))
    return hit.groupBy("dataset", "reason", F.when(~content, F.col("class")).alias("class")).agg(F.count("*").alias("n"))


def top_sources(judged: DataFrame, texts: DataFrame, n: int = 20, chars: int = 80) -> DataFrame:
    """The n first lines on which most content predictions violated a control: reason, line, n.

    texts: world, pred_id, text read. The first non-blank line counts, white space collapsed.
    """
    line = F.substring(F.trim(F.regexp_replace(F.regexp_extract(F.col("text"), r"(?:^|\n)[ \t\r\x0b\f]*(\S[^\n]*)", 1), r"\s+", " ")), 1, chars)
    hit = judged.filter((F.col("outcome") == "false") & F.col("reason").isNotNull() & is_content(F.col("class")))
    rows = hit.join(texts, ["world", "pred_id"]).groupBy("reason", line.alias("line")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "reason", "line").limit(n)


def report_summary(rows: DataFrame, exchanges: int | Column, controls: int | Column) -> DataFrame:
    """One row: overall, out_of_reach and forwarding content counts, access recall, and false
    positives per 1,000 exchanges (null without controls)."""
    exchanges, controls = (F.lit(x) if isinstance(x, int) else x for x in (exchanges, controls))
    content = is_content(F.col("class"))
    tier = F.coalesce("tier", F.lit("none"))
    part = F.when(tier == "out_of_reach", "out_of_reach").when(tier == "forwarding", "forwarding").otherwise("overall")
    sums = [F.coalesce(F.sum(F.when(content & (part == p), F.col(c))), F.lit(0)).alias(f"{p}_{c}") for p in ("overall", "out_of_reach", "forwarding") for c in ("expected", "found", "correct", "false_positive")]
    access = (F.col("class") == "suspected") & (part == "overall")
    sums += [F.coalesce(F.sum(F.when(access, F.col(c))), F.lit(0)).alias(f"access_{c}") for c in ("expected", "found")]
    wrong = F.coalesce(F.sum(F.when(content, F.col("false_positive"))), F.lit(0))
    out = rows.agg(*sums, wrong.alias("false_positives"))
    out = out.withColumn("overall_recall", F.try_divide(F.col("overall_found").cast("double"), "overall_expected"))
    out = out.withColumn("overall_precision", F.try_divide(F.col("overall_correct").cast("double"), F.col("overall_correct") + F.col("overall_false_positive")))
    return out.withColumn("fp_per_1k", F.when(controls > 0, F.try_divide(F.col("false_positives") * 1000.0, exchanges)))


def examples(judged: DataFrame, texts: DataFrame, cap: int | None = None, chars: int | None = None) -> DataFrame:
    """The false positives, each with the text read as its excerpt; with `cap` the first so many in
    order of world and id, with `chars` the first so many characters of a text."""
    rows = judged.filter("outcome = 'false'").select("world", "pred_id", "reason")
    rows = rows if cap is None else rows.orderBy("world", "pred_id").limit(cap)
    excerpt = F.col("text") if chars is None else F.substring("text", 1, chars)
    return rows.join(texts.select("world", "pred_id", excerpt.alias("excerpt")), ["world", "pred_id"], "left")


def missed_examples(outcomes: DataFrame, texts: DataFrame, cap: int, chars: int = 240) -> DataFrame:
    """The first `cap` labels not found in order of world and label, with an excerpt of their text.

    outcomes: as of label_outcomes; texts: world, label_ord, text.
    """
    rows = outcomes.filter(~F.col("found")).select("world", "label_ord", "expects", "tier", "suspected").orderBy("world", "label_ord").limit(cap)
    return rows.join(texts.select("world", "label_ord", F.substring("text", 1, chars).alias("excerpt")), ["world", "label_ord"], "left")


def gates(rows: DataFrame, violated: DataFrame, table: DataFrame, exchanges: int) -> DataFrame:
    """(name, status, value) of every gate.

    table: name, check (recall, precision, violations, fp_per_1k), bound, and selectors dataset,
    route_kind, carrier, class, tier, reason; null is any (of class: any content). A gate of a
    dataset without rows is other_dataset; one without anything to judge is skipped.
    """
    # a row meets gates of its dataset and of any, by equality, so that neither side needs to be small
    either = lambda df: df.withColumn("of", F.explode(F.array_distinct(F.array(F.col("dataset"), F.lit(None).cast("string")))))
    g = table.select(*[F.col(c).alias(f"g_{c}") for c in table.columns])
    same = [F.col("g_dataset").eqNullSafe(F.col("of"))] + [F.col(f"g_{c}").isNull() | F.col(f"g_{c}").eqNullSafe(F.col(c)) for c in ("route_kind", "carrier", "tier")]
    same.append(F.when(F.col("g_class").isNull(), is_content(F.col("class"))).otherwise(F.col("g_class") == F.col("class")))
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    sums = g.join(either(rows), on, "left").groupBy("g_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "found", "correct", "false_positive")])
    charged = violated.filter("class is null").select("dataset", "reason", "n")
    hit = g.join(either(charged), F.col("g_dataset").eqNullSafe(F.col("of")) & (F.col("g_reason").isNull() | (F.col("g_reason") == F.col("reason"))), "left").groupBy("g_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    here = rows.select(F.col("dataset").alias("g_dataset")).distinct().withColumn("scored", F.lit(True))
    all_ = table.select(*[F.col(c).alias(f"g_{c}") for c in table.columns]).join(sums, "g_name").join(hit, "g_name").join(here, "g_dataset", "left")
    value = (
        F.when(F.col("g_check") == "recall", F.try_divide(F.col("found").cast("double"), "expected"))
        .when(F.col("g_check") == "precision", F.try_divide(F.col("correct").cast("double"), F.col("correct") + F.col("false_positive")))
        .when(F.col("g_check") == "violations", F.col("n").cast("double"))
        .otherwise(F.try_divide(F.col("false_positive") * 1000.0, F.lit(exchanges)))
    )
    floor = F.col("g_check").isin("recall", "precision")
    good = F.when(floor, value >= F.col("g_bound")).otherwise(value <= F.col("g_bound"))
    other = F.col("g_dataset").isNotNull() & F.col("scored").isNull()
    status = F.when(other, "other_dataset").when(value.isNull(), "skipped").when(good, "pass").otherwise("fail")
    return all_.select(F.col("g_name").alias("name"), status.alias("status"), F.when(~other, value).alias("value"))


def strongest(matches: DataFrame) -> DataFrame:
    """(world, tx_id, class, carrier): each transmission's strongest class, and the carrier of the
    first match of that class by place."""
    rank = F.create_map(*[x for k, v in CLASS_RANK.items() for x in (F.lit(k), F.lit(v))])
    first = F.min(F.struct((-F.try_element_at(rank, F.col("class"))).alias("r"), "read_message", "read_part", "read_start", "read_end", "pred_id", "class", "carrier"))
    return matches.groupBy("world", "tx_id").agg(first.alias("f")).select("world", "tx_id", F.col("f.class").alias("class"), F.col("f.carrier").alias("carrier"))


def predictions_of(transmissions: DataFrame, matches: DataFrame, co_access: DataFrame) -> DataFrame:
    """(world, tx_id, class, source): what transmissions predict by their state: matches of
    confirmed, classified and aggregated ones, co-accesses of suspected and discarded ones."""
    t = transmissions.select("world", "tx_id", "state")
    content = t.filter(F.col("state").isin("confirmed", "classified", "aggregated")).join(matches.select("world", "tx_id", F.col("pred_id").alias("source"), "class"), ["world", "tx_id"]).select("world", "tx_id", "class", "source")
    access = t.filter(F.col("state").isin(*ACCESS_CLASSES)).join(co_access.select("world", "tx_id", F.col("pred_id").alias("source")), ["world", "tx_id"]).select("world", "tx_id", F.col("state").alias("class"), "source")
    return content.union(access)


def attribute(predictions: DataFrame, attributions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions (world, pred_id, from_detected, to_detected) with from_agent, to_agent and status.

    status: ok; unknown_agent if an end has no exchange; failed_world if any detected agent of the
    world stands for two true agents. attributions: world, detected, exchange; truth: world,
    exchange, agent.
    """
    by = attributions.join(truth, ["world", "exchange"]).groupBy("world", "detected").agg(F.min("agent").alias("agent"), F.count_distinct("agent").alias("n"))
    failed = by.filter("n > 1").select("world").distinct().withColumn("failed", F.lit(True))
    a, b = (by.select("world", F.col("detected").alias(f"{x}_detected"), F.col("agent").alias(f"{x}_agent")) for x in ("from", "to"))
    out = predictions.join(a, ["world", "from_detected"], "left").join(b, ["world", "to_detected"], "left").join(failed, "world", "left")
    status = F.when(F.col("failed"), "failed_world").when(F.col("from_agent").isNull() | F.col("to_agent").isNull(), "unknown_agent").otherwise("ok")
    return out.withColumn("status", status).drop("failed")


def release_summary(runs: DataFrame) -> DataFrame:
    """Counts over the runs of a scenario and detector, rates derived again, runs that passed."""
    s = runs.groupBy("scenario", "detector").agg(*[F.sum(c).alias(c) for c in ("found", "expected", "correct", "false_positive", "exchanges")], F.count("*").alias("runs"), F.count_if("passed").alias("passed"))
    return with_rates(s).withColumn("fp_per_1k", F.try_divide(F.col("false_positive") * 1000.0, "exchanges"))
