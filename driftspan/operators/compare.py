"""Comparison of runs, constraint checks and table digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.operators.digest import DEPTH, differing_nodes, digest_tree


def diff_tables(a: DataFrame, b: DataFrame, key: list[str], body: list[str]) -> DataFrame:
    """key, kind, n: rows only in a, only in b, or changed, as multisets of (key, body)."""
    x = a.groupBy(*key, *body).agg(F.count("*").alias("x"))
    y = b.groupBy(*key, *body).agg(F.count("*").alias("y"))
    on = x.alias("l").join(y.alias("r"), F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in [*key, *body])), "full_outer")
    d = (F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("d")
    rows = on.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in key], d)
    sums = rows.groupBy(*key).agg(F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).alias("a"), F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0)).alias("b"))
    out = sums.withColumn("changed", F.least("a", "b"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in (("changed", F.col("changed")), ("only_a", F.col("a") - F.col("changed")), ("only_b", F.col("b") - F.col("changed")))])
    return out.select(*key, F.explode(F.filter(kinds, lambda s: s["n"] > 0)).alias("s")).select(*key, "s.kind", "s.n")


def normalize_agents(predictions: DataFrame, attributions: DataFrame) -> DataFrame:
    """predictions (world, from_detected, to_detected, ...) with detected agents named by their
    smallest exchange, and without transmission ids, so that runs compare."""
    names = attributions.groupBy("world", "detected").agg(F.min("exchange").alias("name"))
    a, b = (names.select("world", F.col("detected").alias(f"{x}_detected"), F.col("name").alias(f"{x}_name")) for x in ("from", "to"))
    out = predictions.join(a, ["world", "from_detected"], "left").join(b, ["world", "to_detected"], "left")
    return out.drop("from_detected", "to_detected", "tx_id")


def diff_fields(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """(field, n): of rows paired in order by a weak key, how often each field differs."""
    by = Window.partitionBy(*key).orderBy(*order)
    x, y = (d.withColumn("__n", F.row_number().over(by)) for d in (a, b))
    y = y.select(*key, "__n", *[F.col(f).alias(f"__{f}") for f in fields])
    met = x.join(y, [*key, "__n"])
    sums = met.agg(*[F.count_if(~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f) for f in fields])
    return sums.select(F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") as (field, n)"))


def diff_reports(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key, name, left, right: values of two reports that differ; a missing row counts as null."""
    on = a.alias("l").join(b.alias("r"), F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in key)), "full_outer")
    rows = on.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in key], F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"l.{v}").cast("double").alias("left"), F.col(f"r.{v}").cast("double").alias("right")) for v in values])).alias("s")).select(*key, "s.*")
    return rows.filter(~F.col("left").eqNullSafe(F.col("right")))


def check_inputs(agents: DataFrame, messages: DataFrame, exchanges: DataFrame, used: DataFrame) -> DataFrame:
    """(world, problem, item) of inputs that break a rule.

    agents: world, agent; messages: world, message; exchanges: world, exchange, ord, at;
    used: world, exchange, message.
    """

    def twice(df: DataFrame, item: str, problem: str) -> DataFrame:
        return df.groupBy("world", item).agg(F.count("*").alias("n")).filter("n > 1").select("world", F.lit(problem).alias("problem"), F.col(item).cast("string").alias("item"))

    missing = used.join(messages, ["world", "message"], "left_anti").select("world", F.lit("missing_message").alias("problem"), F.col("message").cast("string").alias("item")).distinct()
    unused = messages.join(used, ["world", "message"], "left_anti").select("world", F.lit("unused_message").alias("problem"), F.col("message").cast("string").alias("item")).distinct()
    late = exchanges.withColumn("__p", F.lag("at").over(Window.partitionBy("world").orderBy("ord"))).filter("__p > at").select("world", F.lit("time_order").alias("problem"), F.col("exchange").cast("string").alias("item"))
    out = twice(agents, "agent", "duplicate_agent").union(twice(messages, "message", "duplicate_message")).union(twice(exchanges, "exchange", "duplicate_exchange"))
    return out.union(missing).union(unused).union(late)


def check_labels(labels: DataFrame, agents: DataFrame, owners: DataFrame, messages: DataFrame) -> DataFrame:
    """(world, problem, item) of labels that break a rule.

    labels: world, label_id, from_agent, to_agent, sender_exchange, reader_exchange, loc_message,
    loc_start, loc_end, text, tier, need; agents: world, agent, driven; owners: world, exchange,
    agent, ord, and where it has times at, in which an agent's exchanges must not go back;
    messages: world, message, text.
    """
    say = lambda df, p: df.select("world", F.lit(p).alias("problem"), F.col("label_id").cast("string").alias("item"))
    ends = labels.select("world", "label_id", F.explode(F.array("from_agent", "to_agent")).alias("agent"))
    own = owners.select("world", F.col("exchange").alias("reader_exchange"), F.col("agent").alias("reader"), F.col("ord").alias("r_ord"))
    sent = owners.select("world", F.col("exchange").alias("sender_exchange"), F.col("agent").alias("sender"), F.col("ord").alias("s_ord"))
    read = labels.join(own, ["world", "reader_exchange"], "left")
    both = labels.filter("sender_exchange is not null").join(own, ["world", "reader_exchange"]).join(sent, ["world", "sender_exchange"])
    at = labels.join(messages.select("world", F.col("message").alias("loc_message"), F.col("text").alias("body")), ["world", "loc_message"], "left")
    cut = F.expr("substring(body, loc_start + 1, loc_end - loc_start)")
    owned = owners.join(agents, ["world", "agent"])
    out = say(labels.groupBy("world", "label_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_id")
    out = out.union(say(ends.join(agents.select("world", "agent"), ["world", "agent"], "left_anti"), "unknown_agent").distinct())
    out = out.union(say(read.filter("reader is null"), "unassigned_exchange")).union(say(read.filter("reader <> to_agent"), "wrong_owner"))
    out = out.union(say(both.filter("s_ord >= r_ord"), "sender_after_reader")).union(say(both.filter("sender <> from_agent"), "wrong_sender"))
    out = out.union(say(at.filter("body is null or loc_start < 0 or loc_end <= loc_start or loc_end > length(body)"), "location"))
    out = out.union(say(at.filter(F.expr("body is not null and loc_start >= 0 and loc_end <= length(body)") & (cut != F.col("text"))), "text_at_location"))
    out = out.union(say(labels.filter("from_agent = to_agent"), "self_send")).union(say(labels.filter("(need = 'two_string_levels') <> (tier = 'out_of_reach')"), "reach_and_tier"))
    more = owners.groupBy("world", "exchange").agg(F.count_distinct("agent").alias("n")).filter("n > 1").select("world", F.lit("twice_assigned").alias("problem"), F.col("exchange").cast("string").alias("item"))
    scripted = owned.filter("driven = 'scripted'").select("world", F.lit("scripted_owner").alias("problem"), F.col("exchange").cast("string").alias("item"))
    if "at" in owners.columns:
        back = owners.withColumn("__p", F.lag("at").over(Window.partitionBy("world", "agent").orderBy("ord"))).filter("__p > at")
        out = out.union(back.select("world", F.lit("agent_order").alias("problem"), F.col("exchange").cast("string").alias("item")))
    return out.union(more).union(scripted)


def check_label_rows(controls: DataFrame, clusters: DataFrame, exemptions: DataFrame) -> DataFrame:
    """(world, problem, item) of controls, clusters and exemptions that break a rule of their own row.

    controls: world, label_id, from_agent, to_agent, reason, reader_exchange, at_exchange, at_message,
    origin_message (null: not given); clusters: world, label_id, agents (array); exemptions: world,
    label_id, reader_exchange, at_exchange. A control is bounded by a reader exchange, a place read
    or a place written; only a self_read has one agent at both ends; a cluster has two different
    agents or more, each once; a place read lies in the reader's exchange.
    """
    say = lambda df, p: df.select("world", F.lit(p).alias("problem"), F.col("label_id").cast("string").alias("item"))
    out = say(controls.filter("from_agent = to_agent and not reason <=> 'self_read'"), "self_control")
    out = out.union(say(controls.filter("reader_exchange is null and at_message is null and origin_message is null"), "unbounded_control"))
    out = out.union(say(controls.filter("at_message is not null and at_exchange <> reader_exchange"), "elsewhere_than_reader"))
    out = out.union(say(exemptions.filter("not at_exchange <=> reader_exchange"), "elsewhere_than_reader"))
    return out.union(say(clusters.filter("coalesce(size(array_distinct(agents)), 0) < 2 or size(array_distinct(agents)) <> size(agents)"), "small_cluster"))


def check_predictions(attributions: DataFrame, transmissions: DataFrame, evidence: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(world, problem, item) of predictions that break a rule.

    attributions: world, detected, exchange; transmissions: world, tx_id, state, quality;
    evidence: world, tx_id, kind (match or co_access), pos, from_detected, to_detected,
    reader_exchange, read_exchange, read_message, read_start; exchanges: world, exchange.
    """
    say = lambda df, p, item: df.select("world", F.lit(p).alias("problem"), F.col(item).cast("string").alias("item"))
    out = say(attributions.groupBy("world", "exchange").agg(F.count("*").alias("n")).filter("n > 1"), "exchange_twice", "exchange")
    out = out.union(say(attributions.join(exchanges, ["world", "exchange"], "left_anti"), "unknown_exchange", "exchange"))
    out = out.union(say(transmissions.groupBy("world", "tx_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_tx", "tx_id"))
    ends = evidence.select("world", "tx_id", F.explode(F.array("from_detected", "to_detected")).alias("detected"))
    out = out.union(say(ends.join(attributions.select("world", "detected"), ["world", "detected"], "left_anti"), "unknown_agent", "tx_id").distinct())
    out = out.union(say(evidence.filter("read_exchange <> reader_exchange"), "exchange_mismatch", "tx_id").distinct())
    by = Window.partitionBy("world", "tx_id").orderBy("pos")
    place = F.struct("read_message", "read_start")
    out = out.union(say(evidence.filter("kind = 'match'").withColumn("__p", F.lag(place).over(by)).filter(F.col("__p") > place), "unsorted_evidence", "tx_id").distinct())
    n = evidence.groupBy("world", "tx_id").agg(F.count_if(F.col("kind") == "match").alias("m"), F.count_if(F.col("kind") == "co_access").alias("c"))
    t = transmissions.join(n, ["world", "tx_id"], "left").fillna(0, ["m", "c"])
    content = F.col("state").isin("confirmed", "classified", "aggregated")
    out = out.union(say(t.filter((content & (F.col("m") == 0)) | (F.col("state").isin("suspected", "discarded") & (F.col("c") == 0))), "state_without_evidence", "tx_id"))
    return out.union(say(t.filter((content | F.col("state").isin("suspected", "discarded")) == F.col("quality").isNull()), "quality_and_state", "tx_id"))


def manifest(tables: dict[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(world, table, level, node, rows, digest): the digest trees of every world of every table of
    an export; level 0 holds the whole world's. Null worlds are a world of their own."""
    out = None
    for name, df in sorted(tables.items()):
        part = digest_tree(df, ["world"], depth).select(F.col("world").cast("string").alias("world"), F.lit(name).alias("table"), "level", "node", "rows", "digest")
        out = part if out is None else out.union(part)
    return out


def summed_digest(row: Column) -> Column:
    """An order-free digest of rows as text: of the sum of their digests, so that no task gathers them."""
    part = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string"), 256)


def commitment(worlds: DataFrame, world: str = "world", labels: DataFrame | None = None) -> DataFrame:
    """One row: how many worlds, and an order-free commitment to which; with labels, also
    labels_digest over all their rows, columns in order of name."""
    out = worlds.select(world).distinct().agg(F.count("*").alias("worlds"), summed_digest(F.col(world).cast("string")).alias("commitment"))
    if labels is None:
        return out
    rows = labels.select(F.to_json(F.struct(*sorted(labels.columns)), {"ignoreNullFields": "false"}).alias("row"))
    return out.crossJoin(rows.agg(summed_digest(F.col("row")).alias("labels_digest")))  # one row and one row


def check_run(manifest_rows: DataFrame, found: DataFrame, status: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(world, table, problem, node): tables of a run whose world is missing, or whose count or digest is
    not the manifest's, with each range of row hashes that holds lost, added or altered rows; worlds
    that failed or were not scored are set apart, never counted as zero.

    manifest_rows, found: manifest(...), of one depth.
    """
    keys = ["world", "table"]
    x, y = (t.filter("level = 0").select(*keys, F.col("rows").alias(f"{n}_rows"), F.col("digest").alias(f"{n}_digest")) for t, n in ((manifest_rows, "m"), (found, "f")))
    rows = x.join(y, keys, "full_outer").join(status.select(F.col("world").cast("string").alias("world"), "status"), "world", "left")
    problem = (
        F.when(F.coalesce(F.col("status"), F.lit("unscored")) != "scored", F.concat(F.lit("set_apart:"), F.coalesce("status", F.lit("unscored"))))
        .when(F.col("m_rows").isNull(), "not_in_manifest").when(F.col("f_rows").isNull(), "missing")
        .when(F.col("f_rows") != F.col("m_rows"), "count").when(F.col("f_digest") != F.col("m_digest"), "digest")
    )
    rows = rows.select(*keys, problem.alias("problem")).filter("problem is not null")
    inside = F.col("problem").isin("count", "digest")
    ranges = differing_nodes(manifest_rows, found, keys, depth).select(*keys, "node")
    return rows.filter(inside).join(ranges, keys).select(*keys, "problem", "node").union(rows.filter(~inside).select(*keys, "problem", F.lit(None).cast("string").alias("node")))


def notes(rows: DataFrame) -> DataFrame:
    """(dataset, name, n): the counts of note maps (dataset, notes) added up."""
    return rows.select("dataset", F.explode("notes").alias("name", "n")).groupBy("dataset", "name").agg(F.sum("n").alias("n"))
