"""Order, clocks, sessions and as-of pairing, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.operators.scans import Running, first_of_each, row_numbers, running, spaced


def strictly_increasing(df: DataFrame, keys: list[str], time: str, tie: list[str]) -> DataFrame:
    """Column at: time, raised to one more than the row before where it does not exceed it."""
    rows = running(df, keys, [time, *tie], {"__rn": row_numbers()})
    rows = running(rows, keys, [time, *tie], {"__top": Running("max", F.col(time) - F.col("__rn"))})
    return rows.withColumn("at", F.col("__rn") + F.col("__top")).drop("__rn", "__top")


def gap_clock(df: DataFrame, keys: list[str], order: list[str], gap: str) -> DataFrame:
    """Column at: the running sum of gaps; null and negative gaps count as none."""
    return running(df, keys, order, {"at": Running("sum", F.greatest(F.coalesce(F.col(gap), F.lit(0)), F.lit(0)))})


def paced_clock(df: DataFrame, key: Column, major: str, mean: int, jitter: int) -> DataFrame:
    """Column at: major * mean plus a seeded jitter of at most `jitter` either way."""
    seed = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return df.withColumn("at", F.col(major) * mean + F.pmod(seed, F.lit(2 * jitter + 1)) - jitter)


def cut_sessions(df: DataFrame, keys: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Column context: how many boundaries there are up to a row."""
    return running(df, keys, order, {"context": Running("sum", F.when(boundary, 1).otherwise(0))})


def first_delivery(df: DataFrame, keys: list[str], item: str, order: list[str]) -> DataFrame:
    """The first row of each item per key, with the number of later ones as redelivered."""
    by = Window.partitionBy(*keys, item)
    rows = df.withColumn("__rn", F.row_number().over(by.orderBy(*order))).withColumn("redelivered", F.count("*").over(by) - 1)
    return rows.filter("__rn = 1").drop("__rn")


def shifted_day(time: Column, hours: int = 10) -> Column:
    """The day that begins at this hour."""
    return F.to_date(time - F.expr(f"interval {hours} hours"))


def exchange_order(df: DataFrame, at: str, agent: str, id_: str, session: str) -> DataFrame:
    """Columns ord (in the world), ordinal (in the session) and previous (exchange of the agent)."""
    order = [at, agent, id_]
    rows = running(df, ["world"], order, {"ord": row_numbers()})
    rows = running(rows, ["world", session], order, {"ordinal": row_numbers()})
    rows = running(rows, ["world", agent], order, {"previous": Running("last", F.col(id_), before=True)})
    return rows.withColumns({c: F.col(c).cast("int") for c in ("ord", "ordinal")})


def write_read_pairs(accesses: DataFrame) -> DataFrame:
    """(read_id, write_id, resource, reader, writer, cross_day): a read pairs with the latest earlier
    write of its resource that was not rejected, if another agent made it."""
    good = F.when((F.col("op") == "write") & ~F.col("rejected"), F.struct("id", "agent", "at"))
    rows = running(accesses.filter("resource is not null"), ["resource"], ["at", "agent", "id"], {"w": Running("last", good, before=True)})
    rows = rows.filter("op = 'read' and w is not null and w.agent <> agent")
    day = lambda c: F.floor(c / 86_400_000_000)
    return rows.select(F.col("id").alias("read_id"), F.col("w.id").alias("write_id"), "resource", F.col("agent").alias("reader"), F.col("w.agent").alias("writer"), (day(F.col("at")) != day(F.col("w.at"))).alias("cross_day"))


def access_stats(accesses: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: reads, accepted and rejected writes, resources, pairs, cross-day pairs."""
    a = accesses.agg(F.count_if(F.col("op") == "read").alias("reads"), F.count_if((F.col("op") == "write") & ~F.col("rejected")).alias("writes"), F.count_if((F.col("op") == "write") & F.col("rejected")).alias("rejected"), F.count_distinct("resource").alias("resources"))
    p = pairs.agg(F.count("*").alias("pairs"), F.count_if("cross_day").alias("cross_day"))
    return a.join(p, F.lit(True))  # two single rows


def state_asof(events: DataFrame, probes: DataFrame, key: str, default) -> DataFrame:
    """probes (key, at, id) with value: of the latest event at or before it, else of the first after, else the default.

    What comes after a probe is the last before it in descending order, so that both frames grow
    row by row.
    """
    e = events.select(key, "at", F.lit(0).alias("side"), F.col("id"), F.col("value"))
    p = probes.select(key, "at", F.lit(1).alias("side"), F.col("id"), F.lit(None).cast(events.schema["value"].dataType).alias("value"))
    order = ["at", "side", "id"]
    rows = running(e.union(p), [key], order, {"last": Running("last", F.col("value"))})
    rows = running(rows, [key], order, {"after": Running("last", F.col("value"))}, backward=True)
    return rows.filter("side = 1").select("id", key, "at", F.coalesce("last", "after", F.lit(default)).alias("value"))


def active_at(intervals: DataFrame, probes: DataFrame, key: str, grain: int) -> DataFrame:
    """(probe, interval) pairs with start <= at < end, or no end, of equal keys.

    intervals: id, key, start, end; probes: id, key, at. Time is a binary tree over units of `grain`
    between the first and the last probe. An interval becomes the largest nodes that cover it, two
    a level at most however long it is, and an open one the nodes up to the last probe; a probe
    becomes its path of nodes. Nodes of an interval are apart, so a pair meets once, and only the
    units at an interval's ends meet probes in vain. Nulls in key, start or at match nothing.
    """
    ends = probes.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, -1)
    base, units = lo // grain, hi // grain - lo // grain + 1
    levels = max(units, 1).bit_length()
    unit = lambda t: F.expr(f"({t} - pmod({t}, {grain})) div {grain} - {base}")
    first, last = F.greatest(unit("start"), F.lit(0)), F.least(F.coalesce(unit("end - 1"), F.lit(units - 1)), F.lit(units - 1)) + 1
    spans = intervals.filter("start is not null and (end is null or end > start)").select(F.col("id").alias("interval"), key, "start", "end", first.alias("l"), last.alias("r")).filter("l < r")
    # at each level what is left of the span is [l, r); an odd end is a node of this level
    nodes = F.expr(f"""flatten(transform(sequence(0, {levels}), v -> array(
        case when -shiftright(-l, v) < shiftright(r, v) and pmod(-shiftright(-l, v), 2) = 1 then struct(v as level, -shiftright(-l, v) as node) end,
        case when -shiftright(-l, v) < shiftright(r, v) and pmod(shiftright(r, v), 2) = 1 then struct(v as level, shiftright(r, v) - 1 as node) end)))""")
    covered = spans.select("interval", key, "start", "end", F.explode(F.filter(nodes, lambda n: n.isNotNull())).alias("n")).select("interval", key, "start", "end", "n.level", "n.node")
    path = probes.filter("at is not null").select(F.col("id").alias("probe"), key, "at", unit("at").alias("u")).select("probe", key, "at", F.explode(F.expr(f"transform(sequence(0, {levels}), v -> struct(v as level, shiftright(u, v) as node))")).alias("n"))
    met = path.select("probe", key, "at", "n.level", "n.node").join(covered, [key, "level", "node"])
    return met.filter("start <= at and (end is null or at < end)").select("probe", "interval")


def next_delivery(posts: DataFrame, calls: DataFrame, members: DataFrame, horizon: int) -> DataFrame:
    """(post, agent, call): a post reaches each other member of its room at the member's next call
    within the horizon. posts: id, room, agent, at; calls: id, agent, at; members: room, agent.

    A call is the next one of all times since its agent's call before, no longer ago than the
    horizon. Calls as such intervals meet posts by room and slot of time, a slot being as long as the
    horizon, so that an interval lies in two slots at most; pairs come out of this join and go nowhere else.
    """
    c = running(calls.select("agent", "at", F.col("id").alias("call")), ["agent"], ["at", "call"], {"before": Running("last", F.col("at"), before=True)})
    c = c.withColumn("since", F.greatest(F.col("before") + 1, F.col("at") - horizon)).filter("since <= at")  # of calls at one time the first is the next one
    c = c.select("agent", "call", "since", F.col("at").alias("until"), F.explode(F.expr(f"sequence(since div {horizon}, at div {horizon})")).alias("slot")).join(members, "agent")
    p = posts.select("room", F.expr(f"at div {horizon}").alias("slot"), F.col("id").alias("post"), F.col("agent").alias("author"), "at")
    met = p.join(c, ["room", "slot"]).filter("agent <> author and since <= at and at <= until")
    return met.select("post", "agent", "call")


def nth_occurrence_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of a and b with equal keys paired one to one in order; columns of b get the prefix b_."""
    x = a.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_a)))
    y = b.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_b)))
    y = y.select(*keys, "__n", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    return x.join(y, [*keys, "__n"]).drop("__n")


def zip_in_order(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """The k-th row of a key in a beside the k-th in b, whatever they hold."""
    return nth_occurrence_join(a, b, keys, order_a, order_b)


def pair_tool_results(turns: DataFrame) -> DataFrame:
    """(traj, result_pos, call_pos): a result answers the call with its id; results without an id
    answer the oldest open call without one; call_pos is null where none is open.

    turns: traj, pos, kind (call, result or other), call_id.
    """
    ided = turns.filter("call_id is not null and kind = 'result'").select("traj", F.col("pos").alias("result_pos"), "call_id").join(turns.filter("kind = 'call' and call_id is not null").groupBy("traj", "call_id").agg(F.min("pos").alias("call_pos")), ["traj", "call_id"], "left").select("traj", "result_pos", "call_pos")
    rows = turns.filter("call_id is null and kind in ('call', 'result')")
    by = Window.partitionBy("traj").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum(F.when(F.col("kind") == "call", 1).otherwise(-1)).over(upto)
    rows = rows.withColumn("s", s).withColumn("low", F.least(F.lit(0), F.coalesce(F.min("s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = rows.withColumn("paired", (F.col("kind") == "result") & (F.col("s") >= F.col("low")))
    rows = rows.withColumn("k", F.when(F.col("kind") == "call", F.sum(F.when(F.col("kind") == "call", 1)).over(upto)).when(F.col("paired"), F.sum(F.when(F.col("paired"), 1)).over(upto)))
    calls = rows.filter("kind = 'call'").select("traj", "k", F.col("pos").alias("call_pos"))
    fifo = rows.filter("kind = 'result'").select("traj", "k", F.col("pos").alias("result_pos")).join(calls, ["traj", "k"], "left").select("traj", "result_pos", "call_pos")
    return ided.union(fifo)


def session_owner(claims: DataFrame) -> DataFrame:
    """(session, owner, agents, conflict): the agent with the best priority, then the smallest name."""
    own = claims.groupBy("session").agg(F.min(F.struct("priority", "agent"))["agent"].alias("owner"), F.count_distinct("agent").alias("agents"))
    return own.withColumn("conflict", F.col("agents") > 1)


def session_ordinals(exchanges: DataFrame) -> DataFrame:
    """exchanges (session, exchange, at, turn) with ordinal, their place in their session from 0 by
    (at, exchange), and mismatch: the client's own turn is known and is another. Exchanges without a
    session have no place and go."""
    rows = running(exchanges.filter("session is not null"), ["session"], ["at", "exchange"], {"ordinal": row_numbers()})
    return rows.withColumn("ordinal", F.col("ordinal") - 1).withColumn("mismatch", F.coalesce(F.col("turn") != F.col("ordinal"), F.lit(False)))


def turn_mismatches(exchanges: DataFrame, owners: DataFrame) -> DataFrame:
    """(session, exchange, turn, ordinal): exchanges of owned sessions (session_owner) whose turn is not their place."""
    rows = session_ordinals(exchanges).filter("mismatch").join(owners.select("session"), "session", "left_semi")
    return rows.select("session", "exchange", "turn", "ordinal")


def first_carrier(locations: DataFrame, carried: DataFrame) -> DataFrame:
    """(id, exchange): the agent's first exchange that carries the message, else the world's first, else null.

    locations: id, world, agent, message; carried: world, agent, message, exchange, ord.
    """
    own = carried.groupBy("world", "agent", "message").agg(F.min(F.struct("ord", "exchange"))["exchange"].alias("own"))
    any_ = carried.groupBy("world", "message").agg(F.min(F.struct("ord", "exchange"))["exchange"].alias("other"))
    return locations.join(own, ["world", "agent", "message"], "left").join(any_, ["world", "message"], "left").select("id", F.coalesce("own", "other").alias("exchange"))


def authored_line_found(writes: DataFrame, reads: DataFrame, min_chars: int = 24, min_letters: int = 20) -> DataFrame:
    """(read_id, write_id, line): the longest line of the write that stands in the read, first of equals.

    writes: write_id, key, text; reads: read_id, write_id, text. A line must be long and wordy enough.
    """
    w = writes.select("write_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    w = w.filter((F.length("line") >= min_chars) & (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= min_letters))
    met = reads.join(w, "write_id").filter(F.col("text").contains(F.col("line")))
    best = met.groupBy("read_id", "write_id").agg(F.max(F.struct(F.length("line").alias("l"), (-F.col("n")).alias("n"), "line"))["line"].alias("line"))
    return best


def run_window(rows: DataFrame, run: DataFrame, lead: int, slack: int) -> DataFrame:
    """rows (session, at) with part: inside [start - lead, end + slack] of the run, else reused_session
    if the session is also inside, else outside. run: at."""
    bounds = run.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    rows = rows.join(F.broadcast(bounds), F.lit(True))  # one row
    inside = (F.col("at") >= F.col("lo") - lead) & (F.col("at") <= F.col("hi") + slack)
    sessions = rows.filter(inside).select("session").distinct().withColumn("used", F.lit(True))
    out = rows.withColumn("inside", F.coalesce(inside, F.lit(False))).join(sessions, "session", "left")
    return out.withColumn("part", F.when(F.col("inside"), "inside").when(F.col("used"), "reused_session").otherwise("outside")).drop("lo", "hi", "inside", "used")


def split_worlds(df: DataFrame, listed: DataFrame, split: str, world: str = "world") -> DataFrame:
    """dev: the rows of listed worlds; holdout: all others."""
    return df.join(listed.select(world).distinct(), world, "left_semi" if split == "dev" else "left_anti")


def missing_worlds(df: DataFrame, listed: DataFrame, world: str = "world") -> DataFrame:
    """Listed worlds that df does not have."""
    return listed.select(world).distinct().join(df.select(world).distinct(), world, "left_anti")


def stratified_round_robin(df: DataFrame, strata: str, order: list[str], limit: int, per_stratum: int | None = None) -> DataFrame:
    """One row of each stratum in turn until there are `limit`; `order` should leave no ties."""
    rows = first_of_each(df, [strata], order, min(limit, per_stratum or limit))
    return rows.orderBy("place", strata).limit(limit).drop("place")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Of each key the rows at places i * count div n, i = 0 .. n - 1, each once; `order` should leave no ties."""
    return spaced(df, keys, order, n)


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Column rank: a row's place from 0 in the order of the whole table.

    Rows are sorted by range, and each range's first rank is the sum of the sizes before it: the
    only window over all is one row per range.
    """
    from driftspan.sources.io import checkpointed

    rows = checkpointed(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("__p", before.alias("__b")), "__p").withColumn("rank", F.col("__b") + F.col("__i")).drop("__m", "__p", "__i", "__b")


def batch_worlds(df: DataFrame, traj: str, n: int) -> DataFrame:
    """Column batch: every n trajectories in order share one."""
    t = global_rank(df.select(traj).distinct(), [traj])
    return df.join(t.select(traj, F.expr(f"rank div {n}").alias("batch")), traj)


def new_inputs(messages: DataFrame) -> DataFrame:
    """(agent, exchange, message, n): messages of a request beyond those of the agent's previous
    exchange, as a multiset. messages: agent, exchange, ord, side (request or response), pos, message."""
    ex = messages.select("agent", "exchange", "ord").distinct()
    prev = ex.withColumn("prev", F.lag("exchange").over(Window.partitionBy("agent").orderBy("ord"))).select("agent", "exchange", "prev")
    had = messages.groupBy("agent", F.col("exchange").alias("prev"), "message").agg(F.count("*").alias("had"))
    req = messages.filter("side = 'request'").groupBy("agent", "exchange", "message").agg(F.count("*").alias("n"))
    rows = req.join(prev, ["agent", "exchange"]).join(had, ["agent", "prev", "message"], "left")
    return rows.withColumn("n", F.col("n") - F.coalesce("had", F.lit(0))).filter("n > 0").select("agent", "exchange", "message", "n")


def calls_from_cumulative(requests: DataFrame) -> DataFrame:
    """(session, ord, response, prefix): of each session row but the last, the first assistant message
    that the next row has beyond this one's, and whether the next row begins with this one.

    requests: session, ord, history (array of struct(role, text)).
    """
    by = Window.partitionBy("session").orderBy("ord")
    rows = requests.withColumn("next", F.lead("history").over(by)).filter("next is not null")
    size = F.size("history")
    beyond = F.filter(F.slice("next", size + 1, F.greatest(F.size("next"), F.lit(1))), lambda m: m["role"] == "assistant")
    return rows.select("session", "ord", F.get(beyond, 0)["text"].alias("response"), (F.slice("next", 1, F.greatest(size, F.lit(1))) == F.col("history")).alias("prefix"))


def two_sided_views(records: DataFrame) -> DataFrame:
    """(dialogue, pos, side, role, text): one dialogue as both sides see it: the own turns as
    assistant, the peer's as user; tool results go to their requestor only."""
    a = records.select("dialogue", "pos", F.lit("agent").alias("side"), F.when(F.col("speaker") == "agent", "assistant").when(F.col("speaker") == "user", "user").otherwise("tool").alias("role"), "text", "speaker", "requestor")
    u = records.select("dialogue", "pos", F.lit("user").alias("side"), F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "agent", "user").otherwise("tool").alias("role"), "text", "speaker", "requestor")
    return a.unionByName(u).filter((F.col("speaker") != "tool") | (F.col("requestor") == F.col("side"))).drop("speaker", "requestor")


def dedup_messages(messages: DataFrame) -> DataFrame:
    """(world, message_id, role, text, first_use): each message of a world once, by content."""
    id_ = F.sha2(F.concat_ws("\u0001", "role", F.coalesce("text", F.lit(""))), 256)
    return messages.groupBy("world", id_.alias("message_id")).agg(F.min(F.struct("pos", "agent")).alias("f"), F.first("role").alias("role"), F.first("text").alias("text")).select("world", "message_id", "role", "text", F.col("f.pos").alias("first_pos"), F.col("f.agent").alias("first_agent"))


def event_id(at_us: Column, *parts: Column) -> Column:
    """A time-ordered id: milliseconds in 12 hex digits, then 20 of a digest of the parts."""
    return F.concat(F.lpad(F.hex(F.floor(at_us / 1000).cast("long")), 12, "0"), F.upper(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 20)))


def background_controls(agents: DataFrame, exchanges: DataFrame, planted: DataFrame) -> DataFrame:
    """(world, sender, reader_exchange, reason): every sender and exchange of another agent of the
    world, but planted pairs; shared_source within a group, else boilerplate.

    agents: world, agent, grp; exchanges: world, agent, exchange; planted: world, sender, reader_exchange.
    """
    s = agents.select("world", F.col("agent").alias("sender"), F.col("grp").alias("s_grp"))
    r = exchanges.join(agents, ["world", "agent"])
    met = r.join(s, "world").filter("sender <> agent").select("world", "sender", F.col("exchange").alias("reader_exchange"), F.when(F.col("grp") == F.col("s_grp"), "shared_source").otherwise("boilerplate").alias("reason"))
    return met.join(planted, ["world", "sender", "reader_exchange"], "left_anti")


def action_stats(events: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: how many events each action set has, and how many agents."""
    return events.agg(*[F.count_if(F.col("event_type").isin(*v)).alias(k) for k, v in sets.items()], F.count_distinct("agent").alias("agents"))


def family_stats(revisions: DataFrame) -> DataFrame:
    """(family, pages, multi_author, revisions) from revisions (family, page, author)."""
    pages = revisions.groupBy("family", "page").agg(F.count_distinct("author").alias("authors"), F.count("*").alias("n"))
    return pages.groupBy("family").agg(F.count("*").alias("pages"), F.count_if(F.col("authors") > 1).alias("multi_author"), F.sum("n").alias("revisions"))


def coverage_share(content: DataFrame, earlier: DataFrame, keys: list[str], k: int = 24) -> DataFrame:
    """keys, share, forwarding: how much of a text the windows of earlier texts cover; half is forwarding.

    content: keys, grp, text; earlier: grp, text of the same group.
    """
    from driftspan.functions import text as T

    mine = T.shingles(content.select(*keys, "grp", "text"), "text", k)
    theirs = T.shingles(earlier.select("grp", "text"), "text", k).select("grp", "h").distinct().hint("merge")  # taken for as few as the texts
    runs = T.covered_runs(mine.join(theirs, ["grp", "h"], "left_semi"), keys, k).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"))
    out = content.select(*keys, F.length("text").alias("n")).join(runs, keys, "left")
    share = F.coalesce(F.try_divide(F.col("covered").cast("double"), "n"), F.lit(0.0))
    return out.select(*keys, share.alias("share"), (share >= 0.5).alias("forwarding"))
