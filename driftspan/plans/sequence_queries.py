"""Queries of clocks, sessions, as-of pairing and sampling over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.operators import sequence as Q
from driftspan.sources.adapters import ACCESS_SQL, TURNS_SQL, access_log, conversation_turns, table

from .registry import query

MINUTE = 60_000_000


@query(f"with {ACCESS_SQL} select id, agent, rn + max(t - rn) over (partition by agent order by t, id rows unbounded preceding) as at from (select *, tm // 3600000000 t, row_number() over (partition by agent order by tm // 3600000000, id) rn from accesses)")
def strictly_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour, so that times tie."""
    a = access_log(spark, sf_dir).withColumn("t", F.expr("at div 3600000000")).drop("at")
    return Q.strictly_increasing(a, ["agent"], "t", ["id"]).select("id", "agent", "at")


@query(f"with {ACCESS_SQL} select id, sum(greatest(coalesce(g, 0), 0)) over (partition by agent order by at0, id rows unbounded preceding)::bigint as at from (select id, agent, tm as at0, tm - lag(tm) over (partition by agent order by id) g from accesses)")
def gap_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = access_log(spark, sf_dir).withColumn("g", F.col("at") - F.lag("at").over(Window.partitionBy("agent").orderBy("id"))).withColumnRenamed("at", "at0")
    return Q.gap_clock(a, ["agent"], ["at0", "id"], "g").select("id", "at")


@query("select event_id, event_id * 1000 + ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % 401 - 200 as at from events")
def paced_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id")
    return Q.paced_clock(e, F.col("event_id").cast("string"), "event_id", 1000, 200).select("event_id", "at")


@query(f"with {ACCESS_SQL} select id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by agent order by tm, id rows unbounded preceding)::bigint context from accesses")
def cut_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cut_sessions(access_log(spark, sf_dir), ["agent"], ["at", "id"], F.col("event_type") == "signup").select("id", "context")


@query(f"with {ACCESS_SQL} select id, agent, resource, redelivered from (select *, row_number() over (partition by agent, resource order by tm, id) rn, count(*) over (partition by agent, resource) - 1 redelivered from accesses) where rn = 1")
def first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_delivery(access_log(spark, sf_dir), ["agent"], "resource", ["at", "id"]).select("id", "agent", "resource", "redelivered")


@query("select (ts - interval 10 hours)::date::varchar as day, count(*) n from events group by 1")
def shifted_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "ts").groupBy(Q.shifted_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"""with {ACCESS_SQL} select id, row_number() over (partition by id % 5 order by tm, agent, id) ord, row_number() over (partition by id % 5, resource order by tm, agent, id) ordinal,
    lag(id) over (partition by id % 5, agent order by tm, agent, id) previous from accesses""")
def exchange_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir).withColumn("world", F.col("id") % 5)
    return Q.exchange_order(a, "at", "agent", "id", "resource").select("id", "ord", "ordinal", "previous")


PAIRS_SQL = f"""{ACCESS_SQL}, lw as (select *, last_value(case when op = 'write' and not rejected then id end ignore nulls) over (partition by resource order by tm, agent, id rows between unbounded preceding and 1 preceding) wid from accesses where resource is not null),
pairs as (select r.id read_id, w.id write_id, r.resource, r.agent reader, w.agent writer, r.tm // 86400000000 <> w.tm // 86400000000 cross_day from lw r join accesses w on w.id = r.wid where r.op = 'read' and w.agent <> r.agent)"""


@query(f"with {PAIRS_SQL} select * from pairs")
def write_read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.write_read_pairs(access_log(spark, sf_dir))


@query(f"""with {PAIRS_SQL} select count(*) filter (where op = 'read') reads, count(*) filter (where op = 'write' and not rejected) writes, count(*) filter (where op = 'write' and rejected) rejected,
    count(distinct resource) resources, (select count(*) from pairs) pairs, (select count(*) from pairs where cross_day) cross_day from accesses""")
def access_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir)
    return Q.access_stats(a, Q.write_read_pairs(a))


@query(f"""with {ACCESS_SQL}, e as (select agent, tm, id, resource from accesses where event_type = 'signup'), p as (select agent, tm, id from accesses)
    select p.id, p.agent, p.tm as at, coalesce((select arg_max(resource, (e.tm, e.id)) from e where e.agent = p.agent and e.tm <= p.tm), (select arg_min(resource, (e.tm, e.id)) from e where e.agent = p.agent and e.tm > p.tm), 'none') as value from p""")
def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir)
    events = a.filter("event_type = 'signup'").select("agent", "at", "id", F.col("resource").alias("value"))
    return Q.state_asof(events, a.select("agent", "at", "id"), "agent", "none")


@query(f"""with {ACCESS_SQL}, i as (select id, agent, tm as s, case when id % 13 = 0 then tm + 3155760000000000 when id % 7 = 0 then tm + 60000000 when id % 9 <> 0 then tm + 7200000000 * (1 + id % 12) end e from accesses where event_type = 'purchase'), p as (select id, agent, tm from accesses where op = 'read')
    select p.id probe, i.id as "interval" from p join i on p.agent = i.agent and s <= p.tm and (e is null or p.tm < e)""")
def active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a minute, of hours, of a hundred years, and open ones."""
    a = access_log(spark, sf_dir)
    length = F.when(F.col("id") % 13 == 0, 3_155_760_000_000_000).when(F.col("id") % 7 == 0, MINUTE).when(F.col("id") % 9 != 0, 7_200_000_000 * (1 + F.col("id") % 12))
    i = a.filter("event_type = 'purchase'").select("id", "agent", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return Q.active_at(i, a.filter("op = 'read'").select("id", "agent", "at"), "agent", MINUTE)


@query(f"""with {ACCESS_SQL}, m as (select distinct agent % 12 room, agent from accesses), p as (select id, agent % 12 room, agent, tm from accesses where event_type = 'purchase'), c as (select id, agent, tm from accesses where op = 'read'),
    t as (select p.id post, m.agent, p.tm from p join m on m.room = p.room and m.agent <> p.agent), x as (select t.post, t.agent, t.tm, c.id call, c.tm cat, row_number() over (partition by t.post, t.agent order by c.tm, c.id) rn from t join c on c.agent = t.agent and c.tm >= t.tm)
    select post, agent, call from x where rn = 1 and cat - tm <= 14400000000""")
def next_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir).withColumn("room", F.col("agent") % 12)
    return Q.next_delivery(a.filter("event_type = 'purchase'").select("id", "room", "agent", "at"), a.filter("op = 'read'").select("id", "agent", "at"), a.select("room", "agent").distinct(), 240 * MINUTE)


_AB = f"""{ACCESS_SQL}, a as (select id, agent, resource, row_number() over (partition by agent, resource order by tm, id) n, row_number() over (partition by agent order by tm, id) m from accesses where op = 'read'),
    b as (select id b_id, agent, resource, row_number() over (partition by agent, resource order by id) n, row_number() over (partition by agent order by id) m from accesses where op = 'write')"""


@query(f"with {_AB} select a.agent, a.resource, a.id, b_id from a join b on a.agent = b.agent and a.resource = b.resource and a.n = b.n")
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = access_log(spark, sf_dir)
    return Q.nth_occurrence_join(l.filter("op = 'read'").select("agent", "resource", "id", "at"), l.filter("op = 'write'").select("agent", "resource", "id"), ["agent", "resource"], ["at", "id"], ["id"]).drop("at")


@query(f"with {_AB} select a.agent, a.id, b_id from a join b on a.agent = b.agent and a.m = b.m")
def zip_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = access_log(spark, sf_dir)
    return Q.zip_in_order(l.filter("op = 'read'").select("agent", "id", "at"), l.filter("op = 'write'").select("agent", "id"), ["agent"], ["at", "id"], ["id"]).drop("at")


@query(f"""with recursive {ACCESS_SQL}, t as (select agent traj, row_number() over (partition by agent order by tm, id) pos, case when op = 'write' or id % 3 = 0 then 'call' else 'result' end kind from accesses),
    q as (select traj, pos, kind, case when kind = 'call' then [pos] else []::bigint[] end open, null::bigint call_pos from t where pos = 1
        union all select t.traj, t.pos, t.kind, case when t.kind = 'call' then list_append(open, t.pos) else open[2:] end, case when t.kind = 'result' then open[1] end from q join t on t.traj = q.traj and t.pos = q.pos + 1)
    select traj, pos result_pos, call_pos from q where kind = 'result'""")
def pair_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = access_log(spark, sf_dir)
    t = a.select(F.col("agent").alias("traj"), F.row_number().over(Window.partitionBy("agent").orderBy("at", "id")).cast("long").alias("pos"), F.when((F.col("op") == "write") | (F.col("id") % 3 == 0), "call").otherwise("result").alias("kind"), F.lit(None).cast("string").alias("call_id"))
    return Q.pair_tool_results(t)


@query(f"""with {ACCESS_SQL}, c as (select resource as session, agent, id % 4 as priority from accesses where resource is not null)
    select session, arg_min(agent, priority * 1000000 + agent) as owner, count(distinct agent) agents, count(distinct agent) > 1 conflict from c group by 1""")
def session_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.session_owner(access_log(spark, sf_dir).filter("resource is not null").select(F.col("resource").alias("session"), "agent", (F.col("id") % 4).alias("priority")))


_SESSION_SQL = f"{TURNS_SQL}, o as (select agent as session, agent * 100 + pos as exchange, pos // 2 as turn, row_number() over (partition by agent order by pos) - 1 as ordinal from turns where role = 'assistant')"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions, of which the client counts two turns for each of the model's."""
    t = conversation_turns(spark, sf_dir).filter("role = 'assistant'")
    return t.selectExpr("agent as session", "agent * 100 + pos as exchange", "pos as at", "pos div 2 as turn")


@query(f"with {_SESSION_SQL} select session, exchange, turn, ordinal, turn <> ordinal as mismatch from o")
def session_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.session_ordinals(_sessions(spark, sf_dir)).drop("at")


@query(f"with {_SESSION_SQL} select session, exchange, turn, ordinal from o where turn <> ordinal and session % 3 <> 0")
def turn_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third session has no owner."""
    rows = _sessions(spark, sf_dir)
    owners = Q.session_owner(rows.filter("session % 3 <> 0").selectExpr("session", "session as agent", "turn as priority"))
    return Q.turn_mismatches(rows, owners)


@query(f"""with {ACCESS_SQL}, c as (select id % 6 as world, agent, resource as message, id as exchange, tm as ord from accesses), l as (select id, id % 6 as world, (agent * 7) % 150 as agent, resource as message from accesses)
    select l.id, coalesce((select arg_min(exchange, (ord, exchange)) from c where c.world = l.world and c.agent = l.agent and c.message = l.message), (select arg_min(exchange, (ord, exchange)) from c where c.world = l.world and c.message = l.message)) as exchange from l""")
def first_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir).withColumn("world", F.col("id") % 6)
    carried = a.select("world", "agent", F.col("resource").alias("message"), F.col("id").alias("exchange"), F.col("at").alias("ord"))
    return Q.first_carrier(a.select("id", "world", ((F.col("agent") * 7) % 150).alias("agent"), F.col("resource").alias("message")), carried)


@query("""with w as (select doc_id write_id, n, trim(line) line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents)
    where length(trim(line)) >= 24 and length(regexp_replace(trim(line), '[^\\p{L}]', '', 'g')) >= 20), r as (select doc_id read_id, doc_id - 1 write_id, text from documents union all select doc_id, doc_id, text from documents),
    m as (select read_id, r.write_id, line, row_number() over (partition by read_id, r.write_id order by length(line) desc, n) rn from r join w on w.write_id = r.write_id and contains(text, line)) select read_id, write_id, line from m where rn = 1""")
def authored_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    reads = d.select(F.col("doc_id").alias("read_id"), (F.col("doc_id") - 1).alias("write_id"), "text").union(d.select("doc_id", "doc_id", "text"))
    return Q.authored_line_found(d.select(F.col("doc_id").alias("write_id"), "text"), reads)


@query(f"""with {ACCESS_SQL}, b as (select min(tm) lo, max(tm) hi from accesses where id between 2000 and 4000), i as (select a.id, resource, tm >= lo - 60000000 and tm <= hi + 3600000000 inside from accesses a, b)
    select id, case when inside then 'inside' when resource in (select resource from i where inside) then 'reused_session' else 'outside' end part from i""")
def run_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = access_log(spark, sf_dir)
    return Q.run_window(a.select("id", F.col("resource").alias("session"), "at"), a.filter("id between 2000 and 4000"), MINUTE, 60 * MINUTE).select("id", "part")


@query(f"with {TURNS_SQL} select world, agent, count(*) n from turns where world % 2 = 0 group by 1, 2")
def split_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    return Q.split_worlds(t, t.filter("world % 2 = 0").select("world"), "dev").groupBy("world", "agent").agg(F.count("*").alias("n"))


@query(f"with {TURNS_SQL} select world, agent, count(*) n from turns where world % 2 <> 0 group by 1, 2")
def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    return Q.split_worlds(t, t.filter("world % 2 = 0").select("world"), "holdout").groupBy("world", "agent").agg(F.count("*").alias("n"))


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) rn from documents) where rn <= 4 order by rn, source limit 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stratified_round_robin(table(spark, sf_dir, "documents", "doc_id", "source"), "source", ["doc_id"], 50, 4)


@query("select doc_id, lang from (select *, row_number() over (partition by lang order by doc_id) - 1 i, count(*) over (partition by lang) c from documents) where i in (select k * c // 7 from range(0, 7) r(k))")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.evenly_spaced(table(spark, sf_dir, "documents", "doc_id", "lang"), ["lang"], ["doc_id"], 7)


@query("with t as (select user_id, (row_number() over (order by user_id) - 1) // 8 as batch from (select distinct user_id from events)) select batch, count(*) n, count(distinct e.user_id) agents from events e join t using (user_id) group by 1")
def batch_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.batch_worlds(table(spark, sf_dir, "events", "user_id"), "user_id", 8).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("agents"))


_MSG = f"""{TURNS_SQL}, ex as (select agent, pos from turns where role = 'assistant'), em as (select e.agent, e.pos exchange, 'request' side, t.pos, t.role || ':' || t.text message from ex e join turns t on t.agent = e.agent and t.pos < e.pos
    union all select e.agent, e.pos, 'response', t.pos, t.role || ':' || t.text from ex e join turns t on t.agent = e.agent and t.pos = e.pos)"""


@query(f"""with {_MSG}, pv as (select agent, pos exchange, lag(pos) over (partition by agent order by pos) prev from ex), rq as (select agent, exchange, message, count(*) n from em where side = 'request' group by 1, 2, 3), hd as (select agent, exchange, message, count(*) h from em group by 1, 2, 3),
    d as (select rq.agent, rq.exchange, rq.message, n - coalesce(h, 0) n from rq join pv using (agent, exchange) left join hd on hd.agent = rq.agent and hd.exchange = pv.prev and hd.message = rq.message) select agent, exchange, md5(message) as message, n from d where n > 0""")
def new_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    ex = t.filter("role = 'assistant'").select("agent", F.col("pos").alias("exchange"))
    m = ex.join(t.select("agent", "pos", F.concat("role", F.lit(":"), "text").alias("message")), "agent").filter("pos <= exchange")
    m = m.select("agent", "exchange", F.col("exchange").alias("ord"), F.when(F.col("pos") == F.col("exchange"), "response").otherwise("request").alias("side"), "pos", F.md5("message").alias("message"))
    return Q.new_inputs(m)


@query(f"""with {TURNS_SQL}, ex as (select agent, pos, lead(pos) over (partition by agent order by pos) nxt from turns where role = 'user')
    select agent as session, pos as ord, (select arg_min(text, t.pos) from turns t where t.agent = ex.agent and t.pos > ex.pos and t.pos <= ex.nxt and t.role = 'assistant') as response, true as prefix from ex where nxt is not null""")
def calls_from_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    user = t.filter("role = 'user'").select("agent", F.col("pos").alias("ord"))
    h = user.join(t, "agent").filter("pos <= ord").groupBy(F.col("agent").alias("session"), "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("history"))
    return Q.calls_from_cumulative(h)


_VIEW = "case when turn % 4 = 3 then 'tool' when role = 'assistant' then 'agent' else 'user' end"


@query(f"""with r as (select conv_id dialogue, turn pos, {_VIEW} speaker, case when turn % 8 = 3 then 'agent' else 'user' end requestor, text from conversations), s as (select * from r, (values ('agent'), ('user')) v(side))
    select dialogue, pos, side, case when speaker = 'tool' then 'tool' when speaker = side then 'assistant' else 'user' end as role, text from s where speaker <> 'tool' or requestor = side""")
def two_sided_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return Q.two_sided_views(c.select(F.col("conv_id").alias("dialogue"), F.col("turn").alias("pos"), F.expr(_VIEW).alias("speaker"), F.when(F.col("turn") % 8 == 3, "agent").otherwise("user").alias("requestor"), "text"))


@query(f"with {TURNS_SQL} select world, sha256(role || chr(1) || coalesce(text, '')) message_id, any_value(role) as role, any_value(text) as text, min(pos) first_pos, arg_min(agent, pos * 1000000 + agent) first_agent from turns group by 1, 2")
def dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dedup_messages(conversation_turns(spark, sf_dir))


@query("select event_id, lpad(upper(to_hex(epoch_us(ts) // 1000)), 12, '0') || upper(substr(sha256('events' || chr(1) || event_id::varchar), 1, 20)) as exchange_id from events")
def exchange_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", Q.event_id(F.unix_micros(F.col("ts").cast("timestamp")), F.lit("events"), F.col("event_id").cast("string")).alias("exchange_id"))


@query(f"""with {TURNS_SQL}, a as (select distinct world, agent, agent % 3 grp from turns), e as (select t.world, t.agent, t.agent * 100 + pos exchange, grp from turns t join a using (world, agent) where role = 'assistant')
    select e.world, a.agent sender, exchange reader_exchange, case when e.grp = a.grp then 'shared_source' else 'boilerplate' end reason from e join a on a.world = e.world and a.agent <> e.agent where not (a.agent % 4 = 0 and exchange % 4 = 1)""")
def background_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    agents = t.select("world", "agent", (F.col("agent") % 3).alias("grp")).distinct()
    ex = t.filter("role = 'assistant'").select("world", "agent", (F.col("agent") * 100 + F.col("pos")).alias("exchange"))
    planted = ex.filter("exchange % 4 = 1").select("world", F.col("exchange").alias("reader_exchange")).join(agents.filter("agent % 4 = 0").select("world", F.col("agent").alias("sender")), "world")
    return Q.background_controls(agents, ex, planted)


@query("select count(*) filter (where event_type in ('click', 'view')) looking, count(*) filter (where event_type in ('signup', 'purchase')) acting, count(distinct user_id) agents from events")
def action_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.action_stats(access_log(spark, sf_dir), {"looking": ("click", "view"), "acting": ("signup", "purchase")})


@query("select event_type family, count(*) pages, count(*) filter (where a > 1) multi_author, sum(n)::bigint revisions from (select event_type, json_extract_string(props, '$.k') k, count(distinct user_id) a, count(*) n from events group by 1, 2) group by 1")
def family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.family_stats(access_log(spark, sf_dir).select(F.col("event_type").alias("family"), F.col("resource").alias("page"), F.col("agent").alias("author")))


@query(f"""with {TURNS_SQL}, mine as (select agent, world, pos, text from turns where pos >= 2), th as (select distinct world, substr(text, o + 1, 24) h from turns, range(0, greatest(length(text) - 23, 0)) r(o) where pos < 2),
    w as (select agent, pos, o from mine m, range(0, greatest(length(text) - 23, 0)) r(o) where (world, substr(text, o + 1, 24)) in (select world, h from th)), c as (select agent, pos, count(distinct k) c from w, range(o, o + 24) s(k) group by 1, 2)
    select m.agent, m.pos, coalesce(c / nullif(length(text), 0), 0) share, coalesce(c / nullif(length(text), 0), 0) >= 0.5 forwarding from mine m left join c using (agent, pos)""")
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir).withColumn("grp", F.col("world"))
    return Q.coverage_share(t.filter("pos >= 2"), t.filter("pos < 2"), ["agent", "pos"])
