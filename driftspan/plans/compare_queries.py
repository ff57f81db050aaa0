"""Queries that compare runs, check constraints and find components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.operators import compare as C
from driftspan.operators import digest as D
from driftspan.operators import graph as G
from driftspan.sources import io
from driftspan.sources.adapters import ACCESS_SQL, TURNS_SQL, access_log, conversation_turns, table

from .registry import query
from .score_queries import FIX_SQL, RATES, Fixture


@query("select doc_id, n_chars from documents where lang = 'en' and n_chars > 1000")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = io.read_logs(spark, [f"{sf_dir}/documents.parquet"], columns=["doc_id", "lang", "n_chars"], include="documents")
    return d.filter("lang = 'en' and n_chars > 1000").select("doc_id", "n_chars")


_A = ("doc_id % 8 as world", "doc_id % 60 as k", "doc_id % 5 as v")
_B = ("doc_id % 8 as world", "doc_id % 61 as k", "doc_id % 4 as v")


@query(f"""with a as (select {', '.join(_A)}, count(*) n from labels group by 1, 2, 3), b as (select {', '.join(_B)}, count(*) n from labels group by 1, 2, 3),
    j as (select coalesce(a.world, b.world) world, coalesce(a.k, b.k) k, coalesce(a.n, 0) - coalesce(b.n, 0) d from a full join b on a.world = b.world and a.k = b.k and a.v = b.v),
    s as (select world, k, sum(greatest(d, 0)) a, sum(greatest(-d, 0)) b from j group by 1, 2), x as (select world, k, unnest([('changed', least(a, b)), ('only_a', a - least(a, b)), ('only_b', b - least(a, b))]) t from s)
    select world, k, t[1] as kind, t[2]::bigint as n from x where t[2] > 0""")
def diff_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return C.diff_tables(rows.selectExpr(*_A), rows.selectExpr(*_B), ["world", "k"], ["v"])


@query("""with p as (select doc_id % 8 as world, doc_id, doc_id % 20 f, doc_id % 9 t from labels), n as (select doc_id % 8 as world, doc_id % 10 as detected, min(doc_id) as name from labels group by 1, 2)
    select p.world, p.doc_id, a.name from_name, b.name to_name from p left join n a on a.world = p.world and a.detected = f left join n b on b.world = p.world and b.detected = t""")
def normalize_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    p = rows.selectExpr("doc_id % 8 as world", "doc_id", "doc_id % 20 as from_detected", "doc_id % 9 as to_detected", "doc_id as tx_id")
    return C.normalize_agents(p, rows.selectExpr("doc_id % 8 as world", "doc_id % 10 as detected", "doc_id as exchange"))


@query("""with a as (select doc_id % 30 k, doc_id, quality q, toxic t, row_number() over (partition by doc_id % 30 order by doc_id) n from labels where doc_id % 3 <> 0), b as (select doc_id % 30 k, doc_id, 1 - quality % 2 q, toxic t, row_number() over (partition by doc_id % 30 order by doc_id) n from labels where doc_id % 4 <> 0),
    m as (select a.q <> b.q q, a.t <> b.t t from a join b on a.k = b.k and a.n = b.n) select 'q' as field, count(*) filter (where q) n from m union all select 't', count(*) filter (where t) from m""")
def diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    a = rows.filter("doc_id % 3 <> 0").selectExpr("doc_id % 30 as k", "doc_id", "quality as q", "toxic as t")
    return C.diff_fields(a, rows.filter("doc_id % 4 <> 0").selectExpr("doc_id % 30 as k", "doc_id", "1 - quality % 2 as q", "toxic as t"), ["k"], ["q", "t"], ["doc_id"])


@query(f"""with {FIX_SQL}, a as (select *, {RATES} from sr where carrier = 'user'), b as (select * from a where class <> 'exact'), f as (select a.*, b.expected be, b.correct bc from a left join b on a.dataset = b.dataset and a.route_kind = b.route_kind and a.class = b.class and a.tier is not distinct from b.tier),
    x as (select dataset, route_kind, class, tier, 'expected' as name, expected::double as "left", be::double as "right" from f union all select dataset, route_kind, class, tier, 'correct', correct, bc from f) select * from x where "left" is distinct from "right" """)
def diff_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Fixture(spark, sf_dir).rows().filter("carrier = 'user'")
    return C.diff_reports(rows, rows.filter("class <> 'exact'"), ["dataset", "route_kind", "class", "tier"], ["expected", "correct"])


@query(f"""with {TURNS_SQL}, ag as (select distinct world, agent from turns union all select distinct world, agent from turns where agent % 10 = 0), ms as (select world, agent * 100 + pos message from turns where pos <> 1 union all select world, agent * 100 + 99 from turns where pos = 0 and agent % 7 = 0),
    ex as (select world, agent * 100 + pos exchange, pos * 1000 + agent ord, case when agent % 9 = 0 then 0 else pos end tm from turns where role = 'assistant'), us as (select world, agent * 100 + pos exchange, agent * 100 + pos message from turns),
    l as (select *, lag(tm) over (partition by world order by ord) p from ex)
    select world, 'duplicate_agent' as problem, agent::varchar as item from ag group by world, agent having count(*) > 1 union all select world, 'duplicate_message', message::varchar from ms group by world, message having count(*) > 1
    union all select world, 'duplicate_exchange', exchange::varchar from ex group by world, exchange having count(*) > 1 union all select distinct world, 'missing_message', message::varchar from us where (world, message) not in (select world, message from ms)
    union all select distinct world, 'unused_message', message::varchar from ms where (world, message) not in (select world, message from us) union all select world, 'time_order', exchange::varchar from l where p > tm""")
def check_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir)
    ag = t.select("world", "agent").distinct()
    ag = ag.union(ag.filter("agent % 10 = 0"))
    ms = t.filter("pos <> 1").selectExpr("world", "agent * 100 + pos as message").union(t.filter("pos = 0 and agent % 7 = 0").selectExpr("world", "agent * 100 + 99 as message"))
    ex = t.filter("role = 'assistant'").selectExpr("world", "agent * 100 + pos as exchange", "pos * 1000 + agent as ord", "case when agent % 9 = 0 then 0 else pos end as at")
    return C.check_inputs(ag, ms, ex, t.selectExpr("world", "agent * 100 + pos as exchange", "agent * 100 + pos as message"))


@query(f"""with {TURNS_SQL}, lb as (select world, agent * 100 + pos label_id, agent from_agent, case when agent % 11 = 0 then agent else agent + 1 end to_agent, agent * 100 + pos loc_message, 0 loc_start, case when agent % 5 = 0 then 100000 else 10 end loc_end,
    substr(text, 1, 10) || case when agent % 4 = 0 then 'x' else '' end text from turns where role = 'assistant'), ag as (select distinct world, agent from turns), lo as (select lb.*, t.text body from lb join turns t on t.world = lb.world and t.agent * 100 + t.pos = loc_message)
    select distinct world, 'unknown_agent' as problem, label_id::varchar as item from lb where (world, to_agent) not in (select world, agent from ag) union all select world, 'self_send', label_id::varchar from lb where from_agent = to_agent
    union all select world, 'location', label_id::varchar from lo where loc_end > length(body) union all select world, 'text_at_location', label_id::varchar from lo where loc_end <= length(body) and substr(body, 1, 10) <> text""")
def check_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with planted faults."""
    t = conversation_turns(spark, sf_dir)
    lb = t.filter("role = 'assistant'").selectExpr("world", "agent * 100 + pos as label_id", "agent as from_agent", "case when agent % 11 = 0 then agent else agent + 1 end as to_agent", "cast(null as bigint) as sender_exchange", "agent * 100 + pos as reader_exchange", "agent * 100 + pos as loc_message", "0 as loc_start", "case when agent % 5 = 0 then 100000 else 10 end as loc_end", "concat(substring(text, 1, 10), case when agent % 4 = 0 then 'x' else '' end) as text", "'likely' as tier", "'exact' as need")
    owners = lb.selectExpr("world", "reader_exchange as exchange", "to_agent as agent", "label_id as ord")
    agents = t.select("world", "agent").distinct().withColumn("driven", F.lit("model"))
    return C.check_labels(lb, agents, owners, t.selectExpr("world", "agent * 100 + pos as message", "text"))


def _export(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An export of two tables: the turns of twelve worlds, and their texts as pairs, of which one
    side is null, each twice."""
    t = conversation_turns(spark, sf_dir).withColumn("world", F.col("agent") % 12)
    pairs = t.selectExpr("world", "case when pos % 2 = 0 then text end as a", "case when pos % 2 = 1 then text end as b")
    return {"turns": t, "pairs": pairs.union(pairs).filter("world <> 9")}


def _run_of(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The export as a run has read it: turns lost (worlds 1 and 3), a letter changed (2), both copies
    of a pair replaced by another twice (4), null and value swapped (5), a table lost (8) or added (9)."""
    t = tables["turns"].filter("world not in (1, 3) or pos = 0").withColumn("text", F.expr("case when world = 2 and pos = 1 then concat(text, '.') else text end"))
    pairs = tables["pairs"].filter("world <> 8").selectExpr("world", "case when world = 4 then concat(a, '+') when world = 5 then b else a end as a", "case when world = 5 then a else b end as b")
    return {"turns": t, "pairs": pairs.union(t.filter("world = 9").selectExpr("world", "text as a", "text as b"))}


def _enc(columns: str, *names: str) -> str:
    return f"'{columns};' || " + " || ".join(f"coalesce('v' || strlen({c}::varchar) || ':' || {c}::varchar, 'n')" for c in names)


_EXPORT_SQL = f"""{TURNS_SQL}, t as (select agent % 12 as world, agent, pos, role, text from turns), p1 as (select world, case when pos % 2 = 0 then text end a, case when pos % 2 = 1 then text end b from t where world <> 9), p as (select * from p1 union all select * from p1),
    t2 as (select world, agent, pos, role, case when world = 2 and pos = 1 then text || '.' else text end as text from t where world not in (1, 3) or pos = 0),
    p2 as (select world, case when world = 4 then a || '+' when world = 5 then b else a end a, case when world = 5 then a else b end b from p where world <> 8 union all select world, text, text from t2 where world = 9),
    r as (select world, 'turns' as tb, {_enc('agent bigint,pos bigint,role string,text string,world bigint', 'agent', 'pos', 'role', 'text', 'world')} e, 0 side from t union all select world, 'turns', {_enc('agent bigint,pos bigint,role string,text string,world bigint', 'agent', 'pos', 'role', 'text', 'world')}, 1 from t2
        union all select world, 'pairs', {_enc('a string,b string,world bigint', 'a', 'b', 'world')}, 0 from p union all select world, 'pairs', {_enc('a string,b string,world bigint', 'a', 'b', 'world')}, 1 from p2),
    c as (select world, tb, e, count(*) filter (where side = 0) x, count(*) filter (where side = 1) y from r group by all)"""


@query(f"""with {_EXPORT_SQL}, w as (select world, tb, sum(x) x, sum(y) y from c group by all),
    s as (select *, case when world = 6 then 'set_apart:failed' when world = 7 then 'set_apart:unscored' when x = 0 then 'not_in_manifest' when y = 0 then 'missing' when x <> y then 'count' else 'digest' end problem from w),
    n as (select distinct world, tb, substr(sha256(e), 1, 2) node from c where x <> y)
    select s.world::varchar as world, s.tb as "table", problem, node from s join n on n.world = s.world and n.tb = s.tb where problem in ('count', 'digest') union all select world::varchar, tb, problem, null from s where problem not in ('count', 'digest')""")
def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that lost, altered and added rows of its export, failed in one world and did not score another."""
    tables = _export(spark, sf_dir)
    status = tables["turns"].select("world").distinct().filter("world <> 7").withColumn("status", F.when(F.col("world") == 6, "failed").otherwise("scored"))
    return C.check_run(C.manifest(tables), C.manifest(_run_of(tables)), status)


@query(f"""with {_EXPORT_SQL} select world, e as "row", x as n_a, y as n_b from c where tb = 'pairs' and x <> y""")
def altered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind the digests that differ, of one table of the same run."""
    one, two = _export(spark, sf_dir)["pairs"], _run_of(_export(spark, sf_dir))["pairs"]
    nodes = D.differing_nodes(D.digest_tree(one, ["world"]), D.digest_tree(two, ["world"]), ["world"])
    return D.altered_rows(one, two, nodes, ["world"])


@query(f"""with {_EXPORT_SQL} select tb as "table", world::varchar as world, length(node) as level, node, count(*) as "rows" from (select tb, world, substr(sha256(e), 1, l) node from r, range(0, 3) x(l) where side = 0) group by all""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of every world's tree and their counts, made of two halves' trees added up."""
    halves = [C.manifest({n: t.filter(f"pmod(hash(world, {'pos' if n == 'turns' else 'a'}), 2) = {k}") for n, t in _export(spark, sf_dir).items()}) for k in (0, 1)]
    return D.merged(*halves, ["world", "table"]).select("table", "world", "level", "node", "rows")


@query(f"with {TURNS_SQL}, w as (select distinct world from turns) select count(*) worlds, sha256(sum(('0x' || substr(sha256(world::varchar), 1, 12))::bigint)::varchar) as commitment from w")
def world_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.commitment(conversation_turns(spark, sf_dir))


@query("select concat('d', doc_id % 3) as dataset, case when quality = 1 then 'good' else 'bad' end as name, sum(doc_id % 7)::bigint n from labels group by 1, 2")
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.expr("concat('d', doc_id % 3)").alias("dataset"), F.create_map(F.expr("case when quality = 1 then 'good' else 'bad' end"), F.expr("doc_id % 7")).alias("notes"))
    return C.notes(rows)


@query(f"with {ACCESS_SQL} select id as node, min(id) over (partition by agent, tm // 86400000000) as component from accesses qualify count(*) over (partition by agent, tm // 86400000000) > 1")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every access linked to its agent's one before on the same day."""
    from pyspark.sql import Window

    day = Window.partitionBy("agent", F.expr("at div 86400000000")).orderBy("at", "id")
    return G.components(access_log(spark, sf_dir).select(F.col("id").alias("u"), F.lag("id").over(day).alias("v")).filter("v is not null"))


@query(f"""with {ACCESS_SQL}, e as (select distinct agent, resource || ':' || agent % 10 page, agent % 10 part from accesses where resource is not null)
    select min(page) as world, count(distinct agent) agents, count(distinct page) pages from e group by part""")
def plan_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds of all accesses; an agent's pages are those of its last digit."""
    a = access_log(spark, sf_dir).filter("resource is not null").select(F.col("agent").cast("string").alias("agent"), F.expr("concat(resource, ':', agent % 10)").alias("page"))
    return G.plan_worlds(a, 1)


@query(f"""with {TURNS_SQL}, w as (select world, agent * 100 + pos id, agent, pos from turns where role = 'assistant')
    select world, 'self_control' as problem, id::varchar as item from w where agent % 4 = 0 and agent % 8 <> 0 union all select world, 'unbounded_control', id::varchar from w where agent % 3 = 0
    union all select world, 'elsewhere_than_reader', id::varchar from w where agent % 5 = 0 union all select world, 'small_cluster', id::varchar from w where pos <= 1""")
def check_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls, exemptions and clusters made from the turns, with planted faults."""
    w = conversation_turns(spark, sf_dir).filter("role = 'assistant'").selectExpr("world", "agent * 100 + pos as label_id", "agent", "pos")
    controls = w.selectExpr("world", "label_id", "agent as from_agent", "case when agent % 4 = 0 then agent else agent + 1 end as to_agent", "case when agent % 8 = 0 then 'self_read' else 'boilerplate' end as reason", "case when agent % 3 > 0 then label_id end as reader_exchange", "label_id as at_exchange", "cast(null as bigint) as at_message", "cast(null as bigint) as origin_message")
    exemptions = w.selectExpr("world", "label_id", "label_id as reader_exchange", "case when agent % 5 = 0 then label_id + 1 else label_id end as at_exchange")
    return C.check_label_rows(controls, w.selectExpr("world", "label_id", "array(1, pos) as agents"), exemptions)
