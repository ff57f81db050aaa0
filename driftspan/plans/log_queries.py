"""Queries of the operators that read logs: parts, escapes, captures, deliveries, revisions, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.operators import compare as C
from driftspan.operators import labels as L
from driftspan.operators import plugins
from driftspan.operators.detect import detect
from driftspan.sources import io
from driftspan.sources.adapters import ACCESS_SQL, TURNS_SQL, access_log, conversation_turns, table

from .detect_queries import MATCHES_SQL
from .registry import query

_KIND = "case agent % 3 when 0 then 'text' when 1 then 'tool_call' else 'tool_result' end"


@query(f"with {TURNS_SQL}, t as (select *, {_KIND} k from turns) select world, agent * 100 + pos as message, 0 as part, k as part_type, case k when 'tool_result' then role || chr(10) || text else text end as text from t union all select world, agent * 100 + pos, 2, 'reasoning', role from t")
def explode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages of a part by agent, a media part and a reasoning part."""
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    part = lambda kind, text=none, args=none, lines=texts: F.struct(kind.alias("type"), text.alias("text"), args.alias("args"), lines.alias("texts"))
    first = part(F.expr(_KIND), F.when(F.col("agent") % 3 == 0, F.col("text")), F.when(F.col("agent") % 3 == 1, F.col("text")), F.when(F.col("agent") % 3 == 2, F.array("role", "text")))
    m = conversation_turns(spark, sf_dir).select("world", F.expr("agent * 100 + pos").alias("message"), F.array(first, part(F.lit("media")), part(F.lit("reasoning"), F.col("role"))).alias("parts"))
    return L.explode_parts(m)


@query(f"""with {TURNS_SQL} select agent * 100 + pos id, 0 part, case agent % 3 when 0 then 'reasoning' else 'text' end as "type", text, null as "name" from turns
    union all select agent * 100 + pos, 1, 'tool_call', '{{"at":' || pos || '}}', role from turns""")
def provider_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the responses of three providers, each a text and a call."""
    t = conversation_turns(spark, sf_dir)
    at, text, role = F.struct(F.col("pos").alias("at")), F.col("text"), F.col("role")
    a = F.concat(F.lit('{"content":['), F.to_json(F.struct(F.lit("thinking").alias("type"), text.alias("thinking"))), F.lit(","), F.to_json(F.struct(F.lit("tool_use").alias("type"), role.alias("name"), at.alias("input"))), F.lit("]}"))
    o = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content"), F.array(F.struct(F.struct(role.alias("name"), F.to_json(at).alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    g = F.concat(F.lit('{"candidates":[{"content":{"parts":['), F.to_json(F.struct(text.alias("text"))), F.lit(","), F.to_json(F.struct(F.struct(role.alias("name"), at.alias("args")).alias("functionCall"))), F.lit("]}}]}"))
    body = F.when(F.col("agent") % 3 == 0, a).when(F.col("agent") % 3 == 1, o).otherwise(g)
    return L.provider_parts(t.select(F.expr("agent * 100 + pos").alias("id"), body.alias("body")))


@query(f"with {TURNS_SQL} select world, count(*) n, sum(length(text))::bigint chars, 1 as tables from turns group by 1")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as an export, read back without its label tables."""
    t = conversation_turns(spark, sf_dir).withColumn("dataset", F.lit("conversations"))
    at = f"{io.shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    io.write_export({"turns": t, "labels_tx": t.select("dataset", "world").distinct()}, at)
    back = io.read_export(spark, at, ["turns", "labels_tx"], inputs_only=True)
    return back["turns"].groupBy("world").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("tables", F.lit(len(back)))


def _escaped(text: Column) -> Column:
    """A text inside a JSON string literal, letters beyond ASCII among the escapes, and an emoji as two."""
    out = text
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("é", "\\u00e9")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.concat(out, F.lit("\\ud83d\\ude00"))


@query("select doc_id, md5(text || '😀') as digest, length(text) + 1 as chars from documents where text is not null")
def unescape_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", T.unescape_once(_escaped(F.col("text"))).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query(r"with f as (select agent, pos, ltrim(regexp_replace(lower(text || '😀'), '\s+', ' ', 'g'), ' ') f from (select conv_id agent, turn pos, text from conversations where text is not null)) select agent, pos, md5(f) as digest, length(f) as chars, true as in_order from f")
def fold_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped turns, folded with the raw place of each character."""
    t = conversation_turns(spark, sf_dir).filter("text is not null").select("agent", "pos", T.fold_mapped(_escaped(F.col("text"))).alias("f"))
    ordered = F.forall(F.sequence(F.lit(0), F.size("f.starts") - 1), lambda i: (F.get("f.starts", i) < F.get("f.ends", i)) & F.coalesce(F.get("f.ends", i) <= F.get("f.starts", i + 1) + 1000, F.lit(True)))
    return t.select("agent", "pos", F.md5("f.folded").alias("digest"), F.size("f.starts").alias("chars"), ordered.alias("in_order"))


@query("""select doc_id, 0 as "at", length('{"signature": ') as chars from documents union all select doc_id, length('{"signature": "' || md5(text) || '"'), length('} ' || text || ' ') from documents union all select doc_id, length('{"signature": "' || md5(text) || '"} ' || text || ' c__thought__QQ=='), 2 from documents""")
def mask_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a signature and before a call id that embeds one."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.select("doc_id", F.concat(F.lit('{"signature": "'), F.md5("text"), F.lit('"} '), "text", F.lit(" c__thought__QQ== x")).alias("text"))
    return T.mask_opaque(d, "text").select("doc_id", "at", F.length("piece").alias("chars"))


_GOOD = r"text like '% %' and length(text) >= 24 and length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 20 and not regexp_matches(text, '[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]')"


#: Layers around a text, outermost first, by doc_id % 6.
_LAYERS = ("hex", "url", "base64.hex", "hex.base64.url", "byte_escape.base64.hex", "base64.hex.base64.hex.base64.url")
_PAYLOADS = "text like '% % % %' and trim(text) = text and length(text) >= 24"
_CHAIN_SQL = f"""ch as (select doc_id, trim(text) as text, ['{"', '".join(_LAYERS)}'][doc_id % 6 + 1] as chain from documents where {_GOOD} and {_PAYLOADS})"""


@query(f"with {_CHAIN_SQL} select doc_id::varchar id, chain, text as decoded, len(string_split(chain, '.'))::int as depth, doc_id % 3 = 0 as corroborated from ch")
def decode_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads under one to six layers; every third has a child."""
    return _chains(spark, sf_dir)


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter(_PAYLOADS)
    wrap = {
        "hex": lambda c: F.hex(F.encode(c, "UTF-8")), "base64": lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", ""), "url": lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")),
        "byte_escape": lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"\\x$1"),
    }
    coded = F.col("text")
    for k, layers in enumerate(_LAYERS):
        body = F.col("text")
        for layer in reversed(layers.split(".")):
            body = wrap[layer](body)
        coded = F.when(F.col("doc_id") % 6 == k, body).otherwise(coded)
    own = d.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("run "), coded).alias("text"))
    child = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("parent"), F.lit("plain").alias("text"))
    return L.decode_chains(own.union(child))


@query(f"with {_CHAIN_SQL} select chain, count(*) tokens, sum(length(text))::bigint chars, count(*) filter (where doc_id % 3 = 0) corroborated from ch group by 1")
def chain_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chain_tally(_chains(spark, sf_dir))


#: What is read and of which response, by doc_id % 8.
_NEEDS = ("exact", "decoded", "normalized", "two_string_levels", "decoded", "two_string_levels", "decoded", "semantic")


@query(f"select doc_id, ['{"', '".join(_NEEDS)}'][doc_id % 8 + 1] as need from documents where text is not null")
def match_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted documents as responses: cut, escaped, in capitals, escaped twice, read out of a response
    escaped once and twice, escaped three times, and another text. All but the last hold a line break
    and quotes, so that an escape changes them."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    text = F.concat(F.lit('It said "'), "text", F.lit('" and\nno more'))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    loud = F.replace(F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit("  "))
    way = F.col("doc_id") % 8
    response = F.when(way == 4, escaped(text)).when(way == 5, escaped(escaped(text))).otherwise(text)
    read = F.when(way == 0, F.substring(text, 3, 40)).when(way == 1, escaped(text)).when(way == 2, F.concat(loud, F.lit(" \n"))).when(way == 3, escaped(escaped(text))).when(way.isin(4, 5), text)
    read = read.when(way == 6, escaped(escaped(escaped(text)))).otherwise('Nobody "said" this')
    return d.select("doc_id", L.match_need(response, read).alias("need"))


@query(f"""with {ACCESS_SQL}, r as (select id, id % 9 as world, id // 9 as exchange, case id % 3 when 0 then 'tool' when 1 then 'user' else 'system' end as role, resource from accesses)
    select id hit, world, exchange, case role when 'tool' then 'tool_result' else role end carrier, case when role = 'tool' and resource is not null and id % 2 = 0 then 'channel' else 'direct' end route_kind,
    case when role = 'tool' and id % 2 = 0 then 'file:/srv/' || resource end as resource, 'last' as tool from r""")
def hit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses as hits; each has two calls with its id, of which the later names the resource at even ids."""
    a = access_log(spark, sf_dir).selectExpr("id as hit", "id % 9 as world", "id div 9 as exchange", "case id % 3 when 0 then 'tool' when 1 then 'user' else 'system' end as role", "cast(id as string) as call_id", "resource")
    key = F.when(F.col("hit") % 2 == 0, "path").otherwise("profile")
    args = F.when(F.col("resource").isNull(), "{}").otherwise(F.to_json(F.create_map(key, F.concat(F.lit("/srv/./"), "resource"))))
    at = ["world", "exchange", "call_id"]
    calls = a.select(*at, F.lit(2).alias("pos"), F.lit("last").alias("tool"), args.alias("args")).union(a.select(*at, F.lit(1), F.lit("first"), F.lit('{"path": "/no"}')))
    return L.hit_routes(a.drop("resource"), calls)


@query("""select doc_id id, source as session, case when doc_id % 6 <> 0 then doc_id % 7 end as exchange, case when doc_id % 6 <> 0 then doc_id * 10 + 1 end as message, case when doc_id % 4 <> 0 then doc_id % 7 - 1 end as writer_exchange,
    case when doc_id % 6 = 0 then 'dropped:no_result' when doc_id % 5 = 0 then 'dropped:digest' when doc_id % 4 = 0 then 'noted:no_writer' else 'kept' end as status from documents where text is not null""")
def truth_to_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool results; an earlier part of the message and a later exchange hold others."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text").filter("text is not null").withColumnRenamed("source", "session").withColumn("tool_use_id", F.col("doc_id"))
    truth = d.select(F.col("doc_id").alias("id"), "session", "tool_use_id", F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.sha2("text", 256)).alias("sha256"))
    held = d.filter("doc_id % 6 <> 0")
    result = lambda exchange, pos, body: held.select("session", F.expr(exchange).alias("exchange"), F.expr(exchange).alias("at"), "tool_use_id", F.lit(pos).alias("pos"), F.expr(f"doc_id * 10 + {pos}").alias("message"), F.expr(body).alias("body"))
    results = result("doc_id % 7", 0, "'old'").union(result("doc_id % 7", 1, "text")).union(result("doc_id % 7 + 1", 2, "'later'"))
    writers = d.filter("doc_id % 4 <> 0").select("session", "tool_use_id", F.expr("doc_id % 7 - 1").alias("exchange"), F.expr("doc_id % 7 - 1").alias("at"))
    return L.truth_to_capture(truth, results, writers)


@query(f"""with {TURNS_SQL}, x as (select world, agent * 100 + pos send_id, case when pos % 5 <> 0 then agent + 1 end from_agent, agent to_agent, text, pos % 7 = 0 rejected, pos, row_number() over (partition by world, agent, text order by pos) n from turns),
    y as (select world, agent to_agent, text, (agent * 100 + pos) * 10 reader_exchange, row_number() over (partition by world, agent, text order by pos) n from turns where pos % 3 <> 0),
    j as (select x.*, reader_exchange, case when rejected then 'rejected' when reader_exchange is null then 'unplaced' when from_agent is null then 'control' else 'transmission' end kind from x left join y using (world, to_agent, text, n))
    select world, send_id, to_agent, reader_exchange, kind, case when kind = 'transmission' then case when send_id % 11 = 0 then 'forwarding' when send_id % 2 <> 0 then 'likely' else 'certain' end end as tier from j""")
def delivery_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_turns(spark, sf_dir).withColumn("send_id", F.expr("agent * 100 + pos"))
    transcript = t.selectExpr("world", "send_id", "case when pos % 5 <> 0 then agent + 1 end as from_agent", "agent as to_agent", "text", "pos % 7 = 0 as rejected", "pos as ord")
    turns = t.filter("pos % 3 <> 0").selectExpr("world", "agent as to_agent", "text", "pos as ord", "send_id * 10 as exchange")
    return L.delivery_labels(transcript, turns, t.filter("send_id % 2 = 0").selectExpr("world", "send_id", "send_id as exchange"), t.filter("send_id % 11 = 0").selectExpr("world", "send_id", "true as forwarding"))


_FED = "case when role = 'system' then 'harness' when pos = 0 then 'prompt' when role = 'user' then 'shared_tool' else 'own' end"


@query(f"""with {TURNS_SQL}, f as (select *, {_FED} source from turns), r as (select *, row_number() over (partition by world, agent, source, text order by pos) n from f where source <> 'own')
    select world, agent, pos, case when source = 'harness' then 'boilerplate' else 'shared_source' end reason from r where n = 1 and (source <> 'prompt' or pos = 0)""")
def shared_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shared_source_labels(conversation_turns(spark, sf_dir).withColumn("source", F.expr(_FED)))


_RESET = "(page % 5 = 0 and seq = 2) or (page % 7 = 3 and seq = 1)"
_REV = f"""{TURNS_SQL}, rv0 as (select agent page, pos seq, pos // 2 % 3 author, len(string_split(text, chr(10))) added from turns), rv1 as (select *, sum(added) over (partition by page order by seq) n, {_RESET} reset from rv0),
    rv as (select page, seq, author, (case when reset then n else added end)::bigint added, max(case when reset then seq end) over (partition by page order by seq) since from rv1),
    ls as (select r.page, r.seq, s.seq source, s.author source_author, s.added, coalesce(sum(s.added) over (partition by r.page, r.seq order by s.seq desc rows between unbounded preceding and 1 preceding), 0)::bigint first_line from rv r join rv s on s.page = r.page and s.seq <= r.seq and s.seq >= coalesce(r.since, -1))"""


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions made of conversations: every turn adds its lines at the top, but for some whose
    hunks are not known (page % 5 = 0) or do not give the number of lines."""
    c = conversation_turns(spark, sf_dir).select(F.col("agent").alias("page"), F.col("pos").alias("seq"), F.expr("pos div 2 % 3").alias("author"), F.size(F.split("text", "\n")).alias("added"))
    total = F.sum("added").over(Window.partitionBy("page").orderBy("seq")).cast("int")
    hunks = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("removed"), (F.col("added") + F.expr("case when page % 7 = 3 and seq = 1 then 1 else 0 end")).alias("added")))
    return c.select("page", "seq", "author", total.alias("n_lines"), F.when(F.expr("page % 5 = 0 and seq = 2"), F.array().cast("array<struct<at: int, removed: int, added: int>>")).otherwise(hunks).alias("hunks"))


@query(f"with {_REV} select page, seq, first_line + i line, source from ls, range(0, added) r(i)")
def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = L.line_sources(_revisions(spark, sf_dir))
    return runs.select("page", "seq", F.explode(F.expr("sequence(first_line, first_line + lines - 1)")).alias("line"), "source")


@query(f"with {_REV} select page, seq, 'unbalanced' as problem from rv1 where page % 7 = 3 and seq = 1 and not (page % 5 = 0 and seq = 2) and exists (select 1 from rv1 b where b.page = rv1.page and b.seq < rv1.seq)")
def unreplayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unreplayable(_revisions(spark, sf_dir))


@query(f"""with {_REV}, rd as (select *, lag(author) over (partition by page order by seq) la, lag(seq) over (partition by page order by seq) prev from rv), x as (select rd.page, rd.author reader, rd.seq, source, source_author, first_line, ls.added as "lines" from rd join ls on ls.page = rd.page and ls.seq = rd.prev where la <> rd.author and source_author <> rd.author)
    select page, reader, seq, source_author, first_line, "lines", case when seq = min(seq) over (partition by page, reader, source) then 'transmission' else 'reread' end kind from x""")
def page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = _revisions(spark, sf_dir)
    return L.page_reads(rev, L.line_sources(rev))


@query(r"""with t as (select doc_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(regexp_replace(x, '^["''(<\[]+', ''), '["'')>\].,;:!?]+$', '')),
    lambda x: regexp_matches(x, '^(?:https?://\S+|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})$')))) indicator from documents)
    select doc_id run, doc_id "call", indicator from t where doc_id % 2 = 0""")
def second_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as injections and as later calls; those of odd runs stand in a benign prompt too."""
    d = table(spark, sf_dir, "documents", F.col("doc_id").alias("run"), "text")
    return L.second_hop(d.select("run", F.lit(1).alias("at"), "text"), d.filter("run % 2 = 1").select("run", "text"), d.select("run", F.col("run").alias("call"), F.lit(2).alias("at"), F.upper("text").alias("args")))


@query("""with l as (select doc_id, doc_id % 8 as world from labels), c as (select * from l where doc_id % 10 = 1)
    select world, 'exchange_twice' as problem, doc_id::varchar as item from l where doc_id % 7 = 0 union all select world, 'unknown_exchange', doc_id::varchar from l where doc_id % 5 = 0 union all select world, 'unknown_exchange', doc_id::varchar from l where doc_id % 35 = 0
    union all select world, 'duplicate_tx', doc_id::varchar from l where doc_id % 6 = 0 union all select world, 'unknown_agent', doc_id::varchar from l where doc_id % 9 = 0 union all select world, 'exchange_mismatch', doc_id::varchar from l where doc_id % 4 = 0
    union all select world, 'unsorted_evidence', doc_id::varchar from l where doc_id % 3 = 0 union all select world, 'state_without_evidence', doc_id::varchar from l where doc_id % 2 = 1 union all select world, 'quality_and_state', doc_id::varchar from c""")
def check_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from the labels, with a planted fault of each kind."""
    l = table(spark, sf_dir, "labels", "doc_id").withColumn("world", F.col("doc_id") % 8)
    at = l.selectExpr("world", "concat('d', doc_id) as detected", "doc_id as exchange")
    at = at.union(at.filter("exchange % 7 = 0"))
    tx = l.selectExpr("world", "doc_id as tx_id", "case when doc_id % 2 = 1 then 'suspected' else 'confirmed' end as state", "case when doc_id % 10 <> 1 then 'exact' end as quality")
    tx = tx.union(tx.filter("tx_id % 6 = 0"))
    match = lambda pos, start: l.selectExpr("world", "doc_id as tx_id", "'match' as kind", f"{pos} as pos", "concat('d', doc_id) as from_detected", "case when doc_id % 9 = 0 then 'nobody' else concat('d', doc_id) end as to_detected", "doc_id as reader_exchange", "case when doc_id % 4 = 0 then -1 else doc_id end as read_exchange", "1 as read_message", f"{start} as read_start")
    return C.check_predictions(at, tx, match(0, 5).union(match(1, "case when doc_id % 3 = 0 then 1 else 9 end")), l.filter("doc_id % 5 <> 0").selectExpr("world", "doc_id as exchange"))


@query(f"with {MATCHES_SQL} select world, reader, reader_ex, sender, count(*) n from m group by 1, 2, 3, 4")
def detector_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector by name, over tables whose labels it does not see."""
    plugins.register_detector("shingles", lambda tables: {"matches": detect(tables["turns"])})
    turns = conversation_turns(spark, sf_dir)
    found = plugins.run_detector("shingles", {"turns": turns, "labels_tx": turns})
    return found["matches"].groupBy("world", "reader", "reader_ex", "sender").agg(F.count("*").alias("n"))
