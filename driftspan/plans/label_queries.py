"""Queries of resources, occurrences, classes and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.operators import labels as L
from driftspan.sources.adapters import TURNS_SQL, conversation_turns, table

from .registry import query


@query(r"""with b as (select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') b from pages), p as (select page_id, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') host,
    list_filter(string_split(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/'), lambda s: s <> '' and s <> '.') segs, list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) q from b),
    k as (select page_id, 'url:' || host || case when len(segs) > 0 then '/' || array_to_string(segs, '/') else '' end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end "key" from p)
    select page_id, "key", 'url' as kind, min(page_id) over (partition by "key") as first_page, count(*) over (partition by "key") as pages from k""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by canonical resource, with the first page and the number of pages of each."""
    rows = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", L.canonical_resource(F.col("url")).alias("r")).select("page_id", "r.key", "r.kind")
    groups = rows.groupBy("key").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))
    return rows.join(groups, "key")


def _copies_sql(pairs: str) -> str:
    """Rows of pairs (with needle, text) for each copy: words with white space or escaped line breaks
    between them, whatever the case."""
    rx = r"""'(?is)' || regexp_replace(regexp_replace(trim(needle, chr(32) || chr(9) || chr(10)), '([!-/:-@\[-`{-~])', '\\\1', 'g'), '\s+', '(?:\\s|\\\\n)+', 'g')"""
    return rf"""rx as (select *, {rx} rx from {pairs}), cut as (select *, string_split_regex(text, rx) pieces, regexp_extract_all(text, rx) found from rx where regexp_matches(text, rx)),
    each as (select *, unnest(range(1, len(found) + 1)) i from cut),
    copies as (select *, i - 1 as copy, found[i] as raw, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as "start" from each),
    placed as (select *, "start" + length(raw) as stop, case when raw = trim(needle, chr(32) || chr(9) || chr(10)) then 'exact' when contains(raw, '\n') then 'decoded:json_string' else 'normalized' end as class from copies)"""


@query(rf"""with d as (select doc_id text_id, case when doc_id % 3 = 0 then replace(text, ' ', '\n') else text end as text from documents), n as (select item_id needle_id, text needle from benchmark union all select item_id || ':short', substr(text, 1, 20) from benchmark),
    fd as (select *, regexp_replace(replace(lower(text), '\n', ' '), '\s+', ' ', 'g') f from d), fn as (select *, trim(regexp_replace(lower(needle), '\s+', ' ', 'g')) plain from n), near as (select needle_id, needle, text_id, text from fn join fd on contains(f, plain) where plain <> ''), {_copies_sql("near")}
    select needle_id, text_id, copy, class, "start", stop from placed""")
def benchmark_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items, and the beginning of each as a short needle, in all documents, of which
    every third has its blanks as escaped line breaks."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    needles = b.select(F.col("item_id").cast("string").alias("needle_id"), F.col("text").alias("needle"))
    needles = needles.union(b.select(F.concat("item_id", F.lit(":short")), F.substring("text", 1, 20)))
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\\n"))).otherwise(F.col("text"))
    return L.find_occurrences(needles, table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("text_id"), text.alias("text")))


_INJECTED_SQL = r"""first as (select agent run, trim(substr(text, 3, 50), chr(32) || chr(9) || chr(10)) needle from turns where pos = 0),
    out as (select t.agent run, t.agent * 100 + pos text_id, pos, case when t.agent % 4 = 0 then 'page' end as resource, 'See ' || needle || ' and ' || translate(needle, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '; ' || replace(needle, ' ', '\n') || case when pos % 2 = 1 then ', ' || needle || needle else '' end as text, needle from turns t join first on run = t.agent where role <> 'assistant' and pos > 0),
    rd as (select o.*, (select min(pos) from turns c where c.agent = o.run and c.role = 'assistant' and c.pos > o.pos) called from out o)"""


@query(f"""with {TURNS_SQL}, {_INJECTED_SQL}, near as (select * from rd where called is not null and needle <> ''), {_copies_sql("near")}
    select run, 1 as needle_id, text_id, copy, "start", stop, run * 100 + called as reader_exchange, case when resource is null then class else 'unobserved' end as need, case when resource is null then 'construction' else 'out_of_reach' end as tier from placed""")
def injection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each conversation's first turn, under two ids, as what an attacker wrote; later turns
    of others hold it as it is, in capitals and with escapes, and some twice more."""
    t = conversation_turns(spark, sf_dir).withColumnRenamed("agent", "run")
    needle = F.regexp_replace(F.substring("text", 3, 50), f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")
    first = t.filter("pos = 0").select("run", needle.alias("needle"))
    held = F.concat(F.lit("See "), "needle", F.lit(" and "), F.translate("needle", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("; "), F.replace("needle", F.lit(" "), F.lit("\\n")), F.when(F.col("pos") % 2 == 1, F.concat(F.lit(", "), "needle", "needle")).otherwise(""))
    outputs = t.filter("role <> 'assistant' and pos > 0").join(first, "run").select("run", F.expr("run * 100 + pos").alias("text_id"), "pos", held.alias("text"), F.expr("case when run % 4 = 0 then 'page' end").alias("resource"))
    needles = first.select("run", F.explode(F.array(F.lit(1), F.lit(2))).alias("needle_id"), "needle")
    return L.injection_labels(needles, outputs, t.filter("role = 'assistant'").selectExpr("run", "pos", "run * 100 + pos as exchange"))


@query(r"""with s as (select doc_id, text span, substr(text, 11, 60) c from documents where text is not null), r as (select doc_id, span, case doc_id % 5 when 0 then c when 1 then translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then replace(c, ' ', '  ') when 3 then replace(replace(c, '"', '\"'), chr(10), '\n') else replace(c, '''', '''''') end as r from s)
    select doc_id, case when contains(span, r) then 'exact' when rtrim(ltrim(regexp_replace(lower(r), '\s+', ' ', 'g'), ' '), ' ') <> '' and contains(ltrim(regexp_replace(lower(span), '\s+', ' ', 'g'), ' '), rtrim(ltrim(regexp_replace(lower(r), '\s+', ' ', 'g'), ' '), ' ')) then 'normalized' when doc_id % 5 = 4 then 'decoded:yaml_string' else 'decoded:json_string' end as class from r""")
def classify_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as spans; a cut of each is read as it is, in capitals, spaced out, escaped, or with its quotes doubled."""
    d, cut, way = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null"), F.substring("text", 11, 60), F.col("doc_id") % 5
    escaped = F.replace(F.replace(cut, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    read = F.when(way == 0, cut).when(way == 1, F.translate(cut, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(way == 2, F.replace(cut, F.lit(" "), F.lit("  "))).when(way == 3, escaped).otherwise(F.replace(cut, F.lit("'"), F.lit("''")))
    return d.select("doc_id", T.classify(F.col("text"), read).alias("class"))


@query("""with e as (select event_id, json_extract_string(props, '$.k') k from events) select event_id, case when k is not null then '/srv/' || k end as resource from e""")
def call_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    args = F.when(F.col("k").isNotNull(), F.to_json(F.struct(F.lit("none").alias("a"), F.concat(F.lit("/srv/"), "k").alias("file_path")))).otherwise("{}")
    return e.select("event_id", L.call_resource(args).alias("resource"))


@query("""select source suite, count(*) filter (where doc_id % 5 = 0) exact, count(*) filter (where doc_id % 5 = 1) normalized, count(*) filter (where doc_id % 5 = 2) decoded, count(*) filter (where doc_id % 5 > 2) absent, count(*) filter (where n_chars > 500) attacks, count(*) filter (where n_chars > 5000) second_hops from documents group by 1""")
def arrival_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    kind = F.when(F.col("doc_id") % 5 == 0, "exact").when(F.col("doc_id") % 5 == 1, "normalized").when(F.col("doc_id") % 5 == 2, "decoded")
    return L.arrival_tally(d.select(F.col("source").alias("suite"), kind.alias("class"), (F.col("n_chars") > 500).alias("attack"), (F.col("n_chars") > 5000).alias("second_hop")))


@query(r"""with l as (select conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no, unnest(string_split(text, chr(10))) text from conversations),
    g as (select conv_id // 20 page, turn * 10000 + conv_id as seq, line_no, conv_id * 10 + turn % 3 author, text from l where length(text) >= 24 union all select conv_id // 20, (turn + 100) * 10000 + conv_id, line_no, conv_id * 10 + 9, text from l where length(text) >= 24 and turn = 0 and conv_id % 2 = 0),
    f as (select page, text, min((seq, line_no, author)) m from g group by 1, 2)
    select g.page, g.seq, line_no as line, author, m[3] as origin from g join f on f.page = g.page and f.text = g.text where m[1] < g.seq and m[3] <> author""")
def relay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a score of conversations; another author inserts the first turn of every second one again."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    own = c.select(F.expr("conv_id div 20").alias("page"), F.expr("turn * 10000 + conv_id").alias("seq"), F.expr("conv_id * 10 + turn % 3").alias("author"), line)
    again = c.filter("turn = 0 and conv_id % 2 = 0").select(F.expr("conv_id div 20"), F.expr("(turn + 100) * 10000 + conv_id"), F.expr("conv_id * 10 + 9"), line)
    return L.relay_lines(own.union(again))
