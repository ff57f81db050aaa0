"""SQL for DuckDB with the results of those queries that SQL can express."""

from __future__ import annotations



def _rounds(n: int) -> str:
    """n times: distances to the centroids c, nearest ones a, and the next centroids."""
    return ",\n".join(
        f"""d{k} as (select v.i, c.k, sum((v.x - c.x) ** 2)::bigint d from v join c{k} c on c.j = v.j group by 1, 2), a{k} as (select i, arg_min(k, (d, k)) k, min(d) d from d{k} group by i),
m{k} as (select a.k, v.j, sum(v.x)::bigint s, count(*) n from a{k} a join v on v.i = a.i group by 1, 2),
c{k + 1} as (select c.k, c.j, case when n is null then c.x else floor(s / n)::bigint end x from c{k} c left join m{k} m on m.k = c.k and m.j = c.j)"""
        for k in range(n)
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": r"""
with bare as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') b from pages),
parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') path,
    list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) kept from bare),
p as (select page_id, host || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end url_key,
    '"' || substr(md5(html), 1, 16) || '"' tag, 'lm-' || (page_id % 97) lm from parts),
resp as (select 'r' || page_id response_id, url_key, page_id * 10 ts, tag, lm from p where page_id % 11 <> 5),
rev as (select 'v' || page_id record_id, url_key, page_id * 10 + 5 + 10 * (page_id % 500) ts, case when page_id % 3 <> 0 then 'W/' || tag end etag, lm, 'e' || page_id date from p),
m as (select rev.*, r.response_id, r.tag rtag, r.lm rlm,
    row_number() over (partition by rev.record_id order by r.ts desc nulls last, r.response_id desc) rn
    from rev left join resp r on r.url_key = rev.url_key and r.ts < rev.ts),
o as (select *, case when response_id is null then 'missing' when etag is not null and rtag is not null then case when substr(etag, 3) = rtag then 'resolved' else 'modified' end
    when etag is null and lm is not null and rlm is not null then case when lm = rlm then 'resolved' else 'modified' end else 'unverified' end outcome from m where rn = 1)
select record_id, url_key, response_id, outcome, etag, lm as last_modified, case when outcome = 'resolved' then 'text/html' else 'none' end as content_type, date from o
""",
    "op3_jaccard_join": rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g, least(len(ws), 3) k from w),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.g = b.g and a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id a, doc_id b from documents union select r.a, l.v from r join l on l.u = r.b),
m as (select a, min(b) b from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.b as component_id from documents d join m on m.a = d.doc_id left join n on n.doc_id = d.doc_id
""",
    "op4_quotation_links": r"""
with recursive t as (select conv_id, turn, text raw, coalesce(text, '') text, string_split(coalesce(text, ''), chr(10)) ls from conversations),
q as (select a.*, a.turn % 5 kind, b.text t1, b.ls l1, c.text t2, b.raw is not null h1, c.raw is not null h2 from t a left join t b on b.conv_id = a.conv_id and b.turn = a.turn - 1 left join t c on c.conv_id = a.conv_id and c.turn = a.turn - 2),
asks as (select conv_id, turn, 1 lvl, 0 k, l1[1] x from q where kind = 3 and h1
    union all select conv_id, turn, 1, 1, l1[-1] from q where kind = 3 and h1
    union all select conv_id, turn, 1, 0, case when len(l1) > 1 then array_to_string(l1[2:], chr(10)) else t1 end from q where kind = 4 and h1
    union all select conv_id, turn, 1, 0, t2 from q where not (kind >= 3 and h1) and turn % 3 = 2 and h2
    union all select conv_id, turn, 1, 1, t1 from q where kind < 3 and h1 and not (turn % 3 = 2 and h2)
    union all select conv_id, turn, 2, 0, t2 from q where kind < 3 and h1 and h2 and turn % 2 = 0 and not (turn % 3 = 2)),
parts as (select conv_id, turn, text x from t union all select conv_id, turn, unnest(ls) from t union all select conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) from t
    union all select conv_id, turn, array_to_string(ls[2:], chr(10)) from q where kind = 3 and h1),
have as (select distinct conv_id, turn, trim(regexp_replace(lower(x), '[\s\x00-\x1f\x7f]+', ' ', 'g')) x from parts),
wholes as (select conv_id, turn, lvl, k, trim(regexp_replace(lower(x), '[\s\x00-\x1f\x7f]+', ' ', 'g')) x, string_split(x, chr(10)) ls from asks),
lines as (select distinct conv_id, turn, lvl, k, x whole, trim(regexp_replace(lower(l), '[\s\x00-\x1f\x7f]+', ' ', 'g')) x from (select *, unnest(ls) l from wholes)),
units as (select conv_id, turn, lvl, k, x, 1 whole, 0 w from wholes where x <> '' union all select conv_id, turn, lvl, k, x, 0, length(x) from lines where x <> '' and x <> whole),
u as (select a.conv_id, a.turn, a.lvl, a.k, a.x, a.whole, a.w, max(h.turn) found from units a left join have h on h.conv_id = a.conv_id and h.turn < a.turn and h.x = a.x group by all),
v as (select conv_id, turn, lvl, k, found, max(whole) whole, sum(w) w from u group by all),
s as (select *, sum(w) over (partition by conv_id, turn, lvl, k) total, row_number() over (partition by conv_id, turn, lvl, k order by found is null, whole desc, w desc, found desc) rn from v),
f as (select conv_id, turn, lvl, case when whole = 1 or 2 * w >= total then found end found from s where rn = 1),
g as (select conv_id, turn, count(*) n_quotes, count(found) n_linked, arg_min(found, lvl * 1000000 - found) filter (where found is not null) parent from f group by 1, 2),
e as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) before from (select distinct conv_id, turn from t)),
m as (select t.conv_id, t.turn, regexp_replace(t.text, '^\s+|\s+$', '', 'g') own_text, coalesce(n_quotes, 0) n_quotes, coalesce(n_linked, 0) n_linked, coalesce(g.parent, e.before) parent_turn
    from t join e on e.conv_id = t.conv_id and e.turn = t.turn left join g on g.conv_id = t.conv_id and g.turn = t.turn),
p as (select conv_id, turn, lpad((turn::hugeint + 9223372036854775808)::varchar, 20, '0') path from m where parent_turn is null
    union all select m.conv_id, m.turn, p.path || '/' || lpad((m.turn::hugeint + 9223372036854775808)::varchar, 20, '0') from p join m on m.conv_id = p.conv_id and m.parent_turn = p.turn)
select m.*, p.path from m left join p on p.conv_id = m.conv_id and p.turn = m.turn
""",
    "op6_extendible_shards": f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint h from documents),
p as (select k, h >> (60 - k) p, sum(n_bytes)::bigint b from d, range(0, 61) r(k) group by 1, 2),
f as (select doc_id, n_bytes, h, min(k) depth from (select d.*, p.k from d join p on p.p = (d.h >> (60 - p.k)) where p.b <= {1 << 20} or p.k = 60) group by 1, 2, 3)
select f.doc_id, right(lpad(bin(f.h), 60, '0')[1:f.depth::int], f.depth::int) as shard, f.depth::int as depth, f.n_bytes, p.b as shard_bytes from f join p on p.k = f.depth and p.p = (f.h >> (60 - f.depth))
""",
    "op7_benchmark_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id::varchar item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g from b, range(1, greatest(len(w) - 10, 0) + 2) r(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from d, sizes, range(1, len(w) - n + 2) r(i)),
h as (select doc_id, dw.n, i, item from dw join bw on bw.n = dw.n and bw.g = dw.g),
x as (select doc_id, count(distinct k) n_hit from h, range(i, i + n) r(k) group by doc_id),
y as (select doc_id, count(distinct item) n_items, sha256(string_agg(distinct item, ',' order by item)) s from h group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x on x.doc_id = d.doc_id left join y on y.doc_id = d.doc_id
""",
    "op8_embedding_neardup": """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where embedding is not null and label is not null),
l as (select a.vec_id u, b.vec_id v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select u, count(*) n from l group by u),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.v from r join l on l.u = r.b),
c as (select a, min(b) m from r group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.m as component_id, e.vec_id = c.m as kept from embeddings e join c on c.a = e.vec_id left join n on n.u = e.vec_id
""",
    "op13_centroid_clustering": f"""
with r as (select row_number() over () i, vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
v as (select i, generate_subscripts(embedding, 1) j, floor(64 * unnest(embedding)::double)::bigint x from r),
f as (select i, row_number() over (order by sha256('1:' || vec_id)) - 1 k from r order by k limit 16), c0 as (select f.k, v.j, v.x from f join v on v.i = f.i),
{_rounds(4)},
h as (select k, sha256(string_agg(x::varchar, ',' order by j)) s from c3 group by k)
select r.vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, h.s as centroid_sha256 from a3 a join r on r.i = a.i join h on h.k = a.k
""",
}
