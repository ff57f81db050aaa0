"""Queries of the scorer over labels and predictions made from the label table.

Fixture columns are expressions that both engines read, so the SQL starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.operators import score as S
from driftspan.operators.labels import canonical_resource
from driftspan.sources.adapters import table

from .registry import query

LABELS = (
    "concat('d', doc_id % 2) as dataset", "doc_id % 8 as world", "doc_id as label_ord", "case when doc_id % 7 = 0 then 'access' else 'content' end as expects", "doc_id % 5 as from_agent", "(doc_id + 1 + doc_id % 3) % 5 as to_agent", "doc_id % 16 as reader_exchange",
    "case when doc_id % 2 = 0 then 'channel' else 'direct' end as route_kind", "concat('r', doc_id % 3) as resource_key", "case when doc_id % 3 = 0 then 'tool_result' else 'user' end as carrier", "case when doc_id % 4 = 0 then 'exact' when doc_id % 4 = 1 then 'normalized' else 'decoded' end as need",
    "case when quality = 1 then 'certain' when doc_id % 9 = 0 then 'out_of_reach' when doc_id % 9 = 1 then 'forwarding' else 'likely' end as tier", "concat('m', doc_id % 2) as loc_message", "0 as loc_part", "doc_id % 20 as loc_start", "doc_id % 20 + 5 + doc_id % 13 as loc_end",
)
PREDICTIONS = (
    "concat('d', doc_id % 2) as dataset", "doc_id % 8 as world", "doc_id as pred_id", "doc_id % 40 as tx_id", "doc_id % 5 as from_agent", "(doc_id + 1 + doc_id % 3) % 5 as to_agent", "doc_id % 16 as reader_exchange", "case when doc_id % 6 = 5 then 'direct' else 'channel' end as route_kind",
    "case when doc_id % 4 = 0 then 'user' else 'tool_result' end as carrier", "case doc_id % 11 when 0 then 'suspected' when 1 then 'discarded' when 2 then 'exact' when 3 then 'normalized' else 'decoded' end as class", "case when doc_id % 11 < 2 then 'access' else 'content' end as quality",
    "array(concat('r', doc_id % 3), concat('r', (doc_id + 1) % 3)) as resource_keys", "concat('m', doc_id % 2) as read_message", "0 as read_part", "doc_id % 23 as read_start", "doc_id % 23 + 4 + doc_id % 9 as read_end",
    "case when doc_id % 3 <> 0 then concat('o', doc_id % 2) end as origin_message", "doc_id % 10 as origin_start", "doc_id % 10 + 6 as origin_end",
)
CONTROLS = (
    "doc_id % 8 as world", "doc_id as control_ord", "doc_id % 5 as from_agent", "(doc_id + 1 + doc_id % 3) % 5 as to_agent", "case when doc_id % 4 <> 3 then doc_id % 16 end as reader_exchange", "case when doc_id % 4 = 0 then concat('m', doc_id % 2) end as at_message", "doc_id % 20 as at_start", "doc_id % 20 + 9 as at_end",
    "case when doc_id % 4 = 1 then concat('o', doc_id % 2) end as origin_message", "doc_id % 10 as origin_start", "doc_id % 10 + 3 as origin_end", "case when doc_id % 2 = 0 then 'boilerplate' else 'shared_source' end as reason", "'likely' as tier",
)
EXEMPTIONS = ("doc_id % 8 as world", "(doc_id + 2) % 5 as to_agent", "doc_id % 16 as reader_exchange", "concat('m', doc_id % 2) as at_message", "doc_id % 20 as at_start", "doc_id % 20 + 6 as at_end")
LABEL_ROWS, CONTROL_ROWS, EXEMPT_ROWS = "doc_id % 3 <> 1", "doc_id % 5 = 2", "doc_id % 10 = 9"


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        rows = table(spark, sf_dir, "labels")
        self.labels = rows.filter(LABEL_ROWS).selectExpr(*LABELS)
        self.predictions = rows.selectExpr(*PREDICTIONS)
        self.controls = rows.filter(CONTROL_ROWS).selectExpr(*CONTROLS)
        self.exemptions = rows.filter(EXEMPT_ROWS).selectExpr(*EXEMPTIONS)
        self.coverage = rows.selectExpr("doc_id % 8 as world").distinct().withColumn("coverage_tier", F.when(F.col("world") < 3, "likely"))
        self.texts = rows.select((F.col("doc_id") % 8).alias("world"), F.col("doc_id").alias("pred_id"), "doc_id").join(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").drop("doc_id")

    def judged(self) -> DataFrame:
        return S.judge(self.predictions, self.labels, self.controls, self.exemptions, self.coverage)

    def outcomes(self) -> DataFrame:
        return S.label_outcomes(self.predictions, self.labels)

    def rows(self) -> DataFrame:
        return S.score_rows(self.judged(), self.outcomes())


def _sql(exprs: tuple[str, ...]) -> str:
    return ", ".join(exprs).replace("array(", "list_value(")


FIX_SQL = f"""lab as (select {_sql(LABELS)} from labels where {LABEL_ROWS}), pred as (select {_sql(PREDICTIONS)} from labels),
con as (select {_sql(CONTROLS)} from labels where {CONTROL_ROWS}), exm as (select {_sql(EXEMPTIONS)} from labels where {EXEMPT_ROWS}),
al as (select p.world, p.pred_id, p.class, l.label_ord, l.expects, l.tier from pred p join lab l on p.world = l.world and p.from_agent = l.from_agent and p.to_agent = l.to_agent and p.reader_exchange = l.reader_exchange
    and p.read_message = l.loc_message and p.read_part = l.loc_part and p.read_start < l.loc_end and l.loc_start < p.read_end where l.route_kind <> 'channel' or (p.route_kind = 'channel' and list_contains(p.resource_keys, l.resource_key))),
uc as (select * from (select p.world, p.pred_id, c.control_ord, c.reason, c.tier, row_number() over (partition by p.world, p.pred_id order by case when at_message is not null then 0 when c.origin_message is not null then 1 when c.reader_exchange is not null then 2 else 3 end, control_ord) rn
    from pred p join con c on p.world = c.world and p.from_agent = c.from_agent and p.to_agent = c.to_agent where (c.reader_exchange is null or c.reader_exchange = p.reader_exchange)
    and (at_message is null or (at_message = read_message and at_start < read_end and read_start < at_end)) and (c.origin_message is null or (c.origin_message = p.origin_message and c.origin_start < p.origin_end and p.origin_start < c.origin_end))) where rn = 1),
ex as (select distinct p.world, p.pred_id from pred p join exm e on p.world = e.world and p.to_agent = e.to_agent and p.reader_exchange = e.reader_exchange and read_message = at_message and at_start < read_end and read_start < at_end),
jd0 as (select p.*, r.tier rt, u.reason cr, u.tier ct, case when p.world < 3 then 'likely' end cov,
    case when r.pred_id is not null then 'correct' when class = 'discarded' then 'dismissed' when x.pred_id is not null then 'unjudged' when u.reason is not null or p.world < 3 then 'false' else 'unjudged' end outcome
    from pred p left join (select world, pred_id, arg_min(tier, label_ord) tier from al group by 1, 2) r on r.world = p.world and r.pred_id = p.pred_id left join uc u on u.world = p.world and u.pred_id = p.pred_id left join ex x on x.world = p.world and x.pred_id = p.pred_id),
jd as (select *, case outcome when 'correct' then rt when 'false' then coalesce(ct, cov) end tier, case when outcome in ('false', 'dismissed') then cr end reason from jd0),
oc as (select l.*, coalesce(f, false) found, coalesce(s, false) suspected from lab l left join (select world, label_ord, bool_or((expects = 'content') = (class not in ('suspected', 'discarded'))) f, bool_or(expects = 'content' and class in ('suspected', 'discarded')) s from al group by 1, 2) o on o.world = l.world and o.label_ord = l.label_ord),
sr0 as (select dataset, route_kind, carrier, class, tier, 0 expected, 0 found, 0 missed, 0 suspected, 1 predicted, (outcome = 'correct')::int correct, (outcome = 'false')::int false_positive, (outcome = 'unjudged')::int unjudged, (outcome = 'dismissed')::int dismissed from jd
    union all select dataset, route_kind, carrier, case when expects = 'content' then need else 'suspected' end, tier, 1, found::int, (not found)::int, (not found and suspected)::int, 0, 0, 0, 0, 0 from oc),
sr as (select dataset, route_kind, carrier, class, tier, {', '.join(f'sum({c})::bigint {c}' for c in S.COUNTS)} from sr0 group by 1, 2, 3, 4, 5)"""
RATES = "correct / nullif(correct + false_positive, 0) as precision, found / nullif(expected, 0) as recall"


@query(f"with {FIX_SQL} select world, pred_id, label_ord, expects, tier from al")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return S.align(f.predictions, f.labels)


@query(f"with {FIX_SQL} select world, pred_id, control_ord, reason, tier from uc")
def control_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return S.under_control(f.predictions, f.controls)


@query(f"with {FIX_SQL} select world, pred_id from ex")
def exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return S.exempted(f.predictions, f.exemptions)


@query(f"with {FIX_SQL} select world, pred_id, outcome, tier, reason from jd")
def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).judged().select("world", "pred_id", "outcome", "tier", "reason")


@query(f"with {FIX_SQL} select world, pred_id, label_ord, expects, tier from al")
def align_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same resources, written in one way by labels and in another by predictions."""
    f = Fixture(spark, sf_dir)
    labels = f.labels.withColumn("resource_key", F.concat(F.lit("https://www.Example.org:443/a/../"), "resource_key", F.lit("?utm_source=x#top")))
    predictions = f.predictions.withColumn("resource_keys", F.transform("resource_keys", lambda r: F.concat(F.lit("http://example.org/./"), r)))
    return S.align(predictions, labels, lambda c: canonical_resource(c)["key"])


_CON_SQL = f"con as (select {_sql(CONTROLS)} from labels where {CONTROL_ROWS})"
_RULED_SQL = FIX_SQL.replace(_CON_SQL, f"""con0{_CON_SQL.removeprefix("con")}, ag as (select distinct world, a agent, a % 2 grp from (select world, from_agent a from pred union all select world, to_agent from pred)),
xc as (select distinct world, to_agent agent, reader_exchange exchange from pred where reader_exchange % 3 <> 0), pl as (select distinct world, from_agent sender, reader_exchange exchange from pred where pred_id % 4 = 0),
con as (select * from con0 union all select x.world, 1000000000000, s.agent, x.agent, x.exchange, null, null, null, null, null, null, case when s.grp = r.grp then 'shared_source' else 'boilerplate' end, 'structural'
    from xc x join ag r on r.world = x.world and r.agent = x.agent join ag s on s.world = x.world and s.agent <> x.agent where not exists (select 1 from pl where pl.world = x.world and pl.sender = s.agent and pl.exchange = x.exchange))""")


def _background(f: Fixture) -> DataFrame:
    p = f.predictions
    agents = p.select("world", F.col("from_agent").alias("agent")).union(p.select("world", "to_agent")).distinct().withColumn("grp", F.col("agent") % 2)
    exchanges = p.filter("reader_exchange % 3 <> 0").select("world", F.col("to_agent").alias("agent"), F.col("reader_exchange").alias("exchange")).distinct()
    return S.background_rules(agents, exchanges, p.filter("pred_id % 4 = 0").select("world", F.col("from_agent").alias("sender"), "reader_exchange"))


@query(f"""with {_RULED_SQL} select world, 'sender' as kind, agent, null as exchange, grp from ag union all select world, 'planted', sender, exchange, null from pl
    union all select x.world, 'reader', x.agent, x.exchange, r.grp from xc x join ag r on r.world = x.world and r.agent = x.agent""")
def background_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _background(Fixture(spark, sf_dir))


@query(f"with {_RULED_SQL} select world, pred_id, outcome, tier, reason from jd")
def judge_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over rules; the SQL has a control for each pair."""
    f = Fixture(spark, sf_dir)
    return S.judge(f.predictions, f.labels, f.controls, f.exemptions, f.coverage, rules=_background(f)).select("world", "pred_id", "outcome", "tier", "reason")


@query(f"with {FIX_SQL} select world, label_ord, found, suspected from oc")
def label_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).outcomes().select("world", "label_ord", "found", "suspected")


@query(f"with {FIX_SQL} select *, {RATES} from sr")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).rows()


@query(f"""with {FIX_SQL}, s as (select * replace (coalesce(tier, 'none') as tier) from sr), b as (select * from s union all select * replace ('*' as class) from s where class not in ('suspected', 'discarded'))
    select coalesce(dataset, '*') dataset, coalesce(route_kind, '*') route_kind, coalesce(carrier, '*') carrier, class, coalesce(tier, '*') tier, {', '.join(f'sum({c})::bigint {c}' for c in S.COUNTS)},
    sum(correct) / nullif(sum(correct) + sum(false_positive), 0) as precision, sum(found) / nullif(sum(expected), 0) as recall from b group by class, cube (dataset, route_kind, carrier, tier)""")
def score_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_cube(Fixture(spark, sf_dir).rows())


@query(f"""with {FIX_SQL}, t as (select dataset, world, tx_id, arg_min(route_kind, pred_id) route_kind, arg_min(quality, pred_id) quality, bool_or(outcome = 'correct') good, bool_or(outcome = 'false') bad from jd group by 1, 2, 3)
    select dataset, route_kind, quality, count(*) filter (where good) genuine, count(*) filter (where bad and not good) false_detection, count(*) filter (where not bad and not good) unlabeled from t group by 1, 2, 3""")
def tx_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tx_verdicts(Fixture(spark, sf_dir).judged())


@query(f"""with {FIX_SQL} select dataset, reason, case when class in ('suspected', 'discarded') then class end as class, count(*) n from jd
    where reason is not null and (class in ('suspected', 'discarded') or outcome = 'false') group by 1, 2, 3""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.violations(Fixture(spark, sf_dir).judged())


@query(rf"""with {FIX_SQL}, t as (select reason, substr(trim(regexp_replace(regexp_extract(text, '(?:^|\n)[ \t\r\x0b\f]*(\S[^\n]*)', 1), '\s+', ' ', 'g')), 1, 80) line from jd join documents d on d.doc_id = pred_id
    where outcome = 'false' and reason is not null and class not in ('suspected', 'discarded')) select reason, line, count(*) n from t group by 1, 2 order by n desc, reason, line limit 20""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return S.top_sources(f.judged(), f.texts)


_PARTS = "case when tier = 'out_of_reach' then 'out_of_reach' when tier = 'forwarding' then 'forwarding' else 'overall' end"


@query(f"""with {FIX_SQL}, s as (select *, {_PARTS} part, class not in ('suspected', 'discarded') content from sr)
    select {', '.join(f"coalesce(sum({c}) filter (where content and part = '{p}'), 0)::bigint {p}_{c}" for p in ('overall', 'out_of_reach', 'forwarding') for c in ('expected', 'found', 'correct', 'false_positive'))},
    {', '.join(f"coalesce(sum({c}) filter (where class = 'suspected' and part = 'overall'), 0)::bigint access_{c}" for c in ('expected', 'found'))},
    coalesce(sum(false_positive) filter (where content), 0)::bigint false_positives,
    sum(found) filter (where content and part = 'overall') / nullif(sum(expected) filter (where content and part = 'overall'), 0) overall_recall,
    sum(correct) filter (where content and part = 'overall') / nullif(sum(correct + false_positive) filter (where content and part = 'overall'), 0) overall_precision,
    sum(false_positive) filter (where content) * 1000.0 / 128 fp_per_1k from s""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_summary(Fixture(spark, sf_dir).rows(), 128, 1)


@query(f"with {FIX_SQL}, f as (select world, pred_id, reason from jd where outcome = 'false') select f.*, text excerpt from f left join documents d on d.doc_id = f.pred_id")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every false positive, with the whole text read."""
    f = Fixture(spark, sf_dir)
    return S.examples(f.judged(), f.texts)


@query(f"with {FIX_SQL}, f as (select world, label_ord, expects, tier, suspected from oc where not found order by 1, 2 limit 25) select f.*, substr(text, 1, 240) excerpt from f left join documents d on d.doc_id = f.label_ord")
def missed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return S.missed_examples(f.outcomes(), f.texts.withColumnRenamed("pred_id", "label_ord"), 25)


GATES = (
    ("recall-all", "recall", 0.2, None, None, None, None, None, None), ("recall-exact", "recall", 0.99, None, None, None, "exact", None, None), ("precision-d0", "precision", 0.1, "d0", "channel", None, None, None, None), ("other", "recall", 0.5, "d9", None, None, None, None, None),
    ("fp", "fp_per_1k", 5000.0, None, None, None, None, None, None), ("boilerplate", "violations", 1.0, None, None, None, None, None, "boilerplate"), ("none", "recall", 0.5, None, None, "nobody", None, None, None), ("likely", "precision", 0.5, "d1", None, "user", None, "likely", None),
)
GATE_COLUMNS = ("name", "check", "bound", "dataset", "route_kind", "carrier", "class", "tier", "reason")
_GATE_ROWS = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in row) + ")" for row in GATES)


@query(f"""with {FIX_SQL}, g as (select * from (values {_GATE_ROWS}) t({', '.join(f'"{c}"' for c in GATE_COLUMNS)})),
    v as (select dataset, reason, count(*) n from jd where reason is not null and outcome = 'false' and class not in ('suspected', 'discarded') group by 1, 2),
    s as (select g.name, coalesce(sum(expected), 0) expected, coalesce(sum(found), 0) found, coalesce(sum(correct), 0) correct, coalesce(sum(false_positive), 0) fp from g left join sr r on (g.dataset is null or g.dataset = r.dataset)
        and (g.route_kind is null or g.route_kind = r.route_kind) and (g.carrier is null or g.carrier = r.carrier) and (g.tier is null or g.tier = r.tier) and case when g.class is null then r.class not in ('suspected', 'discarded') else g.class = r.class end group by 1),
    h as (select g.name, coalesce(sum(n), 0) n from g left join v on (g.dataset is null or g.dataset = v.dataset) and (g.reason is null or g.reason = v.reason) group by 1),
    x as (select g.*, case g."check" when 'recall' then found / nullif(expected, 0) when 'precision' then correct / nullif(correct + fp, 0) when 'violations' then n else fp * 1000.0 / 128 end::double value,
        g.dataset is not null and g.dataset not in (select dataset from sr) other from g join s using (name) join h using (name))
    select name, case when other then 'other_dataset' when value is null then 'skipped' when case when "check" in ('recall', 'precision') then value >= bound else value <= bound end then 'pass' else 'fail' end status, case when not other then value end "value" from x""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    j = f.judged()
    rows = spark.createDataFrame(GATES, "name string, check string, bound double, dataset string, route_kind string, carrier string, class string, tier string, reason string")
    return S.gates(S.score_rows(j, f.outcomes()), S.violations(j), rows, 128)


@query(f"""with {FIX_SQL} select world, tx_id, class, carrier from (select *, row_number() over (partition by world, tx_id order by case class when 'exact' then 3 when 'normalized' then 2 when 'decoded' then 1 else 0 end desc, read_message, read_part, read_start, read_end, pred_id) rn
    from pred where class not in ('suspected', 'discarded')) where rn = 1""")
def strongest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strongest(Fixture(spark, sf_dir).predictions.filter(S.is_content(F.col("class"))))


_STATES = "case tx_id % 6 when 0 then 'confirmed' when 1 then 'classified' when 2 then 'aggregated' when 3 then 'suspected' when 4 then 'discarded' else 'detected' end"


@query(f"""with {FIX_SQL}, t as (select distinct world, tx_id, {_STATES} state from pred), m as (select * from pred where class not in ('suspected', 'discarded'))
    select t.world, t.tx_id, m.class, m.pred_id source from t join m on m.world = t.world and m.tx_id = t.tx_id where state in ('confirmed', 'classified', 'aggregated')
    union all select t.world, t.tx_id, state, p.pred_id from t join pred p on p.world = t.world and p.tx_id = t.tx_id where state in ('suspected', 'discarded')""")
def predictions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Fixture(spark, sf_dir).predictions
    return S.predictions_of(p.selectExpr("world", "tx_id", f"{_STATES} as state").distinct(), p.filter(S.is_content(F.col("class"))), p)


_TRUTH = ("doc_id % 8 as world", "doc_id as exchange", "doc_id % 20 as agent")
_SEEN = ("doc_id % 8 as world", "case when doc_id % 8 = 3 then doc_id % 4 else doc_id % 20 end as detected", "doc_id as exchange")
_ENDS = ("doc_id % 8 as world", "doc_id as pred_id", "doc_id % 20 as from_detected", "doc_id % 27 as to_detected")


@query(f"""with t as (select {_sql(_TRUTH)} from labels), a as (select {_sql(_SEEN)} from labels), p as (select {_sql(_ENDS)} from labels),
    b as (select a.world, detected, min(agent) agent, count(distinct agent) n from a join t on t.world = a.world and t.exchange = a.exchange group by 1, 2)
    select p.world, p.pred_id, f.agent from_agent, g.agent to_agent, case when p.world in (select world from b where n > 1) then 'failed_world' when f.agent is null or g.agent is null then 'unknown_agent' else 'ok' end status
    from p left join b f on f.world = p.world and f.detected = from_detected left join b g on g.world = p.world and g.detected = to_detected""")
def attribution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return S.attribute(rows.selectExpr(*_ENDS), rows.selectExpr(*_SEEN), rows.selectExpr(*_TRUTH)).select("world", "pred_id", "from_agent", "to_agent", "status")


_RUNS = ("concat('s', doc_id % 4) as scenario", "concat('det', doc_id % 2) as detector", "doc_id % 30 as found", "doc_id % 30 + doc_id % 5 as expected", "doc_id % 25 as correct", "doc_id % 6 as false_positive", "200 + doc_id % 50 as exchanges", "quality = 1 as passed")


@query(f"""with r as (select {_sql(_RUNS)} from labels), s as (select scenario, detector, sum(found)::bigint found, sum(expected)::bigint expected, sum(correct)::bigint correct, sum(false_positive)::bigint false_positive, sum(exchanges)::bigint exchanges, count(*) runs, count(*) filter (where passed) passed from r group by 1, 2)
    select *, {RATES}, false_positive * 1000.0 / exchanges as fp_per_1k from s""")
def release_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.release_summary(table(spark, sf_dir, "labels").selectExpr(*_RUNS))
