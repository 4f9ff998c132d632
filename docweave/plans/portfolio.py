"""Queries over lifecycles with documents, pages and document links."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import documents as D
from docweave.operators import graph as G
from docweave.operators import lifecycle as L
from docweave.operators import portfolio as P
from docweave.plans.views import EDGES, LC, kg_edges, lifecycle_events, table

NOW = "2024-02-01 00:00:00"
#: Lifecycles of the event view and five without events; state, type and date follow from the number before the dash.
LIFE = f"""{LC}, ids as (select distinct lifecycle_id from lc union all select 'none-' || c_custkey from customer where c_custkey <= 5),
life as (select lifecycle_id, length(lifecycle_id) as k, case length(lifecycle_id) % 3 when 0 then 'active' when 1 then 'completed' else 'in_progress' end as status,
  ['procurement', 'hr', 'sales', 'other'][length(lifecycle_id) % 4 + 1] as lifecycle_type from ids),
ev as (select *, case when event_id % 11 = 0 then 'Deal closed by total: $' || (event_id % 900) when event_id % 3 = 0 then 'Amount 1,200' else 'noted' end as summary from lc),
docs as (select lifecycle_id, event_id % 97 as document_id, event_id + case when event_id % 5 = 0 then 1 else 0 end as event_id,
  case when event_id % 7 = 0 then 'x' || chr(10) || ' Status:  Paid ' || chr(10) || 'y' when event_id % 7 = 1 then 'Status: Open' else 'Status: not here, Paid' end as text,
  ts as uploaded_at, case when event_id % 4 = 0 then value end as processing_s from lc where event_type in ('DOCUMENT_ADDED', 'CONTRACT_UPLOADED'))"""


def _events(spark, sf_dir):
    i = F.col("event_id")
    summary = F.when(i % 11 == 0, F.format_string("Deal closed by total: $%d", i % 900)).when(i % 3 == 0, "Amount 1,200").otherwise("noted")
    return lifecycle_events(spark, sf_dir).withColumn("summary", summary)


def _life(spark, sf_dir):
    none = table(spark, sf_dir, "customer").where("c_custkey <= 5").select(F.concat(F.lit("none-"), F.col("c_custkey").cast("string")).alias("lifecycle_id"))
    ids = lifecycle_events(spark, sf_dir).select("lifecycle_id").distinct().unionByName(none)
    k = F.length("lifecycle_id")
    return ids.select(
        "lifecycle_id", F.when(k % 3 == 0, "active").when(k % 3 == 1, "completed").otherwise("in_progress").alias("status"),
        F.element_at(F.array(*[F.lit(t) for t in ("procurement", "hr", "sales", "other")]), k % 4 + 1).alias("lifecycle_type"),
    )


def _documents(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "x\n Status:  Paid \ny").when(i % 7 == 1, "Status: Open").otherwise("Status: not here, Paid")
    rows = lifecycle_events(spark, sf_dir).where("event_type in ('DOCUMENT_ADDED', 'CONTRACT_UPLOADED')")
    return rows.select(
        "lifecycle_id", (i % 97).alias("document_id"), (i + F.when(i % 5 == 0, 1).otherwise(0)).alias("event_id"), text.alias("text"),
        F.col("ts").alias("uploaded_at"), F.when(i % 4 == 0, F.col("value")).alias("processing_s"),
    )


def _outcomes(spark, sf_dir):
    e = lifecycle_events(spark, sf_dir).where("event_type = 'INVOICE_PAID'")
    kind = F.element_at(F.array(*[F.lit(t) for t in P.VARIANCE_OUTCOMES]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("lifecycle_id", kind.alias("outcome_type"), ((F.col("event_id") % 301 - 150) * 1.0).alias("value"), F.col("ts").alias("recorded_at"))


def _notes(spark, sf_dir):
    e = lifecycle_events(spark, sf_dir).where("event_type = 'RISK_ALERT'")
    return e.select("lifecycle_id", ((F.col("event_id") % 77 - 38) * 0.5).alias("percent"))


VAR = """out_rows as (select lifecycle_id, ['COST_OVERRUN', 'TIME_OVERRUN', 'VARIANCE', 'DEVIATION'][event_id % 4 + 1] as outcome_type, event_id % 4 as rk, (event_id % 301 - 150) * cast(1 as double) as value, ts as recorded_at from lc where event_type = 'INVOICE_PAID'),
means as (select lifecycle_id, rk, avg(value) as m from out_rows group by 1, 2 having abs(avg(value)) <= 100),
told as (select lifecycle_id, min_by(round(case when abs(m) <= 1 then m * 100 else m end, 1), rk) as told from means group by 1),
noted as (select lifecycle_id, max_by(round(p, 1), (abs(p), p)) as noted from (select lifecycle_id, (event_id % 77 - 38) * cast(0.5 as double) as p from lc where event_type = 'RISK_ALERT') group by 1),
var as (select lifecycle_id, case when coalesce(told, 0) <> 0 then told else coalesce(noted, 0) end as v from told full join noted using (lifecycle_id))"""


def lifecycle_parts(spark, sf_dir):
    made = P.with_parts(_life(spark, sf_dir), _events(spark, sf_dir), _documents(spark, sf_dir))
    return made.select("lifecycle_id", "n_events", "n_documents", F.md5(F.array_join(F.col("document_ids").cast("array<string>"), ",")).alias("documents"))


def newest_lifecycles(spark, sf_dir):
    first = lifecycle_events(spark, sf_dir).groupBy("lifecycle_id").agg(F.min("ts").alias("created_at"))
    return P.newest_first(_life(spark, sf_dir).join(first, "lifecycle_id", "left")).limit(20).select("lifecycle_id")


def own_event_documents(spark, sf_dir):
    return P.own_event_documents(_documents(spark, sf_dir), _events(spark, sf_dir)).groupBy("lifecycle_id").agg(F.count("*").alias("n"))


def lifecycle_subgraph(spark, sf_dir):
    nodes, links = P.subgraph(_events(spark, sf_dir), _documents(spark, sf_dir))
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(links.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")))


def retro_evaluation(spark, sf_dir):
    return P.evaluation(_life(spark, sf_dir), _events(spark, sf_dir), _documents(spark, sf_dir))


def retro_counts(spark, sf_dir):
    return P.evaluation_counts(P.evaluation(_life(spark, sf_dir), _events(spark, sf_dir), _documents(spark, sf_dir)))


def invoice_outcomes(spark, sf_dir):
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "CHANGE_ORDER", "PURCHASE_ORDER_UPLOADED").when(F.col("event_type") == "INVOICE_PAID", "INVOICE_UPLOADED").otherwise(F.col("event_type"))
    return P.document_outcomes(e.withColumn("event_type", kind))


def change_outcomes(spark, sf_dir):
    return P.change_outcomes(_events(spark, sf_dir))


def outcome_extraction(spark, sf_dir):
    return P.outcome_extraction(_life(spark, sf_dir), P.change_outcomes(_events(spark, sf_dir)))


def outcome_list(spark, sf_dir):
    return P.filtered_outcomes(_outcomes(spark, sf_dir), outcome_type="VARIANCE", most=30).select("lifecycle_id", "value")


def full_metrics(spark, sf_dir):
    e, docs = _events(spark, sf_dir), _documents(spark, sf_dir)
    v = P.variance(_outcomes(spark, sf_dir), _notes(spark, sf_dir))
    return P.full_metrics(e, _life(spark, sf_dir).select("lifecycle_id", "lifecycle_type"), docs.select("lifecycle_id", F.col("uploaded_at").alias("ts")), v, F.to_timestamp(F.lit(NOW)))


def full_risk(spark, sf_dir):
    n = _documents(spark, sf_dir).groupBy("lifecycle_id").agg(F.count("*").alias("n_revisions"))
    return P.full_risk(_life(spark, sf_dir), _events(spark, sf_dir), n, P.variance(_outcomes(spark, sf_dir), _notes(spark, sf_dir)))


def lifecycle_details(spark, sf_dir):
    return P.detail_text(_life(spark, sf_dir), _events(spark, sf_dir), full_risk(spark, sf_dir).select("lifecycle_id", "risk_score", "risk_label"))


def upload_stats(spark, sf_dir):
    d = _documents(spark, sf_dir)
    undated = d.withColumn("uploaded_at", F.lit(None).cast("timestamp"))
    at = F.to_timestamp(F.lit("2024-01-20 12:00:00"))
    return P.upload_stats(d, at).withColumn("kind", F.lit("dated")).unionByName(P.upload_stats(undated, at).withColumn("kind", F.lit("undated")))


def lifecycle_counts(spark, sf_dir):
    return P.status_counts(_life(spark, sf_dir))


def lifecycle_export(spark, sf_dir):
    return P.as_json(_life(spark, sf_dir).select("lifecycle_id", "status"))


def _mentions(spark, sf_dir):
    e = kg_edges(spark, sf_dir)
    return e.select(F.col("from_node").alias("source"), "seq", F.col("to_node").alias("entity"))


def document_links(spark, sf_dir):
    return G.linked_documents(_mentions(spark, sf_dir))


def document_neighbours(spark, sf_dir):
    return G.document_neighbours(G.linked_documents(_mentions(spark, sf_dir)), "supplier:1")


def graph_export(spark, sf_dir):
    edges = G.upsert_edges(kg_edges(spark, sf_dir), ["seq", "sub", "weight"])
    nodes, some = G.export(G.upsert_nodes(kg_edges(spark, sf_dir), ["seq", "sub", "weight"]), edges, 20)
    return nodes.select(F.col("name").alias("line")).unionByName(some.select(F.concat_ws(">", "from_node", "relation", "to_node").alias("line")))


def bounded_hops(spark, sf_dir):
    return G.bounded_hops(kg_edges(spark, sf_dir), "supplier:2")


def page_meta(spark, sf_dir):
    head = "<meta name='description' content='About <b>us</b>'><meta content=\"Big & Co\" property=\"og:title\"><nav><a class='x' href='/a'> One  <i>two</i></a><a href='/b'></a></nav>"
    people = '<script type="application/ld+json"> {"@type": "Person", "name": "Ada L"} </script>'
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.when(F.col("page_id") % 2 == 0, head + people).otherwise(""), F.coalesce("html", F.lit(""))))
    made = D.page_meta(p).withColumn("people", D.people_in(F.col("html"))).where("page_id % 2 = 0")
    return made.select("page_id", "description", "og_title", F.element_at("nav_links", 1).alias("first_link"), F.size("json_ld") >= 1, F.element_at("people", 1).alias("person")).toDF("page_id", "description", "og_title", "first_link", "has_json", "person")


def page_navigation(spark, sf_dir):
    """The navigation of all pages, from their own html."""
    made = D.page_meta(table(spark, sf_dir, "pages"))
    return made.select("page_id", F.size("nav_links").alias("n"), F.array_join("nav_links", " | ").alias("links"))


def linked_data(spark, sf_dir):
    """Persons and organisations of JSON-LD made of all pages' own titles and addresses: a graph, a list, a nested member, and blocks cut short."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r'[\\"]', "")
    person = F.concat(F.lit('{"name": "'), title, F.lit('", "@type": "Person"}'))
    body = (
        F.when(k == 0, F.concat(F.lit('{"@graph": [{"@type": ["Organization", "Brand"], "name": "'), "url", F.lit('", "employee": ['), person, F.lit("]}]}")))
        .when(k == 1, F.concat(F.lit("["), person, F.lit(', {"@type": "Organization", "name": " '), "url", F.lit(' "}, 7, null]')))
        .when(k == 2, F.concat(F.lit('{"@type": "WebPage", "author": {"@type": "Person", "worksFor": {"@type": "Organization", "name": "'), "url", F.lit('"}}}')))
        .otherwise(F.concat(F.lit('{"@graph": ['), person))
    )
    html = F.concat(F.lit("<script type='application/ld+json'> "), body, F.lit(" </script>"), F.coalesce("html", F.lit("")))
    return D.linked_data(p.withColumn("html", html))


def url_parts(spark, sf_dir):
    u = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://"), F.when(F.col("c_custkey") % 2 == 0, "www.").otherwise(""), F.lit("acme"), (F.col("c_custkey") % 3).cast("string"), F.lit(".com/p/#top")).alias("url"))
    return u.select("c_custkey", D.normal_url(F.col("url")).alias("url"), D.same_domain(F.col("url"), F.lit("acme1.com")).alias("own"), D.organisation(F.col("url")).alias("name"))


def crawl_order(spark, sf_dir):
    """A crawl of up to 500 pages over a tree of addresses of all customers: customer k links to six others."""
    url = lambda k: F.concat(F.lit("https://a.com/"), F.when(k % 3 == 0, "about/").when(k % 3 == 1, "blog/").otherwise("p"), k.cast("string"), F.when(k % 3 == 2, ".pdf").otherwise(""))
    k = F.col("c_custkey")
    pages, link = table(spark, sf_dir, "customer").select(url(k).alias("url"), k), F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: url(6 * k - 4 + i)))
    return D.crawl(spark.range(1).select(url(F.lit(1)).alias("url")), pages, link=link).select("url", "depth", "seq")


_CLOSED = "('" + "', '".join(P.CLOSED_STATUSES) + "')"
_TERM = "(regexp_matches(upper(event_type), '" + "|".join(L.TERMINAL) + "') or regexp_matches(lower(summary), '" + "|".join(P.TERMINAL_TERMS) + "'))"
_EVAL = f"""e as (select lifecycle_id, bool_or({_TERM}) as in_events, bool_or(not {_TERM} and regexp_matches(upper(event_type), '_UPLOADED|_CREATED|_ADDED|DOCUMENT')) as reopening from ev group by 1),
d as (select lifecycle_id, bool_or(text like 'x%') as in_documents from docs group by 1),
r as (select lifecycle_id, status, coalesce(in_events, false) as in_events, coalesce(reopening, false) as reopening, coalesce(in_documents, false) as in_documents, status in {_CLOSED} as closed,
  coalesce(in_events, false) or coalesce(in_documents, false) as ends from life left join e using (lifecycle_id) left join d using (lifecycle_id)),
judged as (select *, case when closed and reopening and not ends then 'reopened' when not closed and ends then 'completed' else 'unchanged' end as action from r)"""
_SUM = "case when event_id % 11 = 0 then event_id % 900 when event_id % 3 = 0 then 1200 end"
_CH = "regexp_matches(upper(event_type), 'CHANGE|MODIFY|UPDATE{}')"
_DAYS = "cast(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) as bigint)"
_URL = "'https://a.com/' || case {k} % 3 when 0 then 'about/' else 'blog/' end || {k}"
_MENTION = f"""{EDGES}, m as (select distinct from_node as source, to_node as entity from raw_edges),
o as (select source, entity from (select from_node as source, to_node as entity, row_number() over (partition by from_node order by seq, to_node) as n from raw_edges) where n <= 20),
x as (select entity, min(source) as lo, max(source) as hi from m group by 1 having min(source) <> max(source)),
links as (select distinct source as from_node, 'SHARES_ENTITY_WITH' as relation, case when source = lo then hi else lo end as to_node from o join x using (entity) union select source, 'CO_MENTIONS', entity from o join x using (entity))"""

QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_parts, newest_lifecycles, own_event_documents, lifecycle_subgraph, retro_evaluation, retro_counts, invoice_outcomes, change_outcomes,
        outcome_extraction, outcome_list, full_metrics, full_risk, lifecycle_details, upload_stats, lifecycle_counts, lifecycle_export, document_links,
        document_neighbours, graph_export, bounded_hops, page_meta, page_navigation, linked_data, url_parts, crawl_order,
    )
}
_RISK = f"""s as (select lifecycle_id, count(*) as n, count(*) filter (where regexp_matches(upper(event_type), 'CHANGE|MODIFY')) as c, {_DAYS} as d from lc group by 1),
rv as (select lifecycle_id, count(*) as r from docs group by 1),
sc as (select lifecycle_id, round(least(cast(0.95 as double), cast(0.2 as double) + least(cast(0.15 as double), n * cast(0.03 as double)) + least(cast(0.25 as double), coalesce(r, 0) * cast(0.1 as double)) + least(cast(0.2 as double), c * cast(0.05 as double))
  + least(cast(0.3 as double), abs(coalesce(v, 0)) / 100 * cast(0.5 as double)) + case when n <= 1 then cast(0 as double) when d > 0 then least(cast(0.15 as double), n / d * cast(0.05 as double)) else cast(0.1 as double) end), 6) as x
  from s left join rv using (lifecycle_id) left join var using (lifecycle_id))"""
ORACLES = {
    "lifecycle_parts": f"""with {LIFE}, e as (select lifecycle_id, count(distinct event_id) as n from lc group by 1),
d as (select lifecycle_id, count(distinct document_id) as n, string_agg(distinct cast(document_id as varchar), ',' order by cast(document_id as varchar)) as s, list_sort(list(distinct document_id)) as l from docs group by 1)
select lifecycle_id, coalesce(e.n, 0) as n_events, coalesce(d.n, 0) as n_documents, md5(array_to_string(l, ',')) as documents from life left join e using (lifecycle_id) left join d using (lifecycle_id)""",
    "newest_lifecycles": f"with {LIFE} select lifecycle_id from life left join (select lifecycle_id, min(ts) as c from lc group by 1) using (lifecycle_id) order by c desc nulls first, lifecycle_id limit 20",
    "own_event_documents": f"with {LIFE} select lifecycle_id, count(*) as n from docs where (lifecycle_id, event_id) in (select lifecycle_id, event_id from lc) group by 1",
    "lifecycle_subgraph": f"""with {LIFE} select 'Lifecycle' as kind, count(distinct lifecycle_id) as n from lc union all select 'Event', count(distinct event_id) from lc union all select 'Document', count(distinct document_id) from docs
union all select 'HAS_EVENT', count(*) from (select distinct lifecycle_id, event_id from lc) union all select 'HAS_DOCUMENT', count(*) from (select distinct lifecycle_id, document_id from docs)
union all select 'RELATES_TO', count(*) from (select distinct document_id, event_id from docs where (lifecycle_id, event_id) in (select lifecycle_id, event_id from lc))""",
    "retro_evaluation": f"""with {LIFE}, {_EVAL} select lifecycle_id, status, in_events, in_documents, action, 'Currently ' || status || case when closed then ' (closed status)' else ' (active status)' end || ' | ' ||
  case when closed and ends then 'Has terminal signals - should remain completed' when closed then 'No terminal signals found' when ends then 'Has terminal signals - SHOULD BE COMPLETED' else 'No terminal signals found - correctly active' end as reason from judged""",
    "retro_counts": f"""with {LIFE}, {_EVAL} select count(*) as evaluated, count(*) filter (where action = 'completed') as completed, count(*) filter (where action = 'reopened') as reopened,
  count(*) filter (where action = 'unchanged') as unchanged from judged""",
    "invoice_outcomes": f"""with {LIFE}, t as (select lifecycle_id, event_type, ts, event_id, cast({_SUM} as double) as s from lc where event_type in ('CHANGE_ORDER', 'INVOICE_PAID')),
p as (select lifecycle_id, s as a from (select *, row_number() over (partition by lifecycle_id order by ts, event_id) as n from t where event_type = 'CHANGE_ORDER') where n = 1),
i as (select lifecycle_id, s as b from (select *, row_number() over (partition by lifecycle_id order by ts desc, event_id desc) as n from t where event_type = 'INVOICE_PAID') where n = 1)
select lifecycle_id, case when b > a then 'COST_OVERRUN' else 'COST_UNDERRUN' end as outcome_type, abs(b - a) as value from p join i using (lifecycle_id) where a > 0 and b <> 0 and abs((b - a) / a * 100) > 5""",
    "change_outcomes": f"with {LC} select lifecycle_id, 'CHANGE_ORDERS' as outcome_type, cast(count(*) as double) as value from lc where {_CH.format('')} group by 1",
    "outcome_extraction": f"""with {LIFE}, o as (select lifecycle_id, 1 as n from lc where {_CH.format('')} group by 1)
select count(*) as processed, coalesce(sum(n), 0) as outcomes_created, count(n) as lifecycles_with_outcomes from life left join o using (lifecycle_id) where status in ('completed', 'closed')""",
    "outcome_list": f"with {LC}, {VAR} select lifecycle_id, value from out_rows where outcome_type = 'VARIANCE' order by recorded_at desc, lifecycle_id limit 30",
    "full_metrics": f"""with {LIFE}, {VAR}, own as (select lifecycle_id, count(*) filter (where {_CH.format('|REVISION')}) as x, count(*) filter (where {_CH.format('|REVISION')} and ts >= timestamp '{NOW}' - interval 30 day) as x30, greatest(1, {_DAYS}) as days from lc group by 1),
inf as (select lifecycle_id, count(*) as n, count(*) filter (where uploaded_at >= timestamp '{NOW}' - interval 30 day) as n30 from docs group by 1)
select lifecycle_id, greatest(x, coalesce(n, 0)) as change_orders, greatest(x30, coalesce(n30, 0)) as change_orders_30d, days as cycle_time_days,
  case lifecycle_type when 'hr' then 30 when 'sales' then 45 else 18 end as cycle_time_target, coalesce(v, 0) as variance_percent,
  case when v > 5 then 'above_threshold' when v < -5 then 'below_threshold' else 'normal' end as variance_status
from own left join inf using (lifecycle_id) left join life using (lifecycle_id) left join var using (lifecycle_id)""",
    "full_risk": f"""with {LIFE}, {VAR}, {_RISK}
select lifecycle_id, coalesce(x, cast(0.2 as double)) as risk_score, case when x >= 0.7 then 'high' when x >= 0.4 then 'medium' else 'low' end as risk_label from life left join sc using (lifecycle_id)""",
    "lifecycle_details": f"""with {LIFE}, {VAR}, {_RISK}, n as (select *, row_number() over (partition by lifecycle_id order by ts desc, event_id desc) as r from lc), t as (select lifecycle_id, string_agg(event_type, ', ' order by r desc) as t from n where r <= 5 group by 1),
cn as (select lifecycle_id, count(*) as n from lc group by 1)
select lifecycle_id, 'Lifecycle detail for ' || lifecycle_id || ':' || chr(10) || '- Status: ' || status || chr(10) || '- Events: ' || coalesce(cn.n, 0) || chr(10) || '- Recent event types: ' || coalesce(t, 'none') || chr(10) || '- Risk: ' || cast(round(coalesce(x, cast(0.2 as double)) * 100) as int) || '% (' || case when x >= 0.7 then 'high' when x >= 0.4 then 'medium' else 'low' end || ')' as detail
from life left join sc using (lifecycle_id) left join t using (lifecycle_id) left join cn using (lifecycle_id)""",
    "upload_stats": f"""with {LIFE} select count(*) filter (where cast(uploaded_at as date) = date '2024-01-20' and uploaded_at <= timestamp '2024-01-20 12:00:00') as today, count(*) filter (where cast(uploaded_at as date) = date '2024-01-19') as yesterday,
  coalesce(round(avg(processing_s) filter (where cast(uploaded_at as date) = date '2024-01-20' and uploaded_at <= timestamp '2024-01-20 12:00:00' and processing_s > 0), 2), 0) as avg_processing_s, 'dated' as kind from docs
union all select count(*), 0, 0, 'undated' from docs""",
    "lifecycle_counts": f"with {LIFE} select count(*) as total, count(*) filter (where status in ('active', 'pending', 'in_progress')) as active from life",
    "lifecycle_export": f"""with {LIFE} select '{{"lifecycle_id":"' || lifecycle_id || '","status":"' || status || '"}}' as json from life""",
    "document_links": f"with {_MENTION} select * from links",
    "document_neighbours": f"with {_MENTION} select distinct case when from_node = 'supplier:1' then to_node else from_node end as document from links where relation = 'SHARES_ENTITY_WITH' and 'supplier:1' in (from_node, to_node)",
    "graph_export": f"""with {EDGES} (select distinct name as line from (select from_node as name from raw_edges union select to_node from raw_edges) order by 1 limit 40)
union all (select distinct from_node || '>' || relation || '>' || to_node as line from raw_edges order by 1 limit 20)""",
    "bounded_hops": f"""with {EDGES}, arcs as (select from_node as a, to_node as b from raw_edges union select to_node, from_node from raw_edges), few as (select a, b from arcs qualify row_number() over (partition by a order by b) <= 20),
h1 as (select distinct b as name from few where a = 'supplier:2'), h2 as (select distinct b as name from few join h1 on a = name where b <> 'supplier:2' and b not in (select name from h1))
select * from (select name, 1 as hop from h1 union all select name, 2 from h2) order by hop, name limit 30""",
    "page_meta": "select page_id, 'About us' as description, 'Big & Co' as og_title, 'One two → /a' as first_link, true as has_json, 'Ada L' as person from pages where page_id % 2 = 0",
    "page_navigation": r"""with n as (select page_id, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) as nav from pages),
l as (select page_id, list_filter(list_transform(list_zip(regexp_extract_all(nav, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2), regexp_extract_all(nav, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)),
  lambda m: {'label': trim(regexp_replace(regexp_replace(m[1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 'to': m[2]}), lambda m: m.label <> '')[1:25] as l from n)
select page_id, cast(len(l) as int) as n, array_to_string(list_transform(l, lambda m: m.label || ' → ' || m.to), ' | ') as links from l""",
    "linked_data": r"""with recursive p as (select page_id, url, page_id % 4 as k, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\"]', '', 'g') as t from pages),
b as (select page_id, case k when 0 then '{"@graph": [{"@type": ["Organization", "Brand"], "name": "' || url || '", "employee": [{"name": "' || t || '", "@type": "Person"}]}]}'
  when 1 then '[{"name": "' || t || '", "@type": "Person"}, {"@type": "Organization", "name": " ' || url || ' "}, 7, null]'
  when 2 then '{"@type": "WebPage", "author": {"@type": "Person", "worksFor": {"@type": "Organization", "name": "' || url || '"}}}' else '{"@graph": [' end as j from p),
n(page_id, j, d) as (select page_id, cast(j as json), 0 from b where json_valid(j)
  union all select page_id, unnest(case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then json_extract(j, '$.*') else [] end), d + 1 from n where d < 6),
t as (select page_id, unnest(case json_type(j, '$."@type"') when 'ARRAY' then json_extract_string(j, '$."@type"[*]') else [json_extract_string(j, '$."@type"')] end) as type, trim(json_extract_string(j, '$.name'), ' ') as name from n where json_type(j) = 'OBJECT')
select distinct page_id, type, name from t where type is not null and name <> ''""",
    "url_parts": """with u as (select c_custkey, case when c_custkey % 2 = 0 then 'www.' else '' end || 'acme' || c_custkey % 3 || '.com' as h from customer)
select c_custkey, 'https://' || h || '/p' as url, h in ('acme1.com', 'www.acme1.com') as own, 'Acme' || c_custkey % 3 as name from u""",
    "crawl_order": f"""with recursive t as (select cast(1 as bigint) as k, 0 as depth union all select unnest(range(6 * k - 4, 6 * k + 2)), depth + 1 from t where depth < 6 and k in (select c_custkey from customer) and k % 3 <> 2),
u as (select {_URL.format(k='k')} as url, k, depth, case k % 3 when 0 then 1 else 5 end + depth as score from t where k % 3 <> 2)
select url, depth, row_number() over (order by depth, score, url) as seq from u order by seq limit 500""",
}
