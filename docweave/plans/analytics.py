"""Analytics queries over the chat-log view, lifecycles and orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from docweave.operators import analytics as A
from docweave.operators import documents
from docweave.plans.views import LOG, chat_log, table

AS_OF = date(2024, 1, 30)


def _security(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", (F.col("event_type") == "error").alias("suspicious"),
        F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "medium").otherwise("low").alias("severity"),
        (F.col("event_id") % 2 == 0).alias("resolved"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
    )


def chat_kpis(spark, sf_dir):
    return A.chat_kpis(chat_log(spark, sf_dir))


def daily_calls(spark, sf_dir):
    return A.dense_daily(chat_log(spark, sf_dir), AS_OF)


def hourly_calls(spark, sf_dir):
    return A.dense_hourly(chat_log(spark, sf_dir), AS_OF)


def query_type_histogram(spark, sf_dir):
    return A.histogram(chat_log(spark, sf_dir), "query_type")


def status_histogram(spark, sf_dir):
    return A.histogram(chat_log(spark, sf_dir), "query_type", "unknown")


def security_stats(spark, sf_dir):
    return A.security_stats(_security(spark, sf_dir))


def user_risk(spark, sf_dir):
    per = _security(spark, sf_dir).groupBy("user_id").agg(F.count_if("suspicious").alias("suspicious"), F.count("*").alias("total"))
    points = A.user_risk(F.col("suspicious"), F.col("total"))
    return per.select("user_id", "suspicious", "total", points.alias("points"), A.risk_label(points).alias("label"))


def security_events(spark, sf_dir):
    return _security(spark, sf_dir).where("severity = 'high'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "severity")


def session_list(spark, sf_dir):
    return A.sessions(chat_log(spark, sf_dir)).select("session_id", "title", "calls", "confidence")


def last_turns(spark, sf_dir):
    return A.last_turns(chat_log(spark, sf_dir), 3).select("session_id", "log_id", "place")


def outcome_stats(spark, sf_dir):
    return A.value_stats(table(spark, sf_dir, "events"), "event_type", "value")


def order_stats(spark, sf_dir):
    return A.value_stats(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def top_users(spark, sf_dir):
    return chat_log(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(50)


def user_daily_activity(spark, sf_dir):
    return chat_log(spark, sf_dir).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def error_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").otherwise("INFO").alias("level"),
        F.concat(F.lit("module"), (F.col("user_id") % 23).cast("string")).alias("source"),
    )
    return A.error_stats(log)


def connection_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("connection_id"), F.col("o_orderstatus").alias("status"))
    return A.status_counts(o, "connection_id", {"indexed": ("F",), "pending": ("O",), "failed": ("P",)})


def cache_hit_rate(spark, sf_dir):
    hit = F.count_if(F.col("latency_ms") < 50)
    return chat_log(spark, sf_dir).agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"), F.round(hit * 100.0 / F.count("*"), 1).alias("hit_rate"))


def storage_summary(spark, sf_dir):
    one = lambda name, out: table(spark, sf_dir, name).agg(F.count("*").alias(out))
    return one("documents", "documents").crossJoin(one("embeddings", "vectors")).crossJoin(one("events", "chats"))


def event_type_top(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


def chunk_browse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return d.select("doc_id", F.substring("text", 1, 400).alias("head")).orderBy("doc_id").limit(50)


def file_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_key")).distinct()


def document_rebuild(spark, sf_dir):
    """Whole texts from their overlapping chunks, as digest."""
    made = documents.rebuild(documents.char_chunks(table(spark, sf_dir, "documents"), strip=False))
    return made.select("doc_id", "n_chunks", F.sha2("text", 256).alias("sha"))


def customer_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hit = F.contains(F.lower("c_name"), F.lit("00012")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))
    return c.where(hit).select("c_custkey", "c_name", "c_mktsegment")


_SEC = """sec as (select user_id, event_id, ts, event_type = 'error' as suspicious, case event_type when 'error' then 'high' when 'click' then 'medium' else 'low' end as severity,
  event_id % 2 = 0 as resolved from events)"""
_POINTS = """case when {n} = 0 then 0 when {b} >= 5 or {b} * 100.0 / {n} >= 30 then 90 when {b} >= 3 or {b} * 100.0 / {n} >= 15 then 65
  when {b} >= 1 or {b} * 100.0 / {n} >= 5 then 35 else 5 end"""

QUERIES = {
    f.__name__: f
    for f in (
        chat_kpis, daily_calls, hourly_calls, query_type_histogram, status_histogram, security_stats, user_risk, security_events,
        session_list, last_turns, outcome_stats, order_stats, top_users, user_daily_activity, error_stats, connection_status,
        cache_hit_rate, storage_summary, event_type_top, chunk_browse, file_names, document_rebuild, customer_search,
    )
}
ORACLES = {
    "chat_kpis": f"""with {LOG} select count(*) as total, round(avg(latency_ms), 1) as avg_latency_ms, round(count(*) filter (where latency_ms < 50) * 100.0 / greatest(count(*), 1), 1) as fast_rate,
  round(count(*) filter (where graph_used) * 100.0 / greatest(count(*), 1), 1) as graph_rate, round(avg(confidence), 1) as avg_confidence from log""",
    "daily_calls": f"""with {LOG}, spine as (select cast(date '2024-01-30' - cast(i as int) as date) as day from range(14) t(i))
select day, coalesce(n, 0) as n from spine left join (select cast(created_at as date) as day, count(*) as n from log group by 1) using (day)""",
    "hourly_calls": f"""with {LOG} select hour, coalesce(n, 0) as n from (select i as hour from range(24) t(i))
left join (select hour(created_at) as hour, count(*) as n from log where cast(created_at as date) = date '2024-01-30' group by 1) using (hour)""",
    "query_type_histogram": f"with {LOG} select query_type, count(*) as n from log where query_type is not null group by 1",
    "status_histogram": f"with {LOG} select coalesce(query_type, 'unknown') as query_type, count(*) as n from log group by 1",
    "security_stats": f"""with {_SEC}, per as (select user_id, count(*) filter (where suspicious) as b, count(*) as n from sec group by 1)
select count(*) as total, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where not resolved) as unresolved,
  (select count(*) from per where {_POINTS.format(b='b', n='n')} >= 65) as risky_users from sec""",
    "user_risk": f"""with {_SEC}, per as (select user_id, count(*) filter (where suspicious) as suspicious, count(*) as total from sec group by 1),
p as (select *, {_POINTS.format(b='suspicious', n='total')} as points from per)
select *, case when points >= 90 then 'critical' when points >= 65 then 'high' when points >= 35 then 'medium' else 'low' end as label from p""",
    "security_events": f"with {_SEC} select event_id, user_id, severity from sec where severity = 'high' order by ts desc, event_id desc limit 50",
    "session_list": f"""with {LOG} select session_id, substring(min_by(question, (created_at, log_id)), 1, 80) as title, count(*) as calls, round(avg(nullif(confidence, 0)), 0) as confidence
from log group by session_id order by max(created_at) desc, session_id limit 50""",
    "last_turns": f"with {LOG} select session_id, log_id, row_number() over (partition by session_id order by created_at desc, log_id desc) as place from log qualify place <= 3",
    "outcome_stats": "select event_type, count(*) as n, round(avg(coalesce(value, 0)), 6) as mean, round(sum(coalesce(value, 0)), 4) as total, min(coalesce(value, 0)) as least, max(coalesce(value, 0)) as most from events group by 1",
    "order_stats": "select o_orderpriority, count(*) as n, round(avg(o_totalprice), 6) as mean, round(sum(o_totalprice), 4) as total, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1",
    "top_users": f"with {LOG} select user_id, count(*) as n from log group by 1 order by n desc, user_id limit 50",
    "user_daily_activity": f"with {LOG} select user_id, cast(created_at as date) as day, count(*) as n from log group by 1, 2",
    "error_stats": """with l as (select case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' else 'INFO' end as level, 'module' || cast(user_id % 23 as varchar) as source from events)
select 'level' as kind, level as name, count(*) as n from l group by 2 union all (select 'source', source, count(*) as n from l group by 2 order by n desc, source limit 10)""",
    "connection_status": "select o_custkey % 50 as connection_id, count(*) filter (where o_orderstatus = 'F') as indexed, count(*) filter (where o_orderstatus = 'O') as pending, count(*) filter (where o_orderstatus = 'P') as failed from orders group by 1",
    "cache_hit_rate": f"with {LOG} select count(*) filter (where latency_ms < 50) as hits, count(*) filter (where not coalesce(latency_ms < 50, false)) as misses, round(count(*) filter (where latency_ms < 50) * 100.0 / count(*), 1) as hit_rate from log",
    "storage_summary": "select (select count(*) from documents) as documents, (select count(*) from embeddings) as vectors, (select count(*) from events) as chats",
    "event_type_top": "select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 10",
    "chunk_browse": "select doc_id, substring(text, 1, 400) as head from documents where contains(lower(text), 'license') order by doc_id limit 50",
    "file_names": "select distinct source as doc_key from documents",
    "document_rebuild": "select doc_id, cast((length(text) - 1) // 1600 + 1 as bigint) as n_chunks, sha256(text) as sha from documents where length(text) > 0",
    "customer_search": "select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), '00012') or contains(lower(c_mktsegment), 'auto')",
}
