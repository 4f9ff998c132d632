"""Lifecycle queries over the event view and purchase orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import lifecycle as L
from docweave.plans.views import LC, PO, lifecycle_events, po_versions


def lifecycle_timeline(spark, sf_dir):
    t = L.timeline(lifecycle_events(spark, sf_dir))
    return t.select("lifecycle_id", "n_events", F.element_at("types", 1).alias("first_type"), F.element_at("types", -1).alias("last_type"), F.sha2(F.array_join("types", ">"), 256).alias("sha"))


def lifecycle_status(spark, sf_dir):
    return L.status_fold(lifecycle_events(spark, sf_dir)).select("lifecycle_id", "status", "reopen_count")


def lifecycle_evaluation(spark, sf_dir):
    return L.evaluate(lifecycle_events(spark, sf_dir))


def lifecycle_metrics(spark, sf_dir):
    return L.metrics(lifecycle_events(spark, sf_dir))


def lifecycle_risk(spark, sf_dir):
    return L.risk(lifecycle_events(spark, sf_dir))


def risk_trend(spark, sf_dir):
    return L.risk_trend(lifecycle_events(spark, sf_dir))


def mean_cycle(spark, sf_dir):
    return L.mean_cycle(lifecycle_events(spark, sf_dir))


def notifications(spark, sf_dir):
    return L.notifications(lifecycle_events(spark, sf_dir), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).drop("ts")


def risky_lifecycles(spark, sf_dir):
    e = lifecycle_events(spark, sf_dir)
    return e.where(L.holds(F.col("event_type"), "RISK", "ALERT")).agg(F.count_distinct("lifecycle_id").alias("lifecycles"))


def repeated_changes(spark, sf_dir):
    e = lifecycle_events(spark, sf_dir).where(L.holds(F.col("event_type"), "CHANGE", "DELAY"))
    return e.groupBy("lifecycle_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "lifecycle_id").limit(3)


def top_lifecycles(spark, sf_dir):
    e = lifecycle_events(spark, sf_dir)
    return e.groupBy("lifecycle_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lifecycle_id").limit(5)


def active_lifecycles(spark, sf_dir):
    """Semi-join: lifecycles that are not completed, or have a change event."""
    e = lifecycle_events(spark, sf_dir)
    status = L.evaluate(e).select("lifecycle_id", "status")
    changed = e.where(L.holds(F.col("event_type"), "CHANGE")).select("lifecycle_id").distinct()
    return status.where("status <> 'completed'").select("lifecycle_id").unionByName(status.join(changed, "lifecycle_id", "left_semi").select("lifecycle_id")).agg(
        F.count_distinct("lifecycle_id").alias("lifecycles")
    )


def lifecycle_activity(spark, sf_dir):
    return L.activity(lifecycle_events(spark, sf_dir)).select("lifecycle_id", "n_events", "sentence")


def lifecycle_graph(spark, sf_dir):
    nodes, links = L.subgraph(lifecycle_events(spark, sf_dir))
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(links.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")))


def cost_outcomes(spark, sf_dir):
    return L.outcomes(po_versions(spark, sf_dir).select(F.col("o_custkey").alias("lifecycle_id"), "version", F.col("o_totalprice").alias("total")))


def revision_frequency(spark, sf_dir):
    v = po_versions(spark, sf_dir).groupBy("o_custkey").agg((F.count("*") - 1).alias("revisions"), F.min("o_orderkey").alias("least_order"))
    return v.where("revisions > 0").select(F.col("o_custkey").alias("lifecycle_id"), "revisions")


_TERMINAL = "upper(event_type) similar to '.*(" + "|".join(L.TERMINAL) + ").*'"
_REOPEN = f"not ({_TERMINAL}) and regexp_matches(upper(event_type), '_UPLOADED|_CREATED|_ADDED|DOCUMENT')"
_HOLDS = "regexp_matches(upper(event_type), '{}')"
_DAYS = "cast(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) as bigint)"
_SPANS = f"""spans as (select lifecycle_id, count(*) as n, {_DAYS} as days, count(*) filter (where {_HOLDS.format('CHANGE|MODIFY')}) as changes,
  count(*) filter (where {_HOLDS.format('CHANGE|MODIFY|UPDATE')}) as change_signals, count(*) filter (where {_HOLDS.format('CHANGE|MODIFY|UPDATE|REVISION')}) as change_orders,
  count(*) filter (where {_HOLDS.format('RISK|ALERT|WARNING')}) as risks, count(*) filter (where {_HOLDS.format('DELAY|LATE|OVERDUE')}) as delays,
  count(*) filter (where {_HOLDS.format('ERROR|FAIL|ISSUE')}) as errors, count(distinct upper(event_type)) as types from lc group by 1)"""
_D = lambda x: f"cast({x} as double)"
_SCORE = f"""least({_D(0.95)}, {_D(0.2)} + least({_D(0.15)}, {{n}} * {_D(0.03)}) + least({_D(0.25)}, {_D(0)}) + least({_D(0.2)}, {{c}} * {_D(0.05)}) + {_D(0)}
  + case when {{n}} <= 1 then {_D(0)} when {{d}} > 0 then least({_D(0.15)}, {{n}} / {{d}} * {_D(0.05)}) else {_D(0.1)} end)"""

QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_timeline, lifecycle_status, lifecycle_evaluation, lifecycle_metrics, lifecycle_risk, risk_trend, mean_cycle,
        notifications, risky_lifecycles, repeated_changes, top_lifecycles, active_lifecycles, cost_outcomes, revision_frequency,
        lifecycle_activity, lifecycle_graph,
    )
}
ORACLES = {
    "lifecycle_activity": f"""with {LC}, s as (select lifecycle_id, count(*) as n_events, max(ts) as latest, {_DAYS} as days from lc group by 1)
select lifecycle_id, n_events, case when days > 0 then n_events || ' events recorded over ' || days || ' days. Last activity: ' || strftime(latest, '%Y-%m-%d') || '.' else n_events || ' events recorded.' end as sentence from s""",
    "lifecycle_graph": f"with {LC} select 'Lifecycle' as kind, count(distinct lifecycle_id) as n from lc union all select 'Event', count(distinct event_id) from lc union all select 'HAS_EVENT', count(*) from (select distinct lifecycle_id, event_id from lc)",
    "lifecycle_timeline": f"""with {LC} select lifecycle_id, count(*) as n_events, min_by(event_type, (ts, event_id)) as first_type, max_by(event_type, (ts, event_id)) as last_type,
  sha256(string_agg(event_type, '>' order by ts, event_id)) as sha from lc group by 1""",
    "lifecycle_status": f"""with {LC}, sig as (select lifecycle_id, ts, event_id, case when {_TERMINAL} then 'completed' when {_REOPEN} then 'active' end as signal from lc),
ch as (select *, coalesce(lag(signal) over (partition by lifecycle_id order by ts, event_id), 'active') as before from sig where signal is not null)
select lifecycle_id, coalesce(status, 'active') as status, coalesce(reopen_count, 0) as reopen_count from (select distinct lifecycle_id from lc)
left join (select lifecycle_id, max_by(signal, (ts, event_id)) as status, count(*) filter (where signal = 'active' and before = 'completed') as reopen_count from ch group by 1) using (lifecycle_id)""",
    "lifecycle_evaluation": f"""with {LC} select lifecycle_id, bool_or({_TERMINAL}) as has_terminal, bool_or({_REOPEN}) as has_reopening, count(*) as n_events,
  case when bool_or({_TERMINAL}) then 'completed' else 'active' end as status from lc group by 1""",
    "lifecycle_metrics": f"""with {LC}, {_SPANS}, lasts as (select lifecycle_id, max(ts) as last_at from lc group by 1)
select lifecycle_id, change_orders, change_orders_30d, greatest(1, days) as cycle_days from spans join (
  select lifecycle_id, count(*) filter (where {_HOLDS.format('CHANGE|MODIFY|UPDATE|REVISION')}) as change_orders_30d from lc join lasts using (lifecycle_id) where ts >= last_at - interval 30 day group by 1) using (lifecycle_id)""",
    "lifecycle_risk": f"""with {LC}, {_SPANS}, s as (select *, round({_SCORE.format(n='n', c='changes', d='days')}, 6) as risk_score from spans),
dr as (select *, list_filter([
  case when change_signals > 0 then 'Change events (' || change_signals || ' occurrences)' end, case when risks > 0 then 'Risk indicators (' || risks || ' alerts)' end,
  case when delays > 0 then 'Timing issues (' || delays || ' delays)' end, case when errors > 0 then 'Error events (' || errors || ' issues)' end,
  case when types > 5 then 'High event diversity (' || types || ' unique types)' end,
  case when n > 3 and n / greatest(days, 1) > 0.5 then 'High change frequency (multiple changes within short timeframe)' end], lambda x: x is not null) as d from s)
select lifecycle_id, risk_score, case when risk_score >= 0.7 then 'high' when risk_score >= 0.4 then 'medium' else 'low' end as risk_label,
  case when len(d) = 0 then 'Event frequency (' || n || ' total events)' else array_to_string(d, '; ') end as drivers from dr""",
    "risk_trend": f"""with {LC}, r as (select lifecycle_id, row_number() over w as n, count(*) over (partition by lifecycle_id) as total,
  sum(cast({_HOLDS.format('CHANGE|MODIFY')} as int)) over w as changes, cast(floor((epoch(ts) - epoch(first_value(ts) over w)) / 86400) as bigint) as days
  from lc window w as (partition by lifecycle_id order by ts, event_id rows between unbounded preceding and current row)),
sc as (select *, round({_SCORE.format(n='n', c='changes', d='days')} + cast(1e-9 as double), 2) as score from r),
k as (select lifecycle_id, p as percent, score from sc cross join (values (20), (40), (60), (80), (100)) t(p) where n = greatest(1, ceil(total * p / 100)))
select lifecycle_id, percent, least(score, max_by(score, percent) over (partition by lifecycle_id)) as score from k""",
    "mean_cycle": f"with {LC}, {_SPANS} select round(avg(days), 1) as avg_cycle_days, count(*) as lifecycles from spans where n >= 2 and days > 0",
    "risky_lifecycles": f"with {LC} select count(distinct lifecycle_id) as lifecycles from lc where {_HOLDS.format('RISK|ALERT')}",
    "repeated_changes": f"with {LC} select lifecycle_id, count(*) as n from lc where {_HOLDS.format('CHANGE|DELAY')} group by 1 having count(*) > 1 order by n desc, lifecycle_id limit 3",
    "top_lifecycles": f"with {LC} select lifecycle_id, count(*) as n from lc group by 1 order by n desc, lifecycle_id limit 5",
    "active_lifecycles": f"""with {LC}, ev as (select lifecycle_id, bool_or({_TERMINAL}) as done, bool_or({_HOLDS.format('CHANGE')}) as changed from lc group by 1)
select count(*) as lifecycles from ev where not done or changed""",
    "notifications": f"""with {LC}, n as (select *, epoch(timestamp '2024-02-01') - epoch(ts) as s, lower(replace(event_type, '_', ' ')) as t from lc order by ts desc, event_id desc limit 10)
select event_id, lifecycle_id, case when {_HOLDS.format('RISK|ALERT')} then 'warning' when {_HOLDS.format('PAID|COMPLETE')} then 'success' else 'info' end as class,
  array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title,
  case when s < 60 then 'just now' when s < 3600 then cast(floor(s / 60) as int) || ' minutes ago' when s < 86400 then cast(floor(s / 3600) as int) || ' hours ago' else cast(floor(s / 86400) as int) || ' days ago' end as age from n""",
    "cost_outcomes": f"""with {PO}, e as (select o_custkey, min_by(o_totalprice, version) as f, max_by(o_totalprice, version) as l, count(*) as n from versions group by 1),
c as (select o_custkey, round(l - f, 2) as delta, round((l - f) / f * 100, 4) as pct from e where n > 1 and f <> 0), b as (select * from c where abs(pct) > 5)
select o_custkey as lifecycle_id, case when delta > 0 then 'COST_OVERRUN' else 'COST_UNDERRUN' end as outcome_type, abs(delta) as value from b union all select o_custkey, 'COST_VARIANCE', pct from b""",
    "revision_frequency": "select o_custkey as lifecycle_id, count(*) - 1 as revisions from orders group by 1 having count(*) > 1",
}
