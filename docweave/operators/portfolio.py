"""Lifecycles with their documents: joins of both sides, evaluation, outcomes, metrics, risk with all terms, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import lifecycle as L

# fixed values: states, and words of summaries that end a lifecycle
OPEN_STATUSES = ("active", "pending", "in_progress")
CLOSED_STATUSES = ("completed", "closed", "cancelled", "canceled", "resolved", "archived", "done")
TERMINAL_STATUSES = ("completed", "complete", "closed", "paid", "signed", "accepted", "fulfilled", "finalized", "finalised", "done", "resolved")
TERMINAL_TERMS = (
    "completed", "closed", "deal closed", "paid", "signed", "accepted", "fulfilled", "finalized", "finalised", "resolved", "cancelled", "canceled", "archived", "done",
)
# fixed values: days that a lifecycle of each type should take
CYCLE_TARGETS = {"procurement": 18, "hr": 30, "sales": 45, "generic": 18}
DEFAULT_TARGET = 18
# fixed values: outcomes that tell the variance, first wins
VARIANCE_OUTCOMES = ("COST_OVERRUN", "TIME_OVERRUN", "VARIANCE", "DEVIATION")
TOTALS = (r"total[:\s]+\$?([\d,]+\.?\d*)", r"amount[:\s]+\$?([\d,]+\.?\d*)", r"cost[:\s]+\$?([\d,]+\.?\d*)")


def terminal_signal(event_type: Column, summary: Column, status: Column) -> Column:
    """Whether an event's type or summary or a document's status ends a lifecycle; words count inside longer words."""
    told = F.lower(F.coalesce(summary, F.lit(""))).rlike("|".join(TERMINAL_TERMS))
    return L.terminal(F.coalesce(event_type, F.lit(""))) | told | F.coalesce(F.trim(F.lower(status)).isin(*TERMINAL_STATUSES), F.lit(False))


def reopen_signal(event_type: Column, summary: Column) -> Column:
    return ~terminal_signal(event_type, summary, F.lit(None).cast("string")) & F.upper(event_type).rlike("_UPLOADED|_CREATED|_ADDED|DOCUMENT")


def status_line(text: Column) -> Column:
    """The status that a text gives on a line of its own, lower-cased; null without one."""
    found = F.regexp_extract(text, r"(?im)^\s*status\s*:\s*([A-Za-z][A-Za-z _-]{0,40})\s*$", 1)
    return F.nullif(F.regexp_replace(F.trim(F.lower(found)), r"\s+", " "), F.lit(""))


def with_parts(lifecycles: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """lifecycles with n_events, event_ids, n_documents, document_ids (distinct, sorted); those without either are kept.

    Each side is aggregated before it is joined, so events and documents never multiply.
    """
    ev = events.groupBy("lifecycle_id").agg(F.count_distinct("event_id").alias("n_events"), F.array_sort(F.collect_set("event_id")).alias("event_ids"))
    doc = documents.groupBy("lifecycle_id").agg(F.count_distinct("document_id").alias("n_documents"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    rows = lifecycles.join(ev, "lifecycle_id", "left").join(doc, "lifecycle_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "n_documents")})


def newest_first(lifecycles: DataFrame) -> DataFrame:
    """Undated ones first, then by creation, newest first; ties by id."""
    return lifecycles.orderBy(F.col("created_at").desc_nulls_first(), "lifecycle_id")


def own_event_documents(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents that name an event of their own lifecycle."""
    return documents.join(events.select("lifecycle_id", "event_id").distinct(), ["lifecycle_id", "event_id"], "left_semi")


def subgraph(events: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, kind), links(source, target, type)) of lifecycles, events and documents; a document is linked to events of its own lifecycle only."""
    nodes, links = L.subgraph(events)
    document = F.concat(F.lit("document:"), F.col("document_id").cast("string"))
    has = documents.select(F.col("lifecycle_id").alias("source"), document.alias("target"), F.lit("HAS_DOCUMENT").alias("type"))
    of = own_event_documents(documents, events).select(document.alias("source"), F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("target"), F.lit("RELATES_TO").alias("type"))
    more = has.select(F.col("source").alias("id"), F.lit("Lifecycle").alias("kind")).unionByName(has.select(F.col("target").alias("id"), F.lit("Document").alias("kind")))
    return nodes.unionByName(more).distinct(), links.unionByName(has).unionByName(of).distinct()


def evaluation(lifecycles: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """(lifecycle_id, status, in_events, in_documents, action, reason) from all events and documents' texts.

    A closed lifecycle is reopened by new activity without any terminal signal, an open one completed
    by a terminal signal; anything else is unchanged.
    """
    nothing = F.lit(None).cast("string")
    ev = events.groupBy("lifecycle_id").agg(
        F.bool_or(terminal_signal(F.col("event_type"), F.col("summary"), nothing)).alias("in_events"), F.bool_or(reopen_signal(F.col("event_type"), F.col("summary"))).alias("reopening")
    )
    doc = documents.groupBy("lifecycle_id").agg(F.bool_or(terminal_signal(F.lit(""), F.lit(""), status_line(F.col("text")))).alias("in_documents"))
    rows = lifecycles.select("lifecycle_id", F.lower(F.coalesce("status", F.lit("active"))).alias("status")).join(ev, "lifecycle_id", "left").join(doc, "lifecycle_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_events", "reopening", "in_documents")})
    closed, ends = F.col("status").isin(*CLOSED_STATUSES), F.col("in_events") | F.col("in_documents")
    action = F.when(closed & F.col("reopening") & ~ends, "reopened").when(~closed & ends, "completed").otherwise("unchanged")
    state = F.concat(F.lit("Currently "), F.col("status"), F.when(closed, " (closed status)").otherwise(" (active status)"))
    why = (
        F.when(closed & ends, "Has terminal signals - should remain completed").when(closed, "No terminal signals found")
        .when(ends, "Has terminal signals - SHOULD BE COMPLETED").otherwise("No terminal signals found - correctly active")
    )
    return rows.select("lifecycle_id", "status", "in_events", "in_documents", action.alias("action"), F.concat_ws(" | ", state, why).alias("reason"))


def evaluation_counts(rows: DataFrame) -> DataFrame:
    """evaluated, completed, reopened, unchanged."""
    return rows.agg(F.count("*").alias("evaluated"), *[F.count_if(F.col("action") == a).alias(a) for a in ("completed", "reopened", "unchanged")])


def total_in(text: Column) -> Column:
    """The total, amount or cost that a text gives, in this order; null without one."""
    return F.coalesce(*[F.replace(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double") for p in TOTALS])


def document_outcomes(events: DataFrame, least_percent: float = 5.0) -> DataFrame:
    """Cost over- and under-runs between the first purchase order's total and the last invoice's: (lifecycle_id, outcome_type, value)."""
    kind, order = F.upper("event_type"), F.struct("ts", "event_id")
    first = F.min_by(total_in(F.col("summary")), F.when(kind.contains("PURCHASE_ORDER"), order)).alias("ordered")
    last = F.max_by(total_in(F.col("summary")), F.when(kind.contains("INVOICE"), order)).alias("billed")
    marked = events.where(kind.contains("PURCHASE_ORDER") | kind.contains("INVOICE")).groupBy("lifecycle_id").agg(
        first, last, F.count_if(kind.contains("PURCHASE_ORDER")).alias("orders"), F.count_if(kind.contains("INVOICE")).alias("invoices")
    )
    rows = marked.where("orders > 0 and invoices > 0 and ordered > 0 and billed <> 0").where(F.abs((F.col("billed") - F.col("ordered")) / F.col("ordered") * 100) > least_percent)
    over = F.col("billed") - F.col("ordered")
    return rows.select("lifecycle_id", F.when(over > 0, "COST_OVERRUN").otherwise("COST_UNDERRUN").alias("outcome_type"), F.abs(over).alias("value"))


def change_outcomes(events: DataFrame) -> DataFrame:
    """How many changes a lifecycle had, where it had any: (lifecycle_id, outcome_type, value)."""
    rows = events.groupBy("lifecycle_id").agg(F.count_if(L.holds(F.col("event_type"), "CHANGE", "MODIFY", "UPDATE")).cast("double").alias("value")).where("value > 0")
    return rows.select("lifecycle_id", F.lit("CHANGE_ORDERS").alias("outcome_type"), "value")


def outcome_extraction(lifecycles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """processed, outcomes_created, lifecycles_with_outcomes over the lifecycles that are completed or closed."""
    done = lifecycles.where(F.lower("status").isin("completed", "closed")).select("lifecycle_id")
    per = done.join(outcomes.groupBy("lifecycle_id").agg(F.count("*").alias("n")), "lifecycle_id", "left")
    return per.agg(F.count("*").alias("processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("outcomes_created"), F.count("n").alias("lifecycles_with_outcomes"))


def filtered_outcomes(outcomes: DataFrame, lifecycle_id: str | None = None, outcome_type: str | None = None, most: int = 100) -> DataFrame:
    """Outcomes that meet every condition given, newest first."""
    for column, value in (("lifecycle_id", lifecycle_id), ("outcome_type", outcome_type)):
        outcomes = outcomes if value is None else outcomes.where(F.col(column) == value)
    return outcomes.orderBy(F.desc("recorded_at"), "lifecycle_id", "outcome_type").limit(most)


def cycle_target(lifecycle_type: Column) -> Column:
    targets = F.create_map(*[F.lit(x) for pair in CYCLE_TARGETS.items() for x in pair])
    return F.coalesce(targets[lifecycle_type], F.lit(DEFAULT_TARGET))


def variance(outcomes: DataFrame, notes: DataFrame) -> DataFrame:
    """(lifecycle_id, variance_percent, variance_status) from outcomes(lifecycle_id, outcome_type, value), else notes(lifecycle_id, percent).

    The mean of the first outcome type that gives a usable one: up to 1 a ratio, up to 100 a percentage,
    anything else of no known scale. Without one the note's percentage of the largest size.
    """
    means = outcomes.where(F.col("outcome_type").isin(*VARIANCE_OUTCOMES)).groupBy("lifecycle_id", "outcome_type").agg(F.avg("value").alias("m"))
    value = F.when(F.abs("m") <= 1, F.col("m") * 100).when(F.abs("m") <= 100, F.col("m"))
    rank = F.array_position(F.array(*[F.lit(t) for t in VARIANCE_OUTCOMES]), F.col("outcome_type"))
    told = means.where(F.abs("m") <= 100).groupBy("lifecycle_id").agg(F.min_by(F.round(value, 1), rank).alias("told"))
    noted = notes.groupBy("lifecycle_id").agg(F.max_by(F.round("percent", 1), F.struct(F.abs("percent"), "percent")).alias("noted"))
    both = told.join(noted, "lifecycle_id", "full_outer")
    v = F.when(F.coalesce("told", F.lit(0.0)) != 0, F.col("told")).otherwise(F.coalesce("noted", F.lit(0.0)))
    label = F.when(v > 5, "above_threshold").when(v < -5, "below_threshold").otherwise("normal")
    return both.select("lifecycle_id", v.alias("variance_percent"), label.alias("variance_status"))


def full_metrics(events: DataFrame, types: DataFrame, revisions: DataFrame, variances: DataFrame, as_of: Column) -> DataFrame:
    """Metrics of each lifecycle: change orders are the most of explicit, inferred and revision counts.

    types(lifecycle_id, lifecycle_type), revisions(lifecycle_id, ts) one row per inferred change,
    variances from variance(). The 30 days end at as_of.
    """
    recent = lambda c: F.col(c) >= as_of - F.expr("interval 30 days")
    changed = L.holds(F.col("event_type"), "CHANGE", "MODIFY", "UPDATE", "REVISION")
    days = L.days_between(F.min("ts"), F.max("ts"))
    own = events.groupBy("lifecycle_id").agg(
        F.count_if(changed).alias("explicit"), F.count_if(changed & recent("ts")).alias("explicit_30d"), F.greatest(F.lit(1), days).alias("cycle_time_days")
    )
    inferred = revisions.groupBy("lifecycle_id").agg(F.count("*").alias("inferred"), F.count_if(recent("ts")).alias("inferred_30d"))
    rows = own.join(inferred, "lifecycle_id", "left").join(types, "lifecycle_id", "left").join(variances, "lifecycle_id", "left")
    most = lambda a, b: F.greatest(F.col(a), F.coalesce(b, F.lit(0)))
    return rows.select(
        "lifecycle_id", most("explicit", "inferred").alias("change_orders"), most("explicit_30d", "inferred_30d").alias("change_orders_30d"), "cycle_time_days",
        cycle_target(F.col("lifecycle_type")).alias("cycle_time_target"), F.coalesce("variance_percent", F.lit(0.0)).alias("variance_percent"),
        F.coalesce("variance_status", F.lit("normal")).alias("variance_status"),
    )


def full_risk(lifecycles: DataFrame, events: DataFrame, revisions: DataFrame, variances: DataFrame) -> DataFrame:
    """(lifecycle_id, risk_score, risk_label) with revisions(lifecycle_id, n_revisions) and variance; 0.2 and low without events."""
    s = L.spans(events).join(revisions, "lifecycle_id", "left").join(variances, "lifecycle_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = L.risk_score(F.col("n_events"), zero("n_revisions"), F.col("changes"), F.abs(zero("variance_percent")), F.col("days"))
    rows = lifecycles.select("lifecycle_id").join(s.select("lifecycle_id", F.round(score, 6).alias("risk_score")), "lifecycle_id", "left")
    rows = rows.withColumn("risk_score", F.coalesce("risk_score", F.lit(0.2)))
    return rows.withColumn("risk_label", L.risk_level(F.col("risk_score")))


def detail_text(lifecycles: DataFrame, events: DataFrame, risk: DataFrame, last: int = 5) -> DataFrame:
    """(lifecycle_id, detail): status, number of events, the last event types and the risk, as lines."""
    order = W.partitionBy("lifecycle_id").orderBy(F.desc("ts"), F.desc("event_id"))
    newest = events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    types = newest.groupBy("lifecycle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))), lambda e: e["event_type"]), ", ").alias("types"))
    counts = events.groupBy("lifecycle_id").agg(F.count("*").alias("n_events"))
    rows = lifecycles.join(types, "lifecycle_id", "left").join(counts, "lifecycle_id", "left").join(risk, "lifecycle_id")
    text = F.format_string(
        "Lifecycle detail for %s:\n- Status: %s\n- Events: %d\n- Recent event types: %s\n- Risk: %d%% (%s)", "lifecycle_id", "status", F.coalesce("n_events", F.lit(0)),
        F.coalesce("types", F.lit("none")), F.round(F.col("risk_score") * 100).cast("int"), "risk_label",
    )
    return rows.select("lifecycle_id", text.alias("detail"))


def upload_stats(documents: DataFrame, now: Column) -> DataFrame:
    """today, yesterday, avg_processing_s of documents(uploaded_at, processing_s): days are those of now; without any date all count as today's."""
    day, today = F.to_date("uploaded_at"), F.to_date(now)
    own = (day == today) & (F.col("uploaded_at") <= now)
    dated = F.count("uploaded_at")
    return documents.agg(
        F.when(dated == 0, F.count("*")).otherwise(F.count_if(own)).alias("today"), F.count_if(day == F.date_sub(today, 1)).alias("yesterday"),
        F.coalesce(F.round(F.avg(F.when(own & (F.col("processing_s") > 0), F.col("processing_s"))), 2), F.lit(0.0)).alias("avg_processing_s"),
    )


def status_counts(lifecycles: DataFrame) -> DataFrame:
    """total and active lifecycles."""
    return lifecycles.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*OPEN_STATUSES)).alias("active"))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): every row as one JSON object, for an export."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def as_csv(rows: DataFrame) -> DataFrame:
    """(n, line): the names of the columns (n is 0), then every row as one line of CSV by its first column; cells with commas or quotes are quoted, nulls are empty."""
    first = rows.columns[0]
    lines = rows.select(F.to_csv(F.struct(*[F.col(c).cast("string") for c in rows.columns]), {"quote": '"', "escape": '"'}).alias("line"), F.lit(1).alias("n"), F.col(first).cast("string").alias("key"))
    head = rows.sparkSession.createDataFrame([(",".join(rows.columns), 0, None)], "line string, n int, key string")
    return head.unionByName(lines).orderBy("n", "key", "line").select("n", "line")
