"""Lifecycles: timelines, status, metrics, risk and its trend, outcomes, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: words that end a lifecycle when an event type holds one of them
TERMINAL = (
    "COMPLETE", "COMPLETED", "CLOSED", "DEAL_CLOSED", "ONBOARDING_COMPLETE", "PAID", "SIGNED", "ACCEPTED", "FULFILLED",
    "FINALIZED", "FINALISED", "RESOLVED",
)
SECONDS_A_DAY = 86400


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 with their fraction: whole seconds would add a day or a minute where only the fraction falls short of it."""
    return F.unix_micros(ts) / 1_000_000


def days_between(first: Column, last: Column) -> Column:
    """Whole days of 24 hours from first to last, to the microsecond."""
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(SECONDS_A_DAY * 1_000_000))


def holds(event_type: Column, *words: str) -> Column:
    return F.upper(event_type).rlike("|".join(words))


def terminal(event_type: Column, strict: bool = False) -> Column:
    """Whether the type ends a lifecycle; words count inside longer words unless strict."""
    words = "|".join(TERMINAL)
    return F.upper(event_type).rlike(f"(^|_)({words})(_|$)" if strict else words)


def reopening(event_type: Column) -> Column:
    return ~terminal(event_type) & F.upper(event_type).rlike("_UPLOADED|_CREATED|_ADDED|DOCUMENT")


def timeline(events: DataFrame) -> DataFrame:
    """Per lifecycle its events in order of time as one array, with count and span."""
    return events.groupBy("lifecycle_id").agg(
        F.count("*").alias("n_events"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("types"),
    )


def status_fold(events: DataFrame) -> DataFrame:
    """Status after all events in order: a reopening event reopens a completed lifecycle, a terminal one completes it.

    (lifecycle_id, status, reopen_count, completed_at): whether an event reopens depends only on the
    last status change before it, so two window passes say what a fold would.
    """
    order = W.partitionBy("lifecycle_id").orderBy("ts", "event_id")
    signal = F.when(terminal(F.col("event_type")), "completed").when(reopening(F.col("event_type")), "active")
    marked = events.withColumn("signal", signal).where("signal is not null")
    changes = marked.withColumn("before", F.coalesce(F.lag("signal").over(order), F.lit("active")))
    return events.select("lifecycle_id").distinct().join(
        changes.groupBy("lifecycle_id").agg(
            F.max_by("signal", F.struct("ts", "event_id")).alias("status"),
            F.count_if((F.col("signal") == "active") & (F.col("before") == "completed")).alias("reopen_count"),
            F.max(F.when(F.col("signal") == "completed", F.col("ts"))).alias("completed_at"),
        ),
        "lifecycle_id",
        "left",
    ).select("lifecycle_id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("reopen_count", F.lit(0)).alias("reopen_count"), "completed_at")


def evaluate(events: DataFrame) -> DataFrame:
    """Retroactive evaluation: flags over all events of a lifecycle and the status they call for."""
    flags = events.groupBy("lifecycle_id").agg(
        F.bool_or(terminal(F.col("event_type"))).alias("has_terminal"),
        F.bool_or(reopening(F.col("event_type"))).alias("has_reopening"),
        F.count("*").alias("n_events"),
    )
    return flags.withColumn("status", F.when(F.col("has_terminal"), "completed").when(F.col("n_events") > 0, "active").otherwise("pending"))


def spans(events: DataFrame) -> DataFrame:
    """(lifecycle_id, n_events, whole days from first to last event, event-type counts by class)."""
    t = F.col("event_type")
    days = days_between(F.min("ts"), F.max("ts"))
    return events.groupBy("lifecycle_id").agg(
        F.count("*").alias("n_events"),
        days.alias("days"),
        F.count_if(holds(t, "CHANGE", "MODIFY")).alias("changes"),
        F.count_if(holds(t, "CHANGE", "MODIFY", "UPDATE")).alias("change_signals"),
        F.count_if(holds(t, "CHANGE", "MODIFY", "UPDATE", "REVISION")).alias("change_orders"),
        F.count_if(holds(t, "RISK", "ALERT", "WARNING")).alias("risks"),
        F.count_if(holds(t, "DELAY", "LATE", "OVERDUE")).alias("delays"),
        F.count_if(holds(t, "ERROR", "FAIL", "ISSUE")).alias("errors"),
        F.count_distinct(F.upper(t)).alias("types"),
    )


def risk_score(n: Column, revisions: Column, changes: Column, variance: Column, days: Column) -> Column:
    """0.2 and what events, revisions, changes, cost variance and a short span add, 0.95 at most."""
    rush = F.when(n <= 1, 0.0).when(days > 0, F.least(F.lit(0.15), n / days * 0.05)).otherwise(0.1)
    return F.least(
        F.lit(0.95),
        F.lit(0.2) + F.least(F.lit(0.15), n * 0.03) + F.least(F.lit(0.25), revisions * 0.1)
        + F.least(F.lit(0.2), changes * 0.05) + F.least(F.lit(0.3), variance / 100.0 * 0.5) + rush,
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def risk(events: DataFrame) -> DataFrame:
    """Score, label and drivers of each lifecycle; revisions and variance join in where the caller has them."""
    s = spans(events)
    zero = F.lit(0.0)
    score = F.round(risk_score(F.col("n_events"), zero, F.col("changes"), zero, F.col("days")), 6)
    says = lambda when, pattern, column: F.when(when, F.format_string(pattern, F.col(column)))
    # fixed values: what the drivers say
    drivers = F.array_compact(F.array(
        says(F.col("change_signals") > 0, "Change events (%d occurrences)", "change_signals"),
        says(F.col("risks") > 0, "Risk indicators (%d alerts)", "risks"),
        says(F.col("delays") > 0, "Timing issues (%d delays)", "delays"),
        says(F.col("errors") > 0, "Error events (%d issues)", "errors"),
        says(F.col("types") > 5, "High event diversity (%d unique types)", "types"),
        F.when((F.col("n_events") > 3) & (F.col("n_events") / F.greatest("days", F.lit(1)) > 0.5), "High change frequency (multiple changes within short timeframe)"),
    ))
    some = F.when(F.size(drivers) == 0, F.array(F.format_string("Event frequency (%d total events)", F.col("n_events")))).otherwise(drivers)
    return s.select("lifecycle_id", score.alias("risk_score"), risk_level(score).alias("risk_label"), F.array_join(some, "; ").alias("drivers"))


def risk_trend(events: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """Scores of the first 20, 40, 60, 80 and 100 % of a lifecycle's events, none above the last.

    Halves go up at the second decimal (1e-9 settles binary ties). revisions(lifecycle_id, ts, event_id) are the
    moments from which a revision is known, an upload that repeats its document for instance: each event counts
    those up to its own moment (as-of). Both go into one ordered run, so that running counts give every prefix at
    once; five of them are kept.
    """
    order = W.partitionBy("lifecycle_id").orderBy("ts", "event_id", F.desc("_revision"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    both = events.select("lifecycle_id", "ts", "event_id", "event_type", F.lit(0).alias("_revision"))
    if revisions is not None:
        both = both.unionByName(revisions.select("lifecycle_id", "ts", "event_id", F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("_revision")))
    own = F.col("_revision") == 0
    days = days_between(F.min(F.when(own, F.col("ts"))).over(upto), F.col("ts"))
    rows = (
        both.withColumn("n", F.sum(1 - F.col("_revision")).over(upto))
        .withColumn("all", F.sum(1 - F.col("_revision")).over(W.partitionBy("lifecycle_id")))
        .withColumn("changes", F.sum(F.when(holds(F.col("event_type"), "CHANGE", "MODIFY"), 1).otherwise(0)).over(upto))
        .withColumn("revised", F.sum("_revision").over(upto)).where(own)
        .withColumn("score", F.round(risk_score(F.col("n"), F.col("revised"), F.col("changes"), F.lit(0.0), days) + 1e-9, 2))
    )
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.greatest(F.lit(1), F.ceil(F.col("all") * p / 100)).alias("at")) for p in (20, 40, 60, 80, 100)]))
    kept = rows.withColumn("step", steps).where(F.col("n") == F.col("step.at")).select("lifecycle_id", F.col("step.percent").alias("percent"), "score")
    last = F.max_by("score", "percent").over(W.partitionBy("lifecycle_id"))
    return kept.select("lifecycle_id", "percent", F.least("score", last).alias("score"))


def metrics(events: DataFrame) -> DataFrame:
    """Change orders (all, last 30 days of the lifecycle), cycle days (at least 1)."""
    last = events.groupBy("lifecycle_id").agg(F.max("ts").alias("last_at"))
    recent = events.join(last, "lifecycle_id").where(F.col("ts") >= F.col("last_at") - F.expr("interval 30 days"))
    recent = recent.groupBy("lifecycle_id").agg(F.count_if(holds(F.col("event_type"), "CHANGE", "MODIFY", "UPDATE", "REVISION")).alias("change_orders_30d"))
    return spans(events).join(recent, "lifecycle_id").select("lifecycle_id", "change_orders", "change_orders_30d", F.greatest(F.lit(1), "days").alias("cycle_days"))


def mean_cycle(events: DataFrame) -> DataFrame:
    """Mean whole days of lifecycles with two or more events and a span above 0."""
    s = spans(events).where("n_events >= 2 and days > 0")
    return s.agg(F.round(F.avg("days"), 1).alias("avg_cycle_days"), F.count("*").alias("lifecycles"))


def notifications(events: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """Newest events with a class and how long ago they were."""
    t = F.col("event_type")
    seconds = seconds_of(as_of) - seconds_of(F.col("ts"))
    age = (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.format_string("%d minutes ago", F.floor(seconds / 60)))
        .when(seconds < SECONDS_A_DAY, F.format_string("%d hours ago", F.floor(seconds / 3600)))
        .otherwise(F.format_string("%d days ago", F.floor(seconds / SECONDS_A_DAY)))
    )
    kind = F.when(holds(t, "RISK", "ALERT"), "warning").when(holds(t, "PAID", "COMPLETE"), "success").otherwise("info")
    return events.select("event_id", "lifecycle_id", kind.alias("class"), F.initcap(F.replace(F.lower(t), F.lit("_"), F.lit(" "))).alias("title"), age.alias("age"), "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def outcomes(totals: DataFrame, least_percent: float = 5.0) -> DataFrame:
    """Cost over- or under-runs between the first and last total of a lifecycle, beyond 5 %, with the variance.

    totals(lifecycle_id, version, total): rows (lifecycle_id, outcome_type, value).
    """
    ends = totals.groupBy("lifecycle_id").agg(F.min_by("total", "version").alias("first"), F.max_by("total", "version").alias("last"), F.count("*").alias("n"))
    change = ends.where("n > 1 and first <> 0").withColumn("delta", F.round(F.col("last") - F.col("first"), 2)).withColumn(
        "percent", F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 4)
    )
    beyond = change.where(F.abs("percent") > least_percent)
    return beyond.select(
        "lifecycle_id",
        F.explode(F.array(
            F.struct(F.when(F.col("delta") > 0, "COST_OVERRUN").otherwise("COST_UNDERRUN").alias("outcome_type"), F.abs("delta").alias("value")),
            F.struct(F.lit("COST_VARIANCE").alias("outcome_type"), F.col("percent").alias("value")),
        )).alias("o"),
    ).select("lifecycle_id", "o.outcome_type", "o.value")


def activity(events: DataFrame) -> DataFrame:
    """(lifecycle_id, n_events, latest, sentence): how much happened over how many whole days."""
    s = events.groupBy("lifecycle_id").agg(
        F.count("*").alias("n_events"), F.max("ts").alias("latest"),
        days_between(F.min("ts"), F.max("ts")).alias("days"),
    )
    last = F.date_format("latest", "yyyy-MM-dd")
    over = F.format_string("%d events recorded over %d days. Last activity: %s.", "n_events", "days", last)
    return s.select("lifecycle_id", "n_events", "latest", F.when(F.col("days") > 0, over).otherwise(F.format_string("%d events recorded.", "n_events")).alias("sentence"))


def subgraph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, kind), links(source, target, type)) of lifecycles and their events."""
    event = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    links = events.select(F.col("lifecycle_id").alias("source"), event.alias("target"), F.lit("HAS_EVENT").alias("type")).distinct()
    nodes = links.select(F.col("source").alias("id"), F.lit("Lifecycle").alias("kind")).unionByName(links.select(F.col("target").alias("id"), F.lit("Event").alias("kind"))).distinct()
    return nodes, links
