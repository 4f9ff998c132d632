"""Usage analytics over chat logs, security events, sessions and error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_up(column, digits: int = 1):
    return F.round(column, digits)


def chat_kpis(log: DataFrame) -> DataFrame:
    """Count, mean latency, share of calls under 50 ms, share with graph, mean confidence: one pass."""
    n = F.greatest(F.count("*"), F.lit(1))
    return log.agg(
        F.count("*").alias("total"),
        half_up(F.avg("latency_ms")).alias("avg_latency_ms"),
        half_up(F.count_if(F.col("latency_ms") < 50) * 100.0 / n).alias("fast_rate"),
        half_up(F.count_if("graph_used") * 100.0 / n).alias("graph_rate"),
        half_up(F.avg("confidence")).alias("avg_confidence"),
    )


def dense_daily(log: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Calls per day for the days up to as_of, days without calls as 0."""
    spine = log.sparkSession.range(days).select(F.date_sub(F.lit(as_of), F.col("id").cast("int")).alias("day"))
    counts = log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def dense_hourly(log: DataFrame, as_of) -> DataFrame:
    """Calls per hour of the day as_of, all 24 hours."""
    spine = log.sparkSession.range(24).select(F.col("id").alias("hour"))
    counts = log.where(F.to_date("created_at") == F.lit(as_of)).groupBy(F.hour("created_at").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per value; nulls are dropped, or counted under name."""
    value = F.col(column) if name is None else F.coalesce(column, F.lit(name))
    return rows.where(value.isNotNull()).groupBy(value.alias(column)).agg(F.count("*").alias("n"))


def sessions(log: DataFrame, most: int = 50) -> DataFrame:
    """Newest sessions: first question (80 characters), calls, last activity, mean non-zero confidence."""
    key = F.coalesce("session_id", F.concat(F.lit("log:"), F.col("log_id").cast("string")))
    first = F.struct("created_at", "log_id")
    return (
        log.groupBy(key.alias("session_id"))
        .agg(
            F.substring(F.min_by("question", first), 1, 80).alias("title"),
            F.count("*").alias("calls"),
            F.max("created_at").alias("last_at"),
            F.round(F.avg(F.nullif("confidence", F.lit(0.0))), 0).alias("confidence"),
        )
        .orderBy(F.desc("last_at"), "session_id")
        .limit(most)
    )


def last_turns(log: DataFrame, n: int) -> DataFrame:
    """The last n calls of each session with their place, 1 the newest."""
    newest = W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("log_id"))
    return log.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def security_stats(events: DataFrame) -> DataFrame:
    """Totals by severity, unresolved ones, and users with a risk of 65 or more."""
    per_user = events.groupBy("user_id").agg(F.count_if(F.col("suspicious")).alias("bad"), F.count("*").alias("n"))
    risky = per_user.where(user_risk(F.col("bad"), F.col("n")) >= 65).agg(F.count("*").alias("risky_users"))
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
    ).crossJoin(risky)


def user_risk(suspicious, total):
    """Risk points by count or share of suspicious queries; 0 without queries."""
    share = suspicious * 100.0 / F.greatest(total, F.lit(1))
    return (
        F.when(total == 0, 0)
        .when((suspicious >= 5) | (share >= 30), 90)
        .when((suspicious >= 3) | (share >= 15), 65)
        .when((suspicious >= 1) | (share >= 5), 35)
        .otherwise(5)
    )


def risk_label(points):
    return F.when(points >= 90, "critical").when(points >= 65, "high").when(points >= 35, "medium").otherwise("low")


def value_stats(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Count, mean, sum, least and largest per kind; null counts as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def error_stats(log: DataFrame, top: int = 10) -> DataFrame:
    """Errors by level and by the most frequent sources, as (kind, name, n)."""
    levels = log.groupBy(F.col("level").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("level"))
    sources = log.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return levels.unionByName(sources.withColumn("kind", F.lit("source"))).select("kind", "name", "n")


def status_counts(rows: DataFrame, key: str, groups: dict[str, tuple[str, ...]], column: str = "status") -> DataFrame:
    """Per key one count for each group of statuses."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column).isin(*s)).alias(g) for g, s in groups.items()])
