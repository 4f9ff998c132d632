"""Change capture and scheduling: delta merges, content hashes, due sources, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "docx", "pptx", "xlsx", "csv", "txt", "md", "json", "html", "xml", "log")


def delta_actions(known: DataFrame, delta: DataFrame) -> DataFrame:
    """(item_id, action) for a feed delta(item_id, name, deleted, is_folder, size, modified) against known files.

    Deleted items that are known are removed; folders and other file types are skipped; an unchanged
    size and no later change is unchanged; a new name alone is a rename; everything else is ingested.
    """
    old = known.select("item_id", F.col("name").alias("old_name"), F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    joined = delta.join(old, "item_id", "left")
    is_known = F.col("old_modified").isNotNull()
    same = is_known & (F.col("old_modified") >= F.col("modified")) & (F.col("old_size") == F.col("size"))
    extension = F.lower(F.substring_index("name", ".", -1))
    action = (
        F.when(F.col("deleted") & is_known, "delete")
        .when(F.col("deleted") | F.col("is_folder") | ~extension.isin(*SUPPORTED), "skip")
        .when(same & (F.col("old_name") != F.col("name")), "rename")
        .when(same, "unchanged")
        .when(is_known, "update")
        .otherwise("insert")
    )
    return joined.select("item_id", action.alias("action"))


def latest_entries(delta: DataFrame, seq_col: str) -> DataFrame:
    """The last entry of every item of a feed that names some more than once."""
    rest = [c for c in delta.columns if c != "item_id"]
    last = F.max_by(F.struct(*rest), seq_col).alias("l")
    return delta.groupBy("item_id").agg(last).select("item_id", *[f"l.{c}" for c in rest])


def apply_delta(known: DataFrame, delta: DataFrame, seq_col: str | None = None) -> DataFrame:
    """The known files after the feed: deleted ones gone, changed and new ones replaced; by seq_col only an item's last entry counts."""
    delta = delta if seq_col is None else latest_entries(delta, seq_col)
    actions = delta_actions(known, delta)
    changed = delta.join(actions.where("action in ('insert', 'update', 'rename')"), "item_id").select(*known.columns)
    touched = actions.where("action in ('delete', 'update', 'rename')").select("item_id")
    return known.join(touched, "item_id", "left_anti").select(*known.columns).unionByName(changed)


def page_changes(seen: DataFrame, crawled: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(*keys, action): new, changed or same by content hash, a row for each of crawled(*keys, content_hash); pages not crawled again do not appear.

    Keys tell pages apart. Of a page that was seen more than once any of its contents is the same.
    """
    old = seen.groupBy(*keys).agg(F.collect_set(F.coalesce("content_hash", F.lit(""))).alias("old"))
    action = F.when(F.col("old").isNull(), "new").when(F.array_contains("old", F.coalesce("content_hash", F.lit(""))), "same").otherwise("changed")
    return crawled.join(old, list(keys), "left").select(*keys, action.alias("action"))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def interval_seconds(priority: Column, override: Column) -> Column:
    return F.coalesce(override, F.when(priority == "high", 600).when(priority == "medium", 7200).otherwise(86400))


def due(sources: DataFrame, now: float) -> DataFrame:
    """Active sources whose time has come, by priority, then time, then id."""
    ready = sources.where((F.col("status") == "active") & (F.col("next_scheduled") <= now))
    return ready.withColumn("rank", priority_rank(F.col("priority"))).orderBy("rank", "next_scheduled", "source_id")


def after_run(sources: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """Sources after results(source_id, ok): success starts the interval, failures wait 60 s and 300 s, the third is an error."""
    joined = sources.join(results, "source_id", "left")
    retries = F.when(F.col("ok"), 0).otherwise(F.col("retry_count") + 1)
    ran = F.col("ok").isNotNull()
    wait = F.when(retries == 1, 60).otherwise(300)
    return joined.select(
        "source_id", "priority",
        F.when(ran & ~F.col("ok") & (retries >= 3), "error").otherwise(F.col("status")).alias("status"),
        F.when(ran, retries).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(ran & F.col("ok"), now + interval_seconds(F.col("priority"), F.col("update_frequency")))
        .when(ran & (retries < 3), now + wait).otherwise(F.col("next_scheduled")).alias("next_scheduled"),
    )


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of a table that a delete leaves; null conditions leave the row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def register(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Sources (source_id, url, source_type, priority, status) after requests(source_id, url, source_type, priority).

    A request for a known url and type changes its priority and makes it active, another one is added.
    """
    keys = ["url", "source_type"]
    asked = requests.groupBy(*keys).agg(F.max_by("priority", "source_id").alias("new_priority"), F.min("source_id").alias("new_id"))
    return sources.join(asked, keys, "full_outer").select(
        F.coalesce("source_id", "new_id").alias("source_id"), "url", "source_type", F.coalesce("new_priority", "priority").alias("priority"),
        F.when(F.col("new_id").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
    )


def dispatch(sources: DataFrame, now: float) -> DataFrame:
    """sources after all that are due were handed out: their next run is an interval away, so that none is handed out twice."""
    ready = (F.col("status") == "active") & (F.col("next_scheduled") <= now)
    later = now + interval_seconds(F.col("priority"), F.col("update_frequency"))
    return sources.withColumn("next_scheduled", F.when(ready, later).otherwise(F.col("next_scheduled")))


def control(sources: DataFrame, commands: DataFrame, now: float) -> DataFrame:
    """sources after commands(source_id, seq, command): the last of pause, resume, trigger (due now) or unregister of each counts."""
    last = commands.groupBy("source_id").agg(F.max_by("command", "seq").alias("_c"))
    rows = sources.join(last, "source_id", "left").where(F.coalesce(F.col("_c") != "unregister", F.lit(True)))
    status = F.when(F.col("_c") == "pause", "paused").when(F.col("_c").isin("resume", "trigger"), "active").otherwise(F.col("status"))
    due_now = F.when(F.col("_c") == "trigger", F.lit(now)).otherwise(F.col("next_scheduled"))
    return rows.withColumns({"status": status, "next_scheduled": due_now}).drop("_c")


def finished_crawls(crawls: DataFrame, sources: DataFrame) -> DataFrame:
    """Finished crawls(url, status) that no source is registered for."""
    return crawls.where("status = 'done'").join(sources.where("source_type = 'website'"), "url", "left_anti")
