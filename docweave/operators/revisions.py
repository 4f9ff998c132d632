"""Document revisions: names and versions from event summaries, groups, and content differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: what a file name loses at its end, in this order, to give its base name.
ENDINGS = (
    r"\.[^.]+$", r"(?i)[_-]?v\d+$", r"(?i)[_-](?:revised|followup|follow-up|final|updated|modified)$", r"(?i)[_-]round\d+$",
    r"(?i)[_-](?:priceadjustment|deliverydelay|adjustment|delay)$", r"[_-]\d{4}[_-]\d{2}(?:[_-]\d{2})?$",
)


def file_in_summary(summary: Column) -> Column:
    """The file name between the first "Document" and the next "uploaded"; null without one."""
    name = F.rtrim(F.trim(F.regexp_extract(summary, r"Document\s+(.*?)\s*uploaded", 1)), F.lit(". "))
    return F.when(name == "", None).otherwise(name)


def version_of(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(?i)[_-]?v(\d+)", 1)
    return F.when(digits == "", None).otherwise(digits).cast("int")


def base_name(name: Column) -> Column:
    for pattern in ENDINGS:
        name = F.regexp_replace(name, pattern, "")
    return F.trim(name)


def revision_rows(events: DataFrame) -> DataFrame:
    """Upload events with doc_type, file_name, version and revision key, in groups of two or more.

    events(lifecycle_id, event_id, event_type, ts, summary). Rows are grouped by type and entity id,
    or base name where there is none, and numbered by time, then version (none: 999), then id.
    """
    named = (
        events.where(F.upper("event_type").endswith("_UPLOADED"))
        .withColumn("file_name", file_in_summary(F.col("summary")))
        .where("file_name is not null")
        .withColumn("doc_type", F.lower(F.replace(F.regexp_replace("event_type", "(?i)_UPLOADED$", ""), F.lit("_"), F.lit(" "))))
        .withColumn("version", version_of(F.col("file_name")))
        .withColumn("revision_key", F.concat_ws("|", "doc_type", F.coalesce(entity_id(F.col("file_name"), F.col("doc_type")), F.lower(base_name(F.col("file_name"))))))
    )
    group = W.partitionBy("lifecycle_id", "revision_key")
    order = group.orderBy("ts", F.coalesce("version", F.lit(999)), "event_id")
    return named.withColumn("n", F.row_number().over(order)).withColumn("n_revisions", F.count("*").over(group)).where("n_revisions > 1")


def revision_summary(rows: DataFrame) -> DataFrame:
    """Per group: revisions (rows - 1), first and last time and version."""
    return rows.groupBy("lifecycle_id", "revision_key").agg(
        (F.count("*") - 1).alias("revision_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.min_by("version", "n").alias("first_version"), F.max_by("version", "n").alias("last_version"),
    )


def revision_changes(rows: DataFrame) -> DataFrame:
    """One row per consecutive pair of a group; where the version falls the two change places. Only orders note their versions."""
    order = W.partitionBy("lifecycle_id", "revision_key").orderBy("n")
    pairs = rows.withColumn("prev_version", F.lag("version").over(order)).withColumn("prev_file", F.lag("file_name").over(order)).where("n > 1")
    swap = F.coalesce(F.col("version") < F.col("prev_version"), F.lit(False))
    return pairs.select(
        "lifecycle_id", "revision_key", "n",
        F.when(swap, F.col("file_name")).otherwise(F.col("prev_file")).alias("from_file"),
        F.when(swap, F.col("prev_file")).otherwise(F.col("file_name")).alias("to_file"),
        F.when(F.col("doc_type").isin("purchase order", "change order") & (F.col("version") != F.col("prev_version")), F.format_string("Version updated: v%d → v%d", F.least("version", "prev_version"), F.greatest("version", "prev_version"))).alias("note"),
    )


def item_changes(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Item differences of consecutive versions: pairs(pair_id, prev_id, curr_id), items(order_id, item_no, quantity, unit_price).

    Rows (pair_id, item_no, change, old, new): quantity, price, added. A full outer join by item number.
    """
    side = lambda key, tag: pairs.join(items, pairs[key] == items["order_id"]).select("pair_id", "item_no", F.col("quantity").cast("double").alias(f"{tag}_quantity"), F.col("unit_price").alias(f"{tag}_price"))
    both = side("prev_id", "old").join(side("curr_id", "new"), ["pair_id", "item_no"], "full_outer")
    change = lambda when, kind, old, new: F.when(when, F.struct(F.lit(kind).alias("change"), old.alias("old"), new.alias("new")))
    had, has = F.col("old_quantity").isNotNull(), F.col("new_quantity").isNotNull()
    kinds = F.array_compact(F.array(
        change(had & has & (F.col("old_quantity") != F.col("new_quantity")), "quantity", F.col("old_quantity"), F.col("new_quantity")),
        change(had & has & (F.col("old_price") != F.col("new_price")), "price", F.col("old_price"), F.col("new_price")),
        change(~had & has, "added", F.lit(None).cast("double"), F.col("new_quantity")),
    ))
    return both.select("pair_id", "item_no", F.explode(kinds).alias("c")).select("pair_id", "item_no", "c.change", "c.old", "c.new")


ITEM = r"(\d+)\.\s*([^-]+?)\s*-\s*quantity[:\s]+(\d+)\s*(?:units?)?\s*(?:-\s*unit\s*price[:\s]+\$?([\d,]+\.?\d*))?"


def order_items(texts: DataFrame) -> DataFrame:
    """Numbered items of order texts: (order_id, item_no, name, quantity, unit_price); the last of a number counts."""
    low = F.lower("text")
    columns = [F.regexp_extract_all(low, F.lit(ITEM), F.lit(i)) for i in range(1, 5)]
    rows = texts.select("order_id", F.posexplode(F.arrays_zip(*columns)).alias("at", "m"))
    rows = rows.select("order_id", "at", F.col("m.0").cast("int").alias("item_no"), F.trim("m.1").alias("name"), F.col("m.2").cast("int").alias("quantity"), F.replace(F.col("m.3"), F.lit(","), F.lit("")).try_cast("double").alias("unit_price"))
    return rows.groupBy("order_id", "item_no").agg(F.max_by(F.struct("name", "quantity", "unit_price"), "at").alias("i")).select("order_id", "item_no", "i.*")


def total_change(prev: Column, curr: Column) -> Column:
    """Text of a change of totals with its signed percentage, null without one."""
    percent = (curr - prev) / prev * 100
    return F.when((prev != curr) & (prev != 0), F.format_string("Total cost change: $%,.2f → $%,.2f (%+.1f%%)", prev, curr, percent))


# fixed values: words of the document type, pattern in the file name, prefix of the id, groups that make it, endings it loses; the first that matches counts
ENTITIES = (
    (("patient", "prescription", "lab"), r"(?:patient|pat|prescription|lab)[_-]?([A-Z0-9]{6,})", "", (1,), ()),
    (("patient", "prescription", "lab"), r"PAT[_-]?(\d+)", "PAT", (1,), ()),
    (("application", "offer", "interview"), r"(?:application|offerletter|interviewfeedback|interview)[_-]([A-Za-z_]+(?:_[A-Za-z]+)*)[_-](position|pos)[_-]?(\d+)", "", (1, 3), ()),
    (("application", "offer", "interview"), r"(?:application|offerletter|interviewfeedback|interview)[_-]([A-Za-z_]+(?:_[A-Za-z]+)*)", "", (1,), (r"[_-](?:revised|followup|follow-up|final|updated|modified|round\d+)$",)),
    (("expense", "financial"), r"(?:employee|emp)[_-]?(\d+)", "Employee", (1,), ()),
    (("lead", "proposal", "contract"), r"(?:lead|proposal|contract)[_-]([A-Za-z_]+(?:_[A-Za-z]+)*)", "", (1,), ()),
    (("lead", "proposal", "contract"), r"project[_-]?(\d+)", "Project", (1,), ()),
    (("contract", "compliance"), r"(?:client|contract)[_-]([A-Za-z_]+(?:_[A-Za-z]+)*)", "", (1,), ()),
    (("purchase", "po", "change"), r"(?:po|purchase|change)[_-](\d{4}[_-][A-Za-z0-9_]+)", "", (1,), (r"[_-]?v\d+$", r"[_-](?:revised|followup|follow-up|final|updated|modified)$")),
    (("purchase", "po", "change"), r"project[_-]([A-Za-z_]+)", "", (1,), ()),
    (("",), r"[_-]([A-Z0-9]{4,}(?:[_-][A-Z0-9]+)*)", "", (1,), ()),
)


def entity_id(name: Column, doc_type: Column) -> Column:
    """What a revision group is about: the id in the file name by the family of the document's type; null without one."""
    stem, kind = F.regexp_replace(name, r"\.[^.]+$", ""), F.lower(doc_type)
    tried = []
    for words, pattern, prefix, groups, endings in ENTITIES:
        own = F.concat_ws("_", *[F.regexp_extract(stem, "(?i)" + pattern, g) for g in groups])
        for ending in endings:
            own = F.regexp_replace(own, "(?i)" + ending, "")
        of_type = reduce(lambda x, y: x | y, [kind.contains(w) for w in words])
        tried.append(F.when(of_type & stem.rlike("(?i)" + pattern), F.concat(F.lit(prefix), own)))
    return F.coalesce(*tried)


def match_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """(lifecycle_id, file_name, stored_name, text): the stored file of each file_name of its lifecycle.

    The same name goes first; otherwise the first by seq of those that hold the name, are held by it,
    or have the same base name, all without regard to case.
    """
    # lower and base names are made once for each row, not for each pair
    forms = lambda df, c, tag: df.withColumns({f"_{tag}": F.lower(c), f"_{tag}_base": F.lower(base_name(F.col(c)))})
    asked = forms(names.select("lifecycle_id", "file_name").distinct(), "file_name", "name")
    pairs = asked.join(forms(files.select("lifecycle_id", "stored_name", "seq", "text"), "stored_name", "stored"), "lifecycle_id")
    fits = F.contains("_stored", "_name") | F.contains("_name", "_stored") | (F.col("_name_base") == F.col("_stored_base"))
    best = F.min_by(F.struct("stored_name", "text"), F.struct((F.col("stored_name") != F.col("file_name")).cast("int"), "seq")).alias("b")
    return pairs.where(fits).groupBy("lifecycle_id", "file_name").agg(best).select("lifecycle_id", "file_name", "b.stored_name", "b.text")


def delivery_outcomes(changes: DataFrame) -> DataFrame:
    """Time over- and under-runs of more than a day from notes "Delivery date changed: a → b": (lifecycle_id, outcome_type, value)."""
    pattern = r"(?i)Delivery\s+date\s+changed[:\s]+(\d{4}-\d{2}-\d{2})\s*→\s*(\d{4}-\d{2}-\d{2})"
    day = lambda g: F.try_to_date(F.regexp_extract("note", pattern, g))
    rows = changes.select("lifecycle_id", F.datediff(day(2), day(1)).alias("days")).where(F.abs("days") > 1)
    return rows.select("lifecycle_id", F.when(F.col("days") > 0, "TIME_OVERRUN").otherwise("TIME_UNDERRUN").alias("outcome_type"), F.abs("days").cast("double").alias("value"))
