"""Exact deduplication on a 128-bit content hash, with bytes compared inside each hash group.

DataFrame functions only. Rows that share a hash are first told apart by their whole normalised
text (partial aggregation collapses the copies of a hot group before the shuffle); what a row is
joined to is one small record per hash, so a group that holds a third of all rows moves only ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import ROW, ascii_lower, materialise, numbered


def content_hash(text: Column) -> Column:
    """128 bits of the text as binary."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = content_hash,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256) and the columns named in carry.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal
    texts the row with the smallest (or largest) id stays; null ids lose to any other id, and where
    a group has null ids only, all of it stays. Rows repeated with the same id share one verdict
    (exact_dedup keeps one of them). An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm"), *carry).withColumn("h", hash_fn(F.col("norm")))

    # bytes compared: rows of one hash fall apart into their different texts
    texts = rows.groupBy("h", "norm").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    groups = materialise(
        texts.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), best("keep_id").alias("keep_id")),
        "exact-groups",
    )
    # the hash groups are known now; only if two texts collided is the text itself a join key
    clash = groups.where("texts > 1").select("h")
    light = rows.select("id", "h", F.sha2(F.col("norm"), 256).alias("text_sha256"), *carry)
    out = light.join(groups.where("texts = 1").select("h", "n", "keep_id"), "h")
    if not clash.isEmpty():
        split = rows.join(clash, "h", "left_semi")
        own = split.groupBy("h", "norm").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
        out = out.unionByName(
            split.join(own, ["h", "norm"]).select("id", "h", F.sha2(F.col("norm"), 256).alias("text_sha256"), *carry, "n", "keep_id")
        )
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        *carry,
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, all columns: one of each group of exact_groups, of rows with one id (or none) the first."""
    docs = numbered(docs)
    kept = exact_groups(docs, id_col, text_col, keep, carry=(ROW,)).where("kept")
    stays = kept.groupBy("text_sha256").agg(F.min(ROW).alias(ROW)).select(ROW)
    return docs.join(stays, ROW, "left_semi").drop(ROW)
