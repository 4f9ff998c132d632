"""Delta feeds as streams into a versioned table of known files: at least once, with a sink that takes a batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.cdc import apply_delta
from docweave.sources import versioned


def merge_batch(delta: DataFrame, batch: int, path: str, seq_col: str | None = None) -> bool:
    """Apply one batch of a feed to the table of known files at path; False if the table has had it already.

    The version that a batch makes carries its number, so a batch that comes again after a failure between
    the sink and the stream's own checkpoint changes nothing. Only the buckets of the batch's items are read
    and written: as many rows as the table has in those.
    """
    spark = delta.sparkSession
    now = versioned.manifest(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path} has no version; write one first, with tag -1")
    if now["tag"] is not None and now["tag"] >= batch:
        return False
    delta = delta.persist()
    try:
        touched = [r[0] for r in delta.select(versioned.bucket_of("item_id", now["of"])).distinct().collect()]  # one for each bucket at most
        known = versioned.read(spark, path, now["version"], touched)
        versioned.write(apply_delta(known, delta, seq_col), path, now["key"], tag=batch, only=touched)
    finally:
        delta.unpersist()
    return True


def sync_files(feed: DataFrame, path: str, checkpoint: str, seq_col: str | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run the feed, a stream of delta(item_id, name, deleted, is_folder, size, modified), to its end into the table at path.

    A checkpoint belongs to one table: the stream goes on where it stopped, and at most the last batch comes
    again. after is called with the number of each batch that was written.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        merge_batch(rows, batch, path, seq_col)
        if after:
            after(batch)

    return feed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark, path: str) -> DataFrame:
    """(version, tag, rows) of all versions of a table."""
    out = None
    for n in versioned.versions(spark, path):
        one = versioned.read(spark, path, n).agg(F.count("*").alias("rows")).select(F.lit(n).cast("long").alias("version"), F.lit(versioned.manifest(spark, path, n)["tag"]).cast("long").alias("tag"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
