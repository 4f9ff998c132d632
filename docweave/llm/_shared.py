"""Helpers shared by the corpus operators: shared folder, materialised tables, text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Column of the number of a row, see numbered; not a name for an input column.
ROW = "_docweave_row_number"

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="docweave-"))
    return _own_dir[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and read it again: cuts lineage and survives lost executors. What the write shuffled goes at its end."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/docweave/{tag}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of written tables, for drop_since."""
    return len(_written)


def drop_since(spark: SparkSession, place: int, keep: int = 1) -> None:
    """Delete what materialise() wrote since mark(), but for the last few tables; for callers that have read everything else."""
    for path in _written[place : len(_written) - keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[place : len(_written) - keep]


def numbered(df: DataFrame) -> DataFrame:
    """df with a long ROW, different for every row, written once so that every use sees the same numbers."""
    return materialise(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. Pure-ASCII rows take the built-in, which does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_or_empty(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys from batches that are sorted by those keys; a run may span batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                part = batch.slice(start, i - start)
                if held and rows[start] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = rows[start]
                held.append(part)
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch so that the texts of each piece hold about most bytes (one row at least), with those texts."""
    texts = text_or_empty(batch, name)
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]
