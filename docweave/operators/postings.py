"""A kept lexical index: postings by term with document statistics, changed by increments, searched by the asked terms.

The index is a versioned folder. A version names segments of postings (term, chunk_id, doc_key, length, tf)
whose counts are signed: what an increment adds is positive, what it takes away negative, so a merge is a sum.
Beside them stands a row for every chunk with its terms and their counts, made where the text is read: postings are
these rows told apart, and a removal reads the rows of its chunks, not the postings.
The terms (term, df) are written whole for every version, with the number of chunks, their length and the mean
idf (over all terms) in its manifest: a search reads the asked terms only. Both are sorted by term inside buckets of terms, so a
filter on terms prunes folders and row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.retrieval import BROADCAST_TERMS, tokens
from docweave.sources import versioned

POSTINGS = "term string, chunk_id {id}, doc_key {key}, length int, tf long"
ROWS = "chunk_id {id}, doc_key {key}, n long, texts long, length int, terms array<string>, counts array<int>"
#: Parts into which the chunks of a term are dealt for writing.
DEALT = 16
#: Chunks whose terms are counted at once in a task.
STEP = 256
#: An index of more segments is merged into one.
SEGMENTS = 8


def term_bucket(buckets: int, term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(chunks: DataFrame, types: dict[str, str]) -> DataFrame:
    """A row (chunk_id, doc_key, n, texts, length, terms, counts) for each of chunks(chunk_id, doc_key, text): its terms, and how often each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                batch = whole.slice(a, STEP)
                lists = batch.column("tokens").fill_null([])
                words = lists.flatten().dictionary_encode()
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                size = max(1, len(words.dictionary))
                keys, counts = np.unique(of * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) * size), pa.int32())
                terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(keys % size)))
                counts = pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))
                columns = [*(batch.column(c) for c in ("chunk_id", "doc_key", "n", "texts", "length")), terms, counts]
                yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "doc_key", "n", "texts", "length", "terms", "counts"])

    one = F.lit(1).cast("long").alias("n")
    docs = chunks.select("chunk_id", "doc_key", one, F.col("text").isNotNull().cast("long").alias("texts"), tokens(F.col("text")).alias("tokens"))
    return docs.withColumn("length", F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens"))).mapInArrow(run, ROWS.format(**types))


def _put(rows: DataFrame, path: str, buckets: int, order: list[str], deal: list[Column]) -> str:
    """Write rows by buckets of terms, sorted in every file; deal tells which rows of a bucket go to one task."""
    place = f"data/{uuid.uuid4().hex}"
    rows = rows.withColumn("bucket", term_bucket(buckets))
    by = ["bucket", *order]
    rows.repartition("bucket", *deal).sortWithinPartitions(*by).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/{place}")
    return place


def _put_postings(rows: DataFrame, path: str, buckets: int) -> str:
    """Write postings; a term that all chunks have is dealt to several tasks by its chunks."""
    return _put(rows, path, buckets, ["term", "chunk_id"], [F.pmod(F.xxhash64("chunk_id"), F.lit(DEALT))])


def _segments(spark: SparkSession, path: str, now: dict[str, Any]) -> DataFrame:
    schema = POSTINGS.format(**now["types"]) + ", bucket int"
    parts = [spark.read.schema(schema).parquet(f"{path}/{p}") for p in now["segments"]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rows(spark: SparkSession, path: str, places: list[str], types: dict[str, str]) -> DataFrame:
    """The chunks' rows of some increments; n is negative for a chunk that was taken away."""
    return spark.read.schema(ROWS.format(**types)).parquet(*[f"{path}/{p}" for p in places])


def _docs(spark: SparkSession, path: str, now: dict[str, Any]) -> DataFrame:
    """(chunk_id, n, texts) of what is in the index: how often a chunk is, and how often it has a text."""
    return _rows(spark, path, now["rows"], now["types"]).groupBy("chunk_id").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).where("n > 0")


def _terms(spark: SparkSession, path: str, now: dict[str, Any]) -> DataFrame:
    return spark.read.schema("term string, df long, bucket int").parquet(f"{path}/{now['terms']}")


def refresh(spark: SparkSession, path: str, added: DataFrame | None = None, removed: DataFrame | None = None, at: float = 0.0, buckets: int = 64) -> int:
    """A new version with the chunks of added(chunk_id, doc_key, text), without those of removed(chunk_id); the number of chunks.

    Builds the index where there is none. A chunk that changed is in both. Removed chunks' postings are made
    from their rows; additions read nothing but themselves, and them once. Chunks that are added twice count twice,
    as in bm25; chunks without a text count, but not in the mean length.
    """
    now = versioned.manifest(spark, path)
    segments, docs, texts, length = (list(now["segments"]), now["docs"], now["texts"], now["length"]) if now else ([], 0, 0, 0)
    held = list(now["rows"]) if now else []
    buckets = now["of"] if now else buckets
    types = now["types"] if now else {"id": dict(added.dtypes)["chunk_id"], "key": dict(added.dtypes)["doc_key"]}
    changes = []
    if added is not None:
        changes.append(counted(added, types))
    if removed is not None and now:
        ids = removed.select("chunk_id").distinct()
        same = ["chunk_id", "doc_key", "length", "terms", "counts"]
        gone = _rows(spark, path, held, types).join(ids, "chunk_id", "left_semi").groupBy(*same).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
        changes.append(gone.where("n <> 0").withColumns({"n": -F.col("n"), "texts": -F.col("texts")}))
    if not changes:
        return docs
    held.append(f"data/{uuid.uuid4().hex}")
    reduce(DataFrame.unionByName, changes).write.option("compression", "zstd").parquet(f"{path}/{held[-1]}")
    new = _rows(spark, path, held[-1:], types)
    here = new.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n"), F.col("texts"), F.col("n") * F.col("length")))).first()
    docs, texts, length = docs + here[0], texts + here[1], length + here[2]
    postings = new.select("chunk_id", "doc_key", "length", "n", F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    segments.append(_put_postings(postings.select("term", "chunk_id", "doc_key", "length", (F.col("counts") * F.col("n")).alias("tf")), path, buckets))
    df = new.select(F.explode("terms").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0")
    if now:
        df = df.unionByName(_terms(spark, path, now).select("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    terms = _put(df, path, buckets, ["term"], [])
    kept = _terms(spark, path, {"terms": terms})
    raw = F.ln((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean, size = kept.agg(F.avg(raw), F.count("*")).first()
    if len(segments) > SEGMENTS:
        merged = _segments(spark, path, {"segments": segments, "types": types}).groupBy("term", "chunk_id", "doc_key", "length").agg(F.sum("tf").alias("tf"))
        segments = [_put_postings(merged.where("tf <> 0"), path, buckets)]
    content = {"segments": segments, "rows": held, "terms": terms, "docs": docs, "texts": texts, "length": length, "mean_idf": mean, "vocabulary": size, "of": buckets, "types": types, "at": at}
    versioned.commit(spark, path, content, now["version"] if now else 0)
    return docs


def maintain(spark: SparkSession, path: str, chunks: DataFrame, at: float, buckets: int = 64) -> str:
    """Bring the index up to chunks if the rule says so: none yet, more than 5 % larger, or older than an hour.

    Returns built, refreshed or kept. Chunks are told apart by their ids; one whose text changed must come with a new id.
    """
    now = versioned.manifest(spark, path)
    if now is None:
        refresh(spark, path, chunks, at=at, buckets=buckets)
        return "built"
    if chunks.count() <= now["docs"] * 1.05 and at - now["at"] <= 3600:
        return "kept"
    known = _docs(spark, path, now)
    refresh(spark, path, chunks.join(known, "chunk_id", "left_anti"), known.join(chunks, "chunk_id", "left_anti"), at)
    return "refreshed"


def search(spark: SparkSession, path: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """As retrieval.bm25: (query_id, chunk_id, doc_key, score) of the chunks with a positive score, from the kept index.

    Up to BROADCAST_TERMS asked terms go into the scan as a filter; more are joined.
    """
    now = versioned.manifest(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path} has no index")
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))
    found, terms = _segments(spark, path, now), _terms(spark, path, now)
    wanted = asked.select("term", term_bucket(now["of"]).alias("bucket")).distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).collect()
    if len(few) <= BROADCAST_TERMS:
        only = F.col("term").isin([r["term"] for r in few]) & F.col("bucket").isin(sorted({r["bucket"] for r in few}))
        found, terms = found.where(only), terms.where(only)
    else:
        found, terms = found.join(wanted, ["term", "bucket"], "left_semi"), terms.join(wanted, ["term", "bucket"], "left_semi")
    tf = found.groupBy("term", "chunk_id", "doc_key", "length").agg(F.sum("tf").alias("tf")).where("tf > 0")
    raw = F.ln((F.lit(now["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.select("term", raw.alias("raw")).join(asked, "term").withColumn("idf", F.when(F.col("raw") < 0, F.lit(epsilon * (now["mean_idf"] or 0.0))).otherwise(F.col("raw")))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(now["length"] / max(now["texts"], 1)))
    part = F.col("asked") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    scored = tf.join(weights, "term").groupBy("query_id", "chunk_id", "doc_key").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0")
