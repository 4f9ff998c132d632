"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._shared import ROW, drop_since, mark, materialise, numbered
from docweave.llm.decontaminate import decontaminate
from docweave.llm.exact_dedup import exact_dedup
from docweave.llm.language_id import keep_identified
from docweave.llm.mixing import mix_sources
from docweave.llm.simhash_dedup import near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not found with enough certainty, go."""
    return keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard index of 0.8 or more over five-word shingles the one with the smallest id stays."""
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy the mix takes: the document's columns, size, source_size, target and copy.

    A column of the documents keeps its name; where one of ours has it too, ours begins with mix_.
    """
    own = {c: f"mix_{c}" if c in docs.columns else c for c in ("size", "source_size", "target", "copy")}
    docs = numbered(docs)
    plan = mix_sources(docs, carry=(ROW,)).where("copies > 0")
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(ROW, *[F.col(c).alias(name) for c, name in own.items()])
    return docs.join(plan, ROW).drop(ROW)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
]

#: SQL cannot express the language, near-duplicate, leak and mixing stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it; what a stage wrote besides goes."""
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_since(spark, place)
    return STAGES[-1][1](spark, docs, sf_dir)
