"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import ball_kmeans, bpe, chat_repair
from docweave.llm.chat_format import chat_format, digest
from docweave.llm.decontaminate import find_leaks
from docweave.llm.exact_dedup import exact_groups
from docweave.llm.html_extract import extract
from docweave.llm.language_id import identify
from docweave.llm.lm_score import lm_scores
from docweave.llm.mixing import mix_sources
from docweave.llm.simhash import near_groups
from docweave.llm.substring_dedup import dedup_windows
from docweave.llm.suffix_dedup import dedup_substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(chat_format(turns))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the driver alone needs the file

    tokenizer = bpe.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digest(bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, decoded_col="decoded"))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_repair.digest(chat_repair.repair(chat_repair.damage(turns)), turns)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.digest(*ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_html_extract": op5_html_extract,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_lm_score": op8_lm_score,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_bpe_tokens": op11_bpe_tokens,
    "op12_chat_repair": op12_chat_repair,
    "op13_ball_kmeans": op13_ball_kmeans,
}
