"""One query per operator: whole tables in, production parameters, full results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table
from .decontaminate import contamination_report
from .line_dedup import dedup_lines
from .mixing import mixing_report
from .quality_compression import THRESHOLD, fit_compression, score_quality
from .quality_rules import judge_quality
from .sharding import shard_manifest
from .simhash import near_components
from .substring import repeated_passages
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(_documents(spark, sf_dir), shingle=3, max_bits=2)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_quality(_documents(spark, sf_dir)).withColumnRenamed("doc", "doc_id")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *base)


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return _verdicts(score_toxicity(docs, model), 0.5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination_report(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", digest, "contaminated")


#: Shares of the corpus's tokens that each kind of text should have.
MIX_WEIGHTS = {"clean": 0.94, "poor": 0.03, "toxic": 0.03}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("poor")
    rows = mixing_report(_documents(spark, sf_dir), labels.select("doc_id", kind.alias("domain")), MIX_WEIGHTS)
    shares = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(sorted(MIX_WEIGHTS))]
    reached = F.array_join(F.transform("mix", lambda m: F.format_string("%s: %.4f of %.4f", m["domain"], m["expected"], m["target"])), ", ")
    return rows.select(F.col("doc").alias("doc_id"), "n_tokens", *shares, "rate", "copies", reached.alias("reached"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.withColumnRenamed("page", "page_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_manifest(_documents(spark, sf_dir), n_shards=16)
    return rows.withColumn("law", F.lit("key"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with another one; the rest have no row."""
    found = repeated_passages(_documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.withColumn("spans", spans).withColumnRenamed("doc", "doc_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_compression(docs, read_table(spark, sf_dir, "labels"))
    return _verdicts(score_quality(docs, model), THRESHOLD)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_url_filters": op7_url_filters,
        "op8_sharding": op8_sharding,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_classifier": op10_quality_classifier,
    }
