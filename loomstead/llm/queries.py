"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import bpe, decontaminate, jaccard, licenses, linededup, lm, merkle, mixing, negatives, quality, sharding, suffixes, toxicity
from loomstead.llm.common import documents


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir, "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(documents(spark, sf_dir, "doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_lines(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "lines_.n_lines", "lines_.n_dropped", F.sha2("lines_.kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir, "doc_id", "text", "lang", "source").withColumn("path", F.expr(licenses.LAYOUT)).select("doc_id", "path", "text")
    return licenses.licences(files).select("doc_id", "path", "own_licence", "licence", "granted_by")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.transform("items", lambda x: x["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("items", lambda x: x["agree"])), F.lit(0)).alias("agree"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir, "doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir, "doc_id", "source", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    rows = rows.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("decoded"))
    return rows.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(documents(spark, sf_dir))


def queries() -> dict:
    found = (op1_lm_scoring, op2_toxicity, op3_quality_rules, op4_jaccard_join, op5_line_dedup, op6_suffix_dedup, op7_license_scan, op8_decontamination, op9_sharding, op10_mixing)
    return {f.__name__: f for f in (*found, op11_hard_negatives, op12_bpe, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.sql(), "op4_jaccard_join": jaccard.SQL, "op5_line_dedup": linededup.SQL, "op7_license_scan": licenses.sql(), "op11_hard_negatives": negatives.SQL, "op13_merkle_manifest": merkle.sql()}
