"""Registered queries of the operators: production parameters over the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import chat_format, curriculum, decontaminate, hard_negatives, licenses, lm_scores, nearest, simhash, suffix_dedup, toxicity, url_filter, warc, whitening
from colloquy.llm.common import read_table
from corpus_pipeline import run as pipeline


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(read_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), rules)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(read_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix_plan(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    files = licenses.document_files(read_table(spark, sf_dir, "documents"))
    return licenses.license_scan(files, templates).withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), whitening.COMPONENTS)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    return chat_format.chat_round_trip(rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


LLM_REGISTRY = {
    "pipeline": pipeline,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scores": op5_lm_scores,
    "op6_nearest": op6_nearest,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}

LLM_ORACLE = {
    "op3_url_filter": url_filter.ORACLE,
    "op7_mixing": curriculum.ORACLE.format(src="documents"),
    "op12_chat_format": chat_format.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
