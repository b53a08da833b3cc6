"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. toxicity          documents that the class models predict as toxic go
2. simhash           one document of each near-duplicate group stays (the smallest doc_id)
3. suffix_dedup      byte strings of 200 or more that repeat are cut out of the texts
4. decontaminate     documents that hold a benchmark item go
5. mixing            the rest is mixed to target weights: whole rows in training order, twice where a target asks for
                     it, with their position, repeat and words taken beside the columns of documents

Rows are kept by row, not by id: repeated rows, null ids and extra columns pass through every stage, and an
empty table gives an empty result.  See each operator's docstring for its defined results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import curriculum, decontaminate, simhash, suffix_dedup, toxicity
from colloquy.llm.common import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
]

#: The class models, fingerprints and latent space are not expressible in SQL; tests compare the stages with
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
