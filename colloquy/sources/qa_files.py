"""Readers for the five question-answer sources, already downloaded as files.

Schemas are fixed (no inference) and contain only the fields the unification reads,
so nested column pruning keeps e.g. SQuAD passages out of the scan.  Several paths
(splits) are read as one DataFrame in the given order (U1): ``split_ord`` keeps it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import configure

SCHEMAS = {
    "ambig": ("question string, annotations struct<qaPairs: array<struct<answer: array<array<string>>>>, "
              "answer: array<array<string>>>"),
    "wiki": "question string, answer string, label int",
    "truthful": "question string, best_answer string, correct_answers array<string>",
    "squad": "question string, answers struct<text: array<string>>",
    "instruct": "instruction string, context string, response string",
}


def read_source(spark: SparkSession, kind: str, paths, fmt: str = "parquet") -> DataFrame:
    """One DataFrame per source; ``paths`` in split order; adds ``split_ord`` and ``row_ord``."""
    configure(spark)
    if isinstance(paths, str):
        paths = [paths]
    parts = []
    for i, p in enumerate(paths):
        r = spark.read.schema(SCHEMAS[kind]).format(fmt).load(p)
        parts.append(r.withColumn("split_ord", F.lit(i)).withColumn("row_ord", F.monotonically_increasing_id()))
    return reduce(DataFrame.unionByName, parts)
