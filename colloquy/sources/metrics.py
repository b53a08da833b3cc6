"""The trainer's metrics JSON (four parallel lists) <-> one row per logged step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.ordering import range_positions

METRICS_SCHEMA = ("train_loss array<double>, steps array<bigint>, "
                  "learning_rates array<double>, memory_used array<double>")
ROW_SCHEMA = "step bigint, train_loss double, lr double, mem_gb double"


INDEX_SCHEMA = "document bigint, first_step bigint, last_step bigint, n bigint"
STEPS_PER_DOCUMENT = 100_000


def read_metrics_json(spark: SparkSession, path) -> DataFrame:
    """Read metrics documents (``json.dump(..., indent=2)``) and zip the lists into rows."""
    doc = spark.read.schema(METRICS_SCHEMA).option("multiLine", "true").json(path)
    return _rows(doc)


def _rows(doc: DataFrame, *more: str) -> DataFrame:
    z = F.arrays_zip(F.col("steps").alias("step"), F.col("train_loss").alias("train_loss"),
                     F.col("learning_rates").alias("lr"), F.col("memory_used").alias("mem_gb"))
    return doc.select(*more, F.inline(z))


def write_metrics_json(rows: DataFrame, path: str, mode: str = "overwrite",
                       steps_per_document: int = STEPS_PER_DOCUMENT) -> None:
    """Write the logged steps as documents of parallel lists in step order, at most ``steps_per_document`` values a list.

    Steps are numbered by a range partitioning, so no task and no list holds them all; a run that fits one document is
    the trainer's single document.  Below ``path``: ``document=<n>``, each one line of JSON, and ``_index`` (hidden from
    readers of the documents) with the first and last step of each.  A null step sorts first.  No logged step: no document,
    an empty index."""
    cols = {"steps": "step", "train_loss": "train_loss", "learning_rates": "lr", "memory_used": "mem_gb"}
    placed = range_positions(rows.select(*cols.values()), list(cols.values()), "_pos")
    doc = (placed.groupBy(F.floor(F.col("_pos") / steps_per_document).cast("bigint").alias("document"))
                 .agg(F.sort_array(F.collect_list(F.struct("_pos", *cols.values()))).alias("r")))
    doc = doc.select("document", *[F.col(f"r.{c}").alias(name) for name, c in cols.items()])
    doc.write.mode(mode).partitionBy("document").json(path)
    placed.groupBy(F.floor(F.col("_pos") / steps_per_document).cast("bigint").alias("document")).agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n")).write.mode(mode).json(f"{path}/_index")


def read_metrics_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).json(f"{path}/_index")


def read_metrics_documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``document`` and its rows from what ``write_metrics_json`` wrote; only documents that can hold a step from ``first``
    to ``last`` are read (the index names them as one range of documents)."""
    index = read_metrics_index(spark, path)
    held = F.lit(True)
    if first is not None:
        held = held & (F.col("last_step") >= first)
    if last is not None:
        held = held & (F.col("first_step") <= last)
    lo, hi = index.filter(held).agg(F.min("document"), F.max("document")).first()
    if lo is None:
        return spark.createDataFrame([], f"document bigint, {ROW_SCHEMA}")
    doc = spark.read.schema(f"{METRICS_SCHEMA}, document bigint").json(path).filter(F.col("document").between(lo, hi))
    r = _rows(doc, "document")
    if first is not None:
        r = r.filter(F.col("step") >= first)
    return r.filter(F.col("step") <= last) if last is not None else r


def write_metrics_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one JSON object per logged step (distributed; no single document)."""
    rows.select("step", "train_loss", "lr", "mem_gb").write.mode(mode).json(path)


def read_metrics_rows(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).json(path)
