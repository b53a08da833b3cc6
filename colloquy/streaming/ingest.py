"""Continuous JSONL ingest with the batch gate's rules.

New files in ``in_dir`` are read as lines and classified by the *same* function as the batch path.  Data errors never
fail the stream.  Two sinks:

* ``start_ingest`` appends to Parquet partitioned by ``reason`` (``reason=ok`` is the corpus; the other partitions are the
  reject report).  The file sink plus checkpoint make each file's rows land exactly once, also after a restart.
* ``start_ingest_tables`` writes each micro-batch by ``foreachBatch`` into folders named by its batch id,
  ``rows/batch=N/reason=R`` and ``counts/batch=N``.  A batch that is run again after a failure replaces its own folders, so rows
  and counts are never doubled, and the counts (S3) come from the write itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.counted import write_counted
from colloquy.session import configure
from colloquy.sources.jsonl import REASONS, classify_lines

OUT = ["reason", "context", "response", "source", "has_replacement_char", "value"]
ROWS_SCHEMA = "context array<string>, response string, source string, has_replacement_char boolean, value string, batch bigint, reason string"
COUNTS_SCHEMA = "reason string, n bigint, batch bigint"


def _lines(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    configure(spark)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(in_dir)


def start_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    out = classify_lines(_lines(spark, in_dir, max_files_per_trigger)).select(*OUT)
    w = (out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .partitionBy("reason").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def land_batch(lines: DataFrame, batch_id: int, out_dir: str) -> dict[str, int]:
    """One micro-batch: classified rows and their counts by reason, in folders of its id (which they replace)."""
    rows = classify_lines(lines).select(*OUT)
    counts = write_counted(rows, lambda d: d.write.mode("overwrite").partitionBy("reason").parquet(f"{out_dir}/rows/batch={batch_id}"), "reason", REASONS)
    (lines.sparkSession.createDataFrame([(k, n) for k, n in counts.items() if n], "reason string, n bigint").coalesce(1)
     .write.mode("overwrite").parquet(f"{out_dir}/counts/batch={batch_id}"))
    return counts


def start_ingest_tables(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                        available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    w = (_lines(spark, in_dir, max_files_per_trigger).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: land_batch(batch, batch_id, out_dir) and None))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows of all landed batches, with their ``batch`` and ``reason``."""
    return spark.read.schema(ROWS_SCHEMA).parquet(f"{out_dir}/rows")


def ingested_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(reason, n, batch)`` as counted while the batches were written."""
    return spark.read.schema(COUNTS_SCHEMA).parquet(f"{out_dir}/counts")
