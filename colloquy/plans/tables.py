"""Readers for the driver's parquet tables (column pruning/pushdown left to Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.session import configure

# Tables whose scan is followed by CPU-heavy narrow work (regex tokenisation of whole
# documents) before any shuffle, with the key that work is grouped by later.  Other tables
# go straight into a window/aggregate shuffle, which spreads them anyway.
SPREAD_KEYS = {"documents": "doc_id"}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Hash-partition the scan on ``key`` only when it has fewer splits than the cluster has cores.

    A single-row-group file is one task, and the text work that follows the scan (regex
    tokenisation, rendering) runs before the first shuffle.  Partitioning on the key the
    later windows/aggregates use means that shuffle is the one they need anyway.  On a
    large input the scan already has far more splits than cores and nothing is added.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave the scan as it is
        return df
    if splits >= target:
        return df
    return df.repartition(key) if key else df.repartition(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df
