"""Helpers the operators share: table reading, shared-folder tables, text words, components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import checkpoint_dir, configure


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the session has cores; larger scans stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder under the session's checkpoint folder (shared by driver and executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and a lost
    executor costs only the tasks that read."""
    spark = df.sparkSession
    path = path or shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, path: str) -> None:
    """Give back the disk of ``df``, materialized at ``path``, once nothing reads it any more."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def bucket_count(n_bytes: int, per_bucket: int, least: int = 1) -> int:
    """Number of buckets of about ``per_bucket`` bytes each."""
    return max(least, -(-int(n_bytes) // per_bucket))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, summed on the cluster."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col).cast("long")), F.lit(0))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of ``edges(a, b)``, as ``(node, root)``.

    Alternating large-star / small-star rounds (each two partial-aggregated shuffles); edges are
    written to the shared folder after each round, never collected.  Stops when a round leaves the
    edge set unchanged.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs: DataFrame, keep_larger_only: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("lo")).select(
            F.col("a").alias("k"), F.least("a", "lo").alias("m"))
        out = pairs.join(least, pairs["a"] == least["k"])
        if keep_larger_only:
            out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                               F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
                             ).select("e.a", "e.b")
        return out.filter(F.col("a") != F.col("b")).distinct()

    def signature(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = materialize(edges.filter(F.col("a") != F.col("b"))
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = signature(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = star(both(cur), True)
        small = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        cur = materialize(small, "cc")
        now = signature(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select("b", "b").distinct()).distinct() if seen[0] else cur.select(
            F.col("a").alias("node"), F.col("b").alias("root"))


def fresh_name(base: str, taken: Sequence[str]) -> str:
    """``base``, with underscores added until no column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base
