"""Global order without a single-partition window.

``global_positions`` numbers rows 0..N-1 in a total order: rows are bucketed by an
expression that is monotone in that order, numbered inside their bucket (one
window partition per bucket, spread over the cluster), then shifted by the
exclusive running count of the earlier buckets.  The bucket table is small by
construction (``16**hex_digits`` rows for hash buckets); it is the only thing
that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import checkpointed

_ROW_BITS = (1 << 33) - 1        # low bits of monotonically_increasing_id: the row inside its partition


def range_partitions(df: DataFrame, order_cols, parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order_cols``, with ``_part`` (ascending along the order) and
    ``_row`` (0-based place inside the part).

    Ranges are sampled from the data, so a crowded value prefix is split like any other and parts stay
    even.  The result is checkpointed once: a re-run of a lost task cannot move a row."""
    d = df.repartitionByRange(parts, *order_cols) if parts else df.repartitionByRange(*order_cols)
    return checkpointed(d.sortWithinPartitions(*order_cols)
                        .select("*", F.spark_partition_id().alias("_part"),
                                F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row")))


def range_positions(df: DataFrame, order_cols, pos_col: str = "pos", parts: int | None = None) -> DataFrame:
    """Add ``pos`` = 0-based rank by ``order_cols`` over the whole table.  Only the row counts of the
    parts (one number a shuffle partition) reach the driver; no window holds the table."""
    d = range_partitions(df, order_cols, parts)
    offsets, at = [], 0
    for part, n in sorted(d.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, at))
        at += n
    offs = df.sparkSession.createDataFrame(offsets, "_part int, _off bigint")
    return d.join(F.broadcast(offs), "_part").withColumn(pos_col, F.col("_off") + F.col("_row")).drop("_part", "_row", "_off")


def global_positions(df: DataFrame, bucket, order_cols, pos_col: str = "pos",
                     partition_cols=(), total_col: str | None = None,
                     max_buckets: int | None = None) -> DataFrame:
    """Add ``pos`` = 0-based rank of each row by ``order_cols`` within ``partition_cols``.

    ``bucket`` must be monotone in ``order_cols`` (rows of a smaller bucket sort first).
    ``max_buckets`` is the proven upper bound of distinct (partition, bucket) keys; when
    it is given the offset table is broadcast, otherwise the join is left to AQE,
    which broadcasts it only after measuring it.
    """
    part = list(partition_cols)
    # one exchange on (partition, bucket) feeds both the in-bucket numbering and the bucket
    # counts, so the input is evaluated once (the second consumer reuses the shuffle)
    d = df.withColumn("_bkt", bucket).repartition(*part, "_bkt")
    counts = d.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    cols = [*part, "_bkt", "_off"]
    if total_col:
        offs = offs.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*part)))
        cols.append(total_col)
    # null keys and null buckets are groups of their own: the join back is null-safe
    offs = offs.select(*[F.col(c).alias(f"_o_{c}") if c in (*part, "_bkt") else F.col(c) for c in cols])
    if max_buckets is not None:
        offs = F.broadcast(offs)
    inner = Window.partitionBy(*part, "_bkt").orderBy(*order_cols)
    return (d.withColumn("_rn", F.row_number().over(inner))
             .join(offs, _same([*part, "_bkt"]))
             .withColumn(pos_col, F.col("_rn") - 1 + F.col("_off"))
             .drop("_bkt", "_rn", "_off", *[f"_o_{c}" for c in (*part, "_bkt")]))


def _same(cols):
    """Null-safe equality of columns with their ``_o_`` copies."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return cond


def largest_group(df: DataFrame, key) -> int:
    """Row count of the biggest ``key`` group (one small aggregate job)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_aggs(df: DataFrame, key: str, order: str, specs, chunk_rows: int = 65536,
                 hot_rows: int | None = 1_000_000, split: bool | None = None) -> DataFrame:
    """Running aggregates per ``key`` in ``order`` (rows up to and including the current one).

    ``specs`` = ``[(out, kind, col)]`` with kind ``sum``, ``max`` or ``last`` (last non-null).
    When the largest group has at most ``hot_rows`` rows this is one window.  Otherwise no
    window sees a whole group: running values are computed inside chunks
    ``(key, order div chunk_rows)`` (``order`` is numeric), each chunk's carry-in comes from a
    window over the chunk summaries of its key (one row per chunk), and the two are combined
    exactly (sum: add, max: greatest, last: coalesce).  ``split`` given by the caller skips the
    size check (True: chunked path, False: one window).
    """
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def agg(kind, c, w):
        if kind == "sum":
            return F.sum(c).over(w)
        if kind == "max":
            return F.max(c).over(w)
        if kind == "last":
            return F.last(c, ignorenulls=True).over(w)
        raise ValueError(kind)

    if split is None:
        split = hot_rows is None or largest_group(df, key) > hot_rows
    if not split:
        out = df
        for name, kind, c in specs:
            out = out.withColumn(name, agg(kind, F.col(c), run))
        return out
    d = df.withColumn("_ck", F.floor(F.col(order) / chunk_rows))
    local = Window.partitionBy(key, "_ck").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = []
    for name, kind, c in specs:
        d = d.withColumn(f"_loc_{name}", agg(kind, F.col(c), local))
        if kind == "sum":
            summary.append(F.sum(c).alias(f"_tot_{name}"))
        elif kind == "max":
            summary.append(F.max(c).alias(f"_tot_{name}"))
        else:
            summary.append(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
                           ["v"].alias(f"_tot_{name}"))
    chunks = d.groupBy(key, "_ck").agg(*summary)
    before = Window.partitionBy(key).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col(key).alias(f"_o_{key}"), F.col("_ck").alias("_o__ck"), *[agg(kind, F.col(f"_tot_{name}"), before).alias(f"_in_{name}")
                                         for name, kind, _ in specs])
    out = d.join(chunks, _same([key, "_ck"]), "left")
    for name, kind, _ in specs:
        loc, cin = F.col(f"_loc_{name}"), F.col(f"_in_{name}")
        if kind == "sum":
            v = F.coalesce(cin, F.lit(0)) + loc
        elif kind == "max":
            v = F.when(cin.isNull(), loc).otherwise(F.greatest(cin, loc))
        else:
            v = F.coalesce(loc, cin)
        out = out.withColumn(name, v)
    return out.drop("_ck", f"_o_{key}", "_o__ck", *[f"_loc_{n}" for n, _, _ in specs], *[f"_in_{n}" for n, _, _ in specs])
