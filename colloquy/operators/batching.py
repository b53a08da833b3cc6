"""Seeded epoch order, fixed-size batches (drop last), collate/pad, stats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.ordering import global_positions, range_positions
from colloquy.functions.permute import keyed_permutation


def epoch_order(df: DataFrame, key_cols, seed: int = config.SEED, epochs: int = 1,
                rows_per_bucket: int = 50_000) -> DataFrame:
    """B1: one seeded permutation per epoch, ``pos`` 0..N-1.

    Order key ``md5("seed:epoch:key...")`` then the keys.  The global position comes from md5-prefix
    buckets (uniform by construction, so no hot bucket); their number follows the row count, at about
    ``rows_per_bucket`` rows each, and the join with the bucket offsets is left to AQE, which broadcasts them
    after measuring.  Adds ``epoch``, ``pos`` and ``n_examples`` (examples per epoch).
    """
    keys = list(key_cols)
    digits = max(2, math.ceil(math.log(max(1.0, df.count() / rows_per_bucket), 16)))
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(epochs) - 1))))
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                            *[F.col(k).cast("string") for k in keys])))
    out = global_positions(d, F.substring("_h", 1, digits), ["_h", *keys], pos_col="pos",
                           partition_cols=["epoch"], total_col="n_examples")
    return out.drop("_h")


def epoch_permutation(df: DataFrame, key_cols, seed: int = config.SEED, epochs: int = 1) -> DataFrame:
    """B1 by arithmetic: rows are numbered once by their keys; each epoch's ``pos`` is a keyed permutation of that number, computed
    row by row.  No hash order and no shuffle an epoch, however many epochs.  Adds ``epoch``, ``pos`` and ``n_examples``."""
    keys = list(key_cols)
    numbered = range_positions(df, [F.asc_nulls_first(k) for k in keys], pos_col="_at")
    n = numbered.count()
    d = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(epochs) - 1))))
    pos = keyed_permutation(F.col("_at"), max(n, 1), F.lit(str(seed)), F.col("epoch").cast("string"))
    return d.withColumn("pos", pos).withColumn("n_examples", F.lit(n).cast("bigint")).drop("_at")


def assign_batches(ordered: DataFrame, batch_size: int = config.BATCH_SIZE, drop_last: bool = True) -> DataFrame:
    """B2: ``batch_idx = pos div B``, ``slot = pos mod B``; the last partial batch is dropped."""
    b = int(batch_size)
    out = (ordered.withColumn("batch_idx", F.floor(F.col("pos") / b).cast("bigint"))
                  .withColumn("slot", (F.col("pos") % b).cast("bigint")))
    if drop_last:
        out = out.filter(F.col("batch_idx") < F.floor(F.col("n_examples") / b))
    return out


def pad_batches(batches: DataFrame, pad_id=config.PAD_TOKEN_ID, ignore_index: int = config.IGNORE_INDEX,
                input_col: str = "input_ids", label_col: str = "labels") -> DataFrame:
    """B3-B6 (collate): pad to the batch maximum, inputs with ``pad_id``, labels with -100.

    ``attention_len`` keeps the real length, so a pad id that equals a real token id never
    confuses real and padded cells.  ``pad_id`` may be an int or a column.
    """
    pad = F.lit(pad_id) if isinstance(pad_id, int) else pad_id  # int or (scalar) column
    d = batch_max_len(batches, input_col)
    fill = (F.col("padded_len") - F.col("attention_len")).cast("int")
    return (d.withColumn(input_col, F.concat(F.col(input_col), F.array_repeat(pad.cast("int"), fill)))
             .withColumn(label_col, F.concat(F.col(label_col), F.array_repeat(F.lit(ignore_index).cast("int"), fill))))


def batch_max_len(batches: DataFrame, input_col: str = "input_ids", length=None) -> DataFrame:
    """B3 without materialising padded arrays: ``padded_len`` per row (``length``: a column that already
    holds the size of ``input_col``)."""
    w = Window.partitionBy("epoch", "batch_idx")
    n = F.size(F.col(input_col)) if length is None else length
    return (batches.withColumn("attention_len", n.cast("bigint"))
                   .withColumn("padded_len", F.max(n).over(w).cast("bigint")))


def export_batches(padded: DataFrame, consume, schema: str) -> DataFrame:
    """Hand padded batches to a consumer: ``consume`` gets an iterator of Arrow record batches (``mapInArrow``)
    in which the rows of a batch are together, in slot order; rows of one batch never leave their task."""
    return padded.repartition("epoch", "batch_idx").sortWithinPartitions("epoch", "batch_idx", "slot").mapInArrow(consume, schema)


def batch_stats(padded: DataFrame) -> DataFrame:
    """B7 report per epoch: batches, examples, padded cells, real cells."""
    return (padded.groupBy("epoch")
                  .agg((F.max("batch_idx") + 1).cast("bigint").alias("n_batches"),
                       F.count(F.lit(1)).alias("n_rows"),
                       F.sum("padded_len").cast("bigint").alias("padded_cells"),
                       F.sum("attention_len").cast("bigint").alias("real_cells")))
