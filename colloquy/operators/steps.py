"""Optimizer-step bookkeeping as column arithmetic on the batch table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import config


def batches_per_epoch(batches: DataFrame) -> DataFrame:
    """``(epoch, nb)`` from the batch table (rows per epoch are full batches)."""
    return batches.groupBy("epoch").agg((F.max("batch_idx") + 1).cast("bigint").alias("nb"))


def run_plan(examples: DataFrame, batch_size: int = config.BATCH_SIZE, epochs: int = config.EPOCHS,
             accumulation: int = config.ACCUMULATION_STEPS, warmup_steps: int = config.WARMUP_STEPS) -> DataFrame:
    """A2: one row. ``nb = N div B``, raw total ``nb*E``, optimizer total ``nb*E div acc``,
    effective batch ``B*acc``, warm-up ``min(warmup, total div 10)``."""
    n = examples.agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"))
    nb = F.floor(F.col("n_examples") / batch_size).cast("bigint")
    total = F.floor(nb * epochs / accumulation).cast("bigint")
    return n.select("n_examples", nb.alias("batches_per_epoch"),
                    (nb * epochs).cast("bigint").alias("raw_total"),
                    total.alias("total_steps"),
                    F.lit(batch_size * accumulation).cast("bigint").alias("effective_batch"),
                    F.least(F.lit(warmup_steps).cast("bigint"), F.floor(total / 10).cast("bigint")).alias("warmup"))


def step_map(batches: DataFrame, accumulation: int = config.ACCUMULATION_STEPS,
             epochs: int = config.EPOCHS) -> DataFrame:
    """Per ``(epoch, batch_idx)``: ``is_update`` when ``(i+1) mod acc = 0``; ``step_after`` =
    ``e*K + (i+1) div acc`` with ``K = nb div acc``; ``consumed_by_step`` = the update that
    applies this batch's gradient - leftover batches fold into the next epoch's first update,
    and are lost after the last epoch (NULL), as are all batches when ``K = 0``."""
    acc = int(accumulation)
    b = batches.select("epoch", "batch_idx").distinct()
    per = F.broadcast(batches_per_epoch(batches))          # one row per epoch: bounded by `epochs`
    d = b.join(per, "epoch")
    e, i = F.col("epoch"), F.col("batch_idx")
    k = F.floor(F.col("nb") / acc)
    consumed = (F.when(i < k * acc, e * k + F.floor(i / acc) + 1)
                 .when((e + 1 < epochs) & (k > 0), (e + 1) * k + 1))
    return d.select(e.cast("bigint").alias("epoch"), i.cast("bigint").alias("batch_idx"),
                    (((i + 1) % acc) == 0).alias("is_update"),
                    (e * k + F.floor((i + 1) / acc)).cast("bigint").alias("step_after"),
                    consumed.cast("bigint").alias("consumed_by_step"))


def step_events(steps: DataFrame, log_interval: int = config.LOG_INTERVAL,
                save_interval: int = config.SAVE_INTERVAL, test_interval: int = config.TEST_INTERVAL) -> DataFrame:
    """Flags per optimizer step (units are optimizer steps)."""
    s = F.col("step")
    flag = (lambda n: (F.pmod(s, F.lit(n)) == 0) if n > 0 else F.lit(False))
    return steps.select(s, flag(log_interval).alias("do_log"), flag(save_interval).alias("do_save"),
                        flag(test_interval).alias("do_test"))


def lr_at(step, total, base: float = config.LEARNING_RATE, min_lr: float = config.MIN_LR,
          warmup_steps: int = config.WARMUP_STEPS):
    """T4 closed form: linear warm-up from 0.1*base, then cosine to ``min_lr``;
    constant ``base`` when the capped warm-up is 0."""
    s = F.col(step) if isinstance(step, str) else step
    t = F.col(total) if isinstance(total, str) else (F.lit(total) if isinstance(total, int) else total)
    w = F.least(F.lit(warmup_steps), F.floor(t / 10))
    warm = F.lit(base) * (F.lit(config.WARMUP_START_FACTOR) + (1 - config.WARMUP_START_FACTOR) * s / w)
    cos = F.lit(min_lr) + (base - min_lr) * (1 + F.cos(F.lit(math.pi) * (s - w) / (t - w))) / 2
    return F.when(w <= 0, F.lit(base)).when(s < w, warm).otherwise(cos)


def metrics_log(steps: DataFrame, batch_loss: DataFrame, total_steps,
                log_interval: int = config.LOG_INTERVAL) -> DataFrame:
    """At each logged update keep ``(step, loss of the last micro-batch, lr after the
    scheduler step, memory)``; ``total_steps`` is an int or a (scalar) column."""
    logged = steps.filter(F.col("is_update") & (F.pmod(F.col("step_after"), F.lit(log_interval)) == 0))
    j = logged.join(batch_loss.select("epoch", "batch_idx", "loss"), ["epoch", "batch_idx"])
    return j.select(F.col("step_after").alias("step"), "epoch", "batch_idx", F.col("loss").alias("train_loss"),
                    lr_at("step_after", total_steps).alias("lr"), F.lit(0.0).alias("mem_gb"))


def epoch_loss(batch_loss: DataFrame) -> DataFrame:
    """A4: unweighted mean of batch losses per epoch (two-level aggregate)."""
    return batch_loss.groupBy("epoch").agg(F.avg("loss").alias("epoch_loss"),
                                           F.count(F.lit(1)).alias("n_batches"))
