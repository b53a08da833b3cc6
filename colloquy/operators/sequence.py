"""M1-M4: numeric sequence operators re-aimed from the network layers (weights are parameters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.ordering import global_positions, largest_group, range_positions
from colloquy.operators.scan import affine_scan

# Largest vector table that is broadcast, in bytes; bigger ones take the shuffle path.
BROADCAST_MAX_BYTES = 64 << 20


def small_side(df: DataFrame, col: str, max_bytes: int = BROADCAST_MAX_BYTES):
    """Size check for a vector table: ``(df or broadcast(df), n_rows)``."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(col)), F.lit(0)).alias("values")).first()
    return (F.broadcast(df) if 32 * r["n"] + 8 * r["values"] <= max_bytes else df), r["n"]


def embed_lookup(positions: DataFrame, embeddings: DataFrame, n_vectors: int | None = None,
                 id_col: str = "token_id", pos_col: str = "pos", max_len: int | None = None) -> DataFrame:
    """M1: gather ``embedding[id]`` and add the positional vector ``embedding[pos]``
    (both ``mod n_vectors``); element-wise add with ``zip_with``.  Vectors are addressed by
    their rank of ``vec_id``, so gaps in the ids lose nothing; null ids address no vector.  A
    table of vectors is broadcast only after its size is checked.

    ``max_len``: places are 0 to ``max_len - 1``, so only as many positional vectors are joined.  With them small enough to
    broadcast, a larger embedding table costs one exchange of the positions, without any vector."""
    emb = range_positions(embeddings.filter("vec_id is not null").select("vec_id", "embedding"), ["vec_id"], pos_col="_slot")
    emb = emb.select(F.col("_slot").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    emb_j, n = small_side(emb, "v")
    n = n_vectors or n
    places = emb_j if max_len is None else small_side(emb.filter(F.col("vec_id") < max_len), "v")[0]
    d = positions.withColumn("_tv", F.pmod(F.col(id_col), F.lit(n))).withColumn("_pv", F.pmod(F.col(pos_col), F.lit(n)))
    tok = emb_j.select(F.col("vec_id").alias("_tv"), F.col("v").alias("_tok_vec"))
    pos = places.select(F.col("vec_id").alias("_pv"), F.col("v").alias("_pos_vec"))
    return (d.join(tok, "_tv").join(pos, "_pv")
             .withColumn("vector", F.zip_with("_tok_vec", "_pos_vec", lambda a, b: a + b))
             .drop("_tv", "_pv", "_tok_vec", "_pos_vec"))


def standardize(df: DataFrame, col: str = "embedding", out: str = "z", eps: float = config.LAYER_NORM_EPS) -> DataFrame:
    """M2: ``(x - mean) / sqrt(population variance + eps)`` per vector, in double."""
    x = F.transform(col, lambda v: v.cast("double"))
    n = F.size(col)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    d = df.withColumn("_x", x).withColumn("_m", mean)
    var = F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / n
    d = d.withColumn("_s", F.sqrt(var + F.lit(eps)))
    return d.withColumn(out, F.transform("_x", lambda v: (v - F.col("_m")) / F.col("_s"))).drop("_x", "_m", "_s")


def causal_fir(df: DataFrame, weights, bias: float = 0.0, key: str = "user_id", order=("ts", "event_id"),
               value: str = "value", out: str = "y", hot_rows: int | None = 1_000_000,
               chunk_seconds: float = 3600.0) -> DataFrame:
    """M3: causal depthwise convolution, left zero padding:
    ``y_t = bias + sum_j w_j * x_{t-(k-1)+j}``.

    A missing value counts as 0, like the padding.  Weighted ``lag`` terms over one window while every key fits a task (``hot_rows``).  Beyond
    that, events are numbered per key two-phase (hourly buckets of ``order[0]``, a timestamp)
    and the ``k-1`` earlier values arrive by equi-joins on ``(key, position)``, which spread a
    hot key over all tasks.
    """
    k = len(weights)
    if hot_rows is not None and largest_group(df, key) <= hot_rows:
        w = Window.partitionBy(key).orderBy(*order)
        x = F.coalesce(F.col(value), F.lit(0.0))
        y = F.lit(float(bias))
        for j, wj in enumerate(weights):
            y = y + F.lit(float(wj)) * F.lag(x, k - 1 - j, 0.0).over(w)
        return df.withColumn(out, y)
    bucket = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (chunk_seconds * 1e6))
    pos = global_positions(df, bucket, list(order), pos_col="_pos", partition_cols=[key])
    base = pos.select(key, "_pos", F.col(value).alias("_x"))
    y = F.lit(float(bias)) + F.lit(float(weights[-1])) * F.coalesce(F.col(value), F.lit(0.0))
    for lag in range(1, k):
        prev = base.select(F.col(key).alias("_pk"), (F.col("_pos") + lag).alias("_pp"), F.col("_x").alias(f"_x{lag}"))
        pos = pos.join(prev, F.col(key).eqNullSafe(F.col("_pk")) & (F.col("_pos") == F.col("_pp")), "left").drop("_pk", "_pp")
        y = y + F.lit(float(weights[k - 1 - lag])) * F.coalesce(F.col(f"_x{lag}"), F.lit(0.0))
    return pos.withColumn(out, y).drop("_pos", *[f"_x{lag}" for lag in range(1, k)])


MAX_EXPONENT = 300.0      # exp(300) is far from the largest double


def decayed_state(df: DataFrame, lam: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                  value: str = "value", out: str = "state", chunk_seconds: float = 86400.0) -> DataFrame:
    """M4: ``h_t = exp(-lam * dt) * h_{t-1} + x_t`` per key in ``(ts, tie)`` order (h before the
    first event is 0).

    The recurrence has the closed form ``h_t = sum_{s<=t} exp(-lam (t - t_s)) x_s``.  Each key
    is cut into time chunks of ``chunk_seconds``, or less where ``lam`` is large: no exponent inside
    a chunk exceeds ``MAX_EXPONENT``.  A hot key is spread over many tasks; inside a chunk it is a running-sum window.  Chunk ends follow the
    same recurrence over the chunk summaries (one row per chunk), as an associative scan, and are added back with one more decay factor.
    A null key is a key like any other; a null value adds nothing.
    """
    if lam > 0:
        chunk_seconds = min(chunk_seconds, MAX_EXPONENT / lam)
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6
    d = df.withColumn("_t", t).withColumn("_c", F.floor(F.col("_t") / chunk_seconds).cast("bigint"))
    d = d.withColumn("_t0", F.col("_c").cast("double") * chunk_seconds)
    wc = Window.partitionBy(key, "_c").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_loc", F.exp(F.lit(-lam) * (F.col("_t") - F.col("_t0")))
                     * F.sum(F.exp(F.lit(lam) * (F.col("_t") - F.col("_t0"))) * F.coalesce(value, F.lit(0.0))).over(wc))
    ends = (d.groupBy(F.col(key).alias("_k"), F.col("_c").alias("_ck"))
             .agg(F.max_by(F.struct("_t", "_loc"), F.struct(ts, tie)).alias("_e"))
             .select("_k", "_ck", F.col("_e._t").alias("_te"), F.col("_e._loc").alias("_le")))
    earlier = Window.partitionBy("_k").orderBy("_ck")
    ends = ends.withColumn("_gap", F.col("_te") - F.lag("_te").over(earlier))
    carry = affine_scan(ends, "_k", ["_ck"], [(F.exp(F.lit(-lam) * F.col("_gap")), F.col("_le"))], ["_he"])
    carry = carry.select("_k", "_ck", F.lag("_te").over(earlier).alias("_tp"), F.lag("_he").over(earlier).alias("_hp"))
    j = d.join(carry, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_ck")), "left")
    h = F.col("_loc") + F.coalesce(F.exp(F.lit(-lam) * (F.col("_t") - F.col("_tp"))) * F.col("_hp"), F.lit(0.0))
    return j.withColumn(out, h).drop("_t", "_c", "_t0", "_loc", "_k", "_ck", "_tp", "_hp")
