"""Next-token statistics, masked loss and decoding filters as window jobs.

Score tables are long: ``(ctx, token, logit)`` - every context at once, one window
partition per context (one shuffle on ``ctx`` shared by all the windows below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.text import count_char, keyed_uniform


def next_token_counts(pairs: DataFrame, input_col: str = "input_ids", label_col: str = "labels") -> DataFrame:
    """``(ctx, token, n)`` - how often ``token`` follows ``ctx`` (partial + final hash agg)."""
    z = pairs.select(F.explode_outer(F.arrays_zip(F.col(input_col).alias("ctx"), F.col(label_col).alias("token"))).alias("z"))
    z = z.filter(F.col("z").isNotNull())
    return z.groupBy(F.col("z.ctx").alias("ctx"), F.col("z.token").alias("token")).agg(
        F.count(F.lit(1)).alias("n"))


def count_scores(counts: DataFrame) -> DataFrame:
    """Logit = ln(count) - the table stand-in for the network's output layer."""
    return counts.withColumn("logit", F.log(F.col("n").cast("double")))


def _probabilities(counts: DataFrame) -> DataFrame:
    tot = counts.groupBy("ctx").agg(F.sum("n").alias("n_ctx"))
    return counts.join(tot, "ctx").select("ctx", "token", (F.col("n") / F.col("n_ctx")).alias("p"))


def example_loss(examples: DataFrame, counts: DataFrame, keys, input_col: str = "input_ids", label_col: str = "labels",
                 smoothing: float | None = None, ignore_index: int = -100) -> DataFrame:
    """A3 per row of ``examples``: ``(*keys, loss_sum, n_positions)``, the sum of ``-ln p(label | ctx)`` over its real positions
    (numeric labels equal to ``ignore_index`` are padding) and their number, p = count ratio within the context.

    An example's loss is the same in every epoch, so its positions meet the counts once, and only sums travel on.  Rows are
    kept as rows, those without a real position too; ``examples`` must be a stored table, as rows are told apart by number.
    An unseen pair fails the job unless a ``smoothing`` probability is given."""
    keys = list(keys)
    numeric = examples.schema[label_col].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    real = F.col("z.token") != F.lit(ignore_index) if numeric else F.lit(True)
    rows = examples.withColumn("_row", F.monotonically_increasing_id())
    pos = (rows.select("_row", F.explode_outer(F.arrays_zip(F.col(input_col).alias("ctx"), F.col(label_col).alias("token"))).alias("z"))
               .filter(F.col("z").isNotNull() & real).select("_row", "z.ctx", "z.token"))
    j = pos.join(_probabilities(counts), ["ctx", "token"], "left")
    p = F.col("p") if smoothing is None else F.coalesce("p", F.lit(float(smoothing)))
    nll = F.when(p.isNull(), F.raise_error(F.lit("batch_loss: unseen (ctx, token) pair"))).otherwise(-F.log(p))
    sums = j.groupBy("_row").agg(F.sum(nll).alias("loss_sum"), F.count(F.lit(1)).alias("n_positions"))
    return rows.select(*keys, "_row").join(sums, "_row", "left").select(
        *keys, F.coalesce("loss_sum", F.lit(0.0)).alias("loss_sum"), F.coalesce("n_positions", F.lit(0)).cast("bigint").alias("n_positions"))


def batch_loss(batches: DataFrame, counts: DataFrame | None = None, accumulation: int = config.ACCUMULATION_STEPS,
               input_col: str = "input_ids", label_col: str = "labels", smoothing: float | None = None,
               ignore_index: int = -100) -> DataFrame:
    """A3 + A5: masked mean of ``-ln p(label | ctx)`` per ``(epoch, batch_idx)`` over the real
    positions (numeric labels equal to ``ignore_index`` are padding), p = count ratio within the context.

    Without ``counts``, ``batches`` holds the sums of ``example_loss`` in place of tokens.  Else positions are aggregated to
    ``(batch, ctx, token)`` before the join.  An unseen pair fails the job unless a ``smoothing`` probability is given."""
    if counts is None:
        out = batches.filter("n_positions > 0").groupBy("epoch", "batch_idx").agg(
            (F.sum("loss_sum") / F.sum("n_positions")).alias("loss"), F.sum("n_positions").cast("bigint").alias("n_positions"))
        return out.withColumn("scaled_loss", F.col("loss") / accumulation)
    numeric = batches.schema[label_col].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    real = F.col("z.token") != F.lit(ignore_index) if numeric else F.lit(True)
    pos = (batches.select("epoch", "batch_idx",
                          F.explode_outer(F.arrays_zip(F.col(input_col).alias("ctx"), F.col(label_col).alias("token"))).alias("z"))
                  .filter(F.col("z").isNotNull() & real)
                  .groupBy("epoch", "batch_idx", F.col("z.ctx").alias("ctx"), F.col("z.token").alias("token"))
                  .agg(F.count(F.lit(1)).alias("c")))
    j = pos.join(_probabilities(counts), ["ctx", "token"], "left")
    p = F.col("p") if smoothing is None else F.coalesce("p", F.lit(float(smoothing)))
    nll = F.when(p.isNull(), F.raise_error(F.lit("batch_loss: unseen (ctx, token) pair"))).otherwise(-F.log(p))
    out = j.groupBy("epoch", "batch_idx").agg((F.sum(F.col("c") * nll) / F.sum("c")).alias("loss"),
                                              F.sum("c").cast("bigint").alias("n_positions"))
    return out.withColumn("scaled_loss", F.col("loss") / accumulation)


def temperature(scores: DataFrame, t: float = config.TEMPERATURE, col: str = "logit") -> DataFrame:
    """Divide logits when ``t > 0``; ``t = 0`` leaves them unscaled (not greedy)."""
    return scores.withColumn(col, F.col(col) / F.lit(float(t))) if t > 0 else scores


def top_k(scores: DataFrame, k: int = config.TOP_K, col: str = "logit") -> DataFrame:
    """Drop logits strictly below the k-th largest - ties at the boundary survive, hence
    ``rank()`` not ``row_number()``; planned as a WindowGroupLimit (partial limit before the
    shuffle).  ``k <= 0`` disables."""
    if k <= 0:
        return scores
    w = Window.partitionBy("ctx").orderBy(F.desc(col))
    return scores.withColumn("rk", F.rank().over(w)).filter(F.col("rk") <= k).drop("rk")


def softmax(scores: DataFrame, col: str = "logit", out: str = "p", method: str = "aggregate") -> DataFrame:
    """``exp(l - max) / sum`` per context.

    ``aggregate`` (for full candidate lists): the per-context max and normaliser come from two
    partial (map-side combined) aggregates joined back on ``ctx``, so a context with millions of
    candidates is never one task (AQE splits its probe-side rows in the joins).
    ``window``: two whole-partition windows; right after top-k, where each context holds about
    k rows and one shuffle is cheaper than two joins."""
    if method == "window":
        w = Window.partitionBy("ctx")
        e = F.exp(F.col(col) - F.max(col).over(w))
        return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")
    m = scores.groupBy("ctx").agg(F.max(col).alias("_m"))
    d = scores.join(m, "ctx").withColumn("_e", F.exp(F.col(col) - F.col("_m")))
    z = d.groupBy("ctx").agg(F.sum("_e").alias("_z"))
    return d.join(z, "ctx").withColumn(out, F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


def top_p(probs: DataFrame, p: float = config.TOP_P, col: str = "logit", prob: str = "p") -> DataFrame:
    """In descending order, drop a token when the mass *before* it exceeds ``p`` (the first
    token always stays), then renormalise.  Token is the tie-break; 1e-12 absorbs summation
    order.  ``p >= 1`` disables (probabilities still renormalised)."""
    w = Window.partitionBy("ctx")
    if p < 1.0:
        ws = Window.partitionBy("ctx").orderBy(F.desc(col), F.asc("token")).rowsBetween(Window.unboundedPreceding, -1)
        probs = (probs.withColumn("_before", F.coalesce(F.sum(prob).over(ws), F.lit(0.0)))
                      .filter(F.col("_before") <= p + 1e-12).drop("_before"))
    return probs.withColumn(prob, F.col(prob) / F.sum(prob).over(w))


def decode_filters(counts: DataFrame, t: float = config.TEMPERATURE, k: int = config.TOP_K,
                   p: float = config.TOP_P) -> DataFrame:
    """G2 -> G3 -> G4 -> G5 on count scores."""
    cut = top_k(temperature(count_scores(counts), t), k)
    return top_p(softmax(cut, method="window" if k > 0 else "aggregate"), p)


def sample(probs: DataFrame, seed: int = config.SEED, step=0, key: str = "ctx",
           col: str = "logit", prob: str = "p") -> DataFrame:
    """Inverse-CDF draw with the keyed uniform ``u = md5(seed:step:key)``: the first token
    (descending, token tie-break) whose inclusive cumulative mass exceeds u, else the last."""
    o = Window.partitionBy(key).orderBy(F.desc(col), F.asc("token"))
    w = Window.partitionBy(key)
    step_c = F.lit(str(step)) if not hasattr(step, "_jc") else step.cast("string")
    d = (probs.withColumn("_u", keyed_uniform(F.lit(str(seed)), step_c, F.col(key).cast("string")))
              .withColumn("_cum", F.sum(prob).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("_rn", F.row_number().over(o)))
    d = d.withColumn("_pick", F.coalesce(F.min(F.when(F.col("_cum") > F.col("_u"), F.col("_rn"))).over(w),
                                         F.max("_rn").over(w)))
    return d.filter(F.col("_rn") == F.col("_pick")).drop("_cum", "_rn", "_pick")


def tail_context(df: DataFrame, n: int, col: str = "tokens", out: str = "context") -> DataFrame:
    """G1: the last ``n`` tokens (all of them when shorter - ``slice(a, -n, n)`` would be empty)."""
    a = F.col(col)
    return df.withColumn(out, F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n))


def stop_cut(gen: DataFrame, keys, eos_token: str | None = config.EOS_TOKEN,
             newline_budget: int = config.NEWLINE_BUDGET, max_new_tokens: int = config.MAX_NEW_TOKENS,
             col: str = "gen_tokens") -> DataFrame:
    """Cut a generated token sequence at the first eos, or at the token after which the
    decoded text holds more than ``budget`` newlines beyond the prompt's, at most
    ``max_new_tokens``; the stopping token is kept.  Per-sequence windows (bounded groups).
    ``gen`` holds one row per sequence with ``col`` = the generated surface tokens only (the
    prompt's own newlines cancel out of the rule)."""
    keys = list(keys)
    ex = (gen.select(*keys, F.posexplode_outer(F.slice(F.col(col), 1, max_new_tokens)).alias("pos", "tok"))
             .filter(F.col("pos").isNotNull()))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ex = ex.withColumn("_nl", F.sum(count_char("tok", "\n")).over(w))
    is_eos = (F.col("tok") == eos_token) if eos_token else F.lit(False)
    stop = is_eos | (F.col("_nl") > newline_budget)
    ex = ex.withColumn("_stop_here", F.when(stop, F.col("pos")))
    ex = ex.withColumn("stop_pos", F.min("_stop_here").over(Window.partitionBy(*keys)))
    kept = ex.filter(F.col("stop_pos").isNull() | (F.col("pos") <= F.col("stop_pos")))
    reason = (F.when(F.max(F.when(is_eos & (F.col("pos") == F.col("stop_pos")), 1)) == 1, F.lit("eos"))
               .when(F.max("stop_pos").isNotNull(), F.lit("newlines"))
               .when(F.count(F.lit(1)) >= max_new_tokens, F.lit("max_tokens"))
               .otherwise(F.lit("end")))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]), "")
         .alias("kept_text"),
        F.count(F.lit(1)).cast("bigint").alias("n_kept"),
        reason.alias("stop_reason"))


def strip_prompt(df: DataFrame, full: str = "full_text", prompt: str = "prompt", out: str = "reply") -> DataFrame:
    """Drop the prompt by character length (``text[len(prompt):]``)."""
    return df.withColumn(out, F.expr(f"substring({full}, char_length({prompt}) + 1)"))
