"""G3-G6 by score levels: nucleus cut and draws whose cost does not follow the size of one context.

Tokens of one context with the same score have the same probability, so a context is a short list of *levels*
``(score, number of tokens)``, built by partial aggregation.  Top-k, softmax, top-p and the inverse CDF work on levels: a level
is kept whole, dropped, or cut at a place that a division gives.  Single tokens matter in two cases only: a level that is
cut, and the level that a draw falls in.  Their places inside the level come from one range-partitioned order over all contexts,
so a context (or one level of it) that holds a third of all rows is spread like any other.

A draw table keeps the tokens of small levels inside the context's row (at most k levels of at most ``INLINE`` tokens) and
those of larger levels in blocks of ``BLOCK`` tokens, found by (context, score, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.ordering import range_positions
from colloquy.operators.scoring import count_scores, temperature
from colloquy.session import checkpointed

INLINE = 1024
BLOCK = 1024


def score_levels(scores: DataFrame, k: int = config.TOP_K, p: float = config.TOP_P) -> DataFrame:
    """``scores(ctx, token, logit)`` -> ``(ctx, logit, m, kept, p, lo, hi)``: levels that survive G3-G5, in their m tokens, the first ``kept`` of which
    (by token) stay, the renormalised probability of each, and the stretch of the context's CDF that they own (the last one's ``hi`` is +inf)."""
    order = Window.partitionBy("ctx").orderBy(F.desc("logit"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("ctx")
    lv = scores.groupBy("ctx", "logit").agg(F.count(F.lit(1)).alias("m"))
    if k > 0:
        # a level holds a token at least, so k levels reach k tokens: a group limit, before the shuffle too
        lv = lv.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
        lv = lv.withColumn("_n", F.coalesce(F.sum("m").over(before), F.lit(0))).filter(F.col("_n") < k).drop("_n")
    lv = lv.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(whole)))
    lv = lv.withColumn("p", F.col("_e") / F.sum(F.col("m") * F.col("_e")).over(whole)).drop("_e").withColumn("kept", F.col("m"))
    if p < 1.0:
        lv = lv.withColumn("_b", F.coalesce(F.sum(F.col("m") * F.col("p")).over(before), F.lit(0.0)))
        room = F.lit(p + 1e-12) - F.col("_b")
        lv = lv.filter(room >= 0).withColumn("kept", F.least("m", F.floor(room / F.col("p")) + 1)).drop("_b")
    lv = lv.withColumn("p", F.col("p") / F.sum(F.col("kept") * F.col("p")).over(whole))
    lv = lv.withColumn("lo", F.coalesce(F.sum(F.col("kept") * F.col("p")).over(before), F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy("ctx").orderBy("logit")) == 1
    return lv.select("ctx", "logit", "m", "kept", "p", "lo", F.when(last, F.lit(float("inf"))).otherwise(F.col("lo") + F.col("kept") * F.col("p")).alias("hi"))


def _with_levels(scores: DataFrame, levels: DataFrame) -> DataFrame:
    lv = levels.select(*[F.col(c).alias(f"_l_{c}") for c in levels.columns])
    return (scores.join(lv, F.col("ctx").eqNullSafe(F.col("_l_ctx")) & (F.col("logit") == F.col("_l_logit")))
            .drop("_l_ctx", "_l_logit"))


def level_ranks(rows: DataFrame, out: str = "rank") -> DataFrame:
    """0-based place of each row of ``rows(ctx, logit, token, ...)`` inside its (ctx, logit), by token: positions in one global
    order, less the first position of the level.  No window holds a level."""
    d = range_positions(rows, [F.asc_nulls_first(c) for c in ("ctx", "logit", "token")], pos_col="_pos")
    first = d.groupBy(F.col("ctx").alias("_f_ctx"), F.col("logit").alias("_f_logit")).agg(F.min("_pos").alias("_first"))
    return (d.join(first, F.col("ctx").eqNullSafe(F.col("_f_ctx")) & (F.col("logit") == F.col("_f_logit")))
            .withColumn(out, F.col("_pos") - F.col("_first")).drop("_pos", "_first", "_f_ctx", "_f_logit"))


def nucleus(scores: DataFrame, t: float = config.TEMPERATURE, k: int = config.TOP_K, p: float = config.TOP_P) -> DataFrame:
    """G2-G5 on ``scores(ctx, token, logit, ...)``: the rows that stay, with ``p``.  Same rows as ``scoring.decode_filters``; no window over the
    rows of a context.  ``scores`` is read three times: pass a stored table."""
    scores = temperature(scores, t)
    d = _with_levels(scores, score_levels(scores, k, p))
    own = [F.col(c) for c in scores.columns] + [F.col("_l_p").alias("p")]
    whole = d.filter(F.col("_l_kept") == F.col("_l_m")).select(*own)
    cut = level_ranks(d.filter(F.col("_l_kept") < F.col("_l_m")), "_rank").filter(F.col("_rank") < F.col("_l_kept"))
    return whole.unionByName(cut.select(*own))


@dataclass
class DrawTable:
    """``contexts(_c_ctx, _levels)``, one row a context, and ``blocks(_b_ctx, _b_logit, _b_block, _b_tokens)`` of ``block`` tokens, None if no level needs them."""
    contexts: DataFrame
    blocks: DataFrame | None
    block: int


def draw_table(counts: DataFrame, t: float = config.TEMPERATURE, k: int = config.TOP_K, p: float = config.TOP_P,
               inline: int = INLINE, block: int = BLOCK) -> DrawTable:
    """Draw table of ``counts(ctx, token, n)`` after G2-G5, stored once in the checkpoint folder."""
    scores = checkpointed(temperature(count_scores(counts), t).select("ctx", "token", "logit"))
    levels = checkpointed(score_levels(scores, k, p))
    small = (_with_levels(scores, levels.filter(F.col("m") <= inline)).groupBy(F.col("ctx").alias("_s_ctx"), F.col("logit").alias("_s_logit"))
             .agg(F.slice(F.sort_array(F.collect_list("token")), F.lit(1), F.first("_l_kept").cast("int")).alias("tokens")))
    contexts = checkpointed(levels.join(small, F.col("ctx").eqNullSafe(F.col("_s_ctx")) & (F.col("logit") == F.col("_s_logit")), "left")
                .groupBy(F.col("ctx").alias("_c_ctx")).agg(F.collect_list(F.struct("lo", "hi", "p", "kept", "logit", "tokens")).alias("_levels")))
    large = levels.filter(F.col("m") > inline)
    if large.isEmpty():
        return DrawTable(contexts, None, block)
    ranked = level_ranks(_with_levels(scores, large), "_rank").filter(F.col("_rank") < F.col("_l_kept"))
    blocks = (ranked.groupBy(F.col("ctx").alias("_b_ctx"), F.col("logit").alias("_b_logit"), F.expr(f"_rank div {block}").alias("_b_block"))
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "token"))), lambda s: s["token"]).alias("_b_tokens")))
    return DrawTable(contexts, checkpointed(blocks), block)


class Draw:
    """G6 against a draw table: the token of context ``key`` that the uniform ``u`` falls on, null where the context is unknown, as column ``out``
    behind the columns ``keep``.

    ``idle``: a value of its own for each row that no context holds; rows without a draw join under it, so they do not meet in one task.
    The expressions are built once, so a loop of draws only chains them."""

    def __init__(self, table: DrawTable, key: Column, u: Column, idle: Column, keep: list[str], out: str = "token"):
        self.table, kept = table, [F.col(c) for c in keep]
        hit = F.filter("_levels", lambda x: (F.col("_u") >= x["lo"]) & (F.col("_u") < x["hi"]))

        def place(x):
            return F.greatest(F.least(F.floor((F.col("_u") - x["lo"]) / x["p"]), x["kept"] - 1), F.lit(0))

        self.ask = [*kept, F.coalesce(key, idle).alias("_key"), u.alias("_u"), *([idle.alias("_idle")] if table.blocks is not None else [])]
        self.same = F.col("_key") == F.col("_c_ctx")
        if table.blocks is None:
            self.answer = [*kept, F.get(F.transform(hit, lambda x: F.get(x["tokens"], place(x).cast("int"))), 0).alias(out)]
            return
        pick = F.transform(hit, lambda x: F.struct(F.get(x["tokens"], place(x).cast("int")).alias("near"), x["tokens"].isNull().alias("far"),
                                                   x["logit"].alias("logit"), place(x).alias("i")))
        self.pick = [*kept, F.col("_key"), F.col("_idle"), F.get(pick, 0).alias("_p")]
        self.find = [*kept, F.col("_p"), F.when(F.col("_p.far"), F.col("_key")).otherwise(F.col("_idle")).alias("_far"), F.expr(f"_p.i div {table.block}").alias("_blk")]
        self.there = (F.col("_far") == F.col("_b_ctx")) & (F.col("_p.logit") == F.col("_b_logit")) & (F.col("_blk") == F.col("_b_block"))
        self.answer = [*kept, F.coalesce("_p.near", F.get("_b_tokens", (F.col("_p.i") % table.block).cast("int"))).alias(out)]

    def __call__(self, df: DataFrame) -> DataFrame:
        d = df.select(self.ask).join(self.table.contexts, self.same, "left")
        if self.table.blocks is not None:
            d = d.select(self.pick).select(self.find).join(self.table.blocks, self.there, "left")
        return d.select(self.answer)


def draw(df: DataFrame, table: DrawTable, key: Column, u: Column, idle: Column, out: str = "token") -> DataFrame:
    """``Draw`` for every row of ``df``, behind all its columns."""
    return Draw(table, key, u, idle, df.columns, out)(df)
