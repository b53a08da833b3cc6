"""G8 + G10: autoregressive rollout for many prompts at once.

Each step joins every live sequence's last token to the draw table of score levels (G2-G5 precomputed once, see ``nucleus``),
draws with the keyed uniform (G6), appends, and applies the stop rule (G7).  Levels of many tied tokens are looked up in
blocks by a second join, which is left out when the table has none.
The driver loop only launches jobs; lineage is cut with ``checkpoint()`` into the
cluster's checkpoint folder every few steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.text import count_char, keyed_uniform
from colloquy.operators.nucleus import Draw, draw_table
from colloquy.operators.scoring import strip_prompt
from colloquy.operators.tokens import tokenize
from colloquy.session import checkpointed


def generate(prompts: DataFrame, counts: DataFrame, steps: int = config.SAMPLER_MAX_TOKENS, t: float = config.TEMPERATURE,
             k: int = config.TOP_K, p: float = config.TOP_P, seed: int = config.SEED,
             eos_token: str | None = config.EOS_TOKEN, newline_budget: int = config.NEWLINE_BUDGET,
             checkpoint_every: int = 10) -> DataFrame:
    """``prompts(prompt_id, tokens)`` -> one row per prompt, ``(prompt_id, gen)``: its generated tokens.

    A sequence stops at eos, when its generated newlines exceed the budget (the stopping token is kept), after
    ``steps`` tokens, or when its last token never occurs as a context (it then ends with a null).

    The draw table is stored once.  A sequence is one row that carries its tokens (at
    most ``steps``), so a step is one join (two with large levels) and the plan is a chain.  Every ``checkpoint_every`` steps the
    rows are stored and ended sequences leave the loop; until then they join under a key of their own.
    """
    table = draw_table(counts, t, k, p)
    idle = F.concat(F.lit("\0"), F.col("prompt_id").cast("string"))        # no token holds this key
    u = keyed_uniform(F.lit(str(seed)), F.col("_step").cast("string"), F.col("prompt_id").cast("string"))
    draw = Draw(table, F.when(~F.col("_done"), F.col("_last")), u, idle, ["prompt_id", "_nl", "gen", "_done", "_step"], "_tok")
    nl = F.col("_nl") + F.coalesce(count_char("_tok", "\n"), F.lit(0))
    stop = F.col("_tok").isNull() | (nl > newline_budget)
    if eos_token:
        stop = stop | F.coalesce(F.col("_tok") == eos_token, F.lit(False))
    # the expressions of a step are the same in every step: they are built once
    after = [F.col("prompt_id"), F.col("_tok").alias("_last"), nl.alias("_nl"),
             F.when(F.col("_done"), F.col("gen")).otherwise(F.concat("gen", F.array("_tok"))).alias("gen"),
             (F.col("_done") | stop).alias("_done"), (F.col("_step") + 1).alias("_step")]
    live = prompts.select("prompt_id", F.get("tokens", F.size("tokens") - 1).alias("_last"), F.lit(0).alias("_nl"),
                          F.array().cast("array<string>").alias("gen"), F.lit(False).alias("_done"), F.lit(0).alias("_step"))
    ended = []
    for step in range(steps):
        live = draw(live).select(after)
        if (step + 1) % checkpoint_every == 0 and step + 1 < steps:
            live = checkpointed(live)
            ended.append(live.filter("_done").select("prompt_id", "gen"))
            live = live.filter("not _done")
            if live.isEmpty():
                break
    return reduce(DataFrame.unionByName, [*ended, live.select("prompt_id", "gen")])


def rollout(prompts: DataFrame, counts: DataFrame, steps: int = config.SAMPLER_MAX_TOKENS, **kw) -> DataFrame:
    """Generated rows ``(prompt_id, pos, token)``; see ``generate``.  A null token is the place where a
    sequence met a context without any continuation."""
    gen = generate(prompts, counts, steps=steps, **kw)
    return gen.select("prompt_id", F.posexplode("gen").alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def generation_report(prompts: DataFrame, counts: DataFrame, steps: int = config.SAMPLER_MAX_TOKENS,
                      **kw) -> DataFrame:
    """Run a prompt table ``(prompt_id, prompt)`` and report ``(prompt_id, prompt, generated)``.

    ``generated`` is the decoded continuation only - the prompt is cut by character length as
    the trainer's sampler does (G9).
    """
    gen = generate(tokenize(prompts, "prompt").select("prompt_id", "tokens"), counts, steps=steps, **kw)
    full = prompts.join(gen, "prompt_id", "left").withColumn(
        "_full", F.concat(F.col("prompt"), F.coalesce(F.array_join("gen", ""), F.lit(""))))
    return strip_prompt(full, "_full", "prompt", "generated").select("prompt_id", "prompt", "generated")
