import math

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import keyed_uniform
from colloquy.operators import nucleus, rollout, scoring

COUNTS = "ctx string, token string, n bigint"


def _counts():
    rows = [("hot", f"t{i:06d}", 2 if i % 3 else 1) for i in range(3000)] + [("hot", "big", 900), ("hot", "mid", 40)]
    rows += [("a", t, n) for t, n in (("x", 5), ("y", 5), ("z", 1), ("w", 1), ("v", 1))] + [("one", "only", 3)]
    return rows + [(f"c{i}", f"t{j:06d}", 1 + (i * j) % 7) for i in range(6) for j in range(40)]


@pytest.mark.parametrize("k, p", [(0, 0.9), (3, 0.9), (50, 0.5), (0, 1.0), (5, 1.0), (1, 0.0)])
def test_nucleus_equals_row_windows(spark, k, p):
    counts = spark.createDataFrame(_counts(), COUNTS)
    want = {(r.ctx, r.token): r.p for r in scoring.decode_filters(counts, 0.8, k, p).collect()}
    got = nucleus.nucleus(scoring.count_scores(counts), 0.8, k, p)
    assert got.columns == [*counts.columns, "logit", "p"]
    got = {(r.ctx, r.token): r.p for r in got.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_draws_from_a_hot_context_are_bounded_blocks(spark):
    """100,000 tokens tied in one context: no array holds more than a block, and each draw is the row form's token."""
    n = 100_000
    counts = spark.range(n).select(F.lit("hot").alias("ctx"), F.format_string("t%06d", "id").alias("token"), F.lit(1).cast("bigint").alias("n"))
    counts = counts.union(spark.createDataFrame(_counts()[3000:], COUNTS))
    table = nucleus.draw_table(counts, 0.8, 50, 1.0, inline=64, block=512)
    assert table.blocks.agg(F.max(F.size("_b_tokens"))).first()[0] == 512
    assert table.contexts.agg(F.max(F.aggregate("_levels", F.lit(0), lambda a, x: a + F.coalesce(F.size(x["tokens"]), F.lit(0))))).first()[0] <= 50 * 64
    draws = spark.range(400).withColumn("u", keyed_uniform(F.lit("1"), F.lit("2"), F.col("id").cast("string")))
    got = nucleus.draw(draws, table, F.lit("hot"), F.col("u"), F.concat(F.lit("\0"), F.col("id").cast("string"))).collect()
    tied = [f"t{i:06d}" for i in range(n)]
    w = [900 ** 1.25, 40 ** 1.25]
    z, wrong = sum(w) + n, 0
    for r in got:
        at = r.u * z
        want = "big" if at < w[0] else "mid" if at < sum(w) else tied[min(n - 1, int(at - sum(w)))]
        wrong += r.token != want
    assert len(got) == 400 and wrong <= 1                    # one draw may lie on a rounding edge
    assert len({r.token for r in got}) > 300


def test_draw_unknown_context_and_ends(spark):
    counts = spark.createDataFrame(_counts(), COUNTS)
    table = nucleus.draw_table(counts, 0.8, 50, 0.9)
    rows = spark.createDataFrame([(0, "nowhere", 0.5), (1, None, 0.5), (2, "one", 0.0), (3, "one", 0.999999999), (4, "a", 0.0), (5, "a", 0.999999999)],
                                 "id bigint, c string, u double")
    got = {r.id: r.token for r in nucleus.draw(rows, table, F.col("c"), F.col("u"), F.concat(F.lit("\0"), F.col("id").cast("string"))).collect()}
    last = max(r.token for r in scoring.decode_filters(counts, 0.8, 50, 0.9).filter("ctx = 'a' AND n = 1").collect())
    assert got == {0: None, 1: None, 2: "only", 3: "only", 4: "x", 5: last}


def test_rollout_over_blocks_follows_the_row_form(spark):
    """Prompts that end in the hot context draw from blocks; the replay uses the row-by-row CDF."""
    counts = spark.createDataFrame(_counts() + [(f"t{i:06d}", "hot", 1) for i in range(3000)] + [("big", "hot", 1), ("mid", "hot", 1)], COUNTS)
    prompts = spark.createDataFrame([(i, ["hot"]) for i in range(20)], "prompt_id bigint, tokens array<string>")
    got = {r.prompt_id: r.gen for r in rollout.generate(prompts, counts, steps=4, t=0.8, k=0, p=0.9).collect()}
    cdf = {}
    for r in scoring.decode_filters(counts, 0.8, 0, 0.9).orderBy("ctx", F.desc("logit"), "token").collect():
        cdf.setdefault(r.ctx, []).append((r.token, r.p))
    us = {(r.id, r.step): r.u for r in spark.range(20).crossJoin(spark.range(4).withColumnRenamed("id", "step")).select(
        "id", "step", keyed_uniform(F.lit("42"), F.col("step").cast("string"), F.col("id").cast("string")).alias("u")).collect()}
    for i in range(20):
        last, want = "hot", []
        for step in range(4):
            at = 0.0
            for token, p in cdf[last]:
                at += p
                if at > us[i, step]:
                    break
            want.append(token)
            last = token
        assert got[i] == want
