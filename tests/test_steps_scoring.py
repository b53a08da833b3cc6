import math

from pyspark.sql import functions as F

from colloquy.operators import render
from colloquy.operators import scoring, steps


def _simulate(nb, acc, epochs):
    """Literal replay of the trainer's loop: which update consumes each batch."""
    step, pending, out = 0, [], {}
    for e in range(epochs):
        for i in range(nb):
            pending.append((e, i))
            if (i + 1) % acc == 0:
                step += 1
                for b in pending:
                    out[b] = step
                pending = []
    for b in pending:
        out[b] = None
    return out


def _batches(spark, nb, epochs):
    return spark.createDataFrame([(e, i) for e in range(epochs) for i in range(nb)] or [(0, 0)],
                                 "epoch int, batch_idx bigint").filter(F.lit(nb > 0))


def test_step_map_against_loop(spark):
    for nb, acc, E in [(5, 2, 2), (7, 3, 3), (4, 6, 2), (12, 4, 1), (1, 1, 2), (9, 2, 3)]:
        got = {(r.epoch, r.batch_idx): r.consumed_by_step for r in steps.step_map(_batches(spark, nb, E), acc, E).collect()}
        assert got == _simulate(nb, acc, E), (nb, acc, E)


def test_step_map_fixture(spark):
    got = {(r.epoch, r.batch_idx): r.consumed_by_step for r in steps.step_map(_batches(spark, 5, 2), 2, 2).collect()}
    assert got[(0, 4)] == 3 and got[(1, 4)] is None


def test_lr_small_run_constant(spark):
    df = spark.range(0, 9).withColumnRenamed("id", "step")
    assert {r.lr for r in df.select(steps.lr_at("step", 9).alias("lr")).collect()} == {3e-4}


def test_lr_closed_form(spark):
    total, w = 1000, 100
    got = {r.step: r.lr for r in spark.range(0, total).withColumnRenamed("id", "step")
           .select("step", steps.lr_at("step", total).alias("lr")).collect()}
    assert math.isclose(got[0], 3e-5) and math.isclose(got[50], 3e-4 * (0.1 + 0.9 * 0.5))
    assert math.isclose(got[w], 3e-4) and math.isclose(got[total - 1], 1e-5 + (3e-4 - 1e-5) * (1 + math.cos(math.pi * 899 / 900)) / 2)


def _scores(spark, rows):
    return spark.createDataFrame(rows, "ctx string, token string, logit double")


def test_topk_ties_survive(spark):
    s = _scores(spark, [("c", "a", 5.0), ("c", "b", 4.0), ("c", "d", 4.0), ("c", "e", 1.0)])
    out = scoring.top_k(s, 2)
    assert sorted(r.token for r in out.collect()) == ["a", "b", "d"]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_topp_boundary(spark):
    s = _scores(spark, [("c", "a", math.log(.5)), ("c", "b", math.log(.3)), ("c", "d", math.log(.2))])
    out = scoring.top_p(scoring.softmax(s), 0.5)
    got = {r.token: r.p for r in out.collect()}
    assert set(got) == {"a", "b"} and math.isclose(got["a"], .5 / .8)


def test_temperature_zero_unscaled(spark):
    s = _scores(spark, [("c", "a", 2.0)])
    assert scoring.temperature(s, 0).first().logit == 2.0 and scoring.temperature(s, 0.5).first().logit == 4.0


def test_sample_in_support_and_masses(spark):
    s = scoring.softmax(_scores(spark, [("c%d" % i, t, float(v)) for i in range(50) for t, v in [("a", 1), ("b", 2), ("d", 3)]]))
    assert all(abs(r.t - 1) < 1e-12 for r in s.groupBy("ctx").agg(F.sum("p").alias("t")).collect())
    picks = scoring.sample(s, seed=7, step=1).collect()
    assert len(picks) == 50 and {r.token for r in picks} <= {"a", "b", "d"}


def test_tail_context_short_and_long(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, list("abcdefg"))], "id int, tokens array<string>")
    got = {r.id: r.context for r in scoring.tail_context(df, 5).collect()}
    assert got == {1: ["a", "b", "c"], 2: list("cdefg")}


def test_stop_cut_rules(spark):
    df = spark.createDataFrame([(1, ["a", "\n", "b", "\n\n", "c", "\n", "d"]), (2, ["x", "<|endoftext|>", "y"]), (3, ["z"] * 250)],
                               "id int, gen_tokens array<string>")
    got = {r.id: (r.kept_text, r.stop_reason, r.n_kept) for r in scoring.stop_cut(df, ["id"]).collect()}
    assert got[1] == ("a\nb\n\nc\n", "newlines", 6)
    assert got[2] == ("x<|endoftext|>", "eos", 2)
    assert got[3][1:] == ("max_tokens", 200)


def test_strip_prompt_by_chars(spark):
    df = spark.createDataFrame([("héllo world", "héllo")], "full_text string, prompt string")
    assert scoring.strip_prompt(df).first().reply == " world"


def test_generation_report_on_test_prompts(spark):
    from colloquy import config
    from colloquy.operators.rollout import generation_report
    from colloquy.plans import training
    from tests.conftest import SF001
    counts = scoring.next_token_counts(training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet")))
    prompts = spark.createDataFrame(list(enumerate(config.TEST_PROMPTS)), "prompt_id long, prompt string")
    rep = {r.prompt_id: r for r in generation_report(prompts, counts, steps=5).collect()}
    assert set(rep) == {0, 1, 2}
    for r in rep.values():
        assert r.generated is not None and len(r.generated) > 0     # ':' is a known context


def test_properties_on_data(spark):
    """SURVEY 5 properties: size(input) = size(labels) = n-1; probabilities sum to 1 per context
    after top-p; top-p keeps a prefix of the top-k order."""
    from colloquy.plans import training
    from tests.conftest import SF001
    ex = training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet"))
    assert ex.filter((F.size("input_ids") != F.size("labels")) | (F.size("input_ids") != F.size("tokens") - 1)).count() == 0
    counts = scoring.next_token_counts(ex)
    p = scoring.decode_filters(counts)
    sums = p.groupBy("ctx").agg(F.sum("p").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-9 for r in sums)
    k = scoring.top_k(scoring.temperature(scoring.count_scores(counts)))
    assert p.join(k, ["ctx", "token"], "left_anti").count() == 0


def test_bounded_history_counts_lines_not_rows(spark):
    rows = [(1, t, "assistant" if t % 3 == 0 else "user", None if 5 < t < 40 else f"word{t}") for t in range(60)]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = {r.turn: (r.context, r.response) for r in render.conversation_examples(conv).collect()}
    cut = {r.turn: (r.context, r.response) for r in render.conversation_examples(conv, max_turns=7).collect()}
    assert cut == {t: (c[-7:], a) for t, (c, a) in whole.items()} and len(cut[39][0]) == 6
