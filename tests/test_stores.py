"""Token dictionaries by block, bucketed token store, histories by reference, segmented metrics documents."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from colloquy.operators import convlog, render, tokens
from colloquy.sources import metrics


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_block_dictionaries_equal_a_dict(spark, block):
    ids = {t: i for i, t in enumerate(["a", "b", " ", "é", "", *[f"w{i}" for i in range(300)]])}
    seqs = [(1, ["a", "b", "a"]), (1, ["b"]), (2, []), (3, None), (None, ["a", "zzz", None]), (4, ["", "é", " "]), (5, ["a"] * 5000),
            (6, [f"w{i % 300}" for i in range(2000)]), (7, ["a", "b"]), (7, ["a", "b"])]
    df = spark.createDataFrame(seqs, "token_id bigint, tokens array<string>")           # a key named like the vocabulary's
    df = df.withColumnRenamed("token_id", "k")
    vocab = spark.createDataFrame(list(ids.items()), "token string, token_id bigint")
    got = tokens.encode_blocks(df, vocab, ["k"], block_tokens=block)
    want = [(k, [ids.get(t) for t in s or []]) for k, s in seqs]
    assert _rows(got, "k", "ids") == sorted(want, key=str)
    back = tokens.detokenize_blocks(got, vocab, ["k"], special_tokens=("w7",), block_tokens=block)
    assert _rows(back, "k", "text") == sorted(((k, "".join(t for t in s or [] if t in ids and t != "w7")) for k, s in seqs), key=str)
    assert tokens.encode_blocks(df.limit(0), vocab, ["k"]).count() == 0
    assert _rows(tokens.encode_blocks(df, vocab.limit(0), ["k"], block_tokens=block), "k", "ids") == sorted(
        ((k, [None] * len(s or [])) for k, s in seqs), key=str)


def test_block_dictionaries_shuffle_distinct_tokens_only(spark):
    """The only generator over elements is the one over a block's distinct tokens."""
    df = spark.range(50).select("id", F.array_repeat(F.lit("a"), 100).alias("tokens"))
    vocab = spark.createDataFrame([("a", 0)], "token string, token_id bigint")
    got = tokens.encode_blocks(df, vocab, ["id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan
    assert got.select(F.explode("ids").alias("i")).agg(F.count("i"), F.max("i")).first() == (5000, 0)


def test_token_store_joins_in_place(spark, scratch):
    df = spark.range(1000).select((F.col("id") % 50).alias("c"), (F.col("id") / 50).cast("int").alias("t"), F.array(F.lit("x")).alias("tokens"))
    name = f"store_{uuid.uuid4().hex}"
    store = tokens.write_store(df, name, ["c", "t"], 4, os.path.join(scratch, "store"))
    try:
        joined = df.select("c", "t", F.lit(1).alias("one")).hint("merge").join(store, ["c", "t"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        other, stored = plan.split("Range (", 1)                            # the other side's leaf, then the store's branch
        assert other.count("Exchange") == 1 and "Exchange" not in stored and "Bucketed: true" in stored, plan
        assert joined.count() == 1000
        assert _rows(store, "c", "t") == _rows(df, "c", "t")
    finally:
        spark.sql(f"DROP TABLE {name}")


CONV = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (1, 4, "assistant", "again"),
        (2, 0, "assistant", "first"), (3, 0, "user", "alone"), (None, 0, "user", "n"), (None, 1, "assistant", "nn"), (4, 0, None, "x"),
        (4, 1, "assistant", ""), (5, 70000, "user", "late"), (5, 140000, "assistant", "later")]


def test_history_ranges_equal_examples(spark):
    conv = spark.createDataFrame(CONV, "conv_id bigint, turn bigint, role string, text string")
    lines = render.history_lines(conv)
    ranges = render.history_ranges(lines)
    got = render.render_ranges(ranges, lines)
    want = render.conversation_examples(conv)
    assert _rows(got, "conv_id", "turn", "context", "response") == _rows(want, "conv_id", "turn", "context", "response")
    for n in (0, 1, 2):
        cut = render.render_ranges(render.ranges_within(ranges, n), lines)
        full = render.conversation_examples(conv, max_turns=n) if n else want.withColumn("context", F.array().cast("array<string>"))
        assert _rows(cut, "conv_id", "turn", "context", "response") == _rows(full, "conv_id", "turn", "context", "response")
    assert render.render_ranges(ranges.limit(0), lines).count() == 0 and render.history_lines(conv.limit(0)).count() == 0


def test_history_of_a_long_conversation_is_linear(spark):
    n = 100_000
    conv = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("abc").alias("text"))
    lines = render.history_lines(conv, chunk_rows=4096)
    ranges = render.history_ranges(lines)
    assert lines.agg(F.count("*"), F.sum(F.length("line"))).first() == (n, n // 2 * (len("User: abc") + len("Assistant: abc")))
    assert ranges.agg(F.count("*"), F.max("last_line")).first() == (n // 2, n - 2)
    some = render.render_ranges(render.ranges_within(ranges.filter("turn in (99999, 501)"), 3), lines).collect()
    assert sorted((r.turn, len(r.context)) for r in some) == [(501, 3), (99999, 3)]


def test_prompt_ranges_equal_prompts(spark):
    log = spark.createDataFrame([(1, 0, "a"), (1, 1, "/temp 0.5"), (1, 2, "b"), (1, 3, "/clear"), (1, 4, "c"), (1, 5, ""), (1, 70000, "d"),
                                 (2, 0, "/clear"), (3, 1, "x"), (3, 2, "/quit"), (3, 3, "y"), (None, 0, "p"), (None, 1, "q"), (4, 0, None)],
                                "conv_id bigint, turn bigint, raw string")
    d = convlog.process_log(log)
    lines = convlog.segment_lines(d)
    got = convlog.render_prompts(lines.select("conv_id", "turn", "first_line", "line_no"), lines)
    assert _rows(got, "conv_id", "turn", "prompt") == _rows(convlog.build_prompts(d), "conv_id", "turn", "prompt")


def test_metrics_in_many_documents(spark, scratch):
    rows = spark.range(1, 26).select((F.col("id") * 5).alias("step"), F.when(F.col("id") != 3, F.col("id") / 7).alias("train_loss"),
                                     (1 / F.col("id")).alias("lr"), F.lit(0.0).alias("mem_gb"))
    path = os.path.join(scratch, "m")
    metrics.write_metrics_json(rows, path, steps_per_document=4)
    cols = ("step", "train_loss", "lr", "mem_gb")
    assert _rows(metrics.read_metrics_json(spark, path), *cols) == _rows(rows, *cols)
    assert _rows(metrics.read_metrics_documents(spark, path), *cols) == _rows(rows, *cols)
    index = sorted(tuple(r) for r in metrics.read_metrics_index(spark, path).collect())
    assert index == [(i, 20 * i + 5, min(20 * i + 20, 125), min(4, 25 - 4 * i)) for i in range(7)]
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".json") and "_index" not in d]
    assert len(files) == 7
    for f in files:
        with open(f) as h:
            steps = json.load(h)["steps"]
        assert len(steps) <= 4 and steps == sorted(steps)
    some = metrics.read_metrics_documents(spark, path, 40, 65)
    assert [r.step for r in some.orderBy("step").collect()] == [40, 45, 50, 55, 60, 65]
    assert {r.document for r in some.collect()} == {1, 2, 3}
    assert metrics.read_metrics_documents(spark, path, 1000).count() == 0


def test_encode_and_detokenize_make_one_sequence_of_a_key(spark):
    """Rows that share a key, null included, are one sequence by place, then value, as a join and a regroup would give."""
    ids = {"a": 2, "é": 0, "": 1, "b ": 3}
    vocab = spark.createDataFrame(list(ids.items()), "token string, token_id bigint")
    seqs = [(1, ["a", "b ", "é"]), (1, ["é"]), (1, []), (2, ["", None, "zzz"]), (2, ["a"]), (None, ["b "]), (None, ["a", "a"]), (3, None), (4, ["é", "é"])]
    df = spark.createDataFrame(seqs, "k int, tokens array<string>").repartition(3)

    def merged(rows, value, least):
        out = {}
        for k, s in rows:
            out.setdefault(k, []).extend((p, value(t)) for p, t in enumerate(s or []))
        return {k: [v for _, v in sorted(s, key=lambda e: (e[0], least if e[1] is None else e[1]))] for k, s in out.items()}

    for block in (1, 4, 1 << 20):
        got = tokens.encode(df, vocab, ["k"], block_tokens=block)
        assert got.dtypes == [("k", "int"), ("ids", "array<bigint>")]
        want = merged(seqs, ids.get, -1)
        assert {r.k: r.ids for r in got.collect()} == want and got.count() == len(want)
        twice = got.union(spark.createDataFrame([(4, [2, 9])], "k int, ids array<bigint>"))
        names = {i: t for t, i in ids.items()}
        text = {k: "".join(s) for k, s in merged([*want.items(), (4, [2, 9])], lambda i: names.get(i, ""), "").items()}
        assert {r.k: r.text for r in tokens.detokenize(twice, vocab, ["k"], block_tokens=block).collect()} == text


def test_no_element_of_a_sequence_crosses_an_exchange(spark, scratch):
    """Shuffled rows of the encoder: the sequences, and each distinct token a few times, not a row a token."""
    df = spark.range(200).select("id", F.array_repeat(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), 50).alias("tokens"))
    df = tokens.materialize(df, os.path.join(scratch, "sequences"))
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(3)], "token string, token_id bigint")
    for got in (tokens.encode(df, vocab, ["id"]), tokens.encode_blocks(df, vocab, ["id"])):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "map_from_entries" not in plan and plan.count("CoGroups") == 1
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 200
        assert got.select(F.explode("ids").alias("i")).agg(F.count("i")).first()[0] == 10000
