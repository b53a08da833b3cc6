"""Split paths equal plain paths on data with nulls and ties; masks, gaps and large decay rates."""
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions.ordering import range_positions, running_aggs
from colloquy.operators import batching, convlog, qa, render, rollout, scoring, sequence, tokens
from colloquy.sources import metrics


def _rows(df):
    return sorted(map(str, df.collect()))


def test_head_examples_both_paths_with_nulls_and_long_conversation(spark):
    rng = random.Random(1)
    rows = [(c, t, "assistant" if t % 2 else "user", None if rng.random() < .2 else f"w{t} x") for c in (1, 2) for t in range(1000 if c == 1 else 7)]
    rows += [(3, t, "user", None) for t in range(460)] + [(3, 460, "user", "hello"), (3, 461, "assistant", "there")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    a = render.conversation_examples_head(conv, 20)
    b = render.conversation_examples_head(conv, 20, chunk_rows=64, hot_rows=None)
    assert _rows(a) == _rows(b)
    last = [r for r in a.collect() if r.conv_id == 3]
    assert last[0].context == ["User: hello"] and last[0].response == "Assistant: there"


def test_running_aggs_null_key(spark):
    rows = [(None if i % 3 == 0 else i % 2, i, 1, None if i % 4 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, x int, v double")
    specs = [("s", "sum", "x"), ("m", "max", "v"), ("l", "last", "v")]
    assert _rows(running_aggs(df, "k", "t", specs, split=False)) == _rows(running_aggs(df, "k", "t", specs, chunk_rows=8, split=True))


def test_fir_both_paths_with_nulls(spark):
    rows = [(None if i % 5 == 0 else i % 2, None if i == 7 else 1_700_000_000 + 900 * i, i, None if i % 6 == 1 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id bigint, s bigint, event_id bigint, value double").withColumn("ts", F.timestamp_seconds("s"))
    a = sequence.causal_fir(df, [0.5, 0.25, 2.0])
    b = sequence.causal_fir(df, [0.5, 0.25, 2.0], hot_rows=None).select(*a.columns)
    assert a.count() == 40 and _rows(a) == _rows(b)


def test_decay_rates(spark):
    df = spark.createDataFrame([(1, 37 * i, i, float(i)) for i in range(200)], "user_id bigint, s bigint, event_id bigint, value double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    for lam in (0.0, 0.001, 0.01, 1.0):
        got = [r.state for r in sequence.decayed_state(df, lam).orderBy("event_id").collect()]
        h = 0.0
        for i, x in enumerate(got):
            h = math.exp(-lam * 37) * h + i
            assert abs(x - h) <= 1e-9 * max(1, abs(h))


def test_embed_lookup_gapped_ids(spark):
    emb = spark.createDataFrame([(10, [1.0, 2.0]), (20, [3.0, 5.0])], "vec_id bigint, embedding array<double>")
    pos = spark.createDataFrame([(0, 0), (1, 1), (3, 2)], "token_id bigint, pos bigint")
    assert sorted((r.token_id, r.vector) for r in sequence.embed_lookup(pos, emb).collect()) == [
        (0, [2.0, 4.0]), (1, [6.0, 10.0]), (3, [4.0, 7.0])]


def test_loss_ignores_padding(spark):
    counts = spark.createDataFrame([(1, 2, 1), (1, 3, 3)], "ctx bigint, token bigint, n bigint")
    plain = spark.createDataFrame([(0, 0, [1, 1], [2, 3])], "epoch int, batch_idx bigint, input_ids array<bigint>, labels array<bigint>")
    padded = spark.createDataFrame([(0, 0, [1, 1, 9, 9], [2, 3, -100, -100])], plain.schema)
    assert scoring.batch_loss(plain, counts).collect() == scoring.batch_loss(padded, counts).collect()
    assert scoring.batch_loss(padded, counts).first().n_positions == 2


def test_special_ids(spark):
    v = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id bigint")
    got = {(p, e): tuple(tokens.special_ids(v, has_pad=p, has_eos=e).first()) for p in (False, True) for e in (False, True)}
    assert got == {(False, True): (3, 2, 2), (False, False): (3, None, 2), (True, True): (4, 2, 3), (True, False): (3, None, 2)}


def test_large_and_foreign_numbers(spark):
    lines = ["/tokens 99999999999999999999", "/tokens 12", "/temp ٣", "/temp 0.5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "conv_id bigint, turn bigint, raw string")
    got = {r.turn: (r.kind, r.temp_value, r.tokens_value) for r in convlog.classify_inputs(convlog.clean_inputs(df)).collect()}
    assert got == {0: ("tokens_bad", None, None), 1: ("tokens", None, 12), 2: ("temp_bad", None, None), 3: ("temp", 0.5, None)}


def test_range_positions_with_crowded_values(spark):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else rng.choice([1, 1, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "f bigint, i bigint")
    got = [(r.pos, r.i) for r in range_positions(df, [F.desc("f"), F.asc("i")], parts=7).orderBy("pos").collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == [(p, r[1]) for p, r in enumerate(want)]
    assert range_positions(df.limit(0), ["i"]).count() == 0


def test_no_single_partition_exchange(spark):
    t = spark.createDataFrame([(i, [f"w{i % 9}", f" v{i}"]) for i in range(90)], "id bigint, tokens array<string>")
    valid = spark.createDataFrame([(i, 0, i % 3 == 0) for i in range(30)], "conv_id bigint, turn bigint, valid boolean")
    emb = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    pos = spark.createDataFrame([(1, 1)], "token_id bigint, pos bigint")
    for df in (tokens.build_vocab(t), tokens.lazy_fill(valid, "conv_id", "turn", "valid", ["turn"]), sequence.embed_lookup(pos, emb)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_generate_stops_and_marks_unseen_contexts(spark):
    counts = spark.createDataFrame([("a", "b", 1), ("b", "<|endoftext|>", 1), ("n", "\n", 1), ("\n", "n", 1), ("x", "y", 1)],
                                   "ctx string, token string, n bigint")
    prompts = spark.createDataFrame([(1, ["a"]), (2, ["n"]), (3, ["x"]), (4, []), (5, ["?"])], "prompt_id bigint, tokens array<string>")
    for every in (2, 3, 50):
        got = {r.prompt_id: r.gen for r in rollout.generate(prompts, counts, steps=20, checkpoint_every=every).collect()}
        assert got == {1: ["b", "<|endoftext|>"], 2: ["\n", "n"] * 3 + ["\n"], 3: ["y", None], 4: [None], 5: [None]}
    rep = rollout.generation_report(spark.createDataFrame([(3, "x"), (5, "?")], "prompt_id bigint, prompt string"), counts, steps=4)
    assert sorted(tuple(r) for r in rep.collect()) == [(3, "x", "y"), (5, "?", "")]


def test_export_keeps_batches_together(spark):
    rows = [(e, b, s, 2, 2, [1, 2], [1, 2]) for e in range(2) for b in range(9) for s in range(2)]
    p = spark.createDataFrame(rows, "epoch bigint, batch_idx bigint, slot bigint, attention_len bigint, padded_len bigint, input_ids array<int>, labels array<int>")

    def consume(batches):
        for x in batches:
            keys = list(zip(x.column("epoch").to_pylist(), x.column("batch_idx").to_pylist(), x.column("slot").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([keys == sorted(keys)]), pa.array([len(keys)])], names=["sorted", "n"])

    got = batching.export_batches(p, consume, "sorted boolean, n bigint").collect()
    assert all(r.sorted for r in got) and sum(r.n for r in got) == 36


def test_metrics_document_round_trip(spark, scratch):
    rows = spark.createDataFrame([(10, .5, .1, 0.0), (5, .7, .2, 0.0)], "step bigint, train_loss double, lr double, mem_gb double")
    metrics.write_metrics_json(rows, scratch)
    assert _rows(metrics.read_metrics_json(spark, scratch)) == _rows(rows)
    metrics.write_metrics_json(rows.limit(0), scratch)
    assert metrics.read_metrics_json(spark, scratch).count() == 0


def test_reject_counts(spark):
    u = spark.createDataFrame([("s", ["q"], "a"), ("s", [None], "a"), ("t", ["q"], None)], "source string, context array<string>, response string")
    assert sorted(tuple(r) for r in qa.reject_counts(u).collect()) == [("s", 2, 1), ("t", 1, 1)]


def test_embed_lookup_exchanges_no_vector(spark, monkeypatch):
    """Ids meet a large table by one exchange; the vectors of the places in use are broadcast."""
    emb = spark.createDataFrame([(10 * i, [float(i)] * 8) for i in range(200)], "vec_id bigint, embedding array<float>")
    pos = spark.createDataFrame([(i % 230, i % 3) for i in range(500)] + [(None, 0)], "token_id bigint, pos int")
    want = sorted((r.token_id, r.pos, r.vector[7]) for r in sequence.embed_lookup(pos, emb).collect())
    small_side = sequence.small_side
    monkeypatch.setattr(sequence, "small_side", lambda df, col: small_side(df, col, 1000))
    got = sequence.embed_lookup(pos, emb, max_len=3)
    assert sorted((r.token_id, r.pos, r.vector[7]) for r in got.collect()) == want and len(want) == 500
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and ("_tv#" in x or "_pv#" in x)]
    assert {"_pv#" in x: "strategy=broadcast" in x for x in joins} == {True: True, False: False} and len(joins) == 2


def test_example_loss_is_taken_once_for_all_epochs(spark):
    """Sums of rows give the loss of a batch; repeated and null keys stay rows, and no epoch carries tokens."""
    schema = "epoch int, batch_idx int, conv_id bigint, turn bigint, input_ids array<int>, labels array<int>"
    rows = [(e, i // 2, None if i == 3 else i // 2, 0, [1, 2, 1], [2, 1, -100 if i == 1 else 3]) for e in range(2) for i in range(4)]
    rows += [(0, 2, 9, 9, [1], [-100])]
    batches = spark.createDataFrame(rows, schema)
    counts = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (2, 1, 5)], "ctx int, token int, n bigint")
    each = scoring.example_loss(batches, counts, ["epoch", "batch_idx", "conv_id"])
    assert each.columns == ["epoch", "batch_idx", "conv_id", "loss_sum", "n_positions"] and each.count() == 9
    def rounded(df):
        return sorted((r.epoch, r.batch_idx, round(r.loss, 12), round(r.scaled_loss, 12), r.n_positions) for r in df.collect())
    assert rounded(scoring.batch_loss(each)) == rounded(scoring.batch_loss(batches, counts)) and len(rounded(scoring.batch_loss(each))) == 4
