import pytest
from pyspark.sql import functions as F

from colloquy.operators import batching, tokens
from colloquy.plans import training
from tests.conftest import SF001


def _toks(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id bigint, tokens array<int>")


def test_shift_minlen_truncate(spark):
    df = _toks(spark, [[7, 8, 9], [7], list(range(10))])
    out = tokens.shift_pairs(tokens.drop_short(tokens.truncate(df, 4))).orderBy("id").collect()
    assert [(r.input_ids, r.labels) for r in out] == [([7, 8], [8, 9]), ([0, 1, 2], [1, 2, 3])]


def test_pretokens_lossless_on_data(spark):
    d = tokens.tokenize(spark.read.parquet(f"{SF001}/documents.parquet"), "text")
    assert d.filter(F.array_join("tokens", "") != F.col("text")).count() == 0


def test_vocab_special_rule_and_roundtrip(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b a c")], "id bigint, text string")
    t = tokens.tokenize(df, "text")
    v = tokens.build_vocab(t)
    got = {r.token: (r.token_id, r.freq) for r in v.collect()}
    assert got == {" a": (0, 2), " b": (1, 1), " c": (2, 1), "a": (3, 1), "b": (4, 1)}
    sp = tokens.special_ids(v).collect()[0]
    assert (sp.vocab_size, sp.eos_id, sp.pad_id) == (6, 5, 5)  # pad falls back to eos
    ids = tokens.encode(t, v, ["id"], "tokens", "ids").withColumn("ids", F.concat("ids", F.array(F.lit(5).cast("bigint"))))
    back = tokens.detokenize(ids, v, ["id"], "ids", "text", specials=tokens.special_ids(v))
    assert sorted((r.id, r.text) for r in back.collect()) == [(1, "a b a"), (2, "b a c")]


def test_lazy_fill_wraps(spark):
    # FIXTURES: values [1, -, -, 4, -] -> [1, 4, 4, 4, 1]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([True, False, False, True, False])],
                               "conv_id bigint, turn bigint, valid boolean")
    out = tokens.lazy_fill(df, "conv_id", "turn", "valid", ["turn"], parts=3).orderBy("turn").collect()
    assert [r.src_turn for r in out] == [0, 3, 3, 3, 0]


def test_lazy_fill_levels_against_loop(spark):
    """Many keys over many parts, some without a valid row: both levels of the carry are exercised."""
    import random
    rnd = random.Random(5)
    rows = [(k, t, rnd.random() < 0.15) for k in range(40) for t in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, valid boolean")
    got = {(r.conv_id, r.turn): (r.src_conv_id, r.src_turn) for r in
           tokens.lazy_fill(df, "conv_id", "turn", "valid", ["conv_id", "turn"], parts=9).collect()}
    order = sorted((k, t) for k, t, _ in rows)
    ok = {(k, t) for k, t, v in rows if v}
    for i, kt in enumerate(order):
        j = i
        while order[j % len(order)] not in ok:
            j += 1
        assert got[kt] == order[j % len(order)]


def test_lazy_fill_no_valid_row_fails(spark):
    df = spark.createDataFrame([(0, 0, False)], "conv_id bigint, turn bigint, valid boolean")
    with pytest.raises(Exception):
        tokens.lazy_fill(df, "conv_id", "turn", "valid", ["turn"]).collect()


def test_drop_last_and_padding_with_real_pad_id(spark):
    df = spark.createDataFrame([(i, [5] * (i + 1), [5] * (i + 1)) for i in range(5)], "id bigint, input_ids array<int>, labels array<int>")
    o = batching.epoch_order(df, ["id"], seed=1, epochs=1)
    b = batching.assign_batches(o, 2)
    assert b.select("batch_idx").distinct().count() == 2       # N=5, B=2 -> 2 batches
    p = batching.pad_batches(b, pad_id=5).collect()            # pad equals a real token id
    for r in p:
        assert len(r.input_ids) == r.padded_len
        assert r.labels[:r.attention_len] == [5] * r.attention_len
        assert r.labels[r.attention_len:] == [-100] * (r.padded_len - r.attention_len)


def test_epoch_order_is_permutation_without_single_partition(spark):
    ex = training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet"))
    o = batching.epoch_order(ex, ["conv_id", "turn"], epochs=2)
    n = ex.count()
    for e in (0, 1):
        assert sorted(r.pos for r in o.filter(F.col("epoch") == e).collect()) == list(range(n))
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_flagship_numbers_sf0001(spark):
    b = training.training_batches(training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet")))
    s = batching.batch_stats(b).filter("epoch = 0").collect()[0]
    # SURVEY 5.1 at sf0.001: 17 batches, 12,550 padded cells, 10,171 positions in 34 examples
    assert (s.n_batches, s.padded_cells) == (17, 12550)
    ex = training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet"))
    assert ex.count() == 34 and ex.agg(F.sum(F.size("input_ids"))).first()[0] == 10171


def test_head_bounded_examples_exact(spark):
    """Short limits so that most examples are cut: bounded history == full history after truncation."""
    from colloquy.operators import render
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    for L in (3, 6):
        full = tokens.truncate(tokens.tokenize(render.render_text(render.conversation_examples(conv)), "full_text"), L)
        a = sorted((r.conv_id, r.turn, tuple(r.tokens)) for r in full.select("conv_id", "turn", "tokens").collect())
        for hot in (None, 10**6):      # split path and single-window path
            head = tokens.truncate(tokens.tokenize(render.render_text(
                render.conversation_examples_head(conv, L, chunk_rows=2, hot_rows=hot)), "full_text"), L)
            b = sorted((r.conv_id, r.turn, tuple(r.tokens)) for r in head.select("conv_id", "turn", "tokens").collect())
            assert a == b and len(a) == 34


def test_detokenize_special_and_empty(spark):
    vocab = spark.createDataFrame([("a", 0, 2), ("b", 1, 1)], "token string, token_id bigint, freq bigint")
    ids = spark.createDataFrame([(1, [0, 2, 1]), (2, [2]), (3, [])], "id int, ids array<bigint>")
    sp = tokens.special_ids(vocab)                      # eos id = 2
    got = {r.id: r.text for r in tokens.detokenize(ids, vocab, ["id"], specials=sp).collect()}
    assert got == {1: "ab", 2: "", 3: ""}


def test_encode_keeps_empty_sequences(spark):
    vocab = spark.createDataFrame([("a", 0, 2), ("b", 1, 1)], "token string, token_id bigint, freq bigint")
    df = spark.createDataFrame([(1, ["b", "a"]), (2, [])], "id int, tokens array<string>")
    got = {r.id: r.ids for r in tokens.encode(df, vocab, ["id"]).collect()}
    assert got == {1: [1, 0], 2: []}
