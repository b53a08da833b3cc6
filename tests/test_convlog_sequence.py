import math
import os

from pyspark.sql import functions as F

from colloquy.operators import convlog, sequence
from colloquy.plans import standins
from colloquy.streaming.chat_state import chat_sessions
from tests.conftest import SF001


def test_commands(spark):
    log = spark.createDataFrame([(0, i, r) for i, r in enumerate(
        ["/TEMP 0.5", "/temp", "/temp abc", "/clear", "hi", "/tokens 1_0", "/tokens 5.0", "/foo", "/quit now", "late"])],
        "conv_id bigint, turn bigint, raw string")
    out = convlog.process_log(log).orderBy("turn").collect()
    assert [r.kind for r in out] == ["temp", "unknown", "temp_bad", "clear", "message", "tokens", "tokens_bad", "unknown"]
    assert out[0].temperature == 0.5 and out[5].max_tokens == 10 and out[4].segment_id == 1


def test_python_whitespace_strip(spark):
    df = spark.createDataFrame([("　\x1c a b\xa0 ",)], "raw string")
    assert convlog.clean_inputs(df).first().clean == "　\x1c a b\xa0 ".strip()


def test_reply_cut(spark):
    df = spark.createDataFrame([("p Assistant: x Assistant: y User: z", "p")], "generated string, prompt string")
    assert convlog.extract_reply(df).first().reply == "y"


def test_chat_state_stream_equals_batch(spark, scratch):
    log = standins.chat_input_log(spark.read.parquet(f"{SF001}/events.parquet"))
    src = os.path.join(scratch, "log")
    for k, (lo, hi) in enumerate([(0, 3), (3, 7), (7, 10_000)]):
        log.filter((F.col("turn") >= lo) & (F.col("turn") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("conv_id bigint, turn bigint, raw string").option("maxFilesPerTrigger", 1).parquet(src)
    q = (chat_sessions(stream, idle_timeout_ms=None).writeStream.format("memory").queryName("chat_state_test").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    got = spark.table("chat_state_test").filter("NOT late")
    batch = convlog.build_prompts(convlog.process_log(log))
    cols = ["conv_id", "turn", "segment_id", "temperature", "max_tokens", "prompt"]
    assert sorted(map(tuple, got.filter("kind = 'message'").select(cols).collect())) == \
        sorted(map(tuple, batch.select(cols).collect()))
    assert got.count() == convlog.process_log(log).count()


def _decay_loop(rows, lam):
    out, h, last = {}, None, None
    for t, eid, x in sorted(rows):
        h = x if h is None else math.exp(-lam * (t - last)) * h + x
        last = t
        out[eid] = h
    return out


def test_decayed_state_matches_loop_across_chunks(spark):
    rows = [(i * 1000.0 + (i % 3), i, float(i % 7) + 0.5) for i in range(300)]
    df = spark.createDataFrame([(1, eid, t, x) for t, eid, x in rows], "user_id bigint, event_id bigint, t double, value double") \
        .withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.state for r in sequence.decayed_state(df, 1 / 3600, chunk_seconds=7200).collect()}
    want = _decay_loop(rows, 1 / 3600)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_causal_fir_zero_padding(spark):
    df = spark.createDataFrame([(1, i, i, float(i + 1)) for i in range(5)], "user_id bigint, event_id bigint, ts bigint, value double")
    got = [r.y for r in sequence.causal_fir(df, [0.1, 0.2, 0.3, 0.4], 0.5).orderBy("event_id").collect()]
    x = [1, 2, 3, 4, 5]
    want = [0.5 + sum(w * (x[t - 3 + j] if t - 3 + j >= 0 else 0) for j, w in enumerate([0.1, 0.2, 0.3, 0.4])) for t in range(5)]
    assert all(math.isclose(a, b) for a, b in zip(got, want))


def test_standardize(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<float>")
    z = sequence.standardize(df).first().z
    sd = math.sqrt(2 / 3 + 1e-5)
    assert all(math.isclose(a, b) for a, b in zip(z, [-1 / sd, 0, 1 / sd]))


def test_chunked_running_state_equals_window(spark):
    """Hot-conversation path (chunks of 3 rows) gives the single-window result."""
    from colloquy.functions import ordering
    log = standins.chat_input_log(spark.read.parquet(f"{SF001}/events.parquet"))
    plain = convlog.process_log(log).select("conv_id", "turn", "kind", "segment_id", "temperature", "max_tokens")
    d = convlog.classify_inputs(convlog.clean_inputs(log)).withColumn("_isq", F.when(F.col("kind") == "quit", 1).otherwise(0))
    d = ordering.running_aggs(d, "conv_id", "turn", [("_q", "max", "_isq")], chunk_rows=3, hot_rows=None)
    d = d.filter("_q = 0").withColumn("_isc", F.when(F.col("kind") == "clear", 1).otherwise(0))
    d = ordering.running_aggs(d, "conv_id", "turn", [("segment_id", "sum", "_isc"), ("_t", "last", "temp_value"),
                                                     ("_m", "last", "tokens_value")], chunk_rows=3, hot_rows=None)
    d = d.select("conv_id", "turn", "kind", F.col("segment_id").cast("bigint").alias("segment_id"),
                 F.coalesce("_t", F.lit(0.8)).alias("temperature"), F.coalesce("_m", F.lit(200).cast("bigint")).alias("max_tokens"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, d.collect()))


def test_causal_fir_hot_path_equals_window(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "user_id", "ts", "value")
    a = {r.event_id: r.y for r in sequence.causal_fir(ev, [0.1, 0.2, 0.3, 0.4], 0.5).collect()}
    b = {r.event_id: r.y for r in sequence.causal_fir(ev, [0.1, 0.2, 0.3, 0.4], 0.5, hot_rows=None).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_chat_state_late_rows(spark, scratch):
    """A repeated turn is emitted with late = true and changes nothing (R2, streamed)."""
    src = os.path.join(scratch, "late")
    spark.createDataFrame([(0, 0, "hi"), (0, 0, "again"), (0, 1, "/temp 0.3"), (0, 2, "there")],
                          "conv_id bigint, turn bigint, raw string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("conv_id bigint, turn bigint, raw string").parquet(src)
    q = (chat_sessions(stream, idle_timeout_ms=None).writeStream.format("memory").queryName("chat_late_test")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ckpt"))
         .trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    out = sorted((r.turn, r.late, r.kind, r.temperature, r.prompt) for r in spark.table("chat_late_test").collect())
    assert out == [(0, False, "message", 0.8, "User: hi\nAssistant:"), (0, True, None, None, None),
                   (1, False, "temp", 0.3, None), (2, False, "message", 0.3, "User: hi\nUser: there\nAssistant:")]
