import os
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions.counted import write_counted
from colloquy.operators import convlog
from colloquy.sources import jsonl
from colloquy.streaming import chat_state, ingest

LOG = "conv_id bigint, turn bigint, raw string"
LINES = ['{"context":["a"],"response":"b"}', "nope", '{"context":["c"]}', '{"context":[],"response":"d"}', ""]


def test_write_counted(spark, scratch):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    path = os.path.join(scratch, "t")
    assert write_counted(df, lambda d: d.write.parquet(path), "k", ["a", "b", "c", None]) == {"a": 2, "b": 1, "c": 0, None: 1}
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError):
        write_counted(df, lambda d: d.write.parquet(path + "2"), "k", ["a"])


def test_landed_batch_replaces_itself(spark, scratch):
    lines = spark.createDataFrame([(v,) for v in LINES], "value string")
    for _ in range(2):                                   # the same batch id again, as after a failure between sink and checkpoint
        counts = ingest.land_batch(lines, 3, scratch)
    ingest.land_batch(lines.limit(1), 4, scratch)
    rows = ingest.ingested(spark, scratch)
    assert rows.count() == len(LINES) + 1 and {r.batch for r in rows.select("batch").collect()} == {3, 4}
    want = {r.reason: r.n for r in jsonl.reason_counts(jsonl.classify_lines(lines)).collect()}
    assert {k: n for k, n in counts.items() if n} == want
    assert {r.reason: r.n for r in ingest.ingested_counts(spark, scratch).filter("batch = 3").collect()} == want


def test_ingest_tables_restart(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    for part in range(2):
        with open(os.path.join(src, f"f{part}.jsonl"), "w") as f:
            f.write("\n".join(LINES[:4]) + "\n")
        assert ingest.start_ingest_tables(spark, src, out, ckpt, max_files_per_trigger=1).awaitTermination(240)
    assert ingest.ingested(spark, out).count() == 8
    total = {r.reason: r.n for r in ingest.ingested_counts(spark, out).groupBy("reason").agg(F.sum("n").alias("n")).collect()}
    assert total == {"ok": 4, "malformed": 2, "missing_key": 2}


def test_chat_sessions_restart_from_checkpoint(spark, scratch):
    """State survives the end of the query: settings, segment, history, quit and the last turn."""
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    raw = {0: ["hi", "/temp 0.3", "there"], 1: ["one", "/clear", "two"], 2: ["a", "/quit", "b"], 3: ["/tokens 9", " ", "/nope"]}
    more = {0: ["again", "/clear", "new"], 1: ["three", "four"], 2: ["c"], 3: ["x"]}
    last = {0: ["end"], 1: ["five"], 4: ["fresh"]}
    rows, at = [], {}
    for part in (raw, more, last):
        now = [(c, at.setdefault(c, 0) + i, r) for c, rs in part.items() for i, r in enumerate(rs)]
        for c, rs in part.items():
            at[c] += len(rs)
        extra = [(0, 0, "late")] if part is more else []
        spark.createDataFrame(now + extra, LOG).coalesce(1).write.mode("append").parquet(src)
        rows += now
        assert chat_state.start_sessions(spark, src, out, ckpt, state_partitions=3).awaitTermination(240)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    got = spark.read.schema(chat_state.OUTPUT_SCHEMA).parquet(out)
    assert [tuple(r) for r in got.filter("late").select("conv_id", "turn", "kind").collect()] == [(0, 0, None)]
    log = spark.createDataFrame(rows, LOG)
    cols = ["conv_id", "turn", "segment_id", "temperature", "max_tokens", "prompt"]
    want = convlog.build_prompts(convlog.process_log(log)).select(cols).collect()
    assert sorted(map(tuple, got.filter("kind = 'message'").select(cols).collect())) == sorted(map(tuple, want))
    assert got.filter("NOT late").count() == convlog.process_log(log).count()


class _State:
    """In-memory stand-in of a value, list or timer state that counts what is written."""

    def __init__(self):
        self.value, self.items, self.timers, self.written, self.reads = None, [], set(), 0, 0

    def exists(self):
        return self.value is not None or bool(self.items)

    def get(self):
        self.reads += 1
        return iter(list(self.items)) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.items = None, []

    def appendList(self, new):
        self.written += len(new)
        self.items += new


def test_chat_state_appends_and_expires():
    settings, lines, timers = _State(), _State(), set()
    handle = SimpleNamespace(getValueState=lambda *a: settings, getListState=lambda *a: lines, registerTimer=timers.add, deleteTimer=timers.discard)
    p = chat_state.ChatProcessor(1000)
    p.init(handle)
    for i in range(50):
        batch = pd.DataFrame({"turn": [i], "kind": ["message"], "clean": [f"m{i}"], "temp_value": [None], "tokens_value": [None]})
        out = pd.concat(p.handleInputRows((7,), iter([batch]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 10 * i)))
        assert out["prompt"].iloc[0] == "\n".join(f"User: m{k}" for k in range(i + 1)) + "\nAssistant:"
    assert lines.written == 50 and timers == {490 + 1000}          # one line a batch, never the history again
    command = pd.DataFrame({"turn": [50], "kind": ["temp"], "clean": ["/temp 1"], "temp_value": [1.0], "tokens_value": [None]})
    before = lines.reads
    list(p.handleInputRows((7,), iter([command]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 600)))
    assert lines.reads == before                                   # a command does not read the history
    list(p.handleExpiredTimer((7,), None, None))
    assert not settings.exists() and not lines.exists()


def test_chat_step_takes_no_frame_a_line():
    """Settings, segments, late rows and the end of a session from plain columns; a line costs microseconds, not a frame's milliseconds."""
    rows = [(1, "message", "a", None, None), (1, "message", "late", None, None), (2, "temp", "/temp 1", 1.0, None), (3, "message", None, None, None),
            (4, "message", "b", None, None), (5, "clear", "/clear", None, None), (6, "tokens", "/tokens 7", None, 7), (7, "message", "c", None, None),
            (9, "quit", "/quit", None, None), (10, "message", "d", None, None)]
    held = (0, False, 2, 0.5, 10)
    new, added, out = chat_state._advance(held, lambda: ["User: x"], *map(list, zip(*rows)))
    assert new == (10, True, 3, 1.0, 7) and added == ["User: c"]
    assert [r[0] for r in out] == [1, 1, 2, 3, 4, 5, 6, 7] and [r[0] for r in out if r[6]] == [1]
    assert [r[5] for r in out if r[5]] == ["User: x\nUser: a\nAssistant:", "User: x\nUser: a\nUser: b\nAssistant:", "User: c\nAssistant:"]
    assert out[4][2:5] == (2, 1.0, 10) and out[7][2:5] == (3, 1.0, 7)
