import json
import os

from pyspark.sql import functions as F

from colloquy.sources import jsonl
from colloquy.streaming.ingest import start_ingest

# FIXTURES 3.1: line -> outcome
CASES = [
    ('{"context":["a"],"response":"b"}', "ok"),
    ('{"context":[],"response":"x"}', "ok"),
    ('{"context":["a"],"response":"b","context":["z"]}', "ok"),
    ("bad", "malformed"),
    ("", "malformed"),
    ("{'context':['a'],'response':'b'}", "malformed"),
    ('{"context":["a"]}', "missing_key"),
    ('["context","response"]', "not_object"),
    ('{"context":null,"response":"x"}', "bad_context"),
    ('{"context":["a",null],"response":"x"}', "bad_context"),
    ('{"context":["a",1],"response":"x"}', "bad_context"),
    ('{"context":"ab","response":"x"}', "bad_context"),
    ('{"context":["a"],"response":1}', "bad_response"),
    ('{"context":["a"],"response":null}', "bad_response"),
    ('{"context":["a"],"response":"b","x":NaN}', "non_finite"),
    ('{"context":["a"],"response":-Infinity}', "non_finite"),
    ('{"context":["NaN"],"response":"b"', "malformed"),
    ('﻿{"context":["a"],"response":"b"}', "malformed"),
]


def test_gate_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, value string")
    got = {r["i"]: r["reason"] for r in jsonl.classify_lines(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [r for _, r in CASES]


def test_valid_rows_parsed(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES[:3]], "value string")
    valid, rejects = jsonl.validate_jsonl(df)
    rows = sorted((tuple(r["context"]), r["response"]) for r in valid.collect())
    assert rows == sorted([(("a",), "b"), ((), "x"), (("z",), "b")])
    assert rejects.count() == 0


def test_read_lines_line_endings(spark, scratch):
    p = os.path.join(scratch, "a.jsonl")
    with open(p, "w", newline="") as f:
        f.write('{"context":["a"],"response":"b"}\r\n{"context":[],"response":"c"}\r{"context":["d"]}\n')
    c = jsonl.classify_lines(jsonl.read_lines(spark, p))
    counts = {r["reason"]: r["n"] for r in jsonl.reason_counts(c).collect()}
    assert counts == {"ok": 2, "missing_key": 1}


def test_corpus_sink_roundtrip(spark, scratch):
    df = spark.createDataFrame([(["User: q"], "Assistant: é", "src")], "context array<string>, response string, source string")
    out = os.path.join(scratch, "corpus")
    jsonl.write_corpus_jsonl(df, out)
    lines = [ln for fn in sorted(os.listdir(out)) if fn.endswith(".json") for ln in open(os.path.join(out, fn))]
    assert [json.loads(ln) for ln in lines] == [{"context": ["User: q"], "response": "Assistant: é"}]


def test_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    for k in range(3):
        with open(os.path.join(src, f"part{k}.jsonl"), "w") as f:
            for v, _ in CASES[k::3]:
                f.write(v.replace("\n", " ") + "\n")
    q = start_ingest(spark, src, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(scratch, "out"))
    batch = jsonl.classify_lines(jsonl.read_lines(spark, src))
    key = ["reason", "value"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    assert streamed.filter(F.col("reason") == "ok").count() == 3
