import json
import os

from colloquy.operators import qa, tokens
from colloquy.sources import metrics, qa_files
from colloquy.plans import training
from tests.conftest import SF001


def test_metrics_reference_document(spark, scratch):
    doc = {"train_loss": [2.5, 2.1], "steps": [100, 200], "learning_rates": [3e-4, 2.9e-4], "memory_used": [0.0, 0.0]}
    p = os.path.join(scratch, "training_metrics.json")
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    rows = sorted((r.step, r.train_loss, r.lr, r.mem_gb) for r in metrics.read_metrics_json(spark, p).collect())
    assert rows == [(100, 2.5, 3e-4, 0.0), (200, 2.1, 2.9e-4, 0.0)]


def test_qa_source_reader_splits_in_order(spark, scratch):
    paths = []
    for i, q in enumerate(["first", "second"]):
        p = os.path.join(scratch, f"squad_{i}")
        spark.createDataFrame([(q, ([f"ans{i}"],), "passage ignored")],
                              "question string, answers struct<text: array<string>>, context string").write.parquet(p)
        paths.append(p)
    src = qa_files.read_source(spark, "squad", paths)
    assert "context" not in src.columns                      # the passage is never read
    out = qa.qa_first_answer(src.withColumnRenamed("row_ord", "row_key")).collect()
    assert sorted(r.response for r in out) == ["Assistant: ans0", "Assistant: ans1"]
    assert [r.split_ord for r in src.orderBy("split_ord").collect()] == [0, 1]


def test_materialize_token_table(spark, scratch):
    ex = training.training_examples(spark.read.parquet(f"{SF001}/conversations.parquet"))
    back = tokens.materialize(ex, os.path.join(scratch, "tokens"))
    assert back.count() == 34 and "FileScan parquet" in back._jdf.queryExecution().executedPlan().toString()
