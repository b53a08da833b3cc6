import pytest
from pyspark.sql import functions as F

from colloquy.operators import qa

AMBIG = ("row_key bigint, question string, annotations struct<qaPairs: array<struct<answer: array<array<string>>>>, "
         "answer: array<array<string>>>")


def test_ambig_nested_answers(spark):
    df = spark.createDataFrame([(1, "q", ([([["x", "y"], [], [""]],)], [["d"], []])), (2, "r", (None, None))], AMBIG)
    rows = [(r.branch, r.pos1, r.pos2, r.context[0], r.response) for r in qa.qa_ambig(df).orderBy("row_key", "branch", "pos1", "pos2").collect()]
    assert rows == [(0, 0, 0, "User: q", "Assistant: x"), (0, 0, 2, "User: q", "Assistant: "),
                    (1, 0, 0, "User: q", "Assistant: d")]


def test_truthful_best_in_correct(spark):
    df = spark.createDataFrame([(1, "q", "a", ["a", "b", "b"])], "row_key bigint, question string, best_answer string, correct_answers array<string>")
    got = [r.response for r in qa.qa_truthful(df).orderBy("branch", "pos1").collect()]
    assert got == ["Assistant: a", "Assistant: b", "Assistant: b"]


def test_instruct_context_rules(spark):
    df = spark.createDataFrame([(1, "i", None, "r"), (2, "i", "", "r"), (3, "i", " ", "r")],
                               "row_key bigint, instruction string, context string, response string")
    got = [r.context[0] for r in qa.qa_instruct(df).orderBy("row_key").collect()]
    assert got == ["User: i", "User: i", "User: i\n\nContext:  "]


def test_first_answer_empty_list(spark):
    df = spark.createDataFrame([(1, "q", (["a", "b"],)), (2, "r", ([],))], "row_key bigint, question string, answers struct<text: array<string>>")
    assert [r.response for r in qa.qa_first_answer(df, on_empty="drop").collect()] == ["Assistant: a"]
    with pytest.raises(Exception):
        qa.qa_first_answer(df).collect()


def test_wiki_filter_pushed_and_union_counts(spark, tmp_path):
    p = str(tmp_path / "wiki")
    spark.createDataFrame([("q1", "a1", 1), ("q2", "a2", 0), ("q3", "a3", 1)], "question string, answer string, label int") \
        .withColumn("row_key", F.monotonically_increasing_id()).write.parquet(p)
    w = qa.qa_wiki(spark.read.parquet(p))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,1)]" in w._jdf.queryExecution().executedPlan().toString()
    u = qa.union_sources({"wiki": w, "instruct": qa.qa_instruct(spark.createDataFrame(
        [(9, "i", None, "r")], "row_key bigint, instruction string, context string, response string"))})
    got = [(r.source, r.n, r.running) for r in qa.source_counts(u).orderBy("source_ord").collect()]
    assert got == [("wiki", 2, 2), ("instruct", 1, 3)]


def test_ambig_scalar_answers(spark):
    """P3/P4 with scalar answers: the value is the answer; "" and null are falsy."""
    schema = ("row_key bigint, question string, annotations struct<qaPairs: array<struct<answer: array<string>>>, "
              "answer: array<string>>")
    df = spark.createDataFrame([(1, "q", ([(["x", "", None],)], ["d", ""]))], schema)
    got = sorted((r.branch, r.pos1, r.pos2, r.response) for r in qa.qa_ambig(df).collect())
    assert got == [(0, 0, 0, "Assistant: x"), (1, 0, 0, "Assistant: d")]
