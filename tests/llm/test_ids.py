"""Ids beyond 2^53 beside null ids stay exact; repeated rows do not meet in one task."""
from colloquy.llm import decontaminate, lm_scores, suffix_dedup
from pyspark.sql import functions as F

BIG = (1 << 60) + 1


def _docs(spark, word):
    return spark.createDataFrame([(BIG, word(40, 1)), (None, word(40, 2)), (BIG + 2, word(40, 1)), (None, None)], "doc_id bigint, text string").coalesce(1)


def test_exact_ids(spark, word):
    docs = _docs(spark, word)
    want = {BIG, BIG + 2, None}
    assert {r.doc_id for r in suffix_dedup.suffix_dedup(docs).collect()} == want
    assert {r.doc_id for r in lm_scores.lm_scores(docs).collect()} == want
    bench = spark.createDataFrame([(BIG + 4, word(40, 1)), (None, word(30, 9)), (BIG + 6, word(40, 2))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(BIG, BIG + 4), (BIG + 2, BIG + 4), (None, BIG + 6)}


def test_repeated_rows_send_their_pieces_once(spark, word, monkeypatch):
    text = word(60, 5) + " " + word(40, 6)
    rows = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    sent = []
    inner = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 0)                 # the pieces are stored on this way: count them
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, what: sent.append((what, inner(df, what))) or sent[-1][1])
    got = suffix_dedup.suffix_dedup(rows.union(spark.createDataFrame([(2, word(80, 7))], rows.schema)))
    assert got.filter("doc_id = 1 AND n_removed = n_bytes AND n_spans = 1").count() == 5000 and got.filter("n_removed = 0").count() == 1
    tables = dict(sent)
    assert tables["suffix-pieces"].count() == tables["suffix-distinct"].count() < 100
