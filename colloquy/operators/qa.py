"""Flatten the five QA source shapes into ``(context, response)`` rows.

Every output row is ``context = ["User: <question>"]``, ``response = "Assistant: <answer>"``
(the role prefixes are added here, once).  Lineage columns ``(source, source_ord, row_key,
branch, pos1, pos2)`` keep the reference's write order without any global sort.
Null questions/answers are not rendered as the text "None": a null makes the row null,
and ``drop_null`` (default) removes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.counted import write_counted

OUT = ["row_key", "branch", "pos1", "pos2", "context", "response"]
SOURCE_ORDER = ("ambig", "wiki", "truthful", "squad", "instruct")


def _user(q: Column) -> Column:
    return F.array(F.concat(F.lit(config.USER_PREFIX), q))


def _assistant(a: Column) -> Column:
    return F.concat(F.lit(config.ASSISTANT_PREFIX), a)


def first_of(c: Column) -> Column:
    """First element of a list."""
    return F.get(c, 0)


def _answers(df: DataFrame, col: str = "alist"):
    """P3 + P4 for one exploded answer entry, decided by its type at plan time: a list is
    kept when non-empty (``[""]`` is kept) and answers with its first element; a scalar is its
    own answer and is kept when truthy (null and ``""`` dropped)."""
    from pyspark.sql.types import ArrayType
    c = F.col(col)
    if isinstance(df.schema[col].dataType, ArrayType):
        return df.filter(c.isNotNull() & (F.size(c) > 0)), first_of(c)
    return df.filter(c.isNotNull() & (c.cast("string") != "")), c


def _emit(df: DataFrame, key, branch: int, pos1, pos2, question, answer) -> DataFrame:
    return df.select(F.col(key).alias("row_key") if isinstance(key, str) else key.alias("row_key"),
                     F.lit(branch).cast("bigint").alias("branch"),
                     pos1.cast("bigint").alias("pos1"), pos2.cast("bigint").alias("pos2"),
                     _user(question).alias("context"), _assistant(answer).alias("response"))


def _finish(df: DataFrame, drop_null: bool) -> DataFrame:
    return df.filter(F.col("response").isNotNull() & F.col("context")[0].isNotNull()) if drop_null else df


def qa_ambig(df: DataFrame, key: str = "row_key", drop_null: bool = True) -> DataFrame:
    """P1+P2 (+P3-P5): one row per non-empty answer list of every qaPair (branch 0), then one
    per non-empty direct answer list (branch 1); the answer is the list's first element and the
    question is always the outer one.  ``[""]`` is kept (it is a non-empty list)."""
    qa_t = df.schema["annotations"].dataType["qaPairs"].dataType
    ans_t = qa_t.elementType["answer"].dataType
    direct_t = df.schema["annotations"].dataType["answer"].dataType
    pairs = (df.select(key, "question",
                       F.posexplode(F.coalesce(F.col("annotations.qaPairs"), F.array().cast(qa_t))).alias("pos1", "pair"))
               .select(key, "question", "pos1",
                       F.posexplode(F.coalesce(F.col("pair.answer"), F.array().cast(ans_t))).alias("pos2", "alist")))
    pairs, pair_answer = _answers(pairs)
    direct = df.select(key, "question",
                       F.posexplode(F.coalesce(F.col("annotations.answer"), F.array().cast(direct_t))).alias("pos1", "alist"))
    direct, direct_answer = _answers(direct)
    out = _emit(pairs, key, 0, F.col("pos1"), F.col("pos2"), F.col("question"), pair_answer).unionByName(
        _emit(direct, key, 1, F.col("pos1"), F.lit(0), F.col("question"), direct_answer))
    return _finish(out, drop_null)


def qa_wiki(df: DataFrame, key: str = "row_key", drop_null: bool = True) -> DataFrame:
    """Keep ``label = 1`` (pushed to the scan)."""
    k = df.filter(F.col("label") == 1)
    return _finish(_emit(k, key, 0, F.lit(0), F.lit(0), F.col("question"), F.col("answer")), drop_null)


def qa_truthful(df: DataFrame, key: str = "row_key", drop_null: bool = True) -> DataFrame:
    """P7+P8: the best answer always (pos1 0), then every correct answer that differs from it
    (null-safe), duplicates among them kept; pos1 = 1 + index in ``correct_answers``."""
    best = _emit(df, key, 0, F.lit(0), F.lit(0), F.col("question"), F.col("best_answer"))
    others = (df.select(key, "question", "best_answer",
                        F.posexplode(F.coalesce("correct_answers", F.array().cast("array<string>"))).alias("i", "ans"))
                .filter(~F.col("ans").eqNullSafe(F.col("best_answer"))))
    rest = _emit(others, key, 1, F.col("i") + 1, F.lit(0), F.col("question"), F.col("ans"))
    return _finish(best.unionByName(rest), drop_null)


def qa_first_answer(df: DataFrame, key: str = "row_key", on_empty: str = "error",
                    drop_null: bool = True) -> DataFrame:
    """The first answer text; the passage is never read.  An empty answer list fails the
    job (``on_empty='error'``, ANSI array index) like the reference, or is dropped (``'drop'``)."""
    texts = F.col("answers.text")
    if on_empty == "drop":
        d = df.filter(F.size(texts) > 0)
        ans = F.get(texts, 0)
    else:
        d = df
        ans = F.when(F.size(texts) > 0, F.get(texts, 0)).otherwise(
            F.raise_error(F.lit("qa_first_answer: empty answer list")))
    return _finish(_emit(d, key, 0, F.lit(0), F.lit(0), F.col("question"), ans), drop_null)


def qa_instruct(df: DataFrame, key: str = "row_key", drop_null: bool = True) -> DataFrame:
    """P10: ``User: {instruction}\\n\\nContext: {context}`` when context is non-empty
    (whitespace counts as present), else ``User: {instruction}``."""
    has_ctx = F.coalesce(F.col("context"), F.lit("")) != ""
    q = F.when(has_ctx, F.concat(F.col("instruction"), F.lit(config.CONTEXT_BLOCK), F.col("context"))).otherwise(
        F.col("instruction"))
    return _finish(_emit(df, key, 0, F.lit(0), F.lit(0), q, F.col("response")), drop_null)


FLATTEN = {"ambig": qa_ambig, "wiki": qa_wiki, "truthful": qa_truthful,
           "squad": qa_first_answer, "instruct": qa_instruct}


def union_sources(flat: dict) -> DataFrame:
    """Concatenate flattened sources in the fixed order, no dedup.  ``source`` is a literal
    per branch, so a filter on it prunes the other branches' scans."""
    parts = []
    for i, name in enumerate(SOURCE_ORDER):
        if name in flat:
            parts.append(flat[name].select(F.lit(name).alias("source"), F.lit(i).cast("bigint").alias("source_ord"),
                                           *OUT))
    return reduce(DataFrame.unionByName, parts)


def write_union(flat: dict, path: str) -> dict[str, int]:
    """U2 -> Parquet, and A1 from the same job: rows written for every source, in the fixed order."""
    return write_counted(union_sources(flat), lambda d: d.write.parquet(path), "source", [n for n in SOURCE_ORDER if n in flat])


def reject_counts(unified: DataFrame) -> DataFrame:
    """Rows per source and how many of them the null rule rejects (of rows flattened with ``drop_null=False``)."""
    bad = F.col("response").isNull() | F.col("context")[0].isNull()
    return unified.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("rejected"))


def source_counts(unified: DataFrame) -> DataFrame:
    """A1: rows per source and the running total after each (a window over <= 5 rows)."""
    c = unified.groupBy("source", "source_ord").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("source_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn("running", F.sum("n").over(w))
