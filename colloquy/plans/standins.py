"""Nested QA-source and chat-log stand-ins derived row by row from the driver's tables.

Each source row is built from one conversation row and its neighbours (``lag``/``lead``
over ``conv_id`` ordered by ``turn``), so no conversation is ever collected into one
group.  The shapes equal the five public QA sources' (see ``sources/qa_files.SCHEMAS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ordering import global_positions

def neighbours(conv: DataFrame) -> DataFrame:
    _W = Window.partitionBy("conv_id").orderBy("turn")
    return (conv.select("conv_id", "turn", "role", "text")
                .withColumn("prev_role", F.lag("role").over(_W)).withColumn("prev_text", F.lag("text").over(_W))
                .withColumn("next_role", F.lead("role").over(_W)).withColumn("next_text", F.lead("text").over(_W))
                .withColumn("row_key", F.concat_ws(":", "conv_id", "turn")))


def _lines(c):
    return F.split(F.col(c), "\n")


def ambig_source(conv: DataFrame) -> DataFrame:
    """Assistant turn after a user turn: question = the user text; one qaPair whose answer lists
    are ``[[answer], [], answer lines]`` (missing when ``(conv_id+turn) % 5 = 0``); direct
    answers ``[question lines, []]``."""
    n = neighbours(conv).filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    pair = F.struct(F.array(F.array("text"), F.array().cast("array<string>"), _lines("text")).alias("answer"))
    pairs = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.array(pair))
    direct = F.array(_lines("prev_text"), F.array().cast("array<string>"))
    return n.select("row_key", F.col("prev_text").alias("question"),
                    F.struct(pairs.alias("qaPairs"), direct.alias("answer")).alias("annotations"))


def wiki_source(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents: question = first line, answer = the whole text, label = quality."""
    return (labels.select("doc_id", F.col("quality").alias("label"))
                  .join(documents.select("doc_id", "text"), "doc_id")
                  .select(F.col("doc_id").cast("string").alias("row_key"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
                          F.col("text").alias("answer"), "label"))


def truthful_source(conv: DataFrame) -> DataFrame:
    """best = the assistant text; correct = ``[first line, best, first line]``."""
    n = neighbours(conv).filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    fl = F.split_part("text", F.lit("\n"), F.lit(1))
    return n.select("row_key", F.col("prev_text").alias("question"), F.col("text").alias("best_answer"),
                    F.array(fl, F.col("text"), fl).alias("correct_answers"))


def squad_source(conv: DataFrame) -> DataFrame:
    """Every user turn; answers.text = the following assistant text, or empty."""
    n = neighbours(conv).filter(F.col("role") == "user")
    texts = F.when(F.col("next_role") == "assistant", F.array("next_text")).otherwise(F.array().cast("array<string>"))
    return n.select("row_key", F.col("text").alias("question"), F.struct(texts.alias("text")).alias("answers"))


def instruct_source(conv: DataFrame) -> DataFrame:
    """User turn followed by an assistant turn; context = a preceding system text, else ``' '``
    when ``turn % 4 = 1``, ``''`` when ``turn % 4 = 3``, else null."""
    n = neighbours(conv).filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    ctx = (F.when(F.col("prev_role") == "system", F.col("prev_text"))
            .when(F.col("turn") % 4 == 1, F.lit(" ")).when(F.col("turn") % 4 == 3, F.lit("")))
    return n.select("row_key", F.col("text").alias("instruction"), ctx.alias("context"),
                    F.col("next_text").alias("response"))


def jsonl_lines(conv: DataFrame) -> DataFrame:
    """One JSONL line per conversation row; ``(conv_id + turn) % 10`` picks a corruption:
    0 truncated, 1 no response, 2 array, 3 null context, 4 numeric response,
    5 duplicate context key (last wins), 6 null inside context, 7 single quotes, 8-9 clean."""
    m = (F.col("conv_id") + F.col("turn")) % 10
    ok = F.to_json(F.struct(F.array("text").alias("context"), F.col("text").alias("response")))
    rsp = F.to_json(F.struct(F.col("text").alias("response")))
    ctx_json = F.to_json(F.array("text"))
    line = (F.when(m == 0, F.expr("substring(_ok, 1, char_length(_ok) - 1)"))
             .when(m == 1, F.to_json(F.struct(F.array("text").alias("context"))))
             .when(m == 2, F.to_json(F.array("role", "text")))
             .when(m == 3, F.concat(F.lit('{"context":null,'), F.expr("substring(_rsp, 2)")))
             .when(m == 4, F.concat(F.lit('{"context":'), F.col("_ctx"), F.lit(',"response":'),
                                    F.col("turn").cast("string"), F.lit("}")))
             .when(m == 5, F.concat(F.lit('{"context":["x"],'), F.expr("substring(_ok, 2)")))
             .when(m == 6, F.concat(F.lit('{"context":[null,'), F.expr("substring(_ctx, 2)"), F.lit(',"response":"x"}')))
             .when(m == 7, F.lit("{'context':['a'],'response':'b'}"))
             .otherwise(F.col("_ok")))
    return (conv.select("conv_id", "turn", "role", "text")
                .withColumn("_ok", ok).withColumn("_rsp", rsp).withColumn("_ctx", ctx_json)
                .select("conv_id", "turn", line.alias("value")))


def chat_input_log(events: DataFrame) -> DataFrame:
    """The chat loop's raw input lines, one per event: conv_id = user, turn = order by (ts, id)."""
    e = F.col("event_type")
    eid = F.col("event_id")
    raw = (F.when(e == "click", F.concat(F.lit("ask "), eid.cast("string")))
            .when(e == "view", F.concat(F.lit("  look "), eid.cast("string"), F.lit(" ")))
            .when(e == "error", F.when(eid % 5 == 0, F.lit("/temp abc"))
                  .otherwise(F.concat(F.lit("/TEMP  "), F.col("value").cast("string"))))
            .when(e == "purchase", F.concat(F.lit("/tokens "), F.floor("value").cast("bigint").cast("string")))
            .when(eid % 7 == 0, F.lit("/clear")).when(eid % 11 == 0, F.lit("/temp"))
            .when(eid % 101 == 0, F.lit("/quit now")).otherwise(F.lit(" ")))
    # turn = position in (ts, event_id) order per user, numbered two-phase (hourly buckets),
    # so a user with a third of all events is not one window task
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    d = events.select("user_id", "ts", "event_id", raw.alias("raw"))
    d = global_positions(d, hour, ["ts", "event_id"], pos_col="turn", partition_cols=["user_id"])
    return d.select(F.col("user_id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "raw")


def one_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The whole table as one group: ``key`` is 0 for all rows and ``order`` follows ``(key, order)``."""
    return df.withColumns({order: F.col(key) * 1_000_000 + F.col(order), key: F.lit(0).cast("bigint")})
