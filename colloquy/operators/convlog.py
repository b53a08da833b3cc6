"""The chat loop's input handling as window jobs over ``(conv_id, turn, raw)`` logs.

The running state (quit seen, clears so far, last setting) is a running aggregate per
conversation: one window normally, a chunked two-phase prefix when a conversation is too
big for one task (``functions.ordering.running_aggs``).  ``hot_rows`` sets that limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.ordering import global_positions, largest_group, running_aggs
from colloquy.functions.text import PY_FLOAT_RE, PY_INT_RE, py_split, py_strip



def clean_inputs(log: DataFrame, raw: str = "raw") -> DataFrame:
    """Python ``strip()``; empty lines are skipped."""
    return log.withColumn("clean", py_strip(raw)).filter(F.col("clean") != "")


def classify_inputs(clean: DataFrame) -> DataFrame:
    """C2+C3: ``kind`` in message / quit / clear / temp / temp_bad / tokens / tokens_bad / unknown.
    A command needs its value (``/temp`` alone is unknown); a value Python's ``float``/``int``
    would reject is ``*_bad`` and changes nothing, as is an integer beyond BIGINT."""
    words = py_split(F.lower(F.col("clean")))
    verb, arg = F.get(words, 0), F.get(words, 1)
    is_cmd = F.col("clean").startswith("/")
    temp_ok = arg.rlike(PY_FLOAT_RE)
    num = F.regexp_replace(arg, "_", "")
    tok_ok = arg.rlike(PY_INT_RE) & num.try_cast("bigint").isNotNull()
    kind = (F.when(~is_cmd, "message")
             .when(verb == "/quit", "quit")
             .when(verb == "/clear", "clear")
             .when((verb == "/temp") & arg.isNotNull(), F.when(temp_ok, "temp").otherwise("temp_bad"))
             .when((verb == "/tokens") & arg.isNotNull(), F.when(tok_ok, "tokens").otherwise("tokens_bad"))
             .otherwise("unknown"))
    return (clean.withColumn("verb", F.when(is_cmd, verb))
                 .withColumn("kind", kind)
                 .withColumn("temp_value", F.when(F.col("kind") == "temp", num.try_cast("double")))
                 .withColumn("tokens_value", F.when(F.col("kind") == "tokens", num.try_cast("bigint"))))


HOT_ROWS = 1_000_000


def cut_after_quit(classified: DataFrame, hot_rows: int | None = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """C4: the first ``/quit`` ends the session; it and every later row are dropped."""
    d = classified.withColumn("_isq", F.when(F.col("kind") == "quit", 1).otherwise(0))
    d = running_aggs(d, "conv_id", "turn", [("_q", "max", "_isq")], hot_rows=hot_rows, split=split)
    return d.filter(F.col("_q") == 0).drop("_q", "_isq")


def segments(df: DataFrame, hot_rows: int | None = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """``/clear`` starts a new history segment (running count of clears)."""
    d = df.withColumn("_isc", F.when(F.col("kind") == "clear", 1).otherwise(0))
    d = running_aggs(d, "conv_id", "turn", [("segment_id", "sum", "_isc")], hot_rows=hot_rows, split=split)
    return d.withColumn("segment_id", F.col("segment_id").cast("bigint")).drop("_isc")


def carry_settings(df: DataFrame, temp0: float = config.TEMPERATURE, tokens0: int = config.MAX_NEW_TOKENS,
                   hot_rows: int | None = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """Temperature and max tokens hold until changed (not reset by ``/clear``)."""
    d = running_aggs(df, "conv_id", "turn", [("_t", "last", "temp_value"), ("_m", "last", "tokens_value")],
                     hot_rows=hot_rows, split=split)
    return (d.withColumn("temperature", F.coalesce("_t", F.lit(temp0)))
             .withColumn("max_tokens", F.coalesce("_m", F.lit(tokens0).cast("bigint"))).drop("_t", "_m"))


def build_prompts(df: DataFrame) -> DataFrame:
    """For each message, all earlier user lines of its segment plus its own, joined by
    newlines, then ``\\nAssistant:``.  Commands add no line.  (Replies are not in the input log;
    a failed reply in the reference also leaves only the user line.)"""
    msgs = df.filter(F.col("kind") == "message")
    w = Window.partitionBy("conv_id", "segment_id").orderBy("turn").rowsBetween(Window.unboundedPreceding,
                                                                                 Window.currentRow)
    hist = F.collect_list(F.concat(F.lit(config.USER_PREFIX), F.col("clean"))).over(w)
    return msgs.withColumn("prompt", F.concat(F.array_join(hist, "\n"), F.lit(config.PROMPT_SUFFIX)))


def segment_lines(df: DataFrame, chunk_rows: int = 65536) -> DataFrame:
    """C7 by reference: each message of ``df`` with its line and the range of lines, ``first_line`` to ``line_no``, that its prompt
    shows.  Lines are numbered per conversation in chunks; a segment's first line is a minimum of chunk minima.  One row a
    message, so storage is linear however long a segment is."""
    msgs = df.filter(F.col("kind") == "message").withColumn("line", F.concat(F.lit(config.USER_PREFIX), F.col("clean")))
    num = global_positions(msgs, F.floor(F.col("turn") / chunk_rows), ["turn"], pos_col="line_no", partition_cols=["conv_id"])
    first = num.groupBy("conv_id", "segment_id").agg(F.min("line_no").alias("first_line"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("segment_id").alias("_s"), "first_line")
    return num.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("segment_id").eqNullSafe(F.col("_s"))).drop("_c", "_s")


def render_prompts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """The prompts of the ``segment_lines`` rows ``wanted``, by a range join with all ``lines``; keeps ``wanted``'s columns."""
    ln = lines.select(F.col("conv_id").alias("_c"), F.col("line_no").alias("_at"), F.col("line").alias("_text"))
    keep = wanted.columns
    d = wanted.join(ln, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_at").between(F.col("first_line"), F.col("line_no")))
    g = d.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("_at", "_text"))).alias("_h"))
    text = F.array_join(F.transform("_h", lambda s: s["_text"]), "\n")
    return g.select(*keep, F.concat(text, F.lit(config.PROMPT_SUFFIX)).alias("prompt"))


def process_log(log: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """C1 -> C6 in order; the largest conversation is measured once, on the raw log."""
    split = hot_rows is None or largest_group(log, "conv_id") > hot_rows
    d = cut_after_quit(classify_inputs(clean_inputs(log)), split=split)
    return carry_settings(segments(d, split=split), split=split)


def extract_reply(df: DataFrame, text: str = "generated", prompt: str = "prompt", out: str = "reply") -> DataFrame:
    """Text after the last ``Assistant:`` (else after the prompt by length), stripped;
    then cut at the first ``User:`` and stripped again."""
    t = F.col(text)
    first = F.when(t.contains("Assistant:"), py_strip(F.substring_index(t, "Assistant:", -1))).otherwise(
        py_strip(F.expr(f"substring({text}, char_length({prompt}) + 1)")))
    d = df.withColumn("_r", first)
    return d.withColumn(out, F.when(F.col("_r").contains("User:"),
                                    py_strip(F.substring_index(F.col("_r"), "User:", 1))).otherwise(F.col("_r"))).drop("_r")
