"""P12 render text, P13 conversation turns -> loader records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ordering import global_positions


def role_line(role="role", text="text"):
    """``"User: hi"``: the role, capitalised, as prefix (user -> "User: ", assistant -> "Assistant: ")."""
    return F.concat(F.initcap(F.col(role)), F.lit(": "), F.col(text))


def conversation_examples(conv: DataFrame, max_turns: int | None = None,
                          key="conv_id", order="turn") -> DataFrame:
    """Every assistant turn becomes ``{context: all earlier lines, response: its own line}``.

    The history window is computed over *all* roles first and only then filtered to
    assistant rows (filtering first would drop the user lines from the context).
    ``max_turns`` optionally bounds the history to that many lines (off by default, like the reference).
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    conv = conv.withColumn("_line", role_line())
    if max_turns is not None:                     # by lines before a row: a row without a line takes no place
        conv = conv.withColumn("_before", F.count("_line").over(w))
        w = Window.partitionBy(key).orderBy("_before").rangeBetween(-int(max_turns), -1)
    return (conv
                .withColumn("context", F.collect_list("_line").over(w))
                .filter(F.col("role") == "assistant")
                .select(key, order, "context", F.col("_line").alias("response")))


def conversation_examples_head(conv: DataFrame, max_lines: int, key="conv_id", order="turn",
                               chunk_rows: int = 65536, hot_rows: int | None = 1_000_000) -> DataFrame:
    """P13 for training: the context is cut to the conversation's first ``max_lines`` lines.

    Exact for anything truncated to ``max_seq_len <= max_lines`` tokens afterwards: every
    line ("Role: text") is at least two tokens, so the first ``max_lines`` lines already hold
    more than ``max_seq_len`` tokens and later lines never reach the kept head.

    The largest conversation is measured first (one small aggregate).  Up to ``hot_rows``
    rows a conversation is one window partition whose history buffer keeps at most
    ``max_lines`` lines.  Beyond it no window sees a whole conversation: line numbers come from
    the two-phase bucket form (buckets ``turn div chunk_rows`` per conversation), rows inside
    the head use a window over at most ``max_lines`` rows, and every later assistant row joins
    the conversation's head (one row per conversation), a hot conversation being spread by
    AQE's skew-join split.  ``hot_rows=None`` always takes the split path.

    A row without text (or role) has no line: it takes no place in the head, adds nothing to a
    context and gives no example, on both paths.
    """
    L = int(max_lines)
    lines = conv.withColumn("_line", role_line()).filter(F.col("_line").isNotNull())
    if hot_rows is not None:
        biggest = conv.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        if biggest <= hot_rows:
            w = Window.partitionBy(key).orderBy(order)
            hist = F.collect_list(F.when(F.col("_rn") <= L, F.col("_line"))).over(
                w.rowsBetween(Window.unboundedPreceding, -1))
            return (lines.withColumn("_rn", F.row_number().over(w))
                         .withColumn("context", hist)
                         .filter(F.col("role") == "assistant")
                         .select(key, order, "context", F.col("_line").alias("response")))
    num = global_positions(lines, F.floor(F.col(order) / chunk_rows), [order], pos_col="_ln",
                           partition_cols=[key])
    head = num.filter(F.col("_ln") < L)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    early = (head.withColumn("context", F.collect_list("_line").over(w))
                 .filter(F.col("role") == "assistant")
                 .select(key, order, "context", F.col("_line").alias("response")))
    head_ctx = (head.groupBy(key)
                    .agg(F.sort_array(F.collect_list(F.struct(order, "_line"))).alias("_h"))
                    .select(key, F.transform("_h", lambda s: s["_line"]).alias("context")))
    late = (num.filter((F.col("_ln") >= L) & (F.col("role") == "assistant"))
               .join(head_ctx.withColumnRenamed(key, "_hk"), F.col(key).eqNullSafe(F.col("_hk")))
               .select(key, order, "context", F.col("_line").alias("response")))
    return early.unionByName(late)


def history_lines(conv: DataFrame, key="conv_id", order="turn", chunk_rows: int = 65536) -> DataFrame:
    """The lines of every conversation once, numbered from 0: ``(key, order, role, line_no, line)``.  A row without text or
    role has no line.  Numbers come from chunks of a conversation and their running counts, so no window holds it whole."""
    lines = conv.withColumn("line", role_line()).filter(F.col("line").isNotNull())
    num = global_positions(lines, F.floor(F.col(order) / chunk_rows), [order], pos_col="line_no", partition_cols=[key])
    return num.select(key, order, "role", "line_no", "line")


def history_ranges(lines: DataFrame, key="conv_id", order="turn") -> DataFrame:
    """P13 by reference: each assistant line's history as line numbers ``first_line`` to ``last_line`` (none: 0 to -1).
    Narrow over ``history_lines``, one small row an example: storage is linear in turns."""
    return lines.filter(F.col("role") == "assistant").select(
        key, order, F.lit(0).cast("bigint").alias("first_line"), (F.col("line_no") - 1).alias("last_line"),
        F.col("line_no").alias("response_line"))


def ranges_within(ranges: DataFrame, max_turns: int) -> DataFrame:
    """The last ``max_turns`` lines of each history: arithmetic on its range."""
    return ranges.withColumn("first_line", F.greatest("first_line", F.col("last_line") + 1 - int(max_turns)))


def render_ranges(ranges: DataFrame, lines: DataFrame, key="conv_id", order="turn") -> DataFrame:
    """``(key, order, context, response)`` of the ranges asked for, by a range join with the lines inside a conversation
    (null keys are a conversation).  Its output, not its storage, is as long as the histories asked for."""
    ln = lines.select(F.col(key).alias("_lk"), "line_no", "line")
    d = ranges.join(ln, F.col(key).eqNullSafe(F.col("_lk")) & F.col("line_no").between(F.col("first_line"), F.col("response_line")))
    past = F.when(F.col("line_no") <= F.col("last_line"), F.struct("line_no", "line"))
    own = F.max(F.when(F.col("line_no") == F.col("response_line"), F.col("line")))
    # the response's line tells rows of one turn apart
    g = d.groupBy(key, order, "first_line", "response_line").agg(F.sort_array(F.collect_list(past)).alias("_h"), own.alias("response"))
    return g.select(key, order, F.transform("_h", lambda s: s["line"]).alias("context"), "response")


def render_text(df: DataFrame, context="context", response="response", out="full_text") -> DataFrame:
    """``"\\n".join(context) + "\\n" + response`` (an empty context keeps the leading newline)."""
    return df.withColumn(out, F.concat(F.array_join(F.col(context), "\n"), F.lit("\n"), F.col(response)))
