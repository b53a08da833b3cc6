"""R2: per-conversation chat state across micro-batches (history, settings, segment).

``groupBy(conv_id).transformWithStateInPandas`` on RocksDB: a value state holds the last turn seen, the quit flag, the segment
number, the carried temperature and max tokens; a list state holds the user lines of the current segment (what the REPL's
history list holds).  A micro-batch *appends* its lines, so the state that is written grows with the new lines and not with the
history; the history is read only when the conversation says something in the segment it is in, and ``/clear`` empties it.

Rows of a micro-batch are processed in ``turn`` order; a row whose turn is not after the last one seen is emitted with
``late = true`` and changes nothing.  A conversation that is idle for ``idle_timeout_ms`` of processing time is forgotten by its timer,
lines and settings together, so the store holds live conversations only.  With timers Spark keeps running timer-only micro-batches,
so a one-shot replay (``availableNow``) passes ``idle_timeout_ms=None``.  How many rows of a conversation a micro-batch may hold is
set by the source's rate limit.  The batch equivalent is ``convlog.process_log`` + ``convlog.build_prompts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy import config
from colloquy.operators.convlog import classify_inputs, clean_inputs
from colloquy.session import configure

OUTPUT_SCHEMA = ("conv_id bigint, turn bigint, kind string, segment_id bigint, temperature double, "
                 "max_tokens bigint, prompt string, late boolean")
SETTINGS_SCHEMA = "last_turn bigint, quit boolean, segment_id bigint, temperature double, max_tokens bigint, timer bigint"
LINES_SCHEMA = "line string"
NEW = (-1, False, 0, config.TEMPERATURE, config.MAX_NEW_TOKENS)


def _advance(held: tuple, history, turns: list, kinds: list, texts: list, temps: list, limits: list) -> tuple[tuple, list[str], list[tuple]]:
    """One conversation's new settings, its new lines in the segment it ends in, and output rows (without the conversation), for
    classified input lines in turn order, given as columns.

    ``history()``: the lines so far of the segment it is in; called once at most."""
    last_turn, ended, segment, temperature, max_tokens = held
    added: list[str] = []
    said, out = None, []                              # the segment's lines as one text, when a message needs it
    for turn, kind, text, temp, limit in zip(turns, kinds, texts, temps, limits):
        if turn <= last_turn:
            out.append((turn, None, None, None, None, None, True))
            continue
        last_turn = turn
        ended = ended or kind == "quit"
        if ended:
            continue
        if kind == "clear":
            segment, said, added = segment + 1, "", []
        temperature = temperature if temp is None else temp
        max_tokens = max_tokens if limit is None else limit
        prompt = None
        if kind == "message" and text is not None:
            if said is None:
                said = "\n".join(history())
            line = config.USER_PREFIX + text
            said = f"{said}\n{line}" if said else line
            added.append(line)
            prompt = said + config.PROMPT_SUFFIX
        out.append((turn, kind, segment, temperature, max_tokens, prompt, False))
    return (last_turn, ended, segment, temperature, max_tokens), added, out


def _values(column: pd.Series) -> list:
    """Values of a column, None where it is null."""
    return [None if v is None or v != v else v for v in column.tolist()]


class ChatProcessor(StatefulProcessor):
    """Value state ``settings``, list state ``lines``, one idle timer a conversation."""

    def __init__(self, idle_timeout_ms: int | None):
        self.idle = idle_timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settings = handle.getValueState("settings", SETTINGS_SCHEMA)
        self.lines = handle.getListState("lines", LINES_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.settings.get() if self.settings.exists() else None
        *old, timer = held if held is not None else (*NEW, None)
        batch = [pd.concat(columns) if len(columns) > 1 else columns[0] for columns in zip(*(
            [part[c] for c in ("turn", "kind", "clean", "temp_value", "tokens_value")] for part in rows))]
        columns = [_values(c) for c in batch]
        order = sorted(range(len(columns[0])), key=columns[0].__getitem__)       # stable: arrival order breaks ties
        turns, kinds, texts, temps, limits = ([c[i] for i in order] for c in columns)
        limits = [None if v is None else int(v) for v in limits]
        new, added, out = _advance(tuple(old), lambda: [r[0] for r in self.lines.get()] if self.lines.exists() else [],
                                   turns, kinds, texts, temps, limits)
        if new[2] != old[2] or new[1]:
            self.lines.clear()                        # another segment, or the session has ended
        if added and not new[1]:
            self.lines.appendList([(line,) for line in added])
        if self.idle:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        self.settings.update((*new, timer))
        if out:
            turn, kind, segment, temperature, limit, prompt, late = zip(*out)
            yield pd.DataFrame({"conv_id": int(key[0]), "turn": np.array(turn, dtype=np.int64), "kind": pd.Series(kind, dtype=object),
                                "segment_id": pd.array(segment, dtype="Int64"), "temperature": np.array(temperature, dtype=float),
                                "max_tokens": pd.array(limit, dtype="Int64"), "prompt": pd.Series(prompt, dtype=object),
                                "late": np.array(late, dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.settings.clear()
        self.lines.clear()
        return iter([])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that list states need; a session that names a RocksDB store keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def chat_sessions(log: DataFrame, idle_timeout_ms: int | None = 3_600_000) -> DataFrame:
    """Streaming (or batch) ``(conv_id, turn, raw)`` -> one row per processed input line.

    Lines are cleaned and classified by the batch operators (C1-C3) before the stateful step, which
    holds only the transition.  Rows without a conversation or a turn are left out."""
    use_rocksdb(log.sparkSession)
    lines = classify_inputs(clean_inputs(log.select("conv_id", "turn", "raw"))).filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", "kind", "clean", "temp_value", "tokens_value")
    return lines.groupBy("conv_id").transformWithStateInPandas(ChatProcessor(idle_timeout_ms), OUTPUT_SCHEMA, "append",
                                                               "ProcessingTime" if idle_timeout_ms else "None")


def start_sessions(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = True,
                   idle_timeout_ms: int | None = None, max_files_per_trigger: int | None = None,
                   state_partitions: int | None = None) -> StreamingQuery:
    """Chat logs that arrive as Parquet files ``(conv_id, turn, raw)`` -> processed lines as Parquet, each row once, also after a restart.

    ``state_partitions``: parts of the state store, each opened by every micro-batch; fixed by the first start of a checkpoint
    (None: the session's shuffle partitions)."""
    configure(spark)
    reader = spark.readStream.schema("conv_id bigint, turn bigint, raw string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    w = (chat_sessions(reader.parquet(in_dir), idle_timeout_ms).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(state_partitions or before))
        return w.start()                  # a stream keeps the settings that it was started with
    finally:
        spark.conf.set(key, before)
