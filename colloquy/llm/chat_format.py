"""Chat formatting by columnar byte assembly, with a loss mask, and reading it back.

A turn becomes ``<turn ROLE>``, a line feed, the text, ``</turn>`` and a line feed (see ``Template``).  Inside a text a
backslash and the control strings ``<turn `` and ``</turn>`` get a backslash in front, inside a role a backslash, ``<``
and ``>``; so every text can be read back exactly, and none can end its turn or open another.  The loss mask lists the
code-point ranges of the assistant texts in the formatted string.

Rows are ordered by (conversation, turn, role, digest of the text) in sampled ranges, so a hot conversation lies over many tasks.
Inside a task each slice of rows is assembled at once: segment lengths (header, escaped text, end) give cumulative offsets,
the offsets give scatter indices, and headers, texts and escapes are copied into one preallocated Arrow buffer, a window of
the source bytes at a time.  Memory is bounded by the slice, a very long text by itself.

The output is a table of pieces, ``(id, part, seq, whole, n_turns, text, chars, loss_start, loss_end)``: a conversation is its
pieces in the order of (part, seq), nearly always one.  A piece ends where a conversation ends, a task ends or
``PIECE_BYTES`` are reached, always between turns.  ``whole`` marks a piece that surely is its whole conversation.

``read_back`` parses written pieces.  Whole ones are digested where they lie; the others (two conversations a task, and hot
ones) stream through one shuffle in order, with nothing but the running digests held.

Defined results: null texts and roles read as empty; null ids are one conversation, ordered first; null turns come first;
repeated rows are turns of their own; a conversation without assistant text has an empty mask.  An empty table gives an
empty result.  Other columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize

ASSISTANT = "assistant"
SLICE_BYTES = 8 << 20          # source bytes assembled at once
PIECE_BYTES = 8 << 20
WINDOW_BYTES = 1 << 20         # source bytes whose scatter indices are held at once


@dataclass(frozen=True)
class Template:
    """``open`` ROLE ``middle`` TEXT ``close``; ``controls`` are escaped in texts, ``role_controls`` in roles.

    Control strings must start with the same character and hold it nowhere else; the escape is one character."""
    open: str = "<turn "
    middle: str = ">\n"
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("<turn ", "</turn>")
    role_controls: str = "<>"
    escape: str = "\\"

    def header(self, role: str) -> str:
        return self.open + re.sub(f"[{re.escape(self.escape + self.role_controls)}]", lambda m: self.escape + m[0], role) + self.middle

    def plain(self, escaped: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", escaped, flags=re.S) if self.escape in escaped else escaped

    def turn_pattern(self) -> re.Pattern:
        """One turn: role and text, still escaped.  Possessive, so a long text costs one pass and no stack."""
        esc, first = re.escape(self.escape), re.escape(self.controls[0][0])
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return re.compile(f"{re.escape(self.open)}((?:[^{esc}{re.escape(self.role_controls)}]|{esc}.)*+){re.escape(self.middle)}"
                          f"((?:[^{esc}{first}]++|{esc}.|{first}(?!{rest}))*+){re.escape(self.close)}", re.S)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def _marks(data: np.ndarray, offsets: np.ndarray, t: Template) -> np.ndarray:
    """Sorted places of the bytes that get an escape in front: escapes, and control strings inside one text."""
    at = np.flatnonzero(data == ord(t.escape))
    first = np.flatnonzero(data == ord(t.controls[0][0]))
    end = offsets[np.searchsorted(offsets, first, side="right")] if first.size else first          # end of the text that holds it
    found = [at]
    for control in t.controls:
        code, hit = control.encode(), first
        hit = hit[hit + len(code) <= end]
        for k in range(1, len(code)):
            hit = hit[data[hit + k] == code[k]]
        found.append(hit)
    return np.sort(np.concatenate(found))


class Assembly:
    """Formatted bytes of a slice of rows: ``buffer`` and, for every row, byte and character offsets."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, roles: pa.Array, t: Template):
        data, starts = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        rows, length = len(starts) - 1, np.diff(starts)
        coded = pc.dictionary_encode(pc.fill_null(roles, ""))
        kinds, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        headers = [t.header(k) for k in kinds]
        encoded = [h.encode() for h in headers]
        head_bytes = np.array([len(h) for h in encoded], dtype=np.int64)[code]
        head_chars = np.array([len(h) for h in headers], dtype=np.int64)[code]
        close = np.frombuffer(t.close.encode(), dtype=np.uint8)
        marks = _marks(data, starts, t)
        before = np.searchsorted(marks, starts)                       # escapes before each text
        # segment lengths (header, escaped text, end) -> cumulative offsets
        lengths = np.column_stack([head_bytes, length + np.diff(before), np.full(rows, len(close))])
        segment = np.concatenate([[0], np.cumsum(lengths.ravel())])
        self.buffer = pa.allocate_buffer(int(segment[-1]), resizable=False)
        out = np.frombuffer(self.buffer, dtype=np.uint8)
        head_at, text_at, close_at = segment[0:-1:3], segment[1:-1:3], segment[2:-1:3]
        blob = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        blob_at = np.concatenate([[0], np.cumsum([len(h) for h in encoded])])[:-1].astype(np.int64)[code]
        inside = np.arange(head_bytes.sum()) - np.repeat(np.cumsum(head_bytes) - head_bytes, head_bytes)
        out[np.repeat(head_at, head_bytes) + inside] = blob[np.repeat(blob_at, head_bytes) + inside]
        out[(close_at[:, None] + np.arange(len(close))).ravel()] = np.tile(close, rows)
        shift, chars = text_at - starts[:-1] - before[:-1], np.diff(before).astype(np.int64)
        for lo in range(0, len(data), WINDOW_BYTES):
            hi = min(len(data), lo + WINDOW_BYTES)
            a, b = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, hi)           # rows that the window meets
            row = np.repeat(np.arange(a, b), np.minimum(starts[a + 1:b + 1], hi) - np.maximum(starts[a:b], lo))
            part = data[lo:hi]
            near = marks[np.searchsorted(marks, lo):np.searchsorted(marks, hi)] - lo
            seen = np.zeros(hi - lo, dtype=np.int64)
            seen[near] = 1
            place = np.arange(lo, hi) + shift[row] + np.cumsum(seen) + np.searchsorted(marks, lo)
            out[place] = part
            out[place[near] - 1] = ord(t.escape)
            chars[a:b] += np.bincount(row - a, weights=(part & 0xC0) != 0x80, minlength=b - a).astype(np.int64)
        self.bytes_at = np.append(head_at, segment[-1])
        self.text_chars, self.head_chars = chars, head_chars
        self.chars_at = np.concatenate([[0], np.cumsum(head_chars + chars + len(t.close))])
        self.loss = np.array([k == ASSISTANT for k in kinds], dtype=bool)[code] if kinds else np.zeros(0, dtype=bool)


@dataclass
class _Piece:
    """A run of rows of one conversation."""
    id: pa.Array
    text: bytes
    turns: int
    chars: int
    start: np.ndarray
    end: np.ndarray

    def joined(self, later: "_Piece") -> "_Piece":
        return _Piece(self.id, self.text + later.text, self.turns + later.turns, self.chars + later.chars,
                      np.concatenate([self.start, later.start + self.chars]), np.concatenate([self.end, later.end + self.chars]))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _runs(ids: pa.Array) -> np.ndarray:
    """First row of every run of equal ids (null equals null), and the number of rows."""
    if len(ids) < 2:
        return np.array([0, len(ids)] if len(ids) else [0])
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    same = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.equal(a, b), pc.equal(pc.is_valid(a), pc.is_valid(b)))
    return np.concatenate([[0], 1 + np.flatnonzero(~pc.fill_null(same, False).to_numpy(zero_copy_only=False)), [len(ids)]])


def _same(a: pa.Array, b: pa.Array) -> bool:
    return a[0].as_py() == b[0].as_py()


def _pieces(batches: Iterator[pa.RecordBatch], t: Template, part: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of one task's ordered rows ``(id, role, text)``."""
    held, seq, first, split = None, 0, True, False      # split: the held piece continues an earlier one

    def batch(ids, whole, turns, text, chars, start, end):
        nonlocal seq
        seq += len(ids)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(np.arange(seq - len(ids), seq)),
                                           pa.array(whole), pa.array(turns, pa.int64()), text, pa.array(chars, pa.int64()), start, end], names=names)

    def one(p: _Piece, whole: bool):
        lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (p.start, p.end)]
        return batch(p.id, [whole], [p.turns], pa.array([p.text], pa.binary()).cast(pa.string()), [p.chars], *lists)

    for b in batches:
        ids, (offsets, data) = b.column(0), _utf8(b.column(2))
        for lo, hi in _slices(offsets):
            mine = ids.slice(lo, hi - lo)
            made = Assembly(offsets[lo:hi + 1], data, b.column(1).slice(lo, hi - lo), t)
            runs = _runs(mine)
            text_at = made.chars_at[:-1] + made.head_chars
            view = memoryview(made.buffer)

            def piece(a, z):
                keep = np.flatnonzero(made.loss[a:z]) + a
                return _Piece(mine.slice(a, 1), bytes(view[made.bytes_at[a]:made.bytes_at[z]]), int(z - a), int(made.chars_at[z] - made.chars_at[a]),
                              text_at[keep] - made.chars_at[a], text_at[keep] + made.text_chars[keep] - made.chars_at[a])

            at = 0
            if held is not None:
                fresh = piece(runs[0], runs[1])
                goes_on = _same(held.id, fresh.id)
                if goes_on and len(held.text) + len(fresh.text) <= PIECE_BYTES:
                    held = held.joined(fresh)
                    at = 1
                if at == 0 or len(runs) > 2:
                    yield one(held, not (first or split or (at == 0 and goes_on)))
                    first, split, held = False, at == 0 and goes_on, None
            last = len(runs) - 2
            if at > last:
                continue
            if at < last and (first or split):       # the first run of a task, or the rest of a conversation
                yield one(piece(runs[at], runs[at + 1]), False)
                first = split = False
                at += 1
            if at < last:                            # runs that begin and end in this slice: straight from the buffer
                rows = runs[at:last + 1]
                keep = np.flatnonzero(made.loss[rows[0]:rows[-1]]) + rows[0]
                base = np.repeat(made.chars_at[rows[:-1]], np.diff(rows))[keep - rows[0]]
                cuts = pa.array(np.searchsorted(keep, rows).astype(np.int32))
                text = pa.Array.from_buffers(pa.string(), len(rows) - 1, [None, pa.py_buffer(made.bytes_at[rows].astype(np.int32)), made.buffer])
                yield batch(mine.take(pa.array(rows[:-1])), np.ones(len(rows) - 1, dtype=bool), np.diff(rows), text, np.diff(made.chars_at[rows]),
                            pa.ListArray.from_arrays(cuts, pa.array(text_at[keep] - base)),
                            pa.ListArray.from_arrays(cuts, pa.array(text_at[keep] + made.text_chars[keep] - base)))
            held = piece(runs[last], runs[last + 1])
    if held is not None:
        yield one(held, False)


def format_conversations(df: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """Formatted pieces of the conversations of ``df(id, turn, role, text)``; see the module."""
    kind = df.schema[id_col].dataType.simpleString()
    order = [F.asc_nulls_first(c) for c in (id_col, "turn", "role", "_digest")]
    names = [id_col, "part", "seq", "whole", "n_turns", "text", "chars", "loss_start", "loss_end"]
    rows = (df.select(id_col, "turn", "role", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"))
            .repartitionByRange(*order).sortWithinPartitions(*order, F.asc_nulls_first("text")).select(id_col, "role", "text"))
    return rows.mapInArrow(lambda batches: _pieces(batches, template, TaskContext.get().partitionId(), names),
                           f"`{id_col}` {kind}, part int, seq bigint, whole boolean, n_turns bigint, text string, chars bigint, "
                           "loss_start array<bigint>, loss_end array<bigint>")


class _Digest:
    """Running digests of one conversation that is read back piece by piece."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def read(self, text: str, starts, ends, t: Template, pattern: re.Pattern) -> "_Digest":
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m is None:
                raise ValueError("formatted text does not read as turns")
            self.turns.update(f"{t.plain(m[1])}\n{t.plain(m[2])}\n".encode())
            self.n += 1
            at = m.end()
        for a, b in zip(starts, ends):
            kept = t.plain(text[a:b])
            self.loss.update(kept.encode())
            self.loss_chars += len(kept)
        self.chars += len(text)
        return self

    def row(self):
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """``(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of written pieces, one row a conversation."""
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    schema = f"`{id_col}` {pieces.schema[id_col].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def made(ids, rows):
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names=names)

    def apart(batches):
        pattern = template.turn_pattern()
        for b in batches:
            if b.num_rows:
                yield made(b.column(0), [_Digest().read(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), template, pattern).row()
                                         for i in range(b.num_rows)])

    def in_order(batches):
        pattern, now, held = template.turn_pattern(), None, None
        for b in batches:
            for i in range(b.num_rows):
                if held is None or not _same(held, b.column(0).slice(i, 1)):
                    if held is not None:
                        yield made(held, [now.row()])
                    held, now = b.column(0).slice(i, 1), _Digest()
                now.read(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), template, pattern)
        if held is not None:
            yield made(held, [now.row()])

    cols = (id_col, "text", "loss_start", "loss_end")
    edges = pieces.filter("not whole").repartition(id_col).sortWithinPartitions(F.asc_nulls_first(id_col), "part", "seq").select(*cols)
    return pieces.filter("whole").select(*cols).mapInArrow(apart, schema).unionByName(edges.mapInArrow(in_order, schema))


def chat_round_trip(df: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """Formats ``df``, writes the pieces to the shared folder and digests what is read back from them."""
    return read_back(materialize(format_conversations(df, template, id_col), "chat-format"), template, id_col)


#: DuckDB SQL of ``op12_chat_format``.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ') + length(regexp_replace(role, '[\\<>]', '\\\0', 'g')) + 2
      + length(regexp_replace(text, '\\|<turn |</turn>', '\\\0', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
