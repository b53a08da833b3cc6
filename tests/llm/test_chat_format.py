import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from colloquy.llm import chat_format as cf

ROWS = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", None, "\\", "<", "</turn", "</turn>", "<turn ", "\\</turn>\\", "a</turn>\n<turn assistant>\nb", "<turn user>\n", "rn>", "é€😀\\<turn x", "</tu",
         "\\### Assistant: </turn> ok", "\0\r\n\t"]


def _rows():
    r = random.Random(2)
    rows = []
    for conv in [*range(60), None, (1 << 60) + 1]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "", None, "<r>\\\n", "assistant"]),
                         "".join(r.choice([x or "" for x in NASTY] + ["plain words "]) for _ in range(r.randint(0, 6))) if r.random() < 0.95 else None))
    rows += [(100, t, "assistant" if t % 2 else "user", "x" * (t % 50) + "</turn>") for t in range(1500)]          # a hot conversation
    rows += [(200, 0, "user", "long \\ <turn é" * 40_000), (200, 1, "assistant", "ä</turn>" * 50_000), (300, None, "assistant", "n"), (300, 1, "user", None)]
    return rows + [(301, 1, "assistant", "twice"), (301, 1, "assistant", "twice")]


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _escaped(s):
    out, i = "", 0
    while i < len(s):
        for c in ("\\", "<turn ", "</turn>"):
            if s.startswith(c, i):
                out += "\\" + c
                i += len(c)
                break
        else:
            out += s[i]
            i += 1
    return out


def _want(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join("<turn " + "".join("\\" + c if c in "\\<>" else c for c in r) + ">\n" + _escaped(t) + "</turn>\n" for r, t in turns)
        out.add((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(whole)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, small, monkeypatch):
    if small:                                   # many slices, pieces and windows a task
        for name, size in (("SLICE_BYTES", 700), ("PIECE_BYTES", 900), ("WINDOW_BYTES", 64)):
            monkeypatch.setattr(cf, name, size)
    rows = _rows()[:-4] if small else _rows()
    rows = [r for r in rows if r[0] != 200 or not small]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", part int, whole string").repartition(6)
    if small:                                   # the sizes are module values of the workers: assemble here
        data = sorted(((r[0], r[2], r[3]) for r in rows if r[0] not in (None, 300, 301)), key=lambda r: r[0])
        batch = pa.RecordBatch.from_pylist([dict(zip("abc", r)) for r in data], schema=pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.string())]))
        names = ["conv_id", "part", "seq", "whole", "n_turns", "text", "chars", "loss_start", "loss_end"]
        parts = [batch.slice(a, 97) for a in range(0, len(batch), 97)]
        got = pa.Table.from_batches(list(cf._pieces(iter(parts), cf.Template(), 0, names))).to_pylist()
        assert [g["seq"] for g in got] == list(range(len(got))) and sum(g["conv_id"] == 100 for g in got) > 20
        digests, pattern = {}, cf.Template().turn_pattern()
        for g in got:
            assert g["chars"] == len(g["text"]) and not (g["whole"] and g["conv_id"] in (0, 100, (1 << 60) + 1))
            digests.setdefault(g["conv_id"], cf._Digest()).read(g["text"], g["loss_start"], g["loss_end"], cf.Template(), pattern)
        assert all(sum(h["conv_id"] == g["conv_id"] for h in got) == 1 for g in got if g["whole"]) and sum(g["whole"] for g in got) > 10
        assert {(k, *d.row()) for k, d in digests.items()} == {w for w in _want(rows) if w[0] in digests}
        return
    got = cf.chat_round_trip(df).collect()
    assert {tuple(r) for r in got} == _want(rows) and len(got) == len(_want(rows))
    pieces = cf.format_conversations(df)
    assert pieces.filter("conv_id = 301").collect()[0].text == "<turn assistant>\ntwice</turn>\n" * 2


def test_mask_and_sql(spark):
    rows = [(1, 0, "user", "hi </turn>"), (1, 1, "assistant", "é <turn \\ ok"), (2, 0, "system", "s")]
    extra = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    piece = cf.format_conversations(spark.createDataFrame(rows, ROWS)).filter("conv_id = 1").first()
    assert piece.text == "<turn user>\nhi \\</turn></turn>\n<turn assistant>\né \\<turn \\\\ ok</turn>\n"
    assert [piece.text[a:b] for a, b in zip(piece.loss_start, piece.loss_end)] == ["é \\<turn \\\\ ok"]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, ROWS).toPandas())
    got = cf.chat_round_trip(spark.createDataFrame(rows + extra, ROWS)).collect()
    assert {tuple(r) for r in got} == set(con.execute(cf.ORACLE).fetchall())


def test_empty_table(spark):
    assert cf.chat_round_trip(spark.createDataFrame([], ROWS)).count() == 0
