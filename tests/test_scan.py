import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import scan, sequence

EVENTS = "user_id bigint, event_id bigint, value double, step double"


def _events():
    r = random.Random(1)
    rows = [(u, i * 10 + (u or 0) % 10, r.choice([None, 0.0, r.uniform(-3, 3)]), r.choice([None, r.uniform(-4, 4), 40.0, -40.0, 800.0]))
            for u in (1, 2, 3, None) for i in range(60)]
    rows += [(9, i, r.uniform(-1, 1), r.uniform(-2, 2)) for i in range(3000)]        # a hot key
    return rows + [(100, 0, None, None), (101, 0, 2.5, 0.0)]


def _softplus(v):
    return max(v, 0) + math.log1p(math.exp(-abs(v)))


def _loop(rows, rates, skip):
    out, by = {}, {}
    for u, e, x, s in sorted(rows, key=lambda r: r[1]):
        by.setdefault(u, []).append((e, x or 0.0, 0.0 if s is None else _softplus(s)))
    for u, seq in by.items():
        h = [0.0] * len(rates)
        for e, x, d in seq:
            b, c = (1.0, math.cos(e)), (math.sin(e), 1.0)
            h = [math.exp(d * r) * v + d * b[n] * x for n, (v, r) in enumerate(zip(h, rates))]
            out[u, e] = sum(a * v for a, v in zip(c, h)) + skip * x
    return out


def _selective(df, **kw):
    return scan.selective_scan(df, "user_id", ["event_id"], F.col("value"), F.col("step"), [F.lit(1.0), F.cos("event_id")], [F.sin("event_id"), F.lit(1.0)],
                               [-1.0, -0.05], skip=0.5, **kw)


@pytest.mark.parametrize("block, parts", [(4, 5), (7, 1), (512, None)])
def test_selective_scan_equals_loop(spark, block, parts):
    rows = _events()
    df = spark.createDataFrame([(*r, "x") for r in rows], EVENTS + ", y string").repartition(4).withColumnRenamed("y", "note")
    got = _selective(df, block=block, parts=parts).collect()
    want = _loop(rows, [-1.0, -0.05], 0.5)
    assert len(got) == len(rows) and {r.note for r in got} == {"x"}
    assert all(math.isclose(r.y, want[r.user_id, r.event_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_scan_plan_has_no_python(spark):
    df = spark.createDataFrame(_events(), EVENTS)
    plan = _selective(df, block=8, parts=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


def test_affine_scan_growth_zero_and_empty(spark):
    rows = [(1, i, None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, EVENTS)
    grown = scan.affine_scan(df, "user_id", ["event_id"], [(F.lit(1e9), F.lit(0.0)), (F.lit(0.0), F.col("event_id")), (F.lit(None).cast("double"), F.lit(1.0))],
                             ["a", "b", "c"], block=16, parts=3).collect()
    assert all(r.a == 0.0 and r.b == r.event_id and r.c == r.event_id + 1 for r in grown)
    assert _selective(df.limit(0)).count() == 0


def test_decayed_state_null_key_and_values(spark):
    """A null key carries its state over chunks like any other key; a null value adds nothing."""
    day = 86400.0
    seq = [(0.0, 1.0), (day * 0.4, 2.0), (day * 1.5, None), (day * 2.2, 4.0), (day * 5.0, 5.0), (day * 5.1, 6.0)]
    rows = [(k, i, t, v) for k in (1, None) for i, (t, v) in enumerate(seq)] + [(7, 0, 0.0, None)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, t double, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.user_id, r.event_id): r.state for r in sequence.decayed_state(df, 1 / day).collect()}
    h, last = 0.0, 0.0
    for i, (t, v) in enumerate(seq):
        h, last = math.exp(-(t - last) / day) * h + (v or 0.0), t
        assert math.isclose(got[1, i], h, rel_tol=1e-9) and math.isclose(got[None, i], h, rel_tol=1e-9)
    assert got[7, 0] == 0.0
