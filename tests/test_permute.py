import pytest
from pyspark.sql import functions as F

from colloquy.functions.permute import keyed_permutation
from colloquy.operators import batching


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101, 4099])
def test_keyed_permutation_is_a_bijection(spark, n):
    d = spark.range(n).withColumn("e", F.explode(F.array(F.lit("0"), F.lit("1"))))
    rows = d.select("id", "e", keyed_permutation(F.col("id"), n, F.lit("42"), F.col("e")).alias("pos")).collect()
    orders = [[r.pos for r in sorted(rows, key=lambda r: r.id) if r.e == e] for e in "01"]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n >= 100:
        assert orders[0] != orders[1]
        steps = [abs(b - a) for o in orders for a, b in zip(o, o[1:])]
        assert sum(s == 1 for s in steps) < 0.05 * len(steps) and 0.2 < sum(steps) / len(steps) / n < 0.45     # neighbours part


def test_epoch_permutation_adds_no_exchange_an_epoch(spark):
    df = spark.createDataFrame([(i // 5, i % 5, "x") for i in range(500)], "conv_id bigint, turn bigint, t string")
    d = batching.epoch_permutation(df, ["conv_id", "turn"], epochs=4)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Window" not in plan
    rows = d.collect()
    assert len(rows) == 2000 and all(sorted(r.pos for r in rows if r.epoch == e) == list(range(500)) for e in range(4))
    assert {r.n_examples for r in rows} == {500}
    assert batching.epoch_permutation(df.limit(0), ["conv_id", "turn"], epochs=2).count() == 0
