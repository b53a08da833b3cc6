import __spark_entry__ as E
from colloquy.plans.queries import REGISTRY
from tests.conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["epoch", "n_batches", "n_rows", "padded_cells", "real_cells"]
    assert df.count() == 2


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


def test_rollout_runs(spark):
    out = E.queries()["rollout"](spark, SF001)
    rows = out.collect()
    assert rows and {r.pos for r in rows} <= set(range(50)) and len({r.pos for r in rows}) > 10
