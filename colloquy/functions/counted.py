"""Counts that come from a write itself, not from a second scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_counted(df: DataFrame, write: Callable[[DataFrame], None], column: str, values: Sequence) -> dict:
    """Runs ``write(df)`` and returns the rows written for each of ``values`` of ``column`` (None counts nulls), in the same job.

    The counts are observed below the write, in the tasks that write, so a task that is run again counts once.
    A row with another value fails the call after the write: ``values`` must be complete for the counts to be whole."""
    seen = Observation()
    counts = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"v{i}") for i, v in enumerate(values)]
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    got = seen.get
    out = {v: got[f"v{i}"] for i, v in enumerate(values)}
    if sum(out.values()) != got["rows"]:
        raise ValueError(f"{got['rows'] - sum(out.values())} rows hold another value of {column}")
    return out
