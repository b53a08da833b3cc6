"""M4, general form: ordered linear recurrences as an associative scan over affine maps.

A row is the map ``h -> a h + b``; maps compose to maps, ``(a2, b2) after (a1, b1) = (a2 a1, a2 b1 + b2)``, so a sequence can be
cut anywhere.  The table is range-partitioned by key and order; runs of ``BLOCK`` rows of a part are folded to one map
each, blocks of blocks to one map, up to one map a key and part, then over the parts of a key.  On the way down each block gets the state
it starts from and its rows follow from that.  All of it is groupings, array folds and joins: a key of any length is spread over
all tasks, and a level is ``BLOCK`` times smaller than the one below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.ordering import range_partitions

BLOCK = 512      # rows folded in one array: a fold appends to an array, so its cost a row grows with the block


def _after(a, h, b):
    """``a h + b``; a state of 0 stays out of the product, so that an overflowed ``a`` cannot turn it into NaN."""
    return F.when(h == 0.0, b).otherwise(a * h + b)


def _groups(elements: DataFrame, keys: list[str], block: int, extra: list[str]) -> DataFrame:
    """Elements ``(keys, _part, _idx, _s, extra)`` as one array in order for each key, part and block."""
    return (elements.groupBy(*keys, "_part", F.expr(f"_idx div {block}").alias("_g"))
            .agg(F.sort_array(F.collect_list(F.struct("_idx", "_s", *extra))).alias("_arr")))


def _total(n: int) -> Column:
    """The map that a whole array of maps composes to."""
    def step(acc, e):
        s = e["_s"]
        return F.struct(*[c for i in range(n) for c in ((s[f"a{i}"] * acc[f"a{i}"]).alias(f"a{i}"), _after(s[f"a{i}"], acc[f"b{i}"], s[f"b{i}"]).alias(f"b{i}"))])

    return F.aggregate("_arr", F.struct(*[F.lit(v).alias(f"{c}{i}") for i in range(n) for c, v in (("a", 1.0), ("b", 0.0))]), step)


def _states(n: int, start: list[Column], inclusive: bool) -> Column:
    """State after (or before) each map of the array."""
    kind = "array<struct<" + ", ".join(f"h{i}: double" for i in range(n)) + ">>"

    def step(acc, e):
        s = e["_s"]
        h = F.struct(*[_after(s[f"a{i}"], acc["h"][f"h{i}"], s[f"b{i}"]).alias(f"h{i}") for i in range(n)])
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(h if inclusive else acc["h"])).alias("out"))

    first = F.struct(*[c.alias(f"h{i}") for i, c in enumerate(start)])
    return F.aggregate("_arr", F.struct(first.alias("h"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def _expand(groups: DataFrame, above: DataFrame | None, keys: list[str], n: int, inclusive: bool) -> DataFrame:
    """One row an element again, with the state ``_h`` after (or before) it."""
    if above is not None:
        cond = F.col("_part") == F.col("_up_part")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_up{k}"))
        above = above.select(*[F.col(k).alias(f"_up{k}") for k in keys], F.col("_part").alias("_up_part"), F.col("_idx").alias("_up_idx"), F.col("_h").alias("_in"))
        groups = groups.join(above, cond & (F.col("_g") == F.col("_up_idx")), "left")
    start = [F.coalesce(F.col("_in")[f"h{i}"], F.lit(0.0)) if above is not None else F.lit(0.0) for i in range(n)]
    z = groups.select(*keys, "_part", F.explode(F.arrays_zip("_arr", _states(n, start, inclusive).alias("_h"))).alias("_z"))
    return z.select(*keys, "_part", "_z._arr.*", F.col("_z._h").alias("_h"))


def _carried(elements: DataFrame, keys: list[str], n: int, most_idx: int, most_part: int, block: int) -> DataFrame | None:
    """State before each element ``(keys, _part, _idx, _s)``; None where every key has a single element."""
    if most_idx == 0:
        if most_part == 0:
            return None
        elements = elements.select(*keys, F.lit(0).alias("_part"), F.col("_part").cast("bigint").alias("_idx"), "_s", F.col("_part").alias("_was"))
        groups = _groups(elements, keys, block, ["_was"])
        above = _carried(groups.select(*keys, "_part", F.col("_g").alias("_idx"), _total(n).alias("_s")), keys, n, most_part // block, 0, block)
        return _expand(groups, above, keys, n, False).select(*keys, F.col("_was").alias("_part"), F.lit(0).cast("bigint").alias("_idx"), "_h")
    groups = _groups(elements, keys, block, [])
    above = _carried(groups.select(*keys, "_part", F.col("_g").alias("_idx"), _total(n).alias("_s")), keys, n, most_idx // block, most_part, block)
    return _expand(groups, above, keys, n, False)


def affine_scan(df: DataFrame, key: str | Sequence[str], order: Sequence[str], maps: Sequence[tuple[Column, Column]], out: Sequence[str],
                block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """``h_t = a_t h_{t-1} + b_t`` per key in ``order`` (h before the first row is 0), one state column of ``out`` for each ``(a, b)`` of ``maps``.

    A null ``a`` or ``b`` passes the state on unchanged in that part (``a`` = 1, ``b`` = 0).  A null key is a key like any other.
    Rows that tie in ``order`` follow each other in no defined order, so ``order`` should end in an id.  Columns of map type cannot be carried."""
    keys, n = [key] if isinstance(key, str) else list(key), len(maps)
    s = F.struct(*[c for i, (a, b) in enumerate(maps) for c in (F.coalesce(a.cast("double"), F.lit(1.0)).alias(f"a{i}"),
                                                                F.coalesce(b.cast("double"), F.lit(0.0)).alias(f"b{i}"))])
    rows = range_partitions(df.select(F.struct(*df.columns).alias("_pay"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                      *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], s.alias("_s")),
                            [f"_k{i}" for i in range(len(keys))] + [f"_o{i}" for i in range(len(order))], parts)
    most_row, most_part = rows.agg(F.coalesce(F.max("_row"), F.lit(0)), F.coalesce(F.max("_part"), F.lit(0))).first()
    ks = [f"_k{i}" for i in range(len(keys))]
    elements = rows.select(*ks, "_part", F.col("_row").alias("_idx"), "_s", "_pay")
    folded = _groups(elements.drop("_pay"), ks, block, [])
    above = _carried(folded.select(*ks, "_part", F.col("_g").alias("_idx"), _total(n).alias("_s")), ks, n, most_row // block, most_part, block)
    z = _expand(_groups(elements, ks, block, ["_pay"]), above, ks, n, True)
    return z.select("_pay.*", *[F.col("_h")[f"h{i}"].alias(name) for i, name in enumerate(out)])


def softplus(c: Column) -> Column:
    """``ln(1 + e^c)`` without overflow."""
    return F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))


def selective_scan(df: DataFrame, key: str | Sequence[str], order: Sequence[str], x: Column, step: Column, b: Sequence[Column], c: Sequence[Column],
                   rates: Sequence[float], skip: float = 0.0, out: str = "y", block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Selective scan: with ``delta = softplus(step)`` and one state a rate ``A_n`` (negative to decay),

    ``h_n <- exp(delta A_n) h_n + delta b_n x``  and  ``y = sum_n c_n h_n + skip x``.

    Step, ``b`` and ``c`` are expressions of the row, so every row chooses what is kept and what is read.  A null ``x``
    counts as 0 and a null step leaves the states alone; a null ``b`` adds nothing, a null ``c`` reads nothing."""
    val, delta = F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(softplus(step.cast("double")), F.lit(0.0))
    d = df.select(F.struct(*df.columns).alias("_row_"), *([F.col(k).alias(f"_key{i}") for i, k in enumerate([key] if isinstance(key, str) else key)]),
                  *[F.col(o).alias(f"_ord{i}") for i, o in enumerate(order)], val.alias("_x"), delta.alias("_delta"),
                  *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"_{name}{i}") for name, es in (("b", b), ("c", c)) for i, e in enumerate(es)])
    maps = [(F.exp(F.col("_delta") * F.lit(float(r))), F.col("_delta") * F.col(f"_b{i}") * F.col("_x")) for i, r in enumerate(rates)]
    names = [f"_state{i}" for i in range(len(rates))]
    h = affine_scan(d, [f for f in d.columns if f.startswith("_key")], [f for f in d.columns if f.startswith("_ord")], maps, names, block, parts)
    y = F.lit(float(skip)) * F.col("_x")
    for i, name in enumerate(names):
        y = y + F.col(f"_c{i}") * F.col(name)
    return h.select("_row_.*", y.alias(out))
