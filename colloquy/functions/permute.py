"""Keyed permutations of 0..n-1 by arithmetic: an epoch's order without a sort or a shuffle an epoch.

A number below ``a * b`` (``a = ceil(sqrt(n))``, ``b = ceil(n / a)``) is a pair (l, r).  Rounds add a keyed function of one half to the other,
modulo a or b, by turns; each round can be undone, so together they permute the pairs (a Feistel network).  A result of n or more is
permuted again until it is below n (cycle walking): a cycle leaves the at most ``a`` surplus numbers for good, so this too permutes 0..n-1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = (1 << 31) - 1
FACTOR = 48_271
WALKS = 48           # a number is surplus with a chance of about 1 / sqrt(n); below some 2,000 rows 48 steps always end


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def keyed_permutation(pos: Column, n: int, *key: Column) -> Column:
    """Place of ``pos`` (0..n-1) in the permutation that ``key`` (strings) names.  ``n`` below 2^60."""
    a, b = sides(n)
    keys = F.array(*[F.struct(F.conv(F.substring(F.md5(F.concat_ws(":", *key, F.lit(str(i)))), 1, 7), 16, 10).cast("bigint").alias("k"),
                              F.lit(i % 2 == 0).alias("left")) for i in range(ROUNDS)])

    def mixed(v, k):
        w = (v + k) % PRIME
        return (w * w) % PRIME * FACTOR % PRIME

    def step(acc, e):
        return F.when(e["left"], F.struct(((acc["l"] + mixed(acc["r"], e["k"])) % a).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), ((acc["r"] + mixed(acc["l"], e["k"])) % b).alias("r")))

    def once(x):
        pair = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), (x % b).alias("r")) if n < 1 << 50 else F.struct(
            ((x - x % b).cast("decimal(20,0)") / F.lit(b)).cast("bigint").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, pair, step, lambda p: p["l"] * F.lit(b).cast("bigint") + p["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(pos.cast("bigint")), lambda x, _: F.when(x >= n, once(x)).otherwise(x))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation did not end")).cast("bigint"))
