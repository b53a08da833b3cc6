"""Embedding whitening from an exact, bit-sliced scatter matrix.

A component ``c`` becomes the integer ``x = floor(256 c)``.  The fit list holds each distinct integer vector once.
Every dimension is shifted to start at 0 and cut into bit planes; the planes of a block of rows are packed into
64-bit words, so the cross-product of two dimensions is a sum of ``2^(p+q) * popcount(plane p AND plane q)``, exact in
integers.  ``n * sum(x_i x_j) - S_i S_j`` is centred as an integer before the one division that makes it a covariance;
``eigh`` then gives the components, numbered from 1 by falling eigenvalue, signs set so that the entry of largest
magnitude is positive.

Spark deals the rows: blocks emit one partial number a pair of dimensions, which are summed by partial and final
aggregation.  Only sums over dimensions (their number depends on the width of the vectors, never on the rows) reach the
driver.  Equal vectors meet in ``distinct``, which combines them before the shuffle, so a hot vector is no hot task.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are left out, as are vectors
of another length than the most distinct vectors have (ties: the longer).  Null and repeated ids stay, one output row
set each.  An empty table gives an empty result; fewer dimensions than components give fewer components.  A component
without variance has whitened 0 and explained 0 and takes no part in the identity error.  ``deviation`` is null where
it does not fit a long; ``deviation_digits`` always holds its digits.  Values of ``256 c`` beyond a long are held at
its ends.  Only id and vector columns are read, so columns of clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize

SCALE = 256
COMPONENTS = 4
BLOCK_VALUES = 1 << 20         # entries of one packed block
LIMB = 22                      # bits of a weight that are kept in one partial sum: 2 * 22 + 14 bits of rows fit a long
BLOCK_ROWS = 1 << 14
_LONG = 1 << 63


def integer_vectors(df: DataFrame, vector: str, scale: int = SCALE):
    """Condition of usable vectors and the expression of their integer form."""
    c = F.col(vector)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad, F.transform(c, lambda v: F.floor(v.cast("double") * float(scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(64, min(BLOCK_ROWS, BLOCK_VALUES // x.shape[1]))
    for at in range(0, len(x), step):
        yield x[at:at + step]


def usual_width(fit: DataFrame) -> int | None:
    """Length of most vectors of ``fit(x)``, the longer one on ties."""
    first = fit.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return None if first is None else first["w"]


def extents(fit: DataFrame, width: int) -> list[tuple[int, int]]:
    """Smallest and largest value of every dimension."""
    def of(batches):
        for b in batches:
            x = matrix(b.column(0), width)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))],
                                                 names=["i", "lo", "hi"])

    parts = fit.select("x").mapInArrow(of, "i int, lo bigint, hi bigint")
    rows = parts.groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    return [(r["lo"], r["hi"]) for r in sorted(rows, key=lambda r: r["i"])]


class Planes:
    """Bit planes of shifted integer columns, ordered by (dimension, bit)."""

    def __init__(self, bounds: list[tuple[int, int]]):
        self.low = np.array([lo for lo, _ in bounds], dtype=np.int64)
        bits = [(hi - lo).bit_length() for lo, hi in bounds]
        self.dim = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.concatenate([np.arange(b) for b in bits]) if self.dim.size else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(bits)])            # first plane of each dimension

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(plane, word): bit r of a word is the plane's bit of row r.  Rows that pad the last word hold no bits."""
        u = x.astype(np.uint64) - self.low.astype(np.uint64)           # modulo 2^64, exact for every range of longs
        rows = -(-len(x) // 64) * 64
        out = np.zeros((self.dim.size, rows // 8), dtype=np.uint8)
        for k, (i, p) in enumerate(zip(self.dim, self.bit)):
            packed = np.packbits(((u[:, i] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8))
            out[k, :packed.size] = packed
        return out.view(np.uint64)

    def scatter(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(i, j, limb, value)``: parts ``value * 2^(LIMB * limb)`` of the sums of ``u_i u_j`` (i <= j) and, with j = -1, of ``u_i``."""
        group = np.flatnonzero(np.diff(self.dim * 8 + self.bit // LIMB, prepend=-1))         # starts of (dimension, limb)
        group_dim, group_limb = self.dim[group], self.bit[group] // LIMB
        weight = np.int64(1) << (self.bit % LIMB)
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        for i, limb, value in zip(group_dim, group_limb, np.add.reduceat(ones * weight, group)):
            yield int(i), -1, int(limb), int(value)
        for i in np.unique(self.dim):
            start = self.first[i]
            here = np.searchsorted(group, start)
            sums = np.zeros((7, len(group) - here), dtype=np.int64)
            for k in range(start, self.first[i + 1]):
                both = np.bitwise_count(words[k] & words[start:]).sum(axis=1, dtype=np.int64) * weight[start:]
                sums[self.bit[k] // LIMB] += np.add.reduceat(both, group[here:] - start) * weight[k]
            for g in np.flatnonzero(sums.any(axis=1)):
                for j, limb, value in zip(group_dim[here:], group_limb[here:], sums[g]):
                    if value:
                        yield int(i), int(j), int(g + limb), int(value)


def exact_scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums ``S`` and the matrix ``n * sum(x_i x_j) - S_i S_j`` of ``fit(x)``, all exact Python integers."""
    bounds = extents(fit, width)
    planes = Planes(bounds)

    def partial(batches):
        for b in batches:
            for x in _blocks(matrix(b.column(0), width)):
                rows = [(-1, -1, 0, len(x)), *(planes.scatter(planes.pack(x)) if planes.dim.size else ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                                 names=["i", "j", "limb", "value"])

    sums = (fit.select("x").mapInArrow(partial, "i int, j int, limb int, value bigint")
            .groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    n, one, two = 0, [0] * width, [[0] * width for _ in range(width)]
    for r in sums:
        value = int(r["value"]) << (LIMB * r["limb"])
        if r["i"] < 0:
            n += value
        elif r["j"] < 0:
            one[r["i"]] += value
        else:
            two[r["i"]][r["j"]] += value
    centred = [[0] * width for _ in range(width)]
    for i in range(width):
        for j in range(i, width):
            centred[i][j] = centred[j][i] = n * two[i][j] - one[i] * one[j]       # the shift falls out
    return n, [one[i] + n * bounds[i][0] for i in range(width)], centred


def principal(n: int, centred: list[list[int]], components: int | None):
    """Unit eigenvectors (columns), eigenvalues by falling size and shares of the trace, of the covariance ``centred / n^2``."""
    cov = np.array([[v / (n * n) for v in row] for row in centred])              # one correctly rounded division an entry
    e, v = np.linalg.eigh(cov)
    k = len(e) if components is None else min(components, len(e))
    e, v = e[::-1][:k].copy(), v[:, ::-1][:, :k].copy()
    v *= np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    trace = sum(centred[i][i] for i in range(len(centred))) / (n * n)
    e[e <= trace * len(cov) * np.finfo(float).eps] = 0.0
    return v, e, e / trace if trace else np.zeros(k)


class Whitener:
    """Whitening of one table: ``n``, ``S``, components, and what rows need for exact deviations."""

    def __init__(self, n: int, sums: list[int], centred: list[list[int]], bounds: list[tuple[int, int]], components: int | None):
        self.n, self.sums, self.width = n, sums, len(sums)
        self.vectors, self.values, self.explained = principal(n, centred, components)
        far = [max(n * hi - s, s - n * lo) for (lo, hi), s in zip(bounds, sums)]
        self.native = max(max(far), *(n * max(abs(lo), abs(hi)) for lo, hi in bounds), *map(abs, sums)) < _LONG // 2
        self.fits = sum(f * f for f in far) < _LONG

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: longs, or Python integers where longs cannot hold them."""
        return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64) if self.native else x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def squares(self, d: np.ndarray) -> list[int]:
        """Exact sums of squares of the rows of ``d``, by 24-bit limbs."""
        if self.native and self.fits:
            return (d * d).sum(axis=1).tolist()
        a, m = np.abs(d), (1 << 24) - 1
        l0, l1, l2 = a & m, (a >> 24) & m, a >> 48
        parts = (l0 * l0, 2 * l0 * l1, 2 * l0 * l2 + l1 * l1, 2 * l1 * l2, l2 * l2)
        return [sum(v << (24 * s) for s, v in enumerate(row)) for row in zip(*(p.sum(axis=1).tolist() for p in parts))]

    def whiten(self, d: np.ndarray) -> np.ndarray:
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros_like(self.values), where=self.values > 0)
        return (d.astype(np.float64) / self.n) @ self.vectors * scale


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured on the rows."""
    k = len(w.values)

    def products(batches):
        for b in batches:
            for x in _blocks(matrix(b.column(0), w.width)):
                z = w.whiten(w.deviations(x))
                i, j = np.triu_indices(k)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((z.T @ z)[i, j])], names=["i", "j", "v"])

    rows = fit.select("x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max([0.0, *(abs(r["v"] / w.n - (r["i"] == r["j"])) for r in rows if w.values[r["i"]] > 0 and w.values[r["j"]] > 0)])


def whiten(df: DataFrame, components: int | None = None, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row per usable row of ``df`` and component: ``(id, component, n, deviation, whitened, explained, identity_error,
    deviation_digits)``.  ``components=None``: all of them."""
    usable, x = integer_vectors(df, vector, scale)
    rows = df.filter(usable).select(F.col(id_col), x.alias("x"))
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    width = usual_width(fit)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double, deviation_digits string")
    if width is None:
        return df.sparkSession.createDataFrame([], schema)
    fit, rows = (t.filter(F.size("x") == width) for t in (fit, rows))
    n, sums, centred = exact_scatter(fit, width)
    w = Whitener(n, sums, centred, extents(fit, width), components)
    error, k = identity_error(fit, w), len(w.values)

    def out(batches):
        for b in batches:
            ids = b.column(0)
            at = 0
            for x in _blocks(matrix(b.column(1), width)):
                d = w.deviations(x)
                square = w.squares(d)
                take = np.repeat(np.arange(len(x)), k)
                m = len(take)
                fit_long = pa.array([v if v < _LONG else None for v in square], pa.int64()).take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(x)).take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(m, n, dtype=np.int64)), fit_long, pa.array(w.whiten(d).ravel()),
                     pa.array(np.tile(w.explained, len(x))), pa.array(np.full(m, error)),
                     pa.array([str(v) for v in square]).take(pa.array(take))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])
                at += len(x)

    return rows.mapInArrow(out, schema)
