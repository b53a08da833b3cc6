"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner product becomes smallest distance by one more coordinate (``sqrt(M^2 - |x|^2)`` for a
vector, 0 for the scaled query).  Each of ``PROJECTIONS`` random directions gives one array of
projected vectors, sorted.  A query looks at the window around its own projection in every array;
the windows grow by a factor (virtual rehashing: no new hash tables).  Vectors whose collision count exceeds ``THRESHOLD`` of the projections
are verified by their exact inner product; growth stops when ``CANDIDATES`` of the block were verified.

Spark deals vectors into blocks and queries into blocks of bounded size; each (query block, vector
block) cell is one task group, so nothing is broadcast and memory does not grow with the table.  The
per-cell winners meet in one window per query.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components take no part;
a row without vec_id takes no part; vectors of different lengths never meet.  Repeated rows are rows of
their own.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import bucket_count, materialize

K = 20
QUERY_EVERY = 20
PROJECTIONS = 96           # at most 255
PAGES = 256
THRESHOLD = 0.65
CANDIDATES = 0.15
FIRST_WIDTH = 0.4
GROWTH = 1.1
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
PILOTS = 8
SEED = 7


def _lift(v: np.ndarray) -> np.ndarray:
    n = (v * v).sum(axis=1)
    return np.column_stack([v, np.sqrt(np.maximum(n.max() - n, 0.0))])


def search_block(q: np.ndarray, v: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray):
    """For each query (``own``: its row of ``v`` or -1) the k best verified rows: (query, row, score)."""
    n, d = v.shape
    rng = np.random.default_rng(SEED)
    dirs = rng.standard_normal((d + 1, PROJECTIONS))
    lifted = _lift(v / np.abs(v).max())                     # squares of huge or tiny components stay finite
    radius = np.sqrt((lifted[0] ** 2).sum())
    proj = lifted @ dirs / max(radius, 1e-300)
    unit = q / np.abs(q).max(axis=1, keepdims=True)
    centre = np.column_stack([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros(len(q))]) @ dirs
    order = np.argsort(proj, axis=0, kind="stable")
    arrays = np.take_along_axis(proj, order, axis=0).T.copy()
    order = order.T
    need, enough = THRESHOLD * PROJECTIONS, min(n, max(10 * k, int(CANDIDATES * n)))
    # the sorted arrays are read in PAGES pages; a window is the run of pages that it touches
    page = np.empty((PROJECTIONS, n), dtype=np.uint8)
    place = (np.arange(n, dtype=np.int64) * PAGES // n)
    for j in range(PROJECTIONS):
        page[j, order[j]] = place
    windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def window(level: int):
        """First page and number of pages less one of every query's windows at a level of widening."""
        if level not in windows:
            width = FIRST_WIDTH * GROWTH ** level
            first = np.stack([np.searchsorted(arrays[j], centre[:, j] - width) for j in range(PROJECTIONS)])
            last = np.stack([np.searchsorted(arrays[j], centre[:, j] + width) for j in range(PROJECTIONS)])
            empty = last <= first
            first, last = np.minimum(first, n - 1), np.maximum(last - 1, 0)
            lo = place[first].astype(np.uint8)
            windows[level] = lo, np.where(empty, 0, place[np.maximum(last, first)] - lo).astype(np.uint8)
        return windows[level]

    def collisions(i: int, level: int) -> np.ndarray:
        """Rows in at least the threshold of the query's windows."""
        lo, more = window(level)
        hit = (page - lo[:, i, None]) <= more[:, i, None]
        return np.flatnonzero(np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8) >= need)

    def first_level(i: int, level: int) -> tuple[int, np.ndarray]:
        while len(rows := collisions(i, level)) < enough:
            level += 1
        return level, rows

    # widening starts at the level that pilot queries need; a query that needs more goes on from there
    pilot = sorted(first_level(i, 0)[0] for i in range(0, len(q), max(1, len(q) // PILOTS)))
    start = pilot[len(pilot) // 2]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        cand = first_level(i, start)[1]
        cand = cand[cand != own[i]]
        score = v[cand] @ q[i]
        if len(cand) > k:                                   # all ties of the k-th score stay in
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            cand, score = cand[near], score[near]
        best = np.lexsort((ids[cand], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_v.append(cand[best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found."""
    v = F.col("embedding").cast("array<double>")
    good = F.expr("embedding is not null and vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and "
                  "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = materialize(vectors.filter(good).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"),
                                                   F.size("embedding").alias("dim"), v.alias("v")), "vectors")
    queries = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0)
    n, n_q = rows.count(), queries.count()
    n_db, n_qb = bucket_count(n, ROWS_PER_BLOCK), bucket_count(n_q, QUERIES_PER_BLOCK)
    db, qb = F.pmod(F.xxhash64(F.lit("d"), "uid"), F.lit(n_db)), F.pmod(F.xxhash64(F.lit("q"), "uid"), F.lit(n_qb))
    left = queries.select("dim", qb.alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_db - 1).cast("long"))).alias("db"), "uid", "vec_id", "v")
    right = rows.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_qb - 1).cast("long"))).alias("qb"), db.alias("db"), "uid", "vec_id", "v")

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["quid", "query_id", "uid", "vec_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in cols})
        a, b = a.sort_values("uid"), b.sort_values("uid")
        at = {u: i for i, u in enumerate(b["uid"])}
        own = np.array([at.get(u, -1) for u in a["uid"]])
        ids = b["vec_id"].to_numpy()
        qi, vi, s = search_block(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), k, own, ids)
        return pd.DataFrame({"quid": a["uid"].to_numpy()[qi], "query_id": a["vec_id"].to_numpy()[qi],
                             "uid": b["uid"].to_numpy()[vi], "vec_id": ids[vi], "score": s})

    keys = ["dim", "qb", "db"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        cell, "quid bigint, query_id bigint, uid bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
