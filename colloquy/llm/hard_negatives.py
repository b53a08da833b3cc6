"""Hard-negative mining by best-first descent of a cover tree over norm-augmented candidates.

A component ``c`` becomes the integer ``floor(256 c)``.  Each candidate gets one more coordinate, ``sqrt(M^2 - |x|^2)``, so all
lie on a sphere of radius M and an anchor's inner product with a candidate is ``|q| M cos(angle)``; the anchor's extra coordinate
is 0.  A node of the cover tree has a centre (one of its points) and a covering radius, the largest angle to a point under it,
so ``|q| M cos(angle(q, centre) -+ radius)`` bounds every inner product below it from both sides.  Radii are taken from the
points themselves, and bounds are widened by the rounding of angles: results are exact.

* The top of the tree is built over a bounded sample (``SAMPLE_ROWS``); every row then descends to its cell, and the radii
  of the top are those of all rows.  Neighbouring cells are packed into shards of about ``SHARD_ROWS`` rows; a larger cell is
  dealt over several shards by a hash.  Each shard builds the lower levels in one task and is stored as one row.
* Anchors go down the top in tasks; only shards that can hold a row of a wanted score window are met, by blocks of
  at most about ``BLOCK_ANCHORS`` anchors.  Inside a shard the anchors of a block descend level by level, skip nodes outside
  the windows or wholly of an unwanted label, and verify leaves best first, by exact inner products.
* Positives: an anchor first meets one shard near it; the score of its fifth row there bounds the search of all others.
  Negatives: one window a positive, searched together.

Equal vectors of one label can only differ by id, so of each such group the first ids (one more than any list needs) enter the tree:
a row limit before the shuffle, exact, and no group of copies is one task.

Defined results: rows with a null label, a null or empty vector, a null or non-finite component, or another length than
most distinct vectors take no part.  Repeated rows are rows of their own.  Null ids are no anchors and come last among ties.
An empty table, or one without anchors, gives an empty result.  Inner products beyond a long raise an error.  Only the id, label
and vector columns are read, so columns of clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import materialize
from colloquy.llm.whitening import SCALE, integer_vectors, matrix, usual_width

POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100          # a negative's score lies within these hundredths of the positive's
SAMPLE_ROWS = 65_536
SHARD_ROWS = 1024
CELL_SAMPLE = 16               # a cell of the top holds at least about so many sampled rows
BLOCK_ANCHORS = 1024
LEAF = 24
FAN = 16
_FAR = 1 << 62


@dataclass
class Tree:
    """Cover tree, nodes in breadth-first order; ``order[lo:hi]`` are a node's points."""
    order: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    centre: np.ndarray         # point of each node
    radius: np.ndarray         # largest angle from the centre to a point below
    child: np.ndarray          # first child, or -1
    children: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def build_tree(p: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    """``p``: points on the unit sphere.  A node's children cover it by half its radius, or are ``fan`` farthest-first centres."""
    order = np.arange(len(p))
    mean = p.mean(axis=0)
    nodes = [dict(parent=-1, level=0, centre=int(np.argmax(p @ mean)), lo=0, hi=len(p), child=-1, children=0)]
    radii = []
    at = 0
    while at < len(nodes):
        node = nodes[at]
        members = order[node["lo"]:node["hi"]]
        near = _angle(p[members] @ p[node["centre"]])
        radius = float(near.max())
        radii.append(radius)
        if len(members) > leaf and radius > 0:
            centres, owner = [node["centre"]], np.zeros(len(members), dtype=np.int64)
            while len(centres) < fan and (len(centres) == 1 or near.max() > radius / 2) and near.max() > 0:
                centres.append(int(members[np.argmax(near)]))
                mine = _angle(p[members] @ p[centres[-1]])
                owner[mine < near] = len(centres) - 1
                near = np.minimum(mine, near)
            by = np.argsort(owner, kind="stable")
            order[node["lo"]:node["hi"]] = members[by]
            ends = np.searchsorted(owner[by], np.arange(len(centres) + 1)) + node["lo"]
            kids = [(c, int(a), int(b)) for c, a, b in zip(centres, ends, ends[1:]) if b > a]
            if len(kids) > 1:
                node["child"], node["children"] = len(nodes), len(kids)
                nodes += [dict(parent=at, level=node["level"] + 1, centre=c, lo=a, hi=b, child=-1, children=0) for c, a, b in kids]
        at += 1
    column = {k: np.array([n[k] for n in nodes], dtype=np.int64) for k in nodes[0]}
    return Tree(order=order, radius=np.array(radii), **column)


def _sphere(x: np.ndarray, m2: int) -> np.ndarray:
    """Integer vectors with the extra coordinate, scaled to the unit sphere."""
    f = x.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(m2 - (f * f).sum(axis=1), 0.0))]) / max(np.sqrt(m2), 1e-300)


def bounds(dots: np.ndarray, radius: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner products under nodes, given those with their centres; ``scale`` is |q| M."""
    angle, slack = _angle(dots / np.maximum(scale, 1e-300)), scale * 1e-6 + 1e-6
    return (np.where(angle + radius >= np.pi, -1.0, np.cos(angle + radius)) * scale - slack,
            np.where(angle <= radius, 1.0, np.cos(angle - radius)) * scale + slack)


class Top:
    """Top of the tree: a bounded number of nodes; its leaves are the cells, in the order of the tree's points."""

    def __init__(self, x: np.ndarray, m2: int, rows: int):
        share = len(x) / max(rows, 1)
        self.m2, self.tree = m2, build_tree(_sphere(x, m2), leaf=max(CELL_SAMPLE, int(SHARD_ROWS * share / 4)))
        self.x, self.unit = x[self.tree.centre].astype(np.float64), _sphere(x[self.tree.centre], m2)
        leaves = np.flatnonzero(self.tree.child < 0)
        self.cells = leaves[np.argsort(self.tree.lo[leaves], kind="stable")]       # cell -> node
        self.cell_of = np.full(len(self.tree.lo), -1)
        self.cell_of[self.cells] = np.arange(len(self.cells))
        self.depth = int(self.tree.level.max()) + 1
        self.radius = np.zeros(len(self.tree.lo))

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every row, and its angles to the centres on the way (rows, depth), 0 below the cell."""
        p, t = _sphere(x, self.m2), self.tree
        node, angles = np.zeros(len(p), dtype=np.int64), np.zeros((len(p), self.depth))
        angles[:, 0] = _angle(p @ self.unit[0])
        for level in range(1, self.depth):
            for k in np.unique(node[t.child[node] >= 0]):
                mine = np.flatnonzero(node == k)
                near = p[mine] @ self.unit[t.child[k]:t.child[k] + t.children[k]].T
                best = near.argmax(axis=1)
                node[mine], angles[mine, level] = t.child[k] + best, _angle(near[np.arange(len(mine)), best])
        return self.cell_of[node], angles

    def cover(self, cell: int, angles: list[float]) -> None:
        """Widens the nodes above a cell to the largest angles of its rows."""
        k = self.cells[cell]
        while k >= 0:
            self.radius[k] = max(self.radius[k], angles[self.tree.level[k]])
            k = self.tree.parent[k]

    def met(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchor, cell): may the cell hold a row whose score lies in one of the anchor's windows (``low``, ``high``: anchor, window)."""
        scale = np.sqrt((q * q).sum(axis=1)) * np.sqrt(self.m2)
        alive = np.zeros((len(q), len(self.tree.lo)), dtype=bool)
        for level in range(self.depth):
            here = np.flatnonzero(self.tree.level == level)
            least, most = bounds(q @ self.x[here].T, self.radius[here], scale[:, None])
            fits = np.zeros(least.shape, dtype=bool)
            for w in range(low.shape[1]):
                fits |= (least <= high[:, w, None]) & (most >= low[:, w, None])
            alive[:, here] = fits & (alive[:, self.tree.parent[here]] if level else True)
        return alive[:, self.cells]


def _shard_row(shard: int, pdf: pd.DataFrame, m2: int) -> tuple:
    x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
    t = build_tree(_sphere(x, m2))
    kinds, code = np.unique(pdf["label"].to_numpy(dtype=str), return_inverse=True)
    code = code[t.order]
    pure = np.array([code[a] if (code[a:b] == code[a]).all() else -1 for a, b in zip(t.lo, t.hi)])
    blob = [a.astype(np.int64).tobytes() for a in (x[t.order], x[t.centre], t.parent, t.level, t.child, t.lo, t.hi, pure, code, pdf["uid"].to_numpy()[t.order])]
    ids = pdf["id"].to_numpy(dtype=object)[t.order]
    return (shard, *blob, t.radius.tobytes(), list(kinds), [None if v is None else str(v) for v in ids])


_SHARD = ("shard bigint, x binary, centre binary, parent binary, level binary, child binary, lo binary, hi binary, pure binary, code binary, "
          "uid binary, radius binary, kinds array<string>, id array<string>")


class Shard:
    """Lower levels of the tree of one shard, read back from its stored row."""

    def __init__(self, row: dict, width: int):
        read = lambda k: np.frombuffer(row[k], dtype=np.int64)
        self.x, self.centre = read("x").reshape(-1, width), read("centre").reshape(-1, width)
        self.parent, self.level, self.child, self.lo, self.hi = (read(k) for k in ("parent", "level", "child", "lo", "hi"))
        self.pure, self.code, self.uid = (read(k) for k in ("pure", "code", "uid"))
        self.radius = np.frombuffer(row["radius"], dtype=np.float64)
        self.kinds, self.id = {k: i for i, k in enumerate(row["kinds"])}, row["id"]
        exact = width * float(np.abs(self.x).max()) ** 2 < 2.0 ** 52
        self.kind = np.float64 if exact else np.int64                  # whole numbers below 2^53 are exact in either
        self.points = self.x.astype(self.kind)

    def search(self, q: np.ndarray, labels: list[str], uids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, m2: int, key):
        """For every anchor and window the first ``k`` rows: arrays ``(anchor, window, score, row of the shard)``.  ``key``: sort key of an id.

        The anchors of a block descend together.  A level's nodes are bounded for the anchors whose parents are alive; every anchor then
        takes its leaves by falling upper bound, 1, 2, 4, ... of them a round, and a leaf that has fallen below the anchor's k-th scores
        by its turn is skipped."""
        n, windows = len(q), low.shape[1]
        own = np.array([self.kinds.get(v, -2) for v in labels])
        scale = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt(m2)
        least, most = bounds(q.astype(np.float64) @ self.centre.T.astype(np.float64), self.radius, scale[:, None])
        alive = np.zeros(most.shape, dtype=bool)
        for level in range(self.level.max() + 1):
            here = np.flatnonzero(self.level == level)
            if level:
                most[:, here] = np.minimum(most[:, here], most[:, self.parent[here]])
            fits = np.zeros((n, len(here)), dtype=bool)
            for w in range(windows):
                fits |= (least[:, here] <= high[:, w, None]) & (most[:, here] >= low[:, w, None])
            unwanted = (self.pure[here] >= 0) & ((self.pure[here] == own[:, None]) != same)
            alive[:, here] = fits & ~unwanted & (alive[:, self.parent[here]] if level else True)
        leaves = np.flatnonzero(self.child < 0)
        most, least, alive = most[:, leaves], least[:, leaves], alive[:, leaves]
        order = np.argsort(np.where(alive, -most, np.inf), axis=1, kind="stable")
        rank = np.empty(len(self.id), dtype=np.int64)
        rank[sorted(range(len(self.id)), key=lambda i: (key(self.id[i]), self.uid[i]))] = np.arange(len(self.id))
        anchors, floor = q.astype(self.kind), low.copy()
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))                      # anchor * windows + window, score, row
        done, take = 0, 1
        while done < len(leaves):
            turn = np.zeros(alive.shape, dtype=bool)
            np.put_along_axis(turn, order[:, done:done + take], True, axis=1)
            useful = np.zeros(alive.shape, dtype=bool)
            for w in range(windows):
                useful |= (least <= high[:, w, None]) & (most >= floor[:, w, None])
            alive &= useful
            if not alive.any():
                break
            turn &= alive
            alive &= ~turn
            done, take = done + take, 2 * take
            met = []
            for leaf in np.flatnonzero(turn.any(axis=0)):
                who, rows = np.flatnonzero(turn[:, leaf]), slice(self.lo[leaves[leaf]], self.hi[leaves[leaf]])
                scores = anchors[who] @ self.points[rows].T
                i, j = np.nonzero(((self.code[rows] == own[who, None]) == same) & (self.uid[rows] != uids[who, None])
                                  & (scores >= floor[who].min(axis=1)[:, None]) & (scores <= high[who].max(axis=1)[:, None]))
                met.append((who[i], scores[i, j].astype(np.int64), rows.start + j))
            if not met:
                continue
            a, s, r = (np.concatenate(c) for c in zip(*met))
            found = [best]
            for w in range(windows):
                fits = np.flatnonzero((s >= floor[a, w]) & (s <= high[a, w]))
                found.append((a[fits] * windows + w, s[fits], r[fits]))
            g, s, r = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((rank[r], -s, g))
            g, s, r = g[by], s[by], r[by]
            place = np.arange(len(g)) - np.searchsorted(g, g)
            best = tuple(c[place < k] for c in (g, s, r))
            last = place == k - 1
            floor[g[last] // windows, g[last] % windows] = s[last]
        return best[0] // windows, best[0] % windows, best[1], best[2]


def _id_key(numeric: bool):
    """Sort key of an id held as text: null last."""
    return (lambda v: (v is None, int(v) if v is not None else 0)) if numeric else (lambda v: (v is None, v or ""))


class Index:
    """Cover tree of the rows ``points(uid, id, label, x)``: top in memory (bounded), shards as a stored table."""

    def __init__(self, points: DataFrame, width: int, m2: int, keep: int, numeric: bool):
        self.spark, self.width, self.m2, self.numeric = points.sparkSession, width, m2, numeric
        first = W.partitionBy("x", "label").orderBy(F.asc_nulls_last("id"), "uid")
        kept = points.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= keep).drop("_r")
        kept = materialize(kept, "negatives-kept")
        rows = kept.count()
        share = min(1.0, SAMPLE_ROWS / max(rows, 1))
        sample = kept if share >= 1 else kept.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(share * (1 << 30)))
        x = matrix(sample.select("uid", "x").orderBy("uid").toArrow().column("x"), width)
        self.top = top = Top(x if len(x) else np.zeros((1, width), dtype=np.int64), m2, rows)

        def assign(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                cell, angles = top.descend(matrix(b.column(3), width))
                way = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), top.depth).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), way], names=["uid", "id", "label", "x", "cell", "way"])

        schema = f"uid bigint, id {dict(kept.dtypes)['id']}, label string, x array<bigint>, cell bigint, way array<double>"
        dealt = materialize(kept.select("uid", "id", "label", "x").mapInArrow(assign, schema), "negatives-cells")
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.get("way", F.lit(i))).alias(f"a{i}") for i in range(top.depth)]).collect()
        count = np.zeros(len(top.cells), dtype=np.int64)
        for r in sizes:
            count[r["cell"]] = r["n"]
            top.cover(r["cell"], [r[f"a{i}"] for i in range(top.depth)])
        # neighbouring cells share a shard; a cell beyond SHARD_ROWS is dealt over shards of its own
        self.first, self.chunks = np.zeros(len(count), dtype=np.int64), np.zeros(len(count), dtype=np.int64)
        shard, filled = 0, 0
        for c, n in enumerate(count.tolist()):
            if filled and filled + n > SHARD_ROWS:
                shard, filled = shard + 1, 0
            self.first[c], self.chunks[c] = shard, -(-n // SHARD_ROWS)
            if n > SHARD_ROWS:
                shard, filled = shard + int(self.chunks[c]), 0
            else:
                filled += n
        deal = self.spark.createDataFrame([(c, int(f), int(k)) for c, (f, k) in enumerate(zip(self.first, self.chunks)) if k], "cell bigint, first bigint, chunks bigint")
        placed = dealt.drop("way").join(F.broadcast(deal), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("chunks")))
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_shard_row(int(pdf["shard"].iloc[0]), pdf, m2)], columns=[f.split()[0] for f in _SHARD.split(", ")])

        # ids travel as text: exact beside nulls
        self.shards = materialize(placed.select("shard", "uid", F.col("id").cast("string").alias("id"), "label", "x")
                                  .groupBy("shard").applyInPandas(build, _SHARD), "negatives-shards")

    def meet(self, anchors: DataFrame, near: bool = False) -> DataFrame:
        """``anchors(uid, label, q, low, high, home)`` with the ``shard`` s that they must search (never ``home``).  ``near``: just one."""
        top, first, chunks, width = self.top, self.first, self.chunks, self.width

        def route(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                if not b.num_rows:
                    continue
                q = matrix(b.column(2), width)
                if near:
                    cell, _ = top.descend(q)
                    who, where = np.arange(len(q)), np.where(chunks[cell] > 0, first[cell], 0)
                else:
                    low, high = (_padded(b.column(i), fill) for i, fill in ((3, _FAR), (4, -_FAR)))
                    a, c = np.nonzero(top.met(q.astype(np.float64), low, high))
                    a, c = np.repeat(a, chunks[c]), np.repeat(c, chunks[c])
                    step = np.arange(len(c)) - np.searchsorted(a * len(chunks) + c, a * len(chunks) + c)
                    pairs = np.unique(np.column_stack([a, first[c] + step]), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
                    home = b.column(5).fill_null(-1).to_numpy(zero_copy_only=False)
                    pairs = pairs[pairs[:, 1] != home[pairs[:, 0]]]
                    who, where = pairs[:, 0], pairs[:, 1]
                for at in range(0, len(who), 4096):
                    part = pa.array(who[at:at + 4096])
                    yield pa.RecordBatch.from_arrays([*(col.take(part) for col in b.columns), pa.array(where[at:at + 4096])], names=[*b.schema.names, "shard"])

        return anchors.mapInArrow(route, "uid bigint, label string, q array<bigint>, low array<bigint>, high array<bigint>, home bigint, shard bigint")

    def search(self, met: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
        """First ``k`` rows a met (anchor, shard) and window: ``(uid, window, score, row, id, shard)``."""
        width, m2, numeric = self.width, self.m2, self.numeric
        groups = (met.withColumn("_b", F.pmod(F.xxhash64("uid"), F.lit(blocks))).groupBy("shard", "_b")
                  .agg(F.collect_list(F.struct("uid", "label", "q", "low", "high")).alias("anchors")))

        def find(batches: Iterator[pa.RecordBatch]):
            key = _id_key(numeric)
            for b in batches:
                for i in range(b.num_rows):
                    row = {n: b.column(n)[i].as_py() for n in b.schema.names if n != "anchors"}
                    anchors = b.column("anchors").slice(i, 1).flatten()
                    uids, labels, q, low, high = anchors.flatten()
                    shard = Shard(row, width)
                    a, w, s, r = shard.search(matrix(q, width), labels.to_pylist(), uids.to_numpy(), _padded(low, _FAR), _padded(high, -_FAR), same, k, m2, key)
                    yield pa.RecordBatch.from_arrays([uids.take(pa.array(a)), pa.array(w.astype(np.int32)), pa.array(s), pa.array(shard.uid[r]), pa.array(shard.id, pa.string()).take(pa.array(r)),
                                                      pa.array(np.full(len(a), row["shard"]))], names=["uid", "window", "score", "row", "id", "shard"])

        return groups.join(self.shards, "shard").drop("_b").mapInArrow(find, "uid bigint, window int, score bigint, row bigint, id string, shard bigint")


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    """Lists of up to a few windows as a matrix; missing windows hold ``fill``, which nothing fits."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), fill, dtype=np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _first(found: DataFrame, k: int, id_type: str) -> DataFrame:
    """First ``k`` rows of every (anchor, window): score falling, id, row."""
    d = found.withColumn("id", F.col("id").cast(id_type))
    order = W.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each of an anchor's first ``positives`` other rows
    of its label, the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's.
    ``anchor``: condition on ``df`` (null: no)."""
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score bigint, negative_score bigint"
    usable, x = integer_vectors(df, vector, scale)
    points = materialize(df.filter(usable & F.col(label).isNotNull())
                         .select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"),
                                 x.alias("x"), F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor")), "negatives-points")
    width = usual_width(points.select("x").distinct())
    if width is None:
        return spark.createDataFrame([], schema)
    points = points.filter(F.size("x") == width)
    square = F.aggregate(F.transform("x", lambda v: v.cast("double") * v), F.lit(0.0), lambda a, v: a + v)
    m2, n = points.agg(F.max(square), F.sum(F.col("is_anchor").cast("long"))).first()
    if m2 >= 2.0 ** 62:
        raise ValueError("inner products do not fit a long")
    if not n:
        return spark.createDataFrame([], schema)
    numeric = id_type in ("tinyint", "smallint", "int", "bigint")
    index = Index(points.drop("is_anchor"), width, int(m2), max(positives, negatives) + 1, numeric)
    blocks = -(-n // BLOCK_ANCHORS)
    anchors = points.filter("is_anchor").select("uid", "label", F.col("x").alias("q"))
    wide = [F.array(F.lit(v).cast("bigint")).alias(c) for c, v in (("low", -_FAR), ("high", _FAR))]
    close = materialize(index.search(index.meet(anchors.select("*", *wide, F.lit(None).cast("bigint").alias("home")), near=True), blocks, True, positives), "negatives-near")
    seeds = close.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).otherwise(F.lit(-_FAR)).alias("seed"), F.first("shard").alias("home"))
    bounded = (anchors.join(seeds, "uid", "left")
               .select("uid", "label", "q", F.array(F.coalesce("seed", F.lit(-_FAR))).alias("low"), wide[1], "home"))
    found = close.unionByName(index.search(index.meet(bounded), blocks, True, positives))
    # an anchor without any row in its first shard meets that shard twice: its rows there are none
    best = materialize(_first(found, positives, id_type).select("uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                       "negatives-positives")
    low, high = (F.expr(f"CAST(floor(({h} * CAST(positive_score AS DECIMAL(38,0)) + {r}) / 100) AS BIGINT)") for h, r in ((least, 99), (most, 0)))
    windows = (best.withColumn("low", low).withColumn("high", high).groupBy("uid")
               .agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w")))
    wanted = (anchors.join(windows, "uid").select("uid", "label", "q", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.lit(None).cast("bigint").alias("home")))
    hard = _first(index.search(index.meet(wanted), blocks, False, negatives), negatives, id_type)
    names = points.filter("is_anchor").select("uid", F.col("id").alias("anchor_id"))
    return (hard.select("uid", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(best, ["uid", "place"]).join(names, "uid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: DuckDB SQL of ``op13_hard_negatives``.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
