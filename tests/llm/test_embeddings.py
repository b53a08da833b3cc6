import math
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from colloquy.llm import hard_negatives, whitening

VECS = "vec_id bigint, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    mix = r.standard_normal((6, 6))
    good = [(i, [float(v) for v in (r.standard_normal(6) @ mix)], int(i % 4)) for i in range(300)]
    big = (1 << 60) + 1
    odd = [(None, good[0][1], 0), (3, good[3][1], 1), (3, good[3][1], 1), (big, good[4][1], None), (400, None, 1),
           (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] + [0.0] * 5, 1), (403, [math.inf] + [0.0] * 5, 1),
           (404, [], 1), (405, [1.0, 2.0], 1), (406, [0.0] * 6, 2), (None, None, None), (700, good[7][1], 2), (700, [-0.0] * 6, 2)]
    return good + odd


def _integers(rows, width):
    ok = [(i, v) for i, v, *_ in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(c * 256) for c in v)) for i, v in ok]


def _brute(rows, width):
    xs = sorted({x for _, x in _integers(rows, width)})
    n, s = len(xs), [sum(c) for c in zip(*xs)]
    cov = np.array([[float(sum(Fraction(n * x[i] - s[i], n) * Fraction(n * x[j] - s[j], n) for x in xs) / n) for j in range(width)] for i in range(width)])
    e, v = np.linalg.eigh(cov)
    return n, s, e[::-1], v[:, ::-1], cov


def test_whitening_equals_brute_force(spark, vectors):
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], VECS + ", n int, component string").repartition(5)
    got = whitening.whiten(df, components=4).collect()
    n, s, e, v, cov = _brute(vectors, 6)
    want = _integers(vectors, 6)
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n}
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(
        (key(i), sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in want)
    assert all(r.deviation_digits == str(r.deviation) for r in got)
    for c in range(4):
        rows = {key(r.vec_id): r for r in got if r.component == c + 1}
        sign = 0
        for i, x in want:
            w = float((np.array(x) - np.array(s) / n) @ v[:, c] / math.sqrt(e[c]))
            if key(i) not in (-1, 3, 700):
                sign = sign or (1 if w * rows[i].whitened > 0 else -1)
                assert abs(rows[i].whitened * sign - w) < 1e-9
        assert abs(rows[5].explained - e[c] / np.trace(cov)) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_wide_integers_stay_exact(spark):
    """Values at the ends of a long, and a deviation beyond it."""
    rows = [(1, [3e30, 1.0], 0), (2, [-3e30, 2.0], 0), (3, [0.5, 3.0], 0)]
    df = spark.createDataFrame(rows, VECS)
    fit = df.select(whitening.integer_vectors(df, "embedding")[1].alias("x"))
    n, s, centred = whitening.exact_scatter(fit, 2)
    top, low = (1 << 63) - 1, -(1 << 63)
    xs = [(top, 256), (low, 512), (128, 768)]
    assert (n, s) == (3, [sum(c) for c in zip(*xs)])
    assert centred == [[3 * sum(a[i] * a[j] for a in xs) - s[i] * s[j] for j in range(2)] for i in range(2)]
    got = {r.vec_id: r for r in whitening.whiten(df).filter("component = 1").collect()}
    want = [sum((3 * a - b) ** 2 for a, b in zip(x, s)) for x in xs]
    assert [got[k + 1].deviation for k in range(3)] == [None, None, want[2]]
    assert [got[k + 1].deviation_digits for k in range(3)] == [str(v) for v in want]


def test_whitening_odd_tables(spark, vectors):
    empty = spark.createDataFrame([], VECS)
    assert whitening.whiten(empty).count() == 0 and "deviation" in whitening.whiten(empty).columns
    assert whitening.whiten(spark.createDataFrame(vectors[-10:-4], VECS).filter("vec_id in (400, 401, 402, 403, 404)")).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25, 1.0], 0) for i in range(5)], VECS), components=4).collect()
    assert len(same) == 15 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(50)], VECS)).collect()
    assert {r.component for r in line} == {1, 2} and all(abs(r.explained - (r.component == 1)) < 1e-9 for r in line)
    assert {r.whitened for r in line if r.component == 2} == {0.0} and line[0].identity_error < 1e-9


def test_planes_give_exact_products():
    r = np.random.default_rng(1)
    x = r.integers(-500, 700, (1000, 5))
    x[:, 3] = 9
    planes = whitening.Planes([(int(c.min()), int(c.max())) for c in x.T])
    u, got = x - x.min(axis=0), {}
    for i, j, limb, value in planes.scatter(planes.pack(x)):
        got[i, j] = got.get((i, j), 0) + (value << (whitening.LIMB * limb))
    for i in range(5):
        assert got.get((i, -1), 0) == u[:, i].sum()
        for j in range(i, 5):
            assert got.get((i, j), 0) == (u[:, i] * u[:, j]).sum()


def _mined(rows, width, every=10):
    """Brute force over every pair: negatives of each anchor's positives."""
    ok = [(u, i, lab, tuple(math.floor(c * 256) for c in v)) for u, (i, v, lab) in enumerate(rows)
          if lab is not None and v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for u, i, lab, x in ok:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, w, m == lab) for w, j, m, y in ok if w != u)
        for s, nameless, pid, _, _ in [r for r in scored if r[4]][:5]:
            fits = [r for r in scored if not r[4] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, None if nameless else pid, k + 1, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["spread", "clustered", "equal"])
def test_hard_negatives_equal_brute_force(spark, vectors, shape, monkeypatch):
    for name, size in (("SHARD_ROWS", 40), ("SAMPLE_ROWS", 150), ("CELL_SAMPLE", 4), ("BLOCK_ANCHORS", 8)):
        monkeypatch.setattr(hard_negatives, name, size)
    r = np.random.default_rng(9)
    if shape == "clustered":
        centres = r.standard_normal((5, 6))
        rows = [(i, [float(v) for v in centres[i % 5] + 0.2 * r.standard_normal(6)], int(r.integers(3))) for i in range(400)] + vectors[300:]
    elif shape == "equal":                     # groups of copies, one of them a third of the rows, and ties
        rows = [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 1.0] if i % 3 else [float(v) for v in r.integers(-1, 3, 6)], i % 2) for i in range(300)]
    else:
        rows = vectors
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], VECS + ", rank int, uid int").coalesce(1)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted((tuple(g) for g in got), key=str) == _mined(rows, 6) and len(got) > 100


def test_hard_negatives_odd_tables(spark, vectors):
    df = spark.createDataFrame(vectors, VECS)
    for t, cond in ((df.limit(0), F.lit(True)), (df, F.col("vec_id") == -5), (df.filter("vec_id = 400"), F.lit(True)), (df.filter("vec_id = 10"), F.lit(True)),
                    (df.filter("label = 1"), F.lit(True))):
        got = hard_negatives.hard_negatives(t, cond)
        assert got.count() == 0 and got.columns[0] == "anchor_id"
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(1, [1e30], 1)], VECS), F.lit(True))


def test_cover_tree_bounds_hold():
    r = np.random.default_rng(4)
    x = r.integers(-300, 300, (700, 8))
    m2 = int((x * x).sum(axis=1).max())
    p = hard_negatives._sphere(x, m2)
    t = hard_negatives.build_tree(p)
    assert sorted(t.order) == list(range(700)) and t.level.max() >= 2
    q = r.integers(-300, 300, 8).astype(float)
    scale = np.sqrt((q * q).sum() * m2)
    low, high = hard_negatives.bounds(x[t.centre] @ q, t.radius, np.full(len(t.lo), scale))
    for k, (a, b) in enumerate(zip(t.lo, t.hi)):
        scores = x[t.order[a:b]] @ q
        assert low[k] <= scores.min() and scores.max() <= high[k]
        if t.child[k] >= 0:
            assert sum(t.hi[c] - t.lo[c] for c in range(t.child[k], t.child[k] + t.children[k])) == b - a
