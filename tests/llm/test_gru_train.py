"""Training against a plain loop: the same weights in less time."""

from __future__ import annotations

import time

import numpy as np

from colloquy.llm import gru


def plain_gradients(p, x, h, end, cls, word):
    k, n, table = h.shape[1], x.size, p["emb"] @ p["w"] + p["b"]
    states, caches = [], []
    for t in range(len(x)):
        prev = h * (x[t] != end)[:, None]
        h, cache = gru.step(p, table[x[t]], prev)
        states.append(h)
        caches.append((prev, cache))
    hs, cf, wf = np.concatenate(states), cls.ravel(), word.ravel()
    d = np.exp(gru.log_softmax(hs @ p["c"] + p["cb"]))
    d[np.arange(n), cf] -= 1
    d /= n
    g = {key: np.zeros_like(v) for key, v in p.items()}
    g["c"], g["cb"], dh = hs.T @ d, d.sum(0), d @ p["c"].T
    for c in np.unique(cf[wf >= 0]):
        rows = np.flatnonzero((cf == c) & (wf >= 0))
        e = np.exp(gru.log_softmax(hs[rows] @ p["o"][c].T + p["ob"][c]))
        e[np.arange(len(rows)), wf[rows]] -= 1
        e /= n
        g["o"][c], g["ob"][c] = e.T @ hs[rows], e.sum(0)
        dh[rows] += e @ p["o"][c]
    dh, dtable, carry = dh.reshape(*x.shape, k), np.zeros_like(table), 0
    for t in range(len(x) - 1, -1, -1):
        prev, (z, r, nn, hun) = caches[t]
        dcur = dh[t] + carry
        dn = dcur * (1 - z) * (1 - nn * nn)
        dz, dr = dcur * (prev - nn) * z * (1 - z), dn * hun * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        np.add.at(dtable, x[t], np.concatenate([dz, dr, dn], axis=1))
        g["u"] += prev.T @ dhu
        carry = (dcur * z + dhu @ p["u"].T) * (x[t] != end)[:, None]
    g["emb"], g["w"], g["b"] = dtable @ p["w"].T, p["emb"].T @ dtable, dtable.sum(0)
    return g, h


def plain_train(p, tokens, classes, words, end, streams, window, rate):
    p, per = {k: v.copy() for k, v in p.items()}, len(tokens) // streams
    x, c, w = (a[:per * streams].reshape(streams, per).T for a in (np.concatenate([[end], tokens[:-1]]), classes, words))
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    h = np.zeros((streams, p["u"].shape[0]), p["u"].dtype)
    for i, a in enumerate(range(0, per, window), 1):
        g, h = plain_gradients(p, x[a:a + window], h, end, c[a:a + window], w[a:a + window])
        clip = min(1.0, 1.0 / max(np.sqrt(sum(float((v * v).sum()) for v in g.values())), 1e-12))
        for k, v in g.items():
            v = v * clip
            m[k] += 0.1 * (v - m[k])
            s[k] += 0.01 * (v * v - s[k])
            p[k] -= rate * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(s[k] / (1 - 0.99 ** i)) + 1e-6)
    return p


def test_training_gives_the_weights_of_a_plain_loop_in_less_time():
    rng = np.random.default_rng(4)
    shape = gru.Shape(1024 + 32, 64, 32, 32, 16, 12)
    p = gru.initial(shape, np.log(np.full(64, 1 / 64)), np.log(np.full((32, 32), 1 / 32)), 3)
    z = np.minimum(rng.zipf(1.15, 30_000), 2000) - 1
    tokens, classes, words = np.where(z < 1024, z, 1024 + z % 32), np.where(z < 1024, z // 32, 32 + z % 32), np.where(z < 1024, z % 32, -1)
    took, got = [], []
    for train in (plain_train, gru.train) * 2:
        began = time.process_time()
        got.append(train(p, tokens, classes, words, 0, 48, 16, 0.01))
        took.append(time.process_time() - began)
    for k, v in got[0].items():
        assert v.shape == got[1][k].shape and np.allclose(v, got[1][k], atol=1e-4), k
    assert min(took[1::2]) < 0.75 * min(took[::2])


def test_training_on_classes_without_words_and_large_logits():
    """No frequent word in a window, one stream, and logits whose exponentials would be out of range."""
    rng = np.random.default_rng(6)
    p = gru.initial(gru.Shape(9, 6, 4, 2, 5, 3), np.log(np.full(6, 1 / 6)), np.log(np.full((4, 2), 0.5)), 1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    for scale in (1, 300):
        p["cb"] = rng.standard_normal(6) * scale
        x, cls, h = rng.integers(0, 9, (8, 1)), rng.integers(4, 6, (8, 1)), np.zeros((1, 5))
        got, loss, last = gru.train_window(p, x, h, 0, cls, np.full((8, 1), -1))
        want, h = plain_gradients(p, x, h, 0, cls, np.full((8, 1), -1))
        assert np.isfinite(loss) and np.allclose(last, h) and all(np.allclose(got[k], v) for k, v in want.items())
