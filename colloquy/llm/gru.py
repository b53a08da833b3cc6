"""A small gated recurrent language model in numpy with a class-factored softmax.

Inputs are ``n_in`` symbols; a target is a class and, for classes of frequent words, a word inside it.  The
state starts at zero with the end token as first input, and is carried across windows.
"""

from __future__ import annotations

import numpy as np


class Shape:
    def __init__(self, n_in: int, n_classes: int, n_frequent_classes: int, per_class: int, hidden: int, embed: int):
        self.n_in, self.n_classes, self.n_frequent_classes = n_in, n_classes, n_frequent_classes
        self.per_class, self.hidden, self.embed = per_class, hidden, embed


def initial(shape: Shape, class_log: np.ndarray, word_log: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Weights whose output, before training, is the unigram distribution given by the two biases."""
    rng = np.random.default_rng(seed)
    h, e = shape.hidden, shape.embed

    def normal(*size, scale):
        return (rng.standard_normal(size) * scale).astype(np.float32)

    return {"emb": normal(shape.n_in, e, scale=0.3), "w": normal(e, 3 * h, scale=1 / np.sqrt(e)), "b": np.zeros(3 * h, np.float32),
            "u": normal(h, 3 * h, scale=1 / np.sqrt(h)), "c": normal(h, shape.n_classes, scale=0.05), "cb": class_log.astype(np.float32),
            "o": normal(shape.n_frequent_classes, shape.per_class, h, scale=0.05),
            "ob": word_log.reshape(shape.n_frequent_classes, shape.per_class).astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(p: dict, xin: np.ndarray, h: np.ndarray):
    """One step from the projected inputs ``xin``; returns (new state, gate cache)."""
    k = h.shape[1]
    hu = h @ p["u"]
    zr = _sigmoid(xin[:, :2 * k] + hu[:, :2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(xin[:, 2 * k:] + r * hu[:, 2 * k:])
    return n + z * (h - n), (z, r, n, hu[:, 2 * k:])


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train_window(p: dict, x: np.ndarray, h0: np.ndarray, end: int, cls: np.ndarray, word: np.ndarray):
    """Loss gradients of one window (truncated backpropagation).  x, cls, word: (steps, streams); ``word``
    is -1 for targets outside the frequent classes.  Returns (gradients, loss per token, last state)."""
    steps, streams = x.shape
    k, kind = h0.shape[1], p["u"].dtype
    sign = np.repeat(np.array([-1, 1], kind), [2 * k, k])              # the gates take exp(-x)
    inputs, u = p["emb"].take(x.ravel(), axis=0), p["u"] * sign
    xin = inputs @ (p["w"] * sign)
    xin += p["b"] * sign
    xin = xin.reshape(steps, streams, 3 * k)
    alive = (x != end).astype(kind)[:, :, None]                        # a document starts from the zero state
    prev, hs, nn = np.empty((3, steps, streams, k), kind)
    hu, zr = np.empty((steps, streams, 3 * k), kind), np.empty((steps, streams, 2 * k), kind)
    h = h0
    for t in range(steps):
        np.multiply(h, alive[t], out=prev[t])
        np.matmul(prev[t], u, out=hu[t])
        g = zr[t]
        np.add(xin[t, :, :2 * k], hu[t, :, :2 * k], out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        n, h = nn[t], hs[t]
        np.multiply(g[:, k:], hu[t, :, 2 * k:], out=n)
        n += xin[t, :, 2 * k:]
        np.tanh(n, out=n)
        np.subtract(prev[t], n, out=h)
        h *= g[:, :k]
        h += n
    last, hs = h, hs.reshape(-1, k)
    cf, wf = cls.ravel(), word.ravel()
    n = len(cf)
    d, loss = _softmax_errors(hs @ p["c"] + p["cb"], cf, n)
    g = {"c": hs.T @ d, "cb": d.sum(0), "o": np.zeros_like(p["o"]), "ob": np.zeros_like(p["ob"])}
    dh = d @ p["c"].T
    frequent = np.flatnonzero(wf >= 0)
    if len(frequent):
        order = frequent[np.argsort(cf[frequent], kind="stable")]      # each class is a stretch
        c, states = cf[order], hs[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        stretches = list(zip(c[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(c)]))
        logits, back = p["ob"][c], np.empty_like(states)
        product = np.empty_like(logits)
        for i, a, b in stretches:
            np.matmul(states[a:b], p["o"][i].T, out=product[a:b])
        logits += product
        e, more = _softmax_errors(logits, wf[order], n)
        loss += more
        for i, a, b in stretches:
            np.matmul(e[a:b].T, states[a:b], out=g["o"][i])
            np.matmul(e[a:b], p["o"][i], out=back[a:b])
        g["ob"][c[starts]] = np.add.reduceat(e, starts, axis=0)
        dh[order] += back
    dh = dh.reshape(steps, streams, k)
    z, r = zr[..., :k], zr[..., k:]
    left = 1 - z
    dn = left * (1 - nn * nn)
    factor = np.empty((steps, streams, 3, k), kind)                    # from a state's gradient to those of its projections
    np.multiply((prev - nn) * z, left, out=factor[:, :, 0])
    np.multiply(dn * hu[..., 2 * k:], r * (1 - r), out=factor[:, :, 1])
    np.multiply(dn, r, out=factor[:, :, 2])
    dhu, back = np.empty_like(factor), np.ascontiguousarray(p["u"].T)
    carry, kept = np.zeros_like(h0), np.empty_like(h0)
    for t in range(steps - 1, -1, -1):
        dh[t] += carry
        np.multiply(dh[t, :, None], factor[t], out=dhu[t])
        np.matmul(dhu[t].reshape(streams, 3 * k), back, out=carry)
        np.multiply(dh[t], z[t], out=kept)
        carry += kept
        carry *= alive[t]
    g["u"] = prev.reshape(-1, k).T @ dhu.reshape(-1, 3 * k)
    dhu[:, :, 2] = dh * dn                                             # now the inputs' gradients
    dx = dhu.reshape(-1, 3 * k)
    g["w"], g["b"] = inputs.T @ dx, dx.sum(0)
    size = p["emb"].shape[1]
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"].reshape(-1), (x.reshape(-1, 1) * size + np.arange(size)).ravel(), (dx @ p["w"].T).ravel())
    return g, loss / n, last


def _softmax_errors(x: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(gradients of the mean loss over ``n`` by the logits ``x``, written over them; summed loss)."""
    rows = np.arange(len(x))
    if x.max(initial=0) > 60 or x.min(initial=0) < -60:                # else no exponential is out of range
        x -= x.max(axis=1, keepdims=True)
    at = x[rows, target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x *= (1 / (total * n))[:, None]
    x[rows, target] -= 1 / n
    return x, float((np.log(total) - at).sum())


def train(p: dict, tokens: np.ndarray, classes: np.ndarray, words: np.ndarray, end: int, streams: int, window: int, rate: float, epochs: int = 1) -> dict:
    """Adam over parallel streams of the token sequence, state carried from window to window.

    ``tokens`` are input symbols of documents, each closed by ``end``; classes and words are its targets."""
    streams = max(1, min(streams, len(tokens) // (2 * window)))
    per = len(tokens) // streams
    if per < 2:
        return {k: v.copy() for k, v in p.items()}
    x = np.concatenate([[end], tokens[:-1]])[:per * streams].reshape(streams, per).T
    c, w = classes[:per * streams].reshape(streams, per).T, words[:per * streams].reshape(streams, per).T
    flat = np.concatenate([v.ravel() for v in p.values()])             # all weights side by side: a step is one pass over them
    ends = np.cumsum([v.size for v in p.values()])
    p = {k: part.reshape(v.shape) for (k, v), part in zip(p.items(), np.split(flat, ends[:-1]))}
    v, m, s, a, b = np.zeros((5, len(flat)), flat.dtype)
    i = 0
    for _ in range(epochs):
        h = np.zeros((streams, p["u"].shape[0]), np.float32)
        for at in range(0, per, window):
            g, _, h = train_window(p, x[at:at + window], h, end, c[at:at + window], w[at:at + window])
            i += 1
            np.concatenate([g[k].ravel() for k in p], out=v)
            v *= min(1.0, 1.0 / max(float(np.sqrt(v @ v)), 1e-12))
            np.subtract(v, m, out=a)
            a *= 0.1
            m += a
            np.multiply(v, v, out=a)
            a -= s
            a *= 0.01
            s += a
            np.divide(s, 1 - 0.99 ** i, out=a)
            np.sqrt(a, out=a)
            a += 1e-6
            np.multiply(m, rate / (1 - 0.9 ** i), out=b)
            b /= a
            flat -= b
    return p


def document_logs(p: dict, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                  end: int, window: int = 32, rows_per_block: int = 32_768) -> np.ndarray:
    """Natural log-likelihood of each document's targets (class, and word inside frequent classes).

    Documents advance together, longest first; a window's states are kept, scored and dropped, and only
    the running state goes on to the next window, so memory does not grow with document length."""
    n_docs = len(starts)
    out = np.zeros(n_docs)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    table = p["emb"] @ p["w"] + p["b"]
    longest = int(left[0]) if n_docs else 0
    alive = n_docs - np.searchsorted(np.sort(left), np.arange(longest), "right")     # documents longer than t
    h = np.zeros((n_docs, p["u"].shape[0]), np.float32)
    for t0 in range(0, longest, window):
        states, where = [], []
        for t in range(t0, min(t0 + window, longest)):
            k = int(alive[t])
            pos = at[:k] + t
            x = inputs[pos - 1] if t else np.full(k, end)
            h = step(p, table[x], h[:k])[0]
            states.append(h)
            where.append(pos)
        hs, pos = np.concatenate(states), np.concatenate(where)
        docs = np.concatenate([order[:len(w)] for w in where])
        for a in range(0, len(pos), rows_per_block):
            s, q = hs[a:a + rows_per_block], pos[a:a + rows_per_block]
            c, w = classes[q], words[q]
            x = s @ p["c"] + p["cb"]
            x -= x.max(axis=1, keepdims=True)
            ll = x[np.arange(len(q)), c] - np.log(np.exp(x).sum(axis=1))
            ll = ll.astype(np.float64)
            frequent = np.flatnonzero(w >= 0)
            by = frequent[np.argsort(c[frequent], kind="stable")]
            for rows in np.split(by, np.flatnonzero(np.diff(c[by])) + 1) if len(by) else []:
                y = s[rows] @ p["o"][c[rows[0]]].T + p["ob"][c[rows[0]]]
                y -= y.max(axis=1, keepdims=True)
                ll[rows] += y[np.arange(len(rows)), w[rows]] - np.log(np.exp(y).sum(axis=1))
            out += np.bincount(docs[a:a + rows_per_block], weights=ll, minlength=n_docs)
    return out
