"""Numbers of the words of many texts at once: code points in numpy, one look-up a word instead of a string a word.

A word's number is the one ``vocab`` gives to it, as by ``WORD.findall(text.lower())``; any other word gets ``len(vocab)``.
Words are found by a polynomial hash of their code points and then compared code point by code point.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORD = re.compile(r"\w+")
BREAK = re.compile(r"\W")
PIECE = 1 << 16                                  # characters worked on at a time; longer texts are cut between words


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """For every code point whether it is part of a word."""
    out = np.zeros(0x110000, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start():m.end()] = True
    return out


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses."""
    out = np.ones((2, n), dtype=np.uint64)
    out[0, 1:], out[1, 1:] = base, pow(base, -1, 1 << 64)
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    power, inverse = _powers(base, 1 << max(10, int(len(points)).bit_length()))
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.multiply(points, power[:len(points)], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)         # spreads what short words differ in to the first bits


def _pieces(text: str):
    at = 0
    while len(text) - at > PIECE:
        cut = BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Terms:
    def __init__(self, vocab: dict[str, int]):
        words = list(vocab)
        self.none = len(vocab)
        self.points = _points("".join(words))
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        self.base = 0xD6E8FEB86659FD93
        while True:
            hashes = _hashes(self.points, ends - lengths, ends, self.base)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            if not (hashes[1:] == hashes[:-1]).any():
                break
            self.base += 2
        self.hashes, self.starts, self.lengths = hashes, (ends - lengths)[order], lengths[order]
        self.numbers = np.array(list(vocab.values()), dtype=np.int32)[order]
        # hashes are sorted, so those with the same first bits follow each other
        self.shift = np.uint64(64 - max(4, (8 * len(words)).bit_length()))
        first = (hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(first, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)
        self.most = int(np.bincount(first).max()) if len(words) else 0

    def ids(self, texts) -> list[np.ndarray]:
        """Term numbers (int32) of the words of each text, in order; null texts have none."""
        parts, owners, group, size = [], [], [], 0
        for i, text in enumerate(texts):
            for piece in _pieces(text.lower()) if isinstance(text, str) else ("",):
                group.append(piece)
                owners.append(i)
                size += len(piece) + 1
                if size >= PIECE:
                    parts += self._group(group)
                    group, size = [], 0
        if group:
            parts += self._group(group)
        if len(parts) == len(texts):
            return parts
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for i, part in zip(owners, parts):
            out[i].append(part)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _group(self, pieces: list[str]) -> list[np.ndarray]:
        points = _points("\n".join(pieces) + "\n")
        bounds = np.cumsum([len(p) + 1 for p in pieces])
        inside = _word_points().take(points)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]                         # the last character is a line end
        ids = np.full(len(starts), self.none, dtype=np.int32)
        if len(starts) and len(self.hashes):
            h = _hashes(points, starts, ends, self.base)
            first = self.first.take((h >> self.shift).astype(np.int64))
            at = np.zeros(len(h), dtype=np.int32)
            for k in range(self.most):
                place = np.minimum(first + k, len(self.hashes) - 1)
                at = np.where(self.hashes.take(place) == h, place, at)
            length = ends - starts
            hit = np.flatnonzero((self.hashes.take(at) == h) & (self.lengths.take(at) == length))
            hit = hit[np.argsort(length[hit], kind="stable")]
            for rows in np.split(hit, np.flatnonzero(np.diff(length[hit])) + 1) if len(hit) else []:
                span = np.arange(length[rows[0]])
                same = (points[starts[rows, None] + span] == self.points[self.starts[at[rows], None] + span]).all(axis=1)
                ids[rows[same]] = self.numbers[at[rows[same]]]
        return np.split(ids, np.searchsorted(starts, bounds)[:-1])
