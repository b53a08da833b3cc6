"""Toxicity by two class-conditional Kneser-Ney models over word pairs.

Each class (``toxic``, ``ordinary``) has a model of a word given the word before it.  Counts are documents of
the sample that hold a word or a pair.  A pair's probability is its discounted share of the class's counts after
the first word, backed off to the class's word model, and that to continuation counts *shared* by both classes
(in how many contexts of either class a word stands), and those to one share for unknown words.

Rare expressions: a class count first moves towards what the shared count predicts for it, by ``PULL`` standard
errors and not beyond it.  So an expression that chance may explain weighs (almost) nothing, an expression of one document costs
both classes alike, and evidence grows steadily with the counts; nothing is cut off.  The prediction for a word
is the class's share of all counts; for a pair it is the share that its second word has by itself, so a pair adds only what its
words leave unexplained (an order of words, a harmless phrase).

A document's evidence is its length-normalised log-likelihood under the toxic model less that under the
ordinary one; a logistic curve fitted on labelled rows that the counts never saw turns it into a score.

Fitting uses a bounded sample of the labelled training rows: about ``SAMPLE`` rows of each class for the counts
(folds 2, 3, 4) and ``CALIBRATION`` rows for the curve (fold 1), and of either kind at most about
``SAMPLE_BYTES`` of text, picked by hashes at rates that follow the number of labels and the size of the texts;
rows that repeat id and text are taken once.  All words and pairs of the sample count; Spark sums them, and the model that the scan carries is bounded by
the sample (some 24 bytes a distinct pair).  Words and pairs are known by 64-bit hashes.  Every row of
``documents`` is scored, whole text, in one scan without a shuffle; a very long text is scored in slices of ``SLICE`` words.

Nulls and edge cases: an empty or null text has evidence 0; a null doc_id counts as held out and has no
label; a null label is ignored and a doc_id that is labelled twice is toxic if any label says so.  Repeated rows
are scored row by row, alike; an empty table gives an empty result.  Without toxic labels every score is 0, without ordinary ones 1.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import fresh_name, materialize

FOLDS = 5
CALIBRATION_FOLD = 1
SAMPLE = 3000
CALIBRATION = 3000
SAMPLE_BYTES = 12 << 20
DISCOUNT = 0.3
PULL = 4.0
CACHE_WORDS = 300_000
SLICE = 1 << 16
WORD = re.compile(r"[^\W\d_]+")
START = xxhash.xxh64_intdigest("\n")             # the context of a text's first word


def words_of(text) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


class Keys:
    """Hashes of a text's words, the start before them; remembers words within a task (bounded)."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text) -> np.ndarray:
        seen, out = self.seen, [START]
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in words_of(text):
            k = seen.get(w)
            if k is None:
                k = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(k)
        return np.array(out, dtype=np.uint64)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def split_counts(a: np.ndarray, b: np.ndarray, odds, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The two classes' counts on the scale of the shared count ``a + b``.  ``odds`` is the part of it that
    is predicted for class 1, ``share`` class 1's part of all counts."""
    both = a + b
    even = both * odds
    gap = b - even
    one = even + np.sign(gap) * np.maximum(np.abs(gap) - PULL * np.sqrt(both * odds * (1 - odds)), 0.0)
    return (both - one) / (1 - share), one / share


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class KneserNey:
    """Log-likelihoods of texts under two classes (index 1 toxic, 0 ordinary).

    ``words``: (w, a, b); ``pairs``: (u, w, a, b), as arrays (keys as uint64; documents of class 0 and 1)."""

    def __init__(self, words: tuple, pairs: tuple):
        order = np.argsort(words[0])
        self.words, a, b = (x[order] for x in words)
        share = b.sum() / (a.sum() + b.sum())
        u, w, pa, pb = pairs
        key = pair_key(u, w)
        order = np.argsort(key)
        self.pairs = key[order]
        del key
        at = np.searchsorted(self.words, w[order]).astype(np.int32)
        self.first = np.unique(u)
        first = np.searchsorted(self.first, u[order]).astype(np.int32)
        pa, pb = pa[order], pb[order]
        del u, w, order
        kinds, contexts = len(self.words), np.bincount(at, minlength=len(self.words)).astype(float)
        rest = DISCOUNT * kinds / (kinds + 1) / contexts.sum()           # an unknown word's share
        shared = np.maximum(contexts - DISCOUNT, 0) / contexts.sum() + rest
        word, self.word, self.unknown = [], [], []
        for c in split_counts(a, b, share, share):
            top = np.maximum(c - DISCOUNT, 0)
            back = 1 - top.sum() / c.sum()
            word.append(top / c.sum() + back * shared)
            self.word.append(np.log(word[-1]))
            self.unknown.append(math.log(back * rest))
        odds = word[1] * share / (word[1] * share + word[0] * (1 - share))
        self.back, self.pair = [], []
        for k, c in enumerate(split_counts(pa, pb, odds[at], share)):
            after = np.maximum(np.bincount(first, weights=c), 1e-12)
            np.maximum(c - DISCOUNT, 0, out=c)
            back = np.maximum(1 - np.bincount(first, weights=c) / after, 1e-9)
            self.back.append(np.log(back))
            c /= after[first]
            c += back[first] * word[k][at]
            self.pair.append(np.log(c, out=c))

    def log_likelihoods(self, keys: np.ndarray) -> tuple[float, float]:
        """(ordinary, toxic) log-likelihood of the words behind the start in ``keys``."""
        out = [0.0, 0.0]
        for s in range(0, len(keys) - 1, SLICE):
            w = keys[s + 1:s + 1 + SLICE]
            u = keys[s:s + len(w)]
            (pair, paired), (word, known), (first, met) = _place(self.pairs, pair_key(u, w)), _place(self.words, w), _place(self.first, u)
            for k in (0, 1):
                low = np.where(known, self.word[k][word], self.unknown[k]) + np.where(met, self.back[k][first], 0.0)
                out[k] += float(np.where(paired, self.pair[k][pair], low).sum())
        return out[0], out[1]

    def evidence(self, keys: np.ndarray) -> float:
        n = len(keys) - 1
        if n < 1:
            return 0.0
        ordinary, toxic = self.log_likelihoods(keys)
        return toxic / n - ordinary / n


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample: text, _y, _held."""
    lab = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
           .agg(F.max((F.col("toxic") == 1).cast("int")).alias("_y")).filter(fold() != 0))
    n = {r["_y"]: (r["n"], r["c"]) for r in lab.groupBy("_y").agg(
        F.sum((fold() != CALIBRATION_FOLD).cast("int")).alias("n"), F.sum((fold() == CALIBRATION_FOLD).cast("int")).alias("c")).collect()}

    def unit(*what):
        return F.pmod(F.xxhash64(*what), F.lit(1_000_000)) / 1_000_000.0

    rate = F.lit(0.0)
    held = sum(c for _, c in n.values())
    for y, (k, _) in n.items():
        rate = F.when((F.col("_y") == y) & (fold() != CALIBRATION_FOLD), min(1.0, SAMPLE / max(1, k))).otherwise(rate)
    rate = F.when(fold() == CALIBRATION_FOLD, min(1.0, CALIBRATION / max(1, held))).otherwise(rate)
    picked = lab.filter(unit(F.lit("sample"), F.col("doc_id")) < rate).select(F.col("doc_id").alias("_id"), "_y", (fold() == CALIBRATION_FOLD).alias("_held"))
    # at most about 2 * SAMPLE + CALIBRATION rows of two numbers: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = materialize(rows.select("doc_id", "text", "_y", "_held").dropDuplicates(["doc_id", "text"]), "toxicity-sample")
    thin = F.lit(1.0)
    for r in rows.groupBy("_held", F.when(~F.col("_held"), F.col("_y")).alias("y")).agg(F.sum(F.octet_length("text").cast("long")).alias("size")).collect():
        part = F.col("_held") if r["_held"] else (~F.col("_held") & (F.col("_y") == r["y"]))
        thin = F.when(part, min(1.0, SAMPLE_BYTES / max(1, r["size"] or 0))).otherwise(thin)
    return rows.filter(unit(F.lit("size"), F.col("doc_id"), F.col("text")) < thin).select("text", "_y", "_held")


def count_tables(sample: DataFrame) -> tuple[tuple, tuple]:
    """Documents that hold each word and each pair of neighbours, by class, summed by Spark over the sample."""
    def counter(length: int):
        def run(batches):
            keys = Keys()
            for pdf in batches:
                for y, part in pdf.groupby("_y"):
                    rows = [np.unique(k[1:, None] if length == 1 else np.stack([k[:-1], k[1:]], axis=1), axis=0) for k in map(keys, part["text"]) if len(k) > 1]
                    if rows:
                        rows, n = np.unique(np.concatenate(rows), axis=0, return_counts=True)
                        cols = {c: rows[:, i].view(np.int64) for i, c in enumerate("uw"[2 - length:])}
                        yield pd.DataFrame({**cols, "y": int(y), "n": n})
        return run

    def of(y):
        return F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("int")

    def table(length: int) -> tuple:
        names = list("uw"[2 - length:])
        got = (sample.mapInPandas(counter(length), ", ".join(f"{c} bigint" for c in names) + ", y int, n bigint")
               .groupBy(*names).agg(of(0).alias("a"), of(1).alias("b")).toArrow())
        return (*(got[c].to_numpy().view(np.uint64) for c in names), got["a"].to_numpy(), got["b"].to_numpy())

    return table(1), table(2)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak ridge; the slope never turns negative."""
    scale = max(1e-9, float(np.std(x)))
    m = np.column_stack([x / scale, np.ones_like(x)])
    w = np.array([1.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (p - y) + 1e-2 * w
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0) / scale, float(w[1])


def fit(docs: DataFrame, labels: DataFrame):
    """A broadcast model, slope and offset, or a constant score where a class is missing."""
    sample = _labelled(docs, labels)
    words, pairs = count_tables(sample.filter(~F.col("_held")).select("text", "_y"))
    if not words[1].sum() or not words[2].sum():
        return (None, 0.0, 0.0 if not words[2].sum() else 1.0)
    model = KneserNey(words, pairs)
    del words, pairs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, keys = shared.value, Keys()
        for pdf in batches:
            yield pd.DataFrame({"x": [model.evidence(keys(t)) for t in pdf["text"]], "y": pdf["_y"].astype(float)})

    cal = sample.filter("_held").select("text", "_y").mapInPandas(run, "x double, y double").toPandas().sort_values(["x", "y"])
    if cal["y"].nunique() < 2:
        return (shared, 50.0, -1.0)
    return (shared, *_logistic(cal["x"].to_numpy(), cal["y"].to_numpy()))


def with_scores(docs: DataFrame, fitted, col: str) -> DataFrame:
    """Every column of ``docs`` plus the score column ``col``."""
    shared, slope, offset = fitted
    if shared is None:
        return docs.withColumn(col, F.lit(offset))

    keys = Keys()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        x = np.array([model.evidence(keys(t)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))))

    return docs.withColumn(col, score("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = with_scores(docs, fit(docs, labels), "score")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as given."""
    col = fresh_name("_score", docs.columns)
    return with_scores(docs, fit(docs, labels), col).filter(F.col(col) < 0.5).select(*docs.columns)
