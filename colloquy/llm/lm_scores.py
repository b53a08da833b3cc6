"""Language-model scores of whole documents: a gated recurrent model over corpus-wide word counts.

Counts: documents are dealt into chunks of about ``CHUNK_BYTES`` of text by a hash of their row.  A chunk
emits each distinct word once with its training count; one shuffle by word sums them (a frequent word is one
row per chunk, never one per occurrence), and each chunk gets back the counts of its own words.  No
vocabulary is broadcast or collected: the gathered table grows with the corpus, and stays distributed.

Model (``gru.py``): the ``FREQUENT`` most frequent words and the end token are predicted one by one, in
classes of ``PER_CLASS``; all other words fall into classes by their spelling, inside which the probability
follows the corpus counts, ``(c + 1) / (N + V + 1)`` of the class; an unknown word takes the one that is
left.  So every word, known or not, has a probability, and those of a class add up to one.  The network's
weights are learnt by truncated backpropagation on all training documents: in each of ``ROUNDS`` rounds every
chunk is a task that trains from the same weights on all of its training documents, and the weights are averaged by
the words they saw, in groups of ``FAN_IN`` on the cluster until one such group is left.

Scoring carries the state across windows, so a document's score is its complete log-likelihood, end token
included, at bounded memory.

Nulls and edge cases: a null text is empty (one end token); a null doc_id counts as the empty string for the
hold-out.  Without training documents N and V are 0 and unknown words share one class model.  Repeated
rows are scored row by row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm import gru
from colloquy.llm.common import bucket_count, materialize, text_bytes

FOLDS, HELD_FOLD = 7, 2
CHUNK_BYTES = 24 << 20
FREQUENT_CLASSES, PER_CLASS = 32, 32
FREQUENT = FREQUENT_CLASSES * PER_CLASS - 1      # and the end token
TAIL_CLASSES = 32
HIDDEN, EMBED = 16, 12
ROUNDS, FAN_IN = 3, 32
STREAMS, WINDOW, RATE = 48, 16, 0.01
SEED = 11
END = b"\n"                                      # no word holds white space


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


def fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))


def word_key(w: bytes) -> int:
    h = xxhash.xxh64_intdigest(w)
    return h - (1 << 64) if h >= 1 << 63 else h


def tail_class(w: bytes) -> int:
    """Spelling class: by the last two bytes that are not punctuation."""
    return zlib.crc32(w.rstrip(b".,;:!?|%$&*#\"')]")[-2:]) % TAIL_CLASSES


def tokens(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words of the texts, word numbers of all tokens with an end token each, tokens per text)."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    get = number.__getitem__
    get(END)
    parts = []
    for t in texts:
        ids = list(map(get, t.encode("utf-8", "surrogatepass").lower().split())) if isinstance(t, str) else []
        ids.append(0)
        parts.append(np.array(ids, dtype=np.int32))
    return list(number), np.concatenate(parts) if parts else np.empty(0, np.int32), np.array([len(x) for x in parts], dtype=np.int64)


def _count_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    words, ids, lengths = tokens(pdf["text"])
    counts = np.bincount(ids[np.repeat(pdf["train"].to_numpy(), lengths)], minlength=len(words))
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "w": np.array([word_key(x) for x in words], dtype=np.int64),
                         "cls": np.array([tail_class(x) for x in words], dtype=np.int16), "n": counts.astype(np.int64)})


class Model:
    """What every scoring task needs; its size is fixed by the parameters."""

    def __init__(self, frequent: dict[int, int], total: int, kinds: int, tail_n: np.ndarray, tail_v: np.ndarray):
        self.frequent, self.total, self.kinds, self.tail_n, self.tail_v, self.weights = frequent, total, kinds, tail_n, tail_v, None

    def symbols(self, words: list[bytes], counts: np.ndarray):
        """Per distinct word: (input symbol, class, word inside the class or -1, log of the fixed part)."""
        place = np.array([self.frequent.get(word_key(w), -1) for w in words], dtype=np.int64)
        tail = np.array([tail_class(w) for w in words], dtype=np.int64)
        known = place >= 0
        symbol = np.where(known, place, FREQUENT + 1 + tail)
        cls = np.where(known, place // PER_CLASS, FREQUENT_CLASSES + tail)
        inside = np.where(known, place % PER_CLASS, -1)
        fixed = np.where(known, 0.0, np.log((counts + 1.0) / (self.tail_n[tail] + self.tail_v[tail] + 1.0)))
        return symbol, cls, inside, fixed


def _frequent_counts(freq: pd.DataFrame) -> np.ndarray:
    out = np.zeros(FREQUENT_CLASSES * PER_CLASS)
    out[freq["place"].to_numpy()] = freq["c"].to_numpy()
    return out


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the weights of a group, averaged by ``words``."""
    pdf = pdf.sort_values("replica")
    total = sum(n * np.frombuffer(w, dtype=np.float64) for n, w in zip(pdf["words"], pdf["weights"]))
    words = int(pdf["words"].sum())
    return pd.DataFrame({"replica": [int(pdf["replica"].iloc[0]) // FAN_IN], "words": [words], "weights": [(total / words).tobytes()]})


def _replica(shared, rate: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        model, start = shared.value
        replica = pdf["chunk"].iloc[0]
        pdf = pdf.sort_values("k")
        words, ids, _ = tokens(pdf["text"])
        symbol, cls, inside, _ = model.symbols(words, np.zeros(len(words)))
        p = gru.train(start, symbol[ids], cls[ids], inside[ids], 0, STREAMS, WINDOW, rate)
        flat = np.concatenate([v.ravel() for v in p.values()]).astype(np.float64)
        return pd.DataFrame({"replica": [replica], "words": [len(ids)], "weights": [flat.tobytes()]})

    return one


def fit_weights(train: DataFrame, chunks: int, model: Model, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameter averaging: in every round each chunk of ``train(chunk, k, text)`` trains from the same weights."""
    spark = train.sparkSession
    schema = "replica bigint, words bigint, weights binary"
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, weights))
        got = materialize(train.groupBy("chunk").applyInPandas(_replica(shared, RATE / (1 + i)), schema), "lm-weights")
        left = chunks
        while left > 1:
            group = F.floor(F.col("replica") / FAN_IN)
            got, left = got.groupBy(group).applyInPandas(_mean, schema), -(-left // FAN_IN)
        got = got.toPandas()
        if not len(got):
            break
        weights = _unpack(np.frombuffer(got["weights"].iloc[0], dtype=np.float64), weights)
    return weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    chunks = bucket_count(text_bytes(docs), CHUNK_BYTES)
    rows = docs.select("doc_id", "text", (fold() != HELD_FOLD).alias("train"), F.xxhash64("doc_id", "text").alias("k"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    counted = rows.select("chunk", "train", "text").groupBy("chunk").applyInPandas(_count_chunk, "chunk int, w bigint, cls smallint, n bigint")
    by_word = W.partitionBy("w")
    counted = materialize(counted.select("chunk", "w", "cls", F.sum("n").over(by_word).alias("c"),
                                         (F.col("chunk") == F.min("chunk").over(by_word)).alias("once")), "lm-counts")
    vocab = counted.filter("once and c > 0")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end_key = word_key(END)
    freq = vocab.filter(F.col("w") != end_key).orderBy(F.col("c").desc(), "w").limit(FREQUENT).select("w", "cls", "c").toPandas()
    ends = vocab.filter(F.col("w") == end_key).select("w", "cls", "c").toPandas()
    freq = pd.concat([ends if len(ends) else pd.DataFrame({"w": [end_key], "cls": [0], "c": [0]}), freq], ignore_index=True)
    freq["place"] = np.arange(len(freq))
    tails = vocab.filter(F.col("w") != end_key).groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    tail_n[tails["cls"].to_numpy()], tail_v[tails["cls"].to_numpy()] = tails["n"].to_numpy(), tails["v"].to_numpy()
    np.subtract.at(tail_n, freq["cls"].to_numpy()[1:], freq["c"].to_numpy()[1:].astype(float))
    np.subtract.at(tail_v, freq["cls"].to_numpy()[1:], 1.0)
    model = Model(dict(zip(freq["w"].tolist(), freq["place"].tolist())), int(total["n"]), int(total["v"]), tail_n, tail_v)
    inner = _frequent_counts(freq) + 0.5
    classes = np.concatenate([inner.reshape(FREQUENT_CLASSES, PER_CLASS).sum(1), tail_n + tail_v + 1])
    shape = gru.Shape(FREQUENT + 1 + TAIL_CLASSES, FREQUENT_CLASSES + TAIL_CLASSES, FREQUENT_CLASSES, PER_CLASS, HIDDEN, EMBED)
    weights = gru.initial(shape, np.log(classes / classes.sum()),
                          np.log(inner.reshape(FREQUENT_CLASSES, PER_CLASS) / inner.reshape(FREQUENT_CLASSES, PER_CLASS).sum(1, keepdims=True)), SEED)
    model.weights = fit_weights(rows.filter("train").select("chunk", "k", "text"), chunks, model, weights)
    shared = spark.sparkContext.broadcast(model)

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        words, ids, lengths = tokens(a["text"])
        count = dict(zip(b["w"].tolist(), b["c"].tolist()))
        c = np.array([count.get(word_key(x), 0) for x in words], dtype=np.float64)
        symbol, cls, inside, fixed = m.symbols(words, c)
        starts = np.cumsum(lengths) - lengths
        log = gru.document_logs(m.weights, symbol[ids], cls[ids], inside[ids], starts, lengths, 0)
        each = fixed[ids]
        base = np.log10((c + 1) / (m.total + m.kinds + 1))[ids]
        add = lambda x: np.add.reduceat(x, starts) if len(x) else np.empty(0)
        return pd.DataFrame({"doc_id": a["doc_id"], "held_out": ~a["train"].to_numpy(), "n_tokens": lengths,
                             "n_known": add((c > 0).astype(np.int64)[ids]), "train_tokens": np.int64(m.total),
                             "base_score": add(base), "score": (log + add(each)) / np.log(10)})

    # ids travel as text: exact beside nulls
    return (rows.select("chunk", F.col("doc_id").cast("string"), "train", "text").groupBy("chunk").cogroup(counted.select("chunk", "w", "c").groupBy("chunk"))
            .applyInPandas(score, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
            .withColumn("doc_id", F.col("doc_id").cast("bigint")))
