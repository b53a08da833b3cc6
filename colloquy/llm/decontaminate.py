"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's terms are counted over all documents.  Items are represented by all
   of their terms, weighted by inverse document frequency.
2. The latent space is fitted on the TF-IDF passages of **all** documents and of the benchmark.  Tasks sum the products
   of terms that share a passage; Spark adds these up by term, and a randomised SVD multiplies the distributed
   sums by a test matrix.  The driver only orthogonalises matrices of (benchmark terms x ``RANK + EXTRA``).  Passages of
   the benchmark weigh ``ITEM_WEIGHT``; those of the documents together weigh as much as ``DOCS_WEIGHT`` documents would,
   so that the space does not forget the benchmark as the table grows.
3. Every document is searched whole: windows are folded into the space, and windows whose cosine to a
   benchmark passage reaches ``COSINE`` are candidates.  An item meets windows of the longest of ``WINDOWS``
   words that is no longer than the item, half a window apart (items of fewer words the shortest).  A window whose
   vector is shorter than ``EVIDENCE`` of the passage's is divided by that length instead of its own: one rare
   term is no passage.  Stretches without any term of the benchmark have no vector and are passed over.
   Items of fewer than ``SHORT`` words are also searched as exact word sequences, whatever their cosine.
4. A candidate is confirmed in the text around it by the longest common subsequence of words with the whole
   item (at least ``OVERLAP`` of the item) and, where the table has an answer, by an answer check (at least
   ``ANSWER`` of the words of the answer, in order); without one the overlap decides and ``answer`` is null.
   Candidates of a pair are tried from the highest cosine on until one holds; left out are only those around which the words in
   common, each as often as both sides have it, are fewer than the overlap asks for.
5. Words are numbered once: the fit and the search read the stored numbers (``drop_contaminated`` numbers the texts where they are).

The benchmark is taken in blocks of ``ITEM_BLOCK`` items, so what a task holds is bounded; a larger benchmark costs more
passes.  Results are one row per (document, item): no document is compared with another.

Nulls and edge cases: null or empty texts and items match nothing; items of fewer than ``SHORT`` words must occur in
full, side by side or in order around a candidate window.  Repeated rows give repeated results; a null doc_id stays null.  An empty benchmark or table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bucket_count, discard, materialize, shared_path, text_bytes
from colloquy.llm.terms import WORD, Terms

WINDOWS = (8, 16, 32)
WINDOW, STRIDE = 32, 16                          # of the passages that the space is fitted on
RANK, EXTRA, POWER = 320, 16, 1
ITEM_WEIGHT = 10.0
DOCS_WEIGHT = 1000
EVIDENCE = 0.5
COSINE = 0.3
OVERLAP = 0.6
ANSWER = 0.5
SHORT = 8
ITEM_BLOCK = 5000
SEED = 5
TASK_BYTES = 32 << 20                             # of text, per task that sums products: each gives out up to all pairs
GROUP_TOKENS = 1 << 15
SEARCH_TOKENS = 1 << 12                          # searched at a time: their vectors stay in the processor's cache
PRODUCT_CELLS = 1 << 23                          # cosines held at a time
REGION_TOKENS = 1 << 18                          # words around candidates that are looked at together
PAIR_CELLS = 1 << 23                             # sums of pairs of terms that a task holds
RESULT = "doc_id bigint, item_id bigint, cosine double, overlap double, answer double, word_start bigint"


def words_of(text) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Item:
    def __init__(self, item_id: int, text: str, answer):
        self.item_id, self.words = item_id, words_of(text)
        self.answer = words_of(answer)

    def numbered(self, vocab: dict[str, int]) -> "Item":
        """The item with numbers for words."""
        out = copy.copy(self)
        out.words, out.answer = [vocab[w] for w in self.words], [vocab.get(w, -1) for w in self.answer]
        return out

    def can_overlap(self, most: int) -> bool:
        """Whether a common subsequence of at most ``most`` words may be enough."""
        return most / len(self.words) >= (OVERLAP if len(self.words) >= SHORT else 1.0)

    def matches(self, region: list):
        """(overlap, answer share or None without an answer) if ``region`` (words, or numbers if ``numbered``) holds the item, else None."""
        common = lcs(self.words, region)
        if not self.can_overlap(common):
            return None
        overlap = common / len(self.words)
        if not self.answer:
            return overlap, None
        answer = lcs(self.answer, region) / len(self.answer)
        return (overlap, answer) if answer >= ANSWER else None


def passages(ids: np.ndarray, nothing: int, stride: int = STRIDE) -> np.ndarray:
    """Term numbers of one document in rows of ``stride``; a window is two rows."""
    rows = max(1, -(-len(ids) // stride))
    out = np.full(rows * stride, nothing, dtype=np.int32)
    out[:len(ids)] = ids
    return out.reshape(rows, stride)


def window_of(n_words: int) -> int:
    """Length of the windows that an item of so many words meets."""
    return max([w for w in WINDOWS if w <= n_words], default=WINDOWS[0])


def _term_ids(words: list[str], vocab: dict[str, int]) -> np.ndarray:
    none, get = len(vocab), vocab.get
    return np.array([get(w, none) for w in words], dtype=np.int32)


def encode_terms(docs: DataFrame, vocab_b) -> DataFrame:
    """``docs`` with ``terms`` for ``text``: the numbers (int32) of its words, words outside the vocabulary as its size, as bytes."""
    def run(batches):
        terms = Terms(vocab_b.value)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(terms=[ids.tobytes() for ids in terms.ids(pdf["text"])])

    return docs.mapInPandas(run, docs.drop("text").withColumn("terms", F.lit(b"")).schema)


def _first(ids: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` terms keep their numbers, all others get ``n``."""
    return np.minimum(ids, np.int32(n))


def document_frequency(encoded: DataFrame, n: int) -> DataFrame:
    """``(t, df)``: documents that hold each of the first ``n`` terms; every batch emits one row per term at most."""
    def run(batches):
        for pdf in batches:
            df = np.zeros(n + 1, dtype=np.int64)
            for terms in pdf["terms"]:
                df[np.unique(_first(np.frombuffer(terms, dtype=np.int32), n))] += 1
            t = np.flatnonzero(df[:-1])
            yield pd.DataFrame({"t": t, "df": df[t]})

    return encoded.select("terms").mapInPandas(run, "t int, df bigint").groupBy("t").agg(F.sum("df").alias("df"))


def _windows(rows: np.ndarray) -> list[np.ndarray]:
    """Term numbers of the windows over rows of terms."""
    return [rows[i:i + 2].ravel() for i in range(max(1, len(rows) - 1))]


class PairSums:
    """Upper triangle of the products of terms that share a passage, summed over passages scaled to unit length.

    Small vocabularies add in place; else sums are kept sorted, and given out when there are many."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.n = idf, len(idf)
        self.first = np.arange(self.n, dtype=np.int64) * self.n - np.arange(self.n, dtype=np.int64) * (np.arange(self.n) + 1) // 2
        cells = self.n * (self.n + 1) // 2                      # pair (t, u), t <= u, has the number first[t] + u
        self.dense = np.zeros(cells) if cells <= PAIR_CELLS else None
        self.keys, self.sums, self.held = [], [], 0

    def add(self, docs: list[np.ndarray], weights: list[float]) -> None:
        """Passages of documents (term numbers) that weigh ``weights``."""
        n, width = self.n, 2 * STRIDE
        rows = [passages(ids, n) for ids in docs]
        per = np.array([len(r) for r in rows])
        last = np.cumsum(per) - 1
        starts = np.ones(int(per.sum()), dtype=bool)
        starts[last[per > 1]] = False
        starts = np.flatnonzero(starts)
        rows = np.concatenate([*rows, np.full((1, STRIDE), n, dtype=np.int32)])
        alone = np.zeros(len(rows), dtype=bool)
        alone[last[per == 1]] = True
        follow = np.where(alone[starts], len(rows) - 1, starts + 1)
        weight = np.repeat(np.asarray(weights, dtype=float), per)[starts]
        some = (rows != n).any(axis=1)
        kept = some[starts] | some[follow]
        win = np.sort(np.concatenate([rows[starts[kept]], rows[follow[kept]]], axis=1), axis=1)
        weight = weight[kept]
        new = np.ones(win.shape, dtype=bool)
        new[:, 1:] = win[:, 1:] != win[:, :-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, win.size))
        term, owner = win.ravel()[at].astype(np.int64), at // width
        real = term != n
        term, owner, count = term[real], owner[real], count[real]
        v = count * self.idf[term]
        v *= (weight / np.sqrt(np.maximum(np.bincount(owner, v * v, len(win)), 1e-300)))[owner]
        for d in range(width):
            same = np.flatnonzero(owner[d:] == owner[:len(owner) - d])
            if not len(same):
                break
            self._sum(self.first[term[same]] + term[same + d], v[same] * v[same + d])

    def _sum(self, key: np.ndarray, x: np.ndarray) -> None:
        if self.dense is not None:
            np.add.at(self.dense, key, x)
            return
        self.keys.append(key)
        self.sums.append(x)
        self.held += len(key)
        if self.held > PAIR_CELLS // 4:
            self._merge()

    def _merge(self) -> None:
        if len(self.keys) > 1:
            key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.sums = [key], [np.bincount(at, np.concatenate(self.sums))]
            self.held = len(key)

    def full(self) -> bool:
        return self.dense is None and len(self.keys) == 1 and self.held > PAIR_CELLS // 8

    def take(self) -> pd.DataFrame:
        """The sums as rows ``(t, u, x)``, one a term, and start anew."""
        if self.dense is not None:
            key = np.flatnonzero(self.dense)
            x = self.dense[key]
            self.dense[key] = 0
        elif self.keys:
            self.keys, self.sums = [np.concatenate(self.keys)], [np.concatenate(self.sums)]
            key, at = np.unique(self.keys[0], return_inverse=True)
            x = np.bincount(at, self.sums[0])
        else:
            key, x = np.empty(0, np.int64), np.empty(0)
        self.keys, self.sums, self.held = [], [], 0
        t = np.searchsorted(self.first + np.arange(self.n), key, "right") - 1
        cut = np.flatnonzero(np.diff(t)) + 1
        u = (key - self.first[t]).astype(np.int32)
        heads = t[np.concatenate([[0], cut])] if len(t) else t
        return pd.DataFrame({"t": heads, "u": pd.Series(np.split(u, cut) if len(t) else [], dtype=object),
                             "x": pd.Series(np.split(x, cut) if len(t) else [], dtype=object)})


def term_products(encoded: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(t, u, x)``: A'A of the weighted unit TF-IDF passages A of ``encoded(terms, weight)``, a row a term with the terms
    that share a passage with it."""
    n = len(idf)
    idf_b = encoded.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        sums = PairSums(idf_b.value)
        docs, weights, size = [], [], 0
        for pdf in batches:
            for terms, weight in zip(pdf["terms"], pdf["weight"]):
                docs.append(_first(np.frombuffer(terms, dtype=np.int32), n))
                weights.append(weight)
                size += len(docs[-1])
                if size >= GROUP_TOKENS:
                    sums.add(docs, weights)
                    docs, weights, size = [], [], 0
                    if sums.full():
                        yield sums.take()
        if docs:
            sums.add(docs, weights)
        yield sums.take()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out, back = [], []
        for t, rows in pdf.groupby("t"):
            total = np.zeros(n)
            for u, x in zip(rows["u"], rows["x"]):
                total[u] += x
            u = np.flatnonzero(total)
            out.append((t, u, total[u]))
            back.append((np.full(int((u != t).sum()), t), u[u != t], total[u[u != t]]))
        t, u, x = (np.concatenate(c) for c in zip(*back))                   # the same sums, by the other term
        order = np.argsort(u, kind="stable")
        cut = np.flatnonzero(np.diff(u[order])) + 1
        if len(u):
            out += zip(u[order][np.concatenate([[0], cut])].tolist(), np.split(t[order], cut), np.split(x[order], cut))
        return pd.DataFrame(out, columns=["t", "u", "x"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(t, np.concatenate(rows["u"].tolist()), np.concatenate(rows["x"].tolist())) for t, rows in pdf.groupby("t")]
        return pd.DataFrame(out, columns=["t", "u", "x"])

    schema, group = "t int, u array<int>, x array<double>", F.pmod("t", F.lit(max(1, n // 32)))
    summed = encoded.select("terms", "weight").mapInPandas(run, schema).groupBy(group).applyInPandas(merge, schema)
    return summed.groupBy(group).applyInPandas(gather, schema)


def latent_space(encoded: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms x rank) of the weighted TF-IDF passages of ``encoded(terms, weight)``, by a
    randomised range finder with ``POWER`` power steps.  Passages are read once; their products stay distributed."""
    spark = encoded.sparkSession
    n = len(idf)
    width = min(n, RANK + EXTRA)
    rows = materialize(term_products(encoded, idf), "lsa-products")

    def product(q: np.ndarray) -> np.ndarray:
        """A'A q."""
        q_b = spark.sparkContext.broadcast(q)

        def run(batches):
            q = q_b.value
            for pdf in batches:
                x = [np.asarray(x) @ q[np.asarray(u)] for u, x in zip(pdf["u"], pdf["x"])]
                yield pd.DataFrame({"t": pdf["t"], "x": pd.Series(x, dtype=object)})

        got = rows.mapInPandas(run, "t int, x array<double>").toPandas()
        out = np.zeros((n, width))
        if len(got):
            out[got["t"].to_numpy()] = np.stack(got["x"].to_numpy())
        return out

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    for _ in range(POWER + 1):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    return q @ vectors[:, np.argsort(values)[::-1][:RANK]]


class Search:
    """Items, their latent passages by window length, and the folding table; size bounded by ``ITEM_BLOCK``.

    The first words of ``vocab`` are those of ``table``, whose last row stands for all others; words of answers alone may follow."""

    def __init__(self, items: list[Item], vocab: dict[str, int], table: np.ndarray):
        self.items, self.table, self.none = items, table, len(table) - 1
        self.terms, self.last = Terms(vocab), (None, None)
        self.numbered = [item.numbered(vocab) for item in items]
        self.counts = []                                  # per item: how often it holds each of its terms
        for item in items:
            count: dict[int, int] = {}
            for w in item.words:
                count[vocab[w]] = count.get(vocab[w], 0) + 1
            self.counts.append(count)
        held = np.array([(i, t, n) for i, count in enumerate(self.counts) for t, n in count.items()], dtype=np.int64).reshape(-1, 3)
        self.most = np.zeros(1 << max(16, (16 * len(held)).bit_length()), dtype=np.int32)   # ``counts`` by slot, the most of those that share one
        np.maximum.at(self.most, self._slot(held[:, 0], held[:, 1]), held[:, 2].astype(np.int32))
        self.lengths = np.array([len(item.words) for item in items], dtype=np.int64)
        self.windows = np.array([window_of(n) for n in self.lengths.tolist()], dtype=np.int64)
        self.groups = []                                  # (window, owners, lengths, unit vectors)
        for window in WINDOWS:
            vectors, owner = [], []
            for i, item in enumerate(items):
                if window_of(len(item.words)) != window:
                    continue
                for w in _windows(passages(_term_ids(item.words, vocab), self.none, window // 2)):
                    vectors.append(table[w].sum(axis=0))
                    owner.append(i)
            if not owner:
                continue
            z = np.array(vectors, dtype=np.float32)
            length = np.linalg.norm(z, axis=1)
            has = length > 1e-9
            self.groups.append((window, np.array(owner)[has], length[has], z[has] / length[has, None]))
        self.short: dict[int, dict[bytes, list[int]]] = {}    # length -> word sequence -> items
        for i, item in enumerate(items):
            if len(item.words) < SHORT:
                sequence = _term_ids(item.words, vocab).tobytes()
                self.short.setdefault(len(item.words), {}).setdefault(sequence, []).append(i)

    def _slot(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        h = item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + term.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self.most).bit_length())).astype(np.int64)

    def ids(self, texts) -> list[np.ndarray]:
        """Term numbers of each text, of which those of the last list are kept; a list of numbers is taken as it is."""
        if len(texts) and isinstance(texts[0], np.ndarray):
            return texts
        if self.last[0] is not texts:
            self.last = texts, self.terms.ids(texts)
        return self.last[1]

    def sequences(self, ids: np.ndarray):
        """(item number, first word) of the first occurrence of each short item in one document."""
        for n, items in self.short.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(np.isin(ids[:len(ids) - n + 1], [np.frombuffer(k, dtype=np.int32)[0] for k in items]))
            left = dict(items)
            for at in starts.tolist():
                for i in left.pop(ids[at:at + n].tobytes(), ()):
                    yield i, at
                if not left:
                    break

    def candidates(self, texts):
        """(text number, item number, first word, cosine) of candidate windows, best first per pair, without those around which the
        words in common cannot be enough."""
        columns = self._near(texts)
        kept = self._may_overlap(texts, *columns[:3])
        return zip(*(x[kept].tolist() for x in columns))

    def _near(self, texts) -> tuple[np.ndarray, ...]:
        """Columns text number, item number, first word, cosine of the windows near an item, best first per pair."""
        none, least = self.none, WINDOWS[0] // 2
        out, group, size = [], [], 0

        def flush():
            if not group:
                return
            unit = np.concatenate([g for _, g in group])          # rows of the smallest stride, padded to the largest
            count = np.array([len(g) for _, g in group])
            number = np.array([i for i, _ in group])
            known = unit != none
            words = known.sum(axis=1)
            own = np.argsort(-words, kind="stable")[:np.count_nonzero(words)]
            z = np.zeros((len(unit), self.table.shape[1]), dtype=np.float32)
            if len(own):                                          # words of the benchmark first, as they follow: others have no vector
                used = np.take_along_axis(unit[own], np.argsort(~known[own], axis=1, kind="stable"), axis=1).T
                folded = self.table.take(used[0], axis=0)
                for j in range(1, int(words[own[0]])):
                    n = np.count_nonzero(words[own] > j)
                    folded[:n] += self.table.take(used[j, :n], axis=0)
                z[own] = folded
            rows, held = z, 1
            for window, owner, length, vectors in self.groups:
                k = window // 2 // least
                rows = rows[::k // held]
                for j in range(held, k):                          # a row is two of the window before
                    rows = rows + z[j::k]
                held = k
                last = np.cumsum(count // k) - 1                  # a document's last row is a window of its own
                whole = np.empty_like(rows)                       # a window is two rows
                np.add(rows[:-1], rows[1:], out=whole[:-1])
                whole[last] = rows[last]
                norm = np.sqrt((whole * whole).sum(axis=1))
                step = max(1, PRODUCT_CELLS // max(1, len(owner)))
                for a in range(0, len(rows), step):
                    cos = whole[a:a + step] @ vectors.T
                    hit = np.flatnonzero((cos > 0.999 * COSINE * norm[a:a + step, None]).ravel())      # few are divided
                    r, c = np.divmod(hit, len(owner))
                    found = cos.ravel()[hit] / (np.maximum(norm[a + r], EVIDENCE * length[c]) + 1e-9)
                    near = found >= COSINE
                    r, c, found = r[near], c[near], found[near]
                    doc = np.searchsorted(last, a + r)
                    at = a + r - (last[doc] + 1 - count[doc] // k)
                    out.append((number[doc], owner[c], at * (window // 2), found))
            group.clear()

        for i, ids in enumerate(self.ids(texts)):
            if not len(ids):
                continue
            for item, at in self.sequences(ids):
                out.append(([i], [item], [at], [1.0]))
            group.append((i, passages(_first(ids, none), none, WINDOWS[-1] // 2).reshape(-1, least)))
            size += len(ids)
            if size >= SEARCH_TOKENS:
                flush()
                size = 0
        flush()
        out.append((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)))
        doc, item, at, cos = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((at, -cos, item, doc))
        return doc[order], item[order], at[order], cos[order]

    def _may_overlap(self, texts, doc: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the candidates around which the words in common with the item may be enough: no subsequence is longer."""
        ids = self.ids(texts)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        ids, base = np.concatenate([np.empty(0, np.int32), *ids]), np.cumsum(sizes) - sizes
        n = self.lengths[item]
        a, b = np.maximum(0, at - n), np.minimum(sizes[doc], at + self.windows[item] + n)
        step = max(1, REGION_TOKENS // max(1, int((b - a).max(initial=0))))
        kept = [np.empty(0, np.int64)]
        for i in range(0, len(doc), step):
            some = np.arange(i, min(i + step, len(doc)))
            size = b[some] - a[some]
            owner = np.repeat(some, size)
            word = ids[np.arange(len(owner)) + np.repeat(base[doc[some]] + a[some] - (np.cumsum(size) - size), size)]
            most = self.most[self._slot(item[owner], word)]
            owner, word, most = owner[most > 0], word[most > 0], most[most > 0]
            enough = self._enough(np.bincount(owner - i, minlength=len(some)), n[some])
            left = enough[owner - i]
            key = np.sort((owner[left] - i) * np.int64(self.terms.none + 1) + word[left])      # each word as often as the item has it
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
            owner, word = np.divmod(key[first], self.terms.none + 1)
            times = np.minimum(np.diff(np.append(first, len(key))), self.most[self._slot(item[owner + i], word)])
            kept.append(some[enough & self._enough(np.bincount(owner, times, len(some)), n[some])])
        return np.concatenate(kept)

    @staticmethod
    def _enough(most: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``Item.can_overlap`` of many."""
        return most / length >= np.where(length >= SHORT, OVERLAP, 1.0)

    def found(self, texts):
        """Confirmed (text number, item number, cosine, overlap, answer, first word); ``texts`` or their term numbers."""
        done, last, ids, tried = set(), None, [], set()
        for doc, i, at, cos in self.candidates(texts):
            if (doc, i) in done:
                continue
            if doc != last:
                last, ids, tried = doc, self.ids(texts)[doc].tolist(), set()
            item = self.numbered[i]
            a, b = max(0, at - len(item.words)), at + window_of(len(item.words)) + len(item.words)
            if (i, a, b) in tried:                        # several passages of an item in one window
                continue
            tried.add((i, a, b))
            got = item.matches(ids[a:b])
            if got:
                done.add((doc, i))
                yield doc, i, cos, *got, at


def searches(docs: DataFrame, benchmark: DataFrame):
    """For each block of the benchmark a broadcast ``Search``, its space fitted on all of ``docs``, and ``docs`` with term numbers
    for texts (``encode_terms``), which are given back when the next block is asked for."""
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    items = materialize(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text", answer.cast("string").alias("answer"))
                        .filter(r"text rlike '(?U)\\w'").dropDuplicates(), "benchmark")
    n_items = items.count()
    blocks = -(-n_items // ITEM_BLOCK)
    if not n_items:
        return
    n_docs = docs.count()
    tasks = bucket_count(text_bytes(docs), TASK_BYTES)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        listed = [Item(r["item_id"], r["text"], r["answer"]) for r in part.orderBy("item_id", "text").collect()]
        listed = [x for x in listed if x.words]
        if not listed:
            continue
        every = sorted({w for x in listed for w in x.words})
        n = len(every)
        every += sorted({w for x in listed for w in x.answer} - set(every))         # only looked for in answers
        vocab = {w: i for i, w in enumerate(every)}
        vocab_b = spark.sparkContext.broadcast(vocab)
        path = shared_path(spark, "lsa-terms")
        encoded = materialize(encode_terms(docs, vocab_b), "lsa-terms", path)       # four bytes a word before compression; no texts
        counted = document_frequency(encoded, n)
        frequency = {r["t"]: r["df"] for r in counted.collect()}            # at most one row per term of the block
        df = np.array([frequency.get(i, 0) for i in range(n)], dtype=float)
        idf = np.log((1 + n_docs) / (1 + df)) + 0.05
        weight = min(1.0, (DOCS_WEIGHT / max(1, n_docs)) ** 0.5)            # squared in the products
        both = encoded.select("terms", F.lit(weight).alias("weight")).union(
            encode_terms(part.select("text"), vocab_b).select("terms", F.lit(ITEM_WEIGHT)))
        space = latent_space(both.coalesce(tasks), idf)
        table = np.zeros((n + 1, space.shape[1]), dtype=np.float32)
        table[:-1] = space * idf[:, None]
        yield spark.sparkContext.broadcast(Search(listed, vocab, table)), encoded
        discard(encoded, path)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, cosine, overlap, answer, word_start)`` of every document and item it holds."""
    # ids travel as text: exact beside nulls
    docs = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text")
    out = None
    for search_b, encoded in searches(docs, benchmark):
        rows = encoded.mapInPandas(_finder(search_b), RESULT.replace("doc_id bigint", "doc_id string"))
        rows = materialize(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), "contaminated")
        out = rows if out is None else out.union(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def _finder(search_b):
    def run(batches):
        search = search_b.value
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            got = [(ids[d], search.items[i].item_id, cos, overlap, answer, at)
                   for d, i, cos, overlap, answer, at in search.found([np.frombuffer(x, dtype=np.int32) for x in pdf["terms"]])]
            out = pd.DataFrame(got, columns=["doc_id", "item_id", "cosine", "overlap", "answer", "word_start"])
            out["item_id"] = pd.array([g[1] for g in got], dtype="Int64")
            yield out

    return run


def _holds_item(search_b):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = search_b.value
        for part in texts:
            bad = np.zeros(len(part), dtype=bool)
            bad[[d for d, *_ in search.found(part.tolist())]] = True
            yield pd.Series(bad)

    return F.pandas_udf(run, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, columns as given.  Rows are judged where they are; only texts go to Python."""
    kept = docs
    for search_b, _ in searches(docs.select("text"), benchmark):
        kept = kept.filter(~_holds_item(search_b)("text"))
    return kept
