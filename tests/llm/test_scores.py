import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, gru, lm_scores, nearest, toxicity

BAD = ["grobnik", "zzfoul", "vexwort"]


@pytest.fixture(scope="module")
def labelled(spark, word):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        t = word(60, 1000 + i).split()
        if toxic:
            for _ in range(4):
                t.insert(rng.randrange(60), rng.choice(BAD) + rng.choice(["", "", "ia"]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_toxicity_held_out(spark, labelled, odd_docs, no_docs):
    docs, labels, truth = labelled
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    odd = toxicity.toxicity_scores(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(odd_docs, labels.limit(0)).collect()} == {0.0}
    named = docs.withColumn("_score", F.lit("mine"))
    kept = toxicity.drop_toxic(named, labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    assert kept.columns == named.columns
    left = {r.doc_id for r in kept.collect()}
    assert len([i for i in left if truth[i]]) <= 8 and len([i for i in left if not truth[i]]) >= 660


def plain_ratio(sample, text):
    """Length-normalised log-likelihood ratio, class 1 over class 0, from dictionaries; sample: (text, class) rows."""
    d, pull = toxicity.DISCOUNT, toxicity.PULL
    words, pairs = {}, {}
    for t, y in sample:
        ws = toxicity.words_of(t)
        for table, items in ((words, set(ws)), (pairs, set(zip([None, *ws], ws)))):
            for i in items:
                table.setdefault(i, [0, 0])[y] += 1
    share = sum(c[1] for c in words.values()) / sum(sum(c) for c in words.values())

    def split(c, odds):
        n, even = sum(c), sum(c) * odds
        far = max(abs(c[1] - even) - pull * math.sqrt(n * odds * (1 - odds)), 0)
        one = even + math.copysign(far, c[1] - even)
        return (n - one) / (1 - share), one / share

    def back_off(counts, k):
        total = sum(c[k] for c in counts)
        return total, 1 - sum(max(c[k] - d, 0) for c in counts) / total

    by_word = {w: split(c, share) for w, c in words.items()}
    rest = d * len(words) / (len(words) + 1) / len(pairs)
    stands = {w: sum(x[1] == w for x in pairs) for w in words}

    def word(w, k):
        total, back = back_off(by_word.values(), k)
        if w not in words:
            return back * rest
        return max(by_word[w][k] - d, 0) / total + back * (max(stands[w] - d, 0) / len(pairs) + rest)

    def odds(w):
        return word(w, 1) * share / (word(w, 1) * share + word(w, 0) * (1 - share))

    by_pair = {x: split(c, odds(x[1])) for x, c in pairs.items()}

    def pair(u, w, k):
        after = {x: c for x, c in by_pair.items() if x[0] == u}
        if not after:
            return word(w, k)
        total, back = back_off(after.values(), k)
        return (max(after[u, w][k] - d, 0) / total if (u, w) in after else 0) + back * word(w, k)

    ws = toxicity.words_of(text)
    return sum(math.log(pair(u, w, 1)) - math.log(pair(u, w, 0)) for u, w in zip([None, *ws], ws)) / len(ws)


def test_toxicity_model_equals_plain_sums(spark, monkeypatch):
    rng = random.Random(3)
    sample = []
    for i in range(160):
        y = int(i % 3 == 0)
        ws = [rng.choice("ab ba cd da ef ga hi".split()) for _ in range(rng.randrange(1, 14))] + (["vex", "ab"] if y else ["ab", "vex"] if i % 5 else [])
        sample.append((" ".join(ws), y))
    words, pairs = toxicity.count_tables(spark.createDataFrame([*sample, (None, 0), ("", 1)], "text string, _y int").repartition(3))
    model, keys = toxicity.KneserNey(words, pairs), toxicity.Keys()
    monkeypatch.setattr(toxicity, "SLICE", 3)
    for t in ("vex ab", "ab vex", "hi", "unheard word ab", "ga ga unheard vex ab ba cd da ef vex"):
        assert math.isclose(model.evidence(keys(t)), plain_ratio(sample, t), rel_tol=1e-9, abs_tol=1e-9)
    assert model.evidence(keys("")) == model.evidence(keys(None)) == 0.0


def test_toxicity_tells_an_order_of_words(spark):
    nice, foul = "you are nice and he is dead", "you are dead and he is nice"
    docs = spark.createDataFrame([(i, (nice, foul)[i % 2]) for i in range(600)], "doc_id bigint, text string")
    extra = docs.withColumn("text", F.concat("text", F.lit(" x"), F.col("doc_id")))          # texts differ: each row counts
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    out = toxicity.toxicity_scores(extra, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_gru_gradients_and_window_carry():
    rng = np.random.default_rng(0)
    shape = gru.Shape(12, 6, 4, 2, 5, 3)
    p = gru.initial(shape, np.log(np.full(6, 1 / 6)), np.log(np.full(8, 0.5)), 1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, cls = rng.integers(0, 12, (7, 3)), rng.integers(0, 6, (7, 3))
    word = np.where(cls < 4, rng.integers(0, 2, (7, 3)), -1)
    h0 = rng.standard_normal((3, 5))
    g, loss, _ = gru.train_window(p, x, h0, 0, cls, word)
    for k, v in p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 5)]:
            old, eps = v[at], 1e-6
            v[at] = old + eps
            up = gru.train_window(p, x, h0, 0, cls, word)[1]
            v[at] = old - eps
            down = gru.train_window(p, x, h0, 0, cls, word)[1]
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-5
    ids = rng.integers(1, 12, 40)
    c = rng.integers(0, 6, 40)
    w = np.where(c < 4, 0, -1)
    starts, lengths = np.array([0, 25, 30]), np.array([25, 5, 10])
    whole = gru.document_logs(p, ids, c, w, starts, lengths, 0, window=64)
    assert np.allclose(whole, gru.document_logs(p, ids, c, w, starts, lengths, 0, window=3, rows_per_block=7))


def test_lm_scores_base_and_total_probability(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scores, "CHUNK_BYTES", 20_000)
    rows = odd_docs.select("doc_id", "text").collect()
    count = {}
    for r in rows:
        if not lm_scores.held_out(r.doc_id):
            for w in [*(r.text or "").encode().lower().split(), b"\n"]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)

    def base(t):
        ws = [*(t or "").encode().lower().split(), b"\n"]
        return (len(ws), sum(w in count for w in ws), round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6))

    want = sorted((str(r.doc_id), lm_scores.held_out(r.doc_id), *base(r.text)) for r in rows)
    got = lm_scores.lm_scores(odd_docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm_scores.lm_scores(no_docs).count() == 0
    assert lm_scores.lm_scores(odd_docs.filter("doc_id is null")).count() == 2


def test_lm_trains_on_every_training_document(spark, monkeypatch):
    class Seen(Exception):
        pass

    def spy(train, *rest):
        raise Seen(train.count())

    monkeypatch.setattr(lm_scores, "fit_weights", spy)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('some words of text ', 250)").alias("text"))
    with pytest.raises(Seen) as seen:
        lm_scores.lm_scores(docs)
    assert seen.value.args[0] == sum(not lm_scores.held_out(i) for i in range(2000))      # about 1.7 M words


def test_weights_are_averaged_by_words():
    rows = [(i, 10 * (i + 1), np.full(3, float(i)).tobytes()) for i in range(5)]
    got = lm_scores._mean(pd.DataFrame(rows, columns=["replica", "words", "weights"]))
    assert got["words"].tolist() == [150] and np.allclose(np.frombuffer(got["weights"][0]), sum(i * 10 * (i + 1) for i in range(5)) / 150)


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [1.0, None] * 8),
                                                          (4080, [float("inf")] * 16), (None, x[0].tolist()), (40, x[40].tolist()), (5000, [1.0, 2.0])]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("uid", F.lit(1))).collect()
    ids, v = np.array([*range(3000), 40]), np.vstack([x, x[40]])
    hits = total = 0
    for q in range(0, 3000, 20):
        s = v @ x[q]
        mine = [r for r in out if r.query_id == q]
        others = [i for i in np.lexsort((ids, -s)) if not (i == q)][:20]
        hits += len({r.vec_id for r in mine} & set(ids[others].tolist()))
        total += len(set(ids[others].tolist()))
        first = sorted(mine, key=lambda r: r["rank"])[:20]
        assert all(a.score > b.score or (a.score == b.score and a.vec_id <= b.vec_id) or q == 40 for a, b in zip(first, first[1:]))
        assert all(abs(r.score - float(v[list(ids).index(r.vec_id)] @ x[q])) < 1e-9 for r in first[:3])
    assert hits / total >= 0.9
    assert not [r for r in out if r.query_id in (4000, 4020, 4040, 4060, 4080, 5000) or r.vec_id in (4000, 4020, 4040, 4060, 4080, 5000)]
    twice = spark.createDataFrame([(40, [1.0, 0.0])] * 2 + [(3, [0.2, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r["rank"], r.vec_id) for r in nearest.nearest(twice).collect()) == [(1, 40), (1, 40), (2, 3), (2, 3)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id bigint, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in nearest.nearest(few).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.5)]
    assert nearest.nearest(few.limit(0)).count() == 0


def test_decontamination(spark, word, odd_docs, no_docs):
    items = [(i, word(40, 5000 + i) + ". " + word(6, 6000 + i) + ".") for i in range(20)] + [(50, "tiny item here"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    exact = (900, word(200, 1) + " " + items[3][1] + " " + word(300, 2))
    edited = items[7][1].split()
    for k in range(2, len(edited), 7):
        edited[k] = "changed"
    para = (901, word(90, 3) + " " + " ".join(edited) + " " + word(90, 4))
    half = (902, word(90, 5) + " " + " ".join(items[9][1].split()[:15]) + " " + word(90, 6))
    rows = [exact, exact, para, half, (903, "nothing tiny at all item there"), (904, "a tiny item here"), (None, items[0][1])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(False, 900, 3), (False, 900, 3), (False, 901, 7), (False, 904, 50), (True, 0, 0)]
    kept = decontaminate.drop_contaminated(docs.withColumn("_row", F.lit(1)), bench)
    assert kept.count() == docs.count() - 5 and kept.columns == ["doc_id", "text", "_row"]
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_without_answer_column(spark, word):
    text = word(37, 7001) + ". Ñ"
    docs = spark.createDataFrame([(1, word(60, 7002) + " " + text.rsplit(" ", 1)[0] + " " + word(60, 7003)), (2, word(150, 7004))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    assert [(r.doc_id, r.answer) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, None)]
    asked = bench.withColumn("answer", F.lit("blue whale"))
    assert decontaminate.contaminated(docs, asked).count() == 0


def test_decontamination_non_latin_items(spark, word):
    cyrillic = "каждое слово этого длинного вопроса написано только русскими буквами без латинских знаков"
    docs = spark.createDataFrame([(1, word(50, 7101) + " " + cyrillic + " " + word(50, 7102)), (2, word(100, 7103))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, cyrillic), (2, "...")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]


def test_recall_against_brute_force_in_a_large_benchmark(spark):
    """3,000 items over one small vocabulary: copies, short items and paraphrases that keep 0.6 to 0.8 of the words."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(1500)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [pick(rng.choice([3, 6, 10, 15, 24, 40, 70])) for _ in range(3000)]
    docs = []
    for d in range(200):
        body = list(items[d * 15])
        if len(body) >= decontaminate.SHORT:
            lost = rng.sample(range(len(body)), int(len(body) * rng.choice([0, 0.2, 0.35])))
            for k in lost:
                body[k] = rng.choice(vocab)
        docs.append((d, " ".join(pick(rng.randrange(20, 120)) + body + pick(rng.randrange(20, 120)))))
    truth = set()
    for d, text in docs:
        item = decontaminate.Item(d * 15, " ".join(items[d * 15]), None)
        if item.matches(decontaminate.words_of(text)):
            truth.add((d, d * 15))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")).collect()}
    recall = len(got & truth) / len(truth)
    print(f"planted pairs {len(truth)}, recall {recall:.3f}")
    assert recall >= 0.95


def test_candidates_at_a_document_start_are_all_tried(word, monkeypatch):
    item = decontaminate.Item(1, word(40, 7200), None)
    stretched = word(30, 7201).split() + [w for pair in zip(item.words, word(40, 7202).split()) for w in pair]
    search = decontaminate.Search([item], {w: k for k, w in enumerate(sorted(set(item.words)))}, np.eye(41, 40, dtype=np.float32))
    monkeypatch.setattr(search, "candidates", lambda texts: [(0, 0, 0, 0.9), (0, 0, 32, 0.8)])
    assert [(d, i) for d, i, *_ in search.found([" ".join(stretched)])] == [(0, 0)]


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(1, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_nearest_huge_and_tiny_components(spark):
    rows = [(i, [10.0 ** e * (i % 7 + 1), 10.0 ** e]) for e in (160, -170) for i in range(40) if (i < 20) == (e > 0)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.query_id for r in out} == {0, 20} and len(out) == 40


def test_latent_space_is_fitted_on_every_document(spark, word, monkeypatch):
    """Products of the passages of more documents than ``DOCS_WEIGHT``, against a plain loop over all of them."""
    monkeypatch.setattr(decontaminate, "DOCS_WEIGHT", 10)
    vocab = {w: i for i, w in enumerate(sorted(set(word(25, 7300).split())))}
    names, rng = list(vocab), random.Random(5)
    texts = [" ".join(rng.choice([*names, "zz", "yy"]) for _ in range(rng.choice([0, 3, 16, 17, 33, 90]))) for _ in range(60)]
    idf = np.linspace(0.1, 2.0, len(vocab))
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(4)
    encoded = decontaminate.encode_terms(rows, spark.sparkContext.broadcast(vocab))
    want = np.zeros((len(vocab), len(vocab)))
    for t in texts:
        for w in decontaminate._windows(decontaminate.passages(decontaminate._term_ids(t.split(), vocab), len(vocab))):
            v = np.bincount(w, minlength=len(vocab) + 1)[:-1] * idf
            if v.any():
                want += np.outer(v, v) / (v @ v) / 4
    got = np.zeros_like(want)
    for r in decontaminate.term_products(encoded.select("terms", F.lit(0.5).alias("weight")), idf).collect():
        got[r.t, r.u] += r.x
    assert np.allclose(want, got)
    monkeypatch.setattr(decontaminate, "PAIR_CELLS", 200)    # too few for dense sums: kept sorted, given out in parts
    got, parts = np.zeros_like(want), 0
    sums = decontaminate.PairSums(idf)
    for t in [*texts, None]:
        if t is None or sums.full():
            parts += 1
            for r in sums.take().itertuples():
                got[r.t, r.u] += r.x
        if t:
            sums.add([decontaminate._term_ids(t.split(), vocab)], [0.5])
    assert np.allclose(np.triu(want), got) and parts > 1
    fitted = []
    monkeypatch.setattr(decontaminate, "latent_space", lambda e, idf: fitted.append(e.groupBy("weight").count().collect()) or np.eye(len(idf)))
    docs = rows.select(F.lit(1).alias("doc_id"), "text")
    decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(names))], "item_id bigint, text string")).collect()
    assert sorted((round(r["weight"] ** 2, 6), r["count"]) for r in fitted[0]) == [(round(10 / 61, 6), 61), (100.0, 1)]
