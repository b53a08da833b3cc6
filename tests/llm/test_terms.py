"""Term numbers by code points against a string a word; the search sends few candidates to the longest common subsequence."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import decontaminate
from colloquy.llm.terms import PIECE, Terms


def test_terms_match_a_string_a_word():
    rng = random.Random(3)
    some = ["Σας", "İstanbul", "straße", "naïve", "ćd", "為日本", "٣٤", "²½", "a_b", "x" * 300, "de", "as", "\U0001d400b", "\ud800x"]
    texts = ["", None, "ΑΣ ΣΑΣ\nΣ", "-", "word", "y" * (2 * PIECE) + " as", "de as " * PIECE]
    texts += ["".join(rng.choice(some) + rng.choice(" .\n‍-") for _ in range(rng.randrange(40))) for _ in range(200)]
    every = sorted({w for t in texts for w in decontaminate.words_of(t)})
    for vocab in ({w: i for i, w in enumerate(every)}, {w: i for i, w in enumerate(every[::3])}, {}):
        got = Terms(vocab).ids(texts)
        assert len(got) == len(texts)
        for ids, text in zip(got, texts):
            assert ids.dtype == np.int32 and np.array_equal(ids, decontaminate._term_ids(decontaminate.words_of(text), vocab))


def test_terms_take_less_time_than_a_string_a_word(word):
    texts = [word(5000, 7400 + i) for i in range(40)]
    vocab = {w: i for i, w in enumerate(sorted(set(" ".join(texts[:20]).split())))}
    terms = Terms(vocab)
    terms.ids(texts)

    def cpu(f):
        best = []
        for _ in range(3):
            began = time.process_time()
            f()
            best.append(time.process_time() - began)
        return min(best)

    assert cpu(lambda: terms.ids(texts)) < cpu(lambda: [decontaminate._term_ids(decontaminate.words_of(t), vocab) for t in texts])


def test_windows_without_enough_common_words_are_not_compared(word, monkeypatch):
    """Candidates that cannot reach the overlap cost no subsequence; those that can are judged as before."""
    items = [decontaminate.Item(i, word(40, 7500 + i), None) for i in range(5)]
    vocab = {w: k for k, w in enumerate(sorted({w for x in items for w in x.words}))}
    table = np.eye(len(vocab) + 1, len(vocab), dtype=np.float32)
    texts = [word(300, 7600) + " " + " ".join(items[2].words) + " " + word(100, 7601), word(500, 7602), None]
    search, asked = decontaminate.Search(items, vocab, table), []
    plain = decontaminate.lcs
    monkeypatch.setattr(decontaminate, "lcs", lambda a, b: asked.append(1) or plain(a, b))
    assert [(d, i) for d, i, *_ in search.found(texts)] == [(0, 2)]
    pairs = len({c[:2] for c in search.candidates(texts)})
    assert pairs >= 1 and len(asked) <= pairs


def test_drop_contaminated_keeps_no_copy_of_the_texts(spark, word, monkeypatch):
    written = []
    plain = decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, what, path=None: written.append(df.columns) or plain(df, what, path))
    gone, throw = [], decontaminate.discard
    monkeypatch.setattr(decontaminate, "discard", lambda df, path: throw(df, path) or gone.append(spark.read.parquet(path).count()))
    item = word(40, 7700)
    docs = spark.createDataFrame([(1, word(50, 7701) + " " + item, {"k": 1}), (None, word(90, 7702), None), (2, None, {}), (2, None, {})],
                                 "doc_id bigint, text string, more map<string, int>")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("not doc_id <=> 1").collect()))
    assert all("text" not in c or "item_id" in c for c in written) and gone == [0]
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 1)                 # one pass a block
    more = bench.union(spark.createDataFrame([(2, word(90, 7702))], bench.schema))
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, more).select(F.col("doc_id")).collect()) == [2, 2]


def test_search_goes_over_the_stored_numbers(spark, word, monkeypatch):
    """Words are numbered once; texts and their numbers give the same rows, and words of answers alone have numbers too."""
    items = [decontaminate.Item(i, word(40, 7800 + i), "blue whale" if i else None) for i in range(3)]
    vocab = {w: k for k, w in enumerate(sorted({w for x in items for w in x.words}))}
    table = np.eye(len(vocab) + 1, len(vocab), dtype=np.float32)
    vocab |= {"blue": len(vocab), "whale": len(vocab) + 1}
    body = [" ".join(x.words) for x in items]
    texts = [word(200, 7810) + " " + body[0], None, word(70, 7811) + " " + body[1] + " Blue, whale " + word(50, 7812), body[2] + " whale blue " + body[1]]
    search = decontaminate.Search(items, vocab, table)
    got = list(search.found(texts))
    assert [(d, i, answer) for d, i, _, _, answer, _ in got] == [(0, 0, None), (2, 1, 1.0), (3, 1, 0.5), (3, 2, 0.5)]
    assert got == list(search.found(Terms(vocab).ids(texts)))
    written, plain = [], decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, what, path=None: written.append(df.columns) or plain(df, what, path))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(x.item_id, b, " ".join(x.answer) or None) for x, b in zip(items, body)], "item_id bigint, text string, answer string")
    assert sorted((r.doc_id, r.item_id, r.answer) for r in decontaminate.contaminated(docs, bench).collect()) == [(d, i, a) for d, i, _, _, a, _ in got]
    assert ["doc_id", "terms"] in written and all("text" not in c or "item_id" in c for c in written)


def test_no_candidate_that_may_hold_its_item_is_left_out(word):
    """Words in common are counted for many candidates at once: as ``Item.can_overlap`` of each word as often as both have it."""
    rng = random.Random(9)
    names = word(60, 7900).split()
    items = [decontaminate.Item(i, " ".join(rng.choices(names, k=n)), None) for i, n in enumerate([3, 5, 9, 20, 33, 60])]
    vocab = {w: k for k, w in enumerate(sorted({w for x in items for w in x.words}))}
    search = decontaminate.Search(items, vocab, np.eye(len(vocab) + 1, len(vocab), dtype=np.float32))
    texts = [" ".join(rng.choices([*names, "zz"], k=n)) for n in (1, 8, 40, 300)] + [None, ""]
    at = [(d, i, a) for d, t in enumerate(texts) for i in range(6) for a in range(0, len(decontaminate.words_of(t)), 4)]
    want = []
    for k, (d, i, a) in enumerate(at):
        n = len(items[i].words)
        region = decontaminate.words_of(texts[d])[max(0, a - n):a + decontaminate.window_of(n) + n]
        if items[i].can_overlap(sum(min(items[i].words.count(w), region.count(w)) for w in set(region))):
            want.append(k)
    assert search._may_overlap(texts, *np.array(at).T).tolist() == want and 0 < len(want) < len(at)
