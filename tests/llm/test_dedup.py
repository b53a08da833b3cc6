import hashlib
import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import simhash, suffix_dedup
from colloquy.llm.common import connected_components


def _raw(t):
    return (t or "").encode()


def test_suffix_dedup_equals_brute_force(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = suffix_dedup.brute_force([(i, _raw(r.text)) for i, r in enumerate(rows)])
    expected = sorted(((r.doc_id is None, r.doc_id), *want[i]) for i, r in enumerate(rows))
    got = sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(odd_docs).collect())
    assert got == expected and sum(g[2] for g in got) > 3000


@pytest.mark.parametrize("hot", [1, 20_000])
def test_suffix_dedup_edits_overlaps_and_crowded_anchors(spark, hot, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(1500))
    texts = [base]
    for i in range(25):
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(len(t))] = "Z"
        k = rng.randrange(200)
        texts.append("".join(t[k:]) + "".join(rng.choice("abcd ") for _ in range(rng.randrange(300))))
    texts += [base[300:499], base[300:500], base[300:501], base[700:700 + 150] * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    want = suffix_dedup.brute_force([(i, t.encode()) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want


def test_transform_merge_orders_suffixes():
    """The merged interleave lists all suffixes by their first DEPTH symbols."""
    import numpy as np
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 3, n).tolist() + [-1] for n in (40, 31, 55, 12)]
    sym = np.array([x + 1 for t in texts for x in t])
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    end = np.repeat(begin + size - 1, size)
    first, follow, orders = [], [], []
    for a, b in ((0, int(size[:2].sum())), (int(size[:2].sum()), len(sym))):
        o = suffix_dedup.shard_order(sym[a:b], end[a:b] - a)
        rank = np.empty(b - a, dtype=np.int64)
        rank[o] = np.arange(b - a)
        first.append(sym[a:b][o])
        follow.append(rank[np.minimum(o + 1, end[a:b][o] - a)])
        orders.append(o + a)
    order, block = suffix_dedup.merge_transforms(first, follow)
    suffix = np.concatenate(orders)[order]
    keys = [tuple(sym[s:end[s] + 1][:suffix_dedup.DEPTH]) for s in suffix]
    assert keys == sorted(keys)
    assert all((a == b) == (x == y) for (a, x), (b, y) in zip(zip(keys, block), list(zip(keys, block))[1:]))


def test_remove_repeats_keeps_columns(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({"_k1": F.lit("x"), "_ranges": F.lit(1)})
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert rows[103].text is None and rows[106].n_chars == 9 and rows[108].text == "" and rows[108].n_chars == 0
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0 and suffix_dedup.remove_repeats(no_docs).count() == 0


def test_fingerprint_is_the_majority_of_seeded_xxh64():
    text = "The  quick\tBROWN fox\njumps over Ä the lazy dog"
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    for pair in itertools.combinations(range(64), 2):
        diff = sum(1 << b for b in pair)
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_have_the_components_of_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(20):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) if rng.random() < .7 else 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "_fp bigint")
    edges = simhash.links(df)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in edges.collect())
    root = {r.node: r.root for r in connected_components(edges).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 2:
            parent[find(a)] = find(b)
    for a, b in itertools.combinations(fps, 2):
        sa, sb = simhash._signed(a), simhash._signed(b)
        assert (find(a) == find(b)) == (root.get(sa, sa) == root.get(sb, sb))


def test_simhash_groups(spark, odd_docs, no_docs):
    got = {}
    for r in simhash.simhash_near_dedup(odd_docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert got[102] == got[102] and next(iter(got[102]))[1] == 1          # copy of document 1
    assert {x for x in got[103]} == {("0" * 16, 103)} and {c for _, c in got[104] | got[105]} == {103}
    assert (next(iter(got[2]))[0], 2) in got[None]                        # a null id is never the smallest
    assert simhash.simhash_near_dedup(no_docs).count() == 0
    kept = simhash.keep_one_per_group(odd_docs.withColumn("_uid", F.lit(7)))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns[-1] == "_uid" and 102 not in ids and None not in ids and 104 not in ids and ids.count(103) == 1


def test_sha_of_untouched_text(spark):
    docs = spark.createDataFrame([(1, "short text")], "doc_id bigint, text string")
    assert suffix_dedup.suffix_dedup(docs).first().kept_sha256 == hashlib.sha256(b"short text").hexdigest()


def test_simhash_keeps_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "one two three"), (None, "four five six")], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.simhash_near_dedup(docs).collect()} == {big, None}
