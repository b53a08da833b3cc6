"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two
fingerprints link when they differ in at most ``RADIUS`` bits.

Candidate search is *covering*: bit ``i`` gets the non-zero vector ``phi(i)`` of GF(2)^(r+1) and
table ``v`` keeps exactly the bits with ``<phi(i), v> = 1``.  Any ``r`` differing bits span at most
``r`` dimensions, so some non-zero ``v`` is orthogonal to all of them: in that table the pair falls
into one bucket.  No pair inside the radius is missed, for any data.

Skew: equal fingerprints collapse to one node first (partial aggregation), so a hot group of copies
is one row.  Buckets of up to ``PAIR_BUCKET`` distinct fingerprints compare their pairs; larger ones
take an exact other way: every fingerprint is filed under itself and its one-bit flips outside the
table's mask.  Two fingerprints within two bits share such a file, and a file holds at most 65, so no
bucket ever emits all of its pairs.

Nulls and edge cases: a null or empty text has the fingerprint zero and links like any other.  A null
doc_id takes part in linking and is never the smallest id (a component of only null ids has a null
component_id).  Repeated rows stay repeated rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import connected_components, fresh_name, materialize

SHINGLE_WORDS = 3
RADIUS = 2
PAIR_BUCKET = 32
SEED = 42


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family (bit i has vector 1 + i mod (2^(r+1) - 1))."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Majority fingerprint of one text as an unsigned 64-bit number (0 without words)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for block in range(0, len(h), 65_536):        # bounded memory for very long texts
        part = h[block:block + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with a ``_fp`` (signed 64-bit) column in place of ``text``; only texts go through Python, so
    ids keep their exact values beside nulls."""
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_signed(fingerprint(t if isinstance(t, str) else None, k)) for t in texts], dtype=np.int64))

    return docs.withColumn("_fp", fp("text")).drop("text")


def _bit_flips(outside: int) -> list[int]:
    return [0] + [_signed(1 << i) for i in range(64) if outside >> i & 1]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``_fp``); their components are those of
    all pairs within ``radius``.  The large-bucket way needs radius 2."""
    if radius != 2:
        raise ValueError("the one-bit-flip files of large buckets are exact for radius 2")
    masks = covering_masks(radius=radius)
    rows = fps.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                      .alias("t", "key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = rows.join(sizes, ["t", "key"])
    lists = (filed.filter(F.col("n") <= PAIR_BUCKET).groupBy("t", "key").agg(F.sort_array(F.collect_list("_fp")).alias("m"))
             .withColumn("x", F.explode("m")))
    small = lists.select("x", F.explode(F.expr("filter(m, y -> y > x and bit_count(y ^ x) <= 2)")).alias("y"))
    flips = F.array(*[F.array(*[F.lit(b).cast("long") for b in _bit_flips(~m & (1 << 64) - 1)]) for m in masks])
    files = (filed.filter(F.col("n") > PAIR_BUCKET)
             .select("t", "key", "_fp", F.explode(F.get(flips, F.col("t"))).alias("bit"))
             .groupBy("t", "key", F.col("_fp").bitwiseXOR(F.col("bit")).alias("v"))
             .agg(F.min("_fp").alias("x"), F.collect_list("_fp").alias("m")).filter(F.size("m") > 1))
    large = files.select("x", F.explode("m").alias("y")).filter("y <> x")
    return small.union(large).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every column of ``docs`` but ``text``, plus ``_fp`` and ``_component``."""
    rows = materialize(fingerprints(docs), "simhash")
    nodes = materialize(rows.groupBy("_fp").agg(F.min(id_col).alias("_lo")), "simhash-nodes")
    root = connected_components(links(nodes))
    named = nodes.join(root, nodes["_fp"] == root["node"], "left").select(
        "_fp", "_lo", F.coalesce("root", "_fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_lo").alias("_component"))
    comp = named.join(least, "_root").select("_fp", "_component")
    return rows.join(comp, "_fp")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash_components(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                      F.col("_component").alias("component_id"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which one per component stays: the smallest doc_id (nulls last; among rows
    that repeat an id the first by text).  Columns as given."""
    cols = docs.columns
    uid = fresh_name("_uid", cols)
    src = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "simhash-in")
    comp = simhash_components(src.select("doc_id", F.col(uid).alias("_uid"), "text"))
    group = F.struct(F.col("_component"), F.when(F.col("_component").isNull(), F.col("_fp")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_uid"))
    kept = comp.groupBy(group.alias("g")).agg(F.min(order).alias("o")).select(F.col("o._uid").alias("_keep"))
    return src.join(kept, src[uid] == kept["_keep"], "left_semi").select(*cols)


def brute_force(rows: list[tuple[int, str | None]]) -> pd.DataFrame:
    """All-pairs reference for tests on small tables."""
    fps = {i: fingerprint(t) for i, t in rows}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= RADIUS:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return pd.DataFrame([(i, f"{fps[i]:016x}", find(i)) for i in fps], columns=["doc_id", "fingerprint", "component_id"])
