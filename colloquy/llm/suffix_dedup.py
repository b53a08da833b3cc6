"""Suffix-array dedup: remove every byte that lies in a ``LENGTH``-byte string that occurs twice.

1. *Anchors.*  The smallest rolling hash of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes
   (leftmost on ties) depends on the window's bytes alone.  Runs of window starts that share an anchor form a
   *piece*; equal windows always lie in pieces with equal anchors, at equal distance from them.  One scan
   emits a small row per piece (two hashes and offsets, no text); anchors that occur once drop out.
2. *Texts.*  Equal pieces are counted by partial aggregation and enter once, with their number of copies.
   The texts of the distinct pieces are cut from one representative document each.
3. *Merging Burrows-Wheeler transforms.*  Pieces meet in buckets by anchor.  A piece is read as a string of
   8-byte symbols aligned to its anchor.  Each shard of a bucket has its suffixes in order, which is its
   transform; the shards' transforms are merged by iterative interleave refinement: the interleave by ``h``
   symbols gives the one by ``h + 1`` by merging, for each first symbol, the runs of every shard by the place
   of the suffix that follows.  No suffix is sorted again.  A boundary that appears at step ``h`` is a common
   prefix of ``h - 1`` symbols, and what holds together after ``DEPTH`` = 24 steps is a repeated interval of
   192 bytes.  The 8 bytes left of a 200-byte window (some before, the rest behind) are compared exactly
   inside each interval.
4. *Removal.*  The repeated ranges of the pieces are joined back to all their occurrences and to the
   documents; bytes are judged on the input only.

Skew: copies collapse before texts move; an anchor with more than ``HOT_PIECES`` distinct pieces leaves the
buckets and goes an exact other way, where each of its windows is one row under a 128-bit digest, counted by
partial aggregation.  Joins on hot keys are split by adaptive execution.  Memory is bounded by the bucket
size and by single documents.

Nulls and edge cases: a null text counts as empty, shorter texts than ``LENGTH`` bytes keep everything.  Rows
that repeat id and text are occurrences of their own, so their long texts go.  A null doc_id stays null.
``remove_repeats`` keeps a null text null, drops the broken rest of a character that a cut runs through, and sets
``n_chars`` to the new length where that column exists.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import bucket_count, fresh_name, materialize

LENGTH = 200
GRAM = 32
SYMBOL = 8
DEPTH = (LENGTH - SYMBOL) // SYMBOL        # 24 symbols = 192 bytes, plus 8 bytes compared exactly
SHARDS = 4
BUCKET_BYTES = 2 << 20
HOT_PIECES = 20_000
BUFFER = 4 << 20

_SPAN = LENGTH - GRAM + 1                  # 32-byte strings in a window
_STARTS = 65_536 - _SPAN                   # window starts per segment: places fit in 16 bits
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    size, step = 1, base
    while size < n:                        # doubling: out[size:2 size] = out[:size] * base^size
        take = min(size, n - size)
        out[size:size + take] = out[:take] * np.uint64(step)
        size, step = size * 2, step * step % (1 << 64)
    return out


_POW = _powers(_BASE, 65_536 + LENGTH)
_INV = _powers(pow(_BASE, -1, 1 << 64), 65_536 + LENGTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(29)
    return x


def segment_pieces(seg: np.ndarray, valid: np.ndarray):
    """Pieces of one segment of bytes: (anchor hash, piece hash, first start, distance to anchor, starts)."""
    n = len(seg)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[seg] * _POW[:n], out=pre[1:])
    grams = _mix((pre[GRAM:] - pre[:-GRAM]) * _INV[:n - GRAM + 1])
    low = (grams & np.uint64(0xFFFF_FFFF_FFFF_0000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= _SPAN:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < _SPAN:
        low = np.minimum(low[:-(_SPAN - size)], low[_SPAN - size:])
    at = np.flatnonzero(valid[:len(low)])
    if not len(at):
        return None
    anchor = (low[at] & np.uint64(0xFFFF)).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])) + 1
    first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    pos = anchor[np.r_[0, cut]]
    whole = (pre[last + LENGTH] - pre[first]) * _INV[first] + (last - first + 1).astype(np.uint64) * _M2
    return grams[pos], _mix(whole), first, pos - first, last - first + 1


def pieces_of(texts: list[bytes]):
    """Pieces of many texts: (text number, anchor hash, piece hash, start, distance to anchor, starts)."""
    out = []
    group, size = [], 0

    def flush():
        if not group:
            return
        starts = np.cumsum([0, *[len(texts[i]) for i in group]])
        buf = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
        valid = np.zeros(len(buf), dtype=bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            valid[a:b - LENGTH + 1] = True
        for s in range(0, len(buf) - LENGTH + 1, _STARTS):
            got = segment_pieces(buf[s:s + _STARTS + LENGTH - 1], valid[s:s + _STARTS])
            if got:
                h, pid, first, left, count = got
                doc = np.searchsorted(starts, first + s, "right") - 1
                out.append((np.asarray(group)[doc], h, pid, first + s - starts[doc], left, count))
        group.clear()

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if size and size + len(t) > BUFFER:
            flush()
            size = 0
        group.append(i)
        size += len(t)
    flush()
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _encode(t) -> bytes:
    return t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def _scan(batches):
    for pdf in batches:
        got = pieces_of([_encode(t) for t in pdf["text"]])
        if got:
            doc, h, pid, first, left, count = got
            yield pd.DataFrame({"h": h.view(np.int64), "pid": pid.view(np.int64), "k1": pdf["k1"].to_numpy()[doc], "k2": pdf["k2"].to_numpy()[doc],
                                "lo": first, "left": left.astype(np.int16), "starts": count.astype(np.int16)})


PIECE = "h bigint, pid bigint, k1 bigint, k2 bigint, lo bigint, left smallint, starts smallint"


# ---- the bucket: transforms of shards and their merge -------------------------------------------------

def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int32)


def shard_order(sym: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of one shard by their first ``DEPTH`` symbols (by prefix doubling); ``end``: each
    position's terminator."""
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _dense(a.astype(np.int64) * (int(b.max()) + 1) + b)

    at = np.arange(len(sym), dtype=np.int32)
    # DEPTH in binary: the ranks of a size are kept only while a doubling or the result needs them
    r, done, power, size = None, 0, _dense(sym), 1
    while True:
        if DEPTH & size:
            r = power if r is None else joined(r, power[np.minimum(at + done, end)])
            done += size
        if size * 2 > DEPTH:
            return np.argsort(r, kind="stable").astype(np.int32)
        power = joined(power, power[np.minimum(at + size, end)])
        size *= 2


def merge_transforms(first: list[np.ndarray], follow: list[np.ndarray]):
    """Interleave refinement.  For every shard, in its suffix order: ``first`` symbol and place of the
    following suffix.  Returns (interleave as order of the shards' concatenated suffixes, block number of each
    place: suffixes that agree in ``DEPTH`` symbols)."""
    base = np.cumsum([0, *[len(f) for f in first]])
    sym = np.concatenate(first)
    nxt = np.concatenate([f + b for f, b in zip(follow, base)])
    n = len(sym)
    place = np.arange(n, dtype=np.int32)   # interleave by no symbol: shard after shard
    block = np.zeros(n, dtype=np.int32)    # by place
    top = sym.astype(np.int64) * n
    for _ in range(DEPTH):
        after = place[nxt]
        order = np.argsort(top + after, kind="stable").astype(np.int32)      # every shard's run is sorted: a merge of runs
        of, behind = sym[order], block[after[order]]
        fresh = np.empty(n, dtype=bool)
        fresh[0] = False
        np.not_equal(of[1:], of[:-1], out=fresh[1:])
        fresh[1:] |= behind[1:] != behind[:-1]
        block = np.cumsum(fresh, dtype=np.int32)
        place = np.empty(n, dtype=np.int32)
        place[order] = np.arange(n, dtype=np.int32)
    return order, block


def repeated_starts(texts: list[bytes], left: np.ndarray, starts: np.ndarray, weight: np.ndarray):
    """(piece, start) of every window of distinct pieces that occurs twice, copies of a piece counting."""
    single = weight == 1
    shift = left % SYMBOL
    lengths = starts + LENGTH - 1
    blocks = (lengths - shift) // SYMBOL
    raw = b"".join(t[s:s + SYMBOL * b] for t, s, b in zip(texts, shift.tolist(), blocks.tolist()))
    values, ids = np.unique(np.frombuffer(raw, dtype=">u8").astype(np.uint64), return_inverse=True)
    size = blocks + 1                      # with its terminator
    begin = np.cumsum(size) - size
    total = int(size.sum())
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    end = (begin + blocks).astype(np.int32)[piece]
    sym = np.zeros(total, dtype=np.int32)
    inner = np.ones(total, dtype=bool)
    inner[begin + blocks] = False
    sym[inner] = ids + 1
    # shards: runs of whole pieces
    edges = np.unique(np.r_[0, begin[np.minimum(len(texts) - 1, len(texts) * np.arange(1, SHARDS) // SHARDS)], total])
    first, follow, orders = [], [], []
    for a, b in zip(edges[:-1], edges[1:]):
        order = shard_order(sym[a:b], end[a:b] - a)
        rank = np.empty(b - a, dtype=np.int32)
        rank[order] = np.arange(b - a, dtype=np.int32)
        first.append(sym[a:b][order])
        follow.append(rank[np.minimum(order + 1, end[a:b][order] - a)])
        orders.append(order + a)
    order, block = merge_transforms(first, follow)
    suffix = np.concatenate(orders)[order]                    # text positions in merged order
    whole = end[suffix] - suffix >= DEPTH
    suffix, block = suffix[whole], block[whole]
    if not len(suffix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = piece[suffix]
    new = np.r_[True, block[1:] != block[:-1]]
    interval = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    several = (np.add.reduceat(weight[p], head) > 1) & (np.add.reduceat(single[p].astype(np.int64), head) > 0)
    take = several[interval]
    p, interval = p[take], interval[take]
    at = (suffix[take] - begin[p]) * SYMBOL + shift[p]        # byte offset of the aligned start
    # the bytes around the 192 common ones, from one padded buffer
    pad = np.zeros(SYMBOL, np.uint8)
    joined = np.concatenate([pad, np.frombuffer(b"".join(texts), dtype=np.uint8), np.zeros(2 * SYMBOL, np.uint8)])
    byte0 = np.cumsum(lengths) - lengths + SYMBOL
    words = np.lib.stride_tricks.sliding_window_view(joined, SYMBOL)
    where = byte0[p] + at
    before = np.ascontiguousarray(words[where - SYMBOL]).view(">u8").ravel().astype(np.uint64)
    behind = np.ascontiguousarray(words[where + DEPTH * SYMBOL]).view(">u8").ravel().astype(np.uint64)
    got_p, got_s = [], []
    for e in range(SYMBOL):
        ok = (at - e >= 0) & (at - e < starts[p])
        if e == 0:
            word = behind[ok]
        else:
            word = (before[ok] << np.uint64(64 - 8 * e)) | (behind[ok] >> np.uint64(8 * e))
        q, iv, s = p[ok], interval[ok], (at - e)[ok]
        if not len(q):
            continue
        o = np.lexsort((word, iv))
        q, iv, s, word = q[o], iv[o], s[o], word[o]
        new = np.r_[True, (iv[1:] != iv[:-1]) | (word[1:] != word[:-1])]
        twice = np.add.reduceat(weight[q], np.flatnonzero(new)) > 1
        keep = twice[np.cumsum(new) - 1] & single[q]
        got_p.append(q[keep])
        got_s.append(s[keep])
    if not got_p:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(got_p), np.concatenate(got_s)


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated byte ranges (inside the piece) of the distinct pieces of one bucket."""
    pdf = pdf.drop_duplicates(["h", "pid"]).sort_values(["h", "pid"])
    weight, starts = pdf["n"].to_numpy().astype(np.int64), pdf["starts"].to_numpy().astype(np.int64)
    p, s = repeated_starts(pdf["piece"].tolist(), pdf["left"].to_numpy().astype(np.int64), starts, np.minimum(weight, 2))
    o = np.lexsort((s, p))
    p, s = p[o], s[o]
    copies = np.flatnonzero(weight > 1)
    if len(p):
        new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] > s[:-1] + LENGTH)]
        a, z = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]
        rows, lo, hi = p[a], s[a], s[z] + LENGTH
    else:
        rows = lo = hi = np.empty(0, np.int64)
    rows, lo, hi = np.r_[rows, copies], np.r_[lo, np.zeros(len(copies), np.int64)], np.r_[hi, starts[copies] + LENGTH - 1]
    return pd.DataFrame({"h": pdf["h"].to_numpy()[rows], "pid": pdf["pid"].to_numpy()[rows], "a": lo, "b": hi})


# ---- the job ------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Rows are named by id and text digest, which a re-run of a lost task finds again."""
    return docs.select(*extra, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _single(docs: DataFrame) -> DataFrame:
    """One ``(k1, k2, text)`` of every group of repeated rows; the others stop before the shuffle."""
    one_row = W.partitionBy("k1", "k2").orderBy("k2")
    return _keyed(docs, []).withColumn("_r", F.row_number().over(one_row)).filter("_r = 1").drop("_r")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``(k1, k2, ranges)``: the byte ranges of each document's text that repeat; ranges may overlap."""
    found = materialize(_keyed(docs, []).select("k1", "k2", "text").mapInPandas(_scan, PIECE), "suffix-anchors")
    # a table of its own, so that the join's sides are plain exchanges and a hot anchor's rows can be split
    twice = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "suffix-twice")
    found = materialize(found.join(twice, "h", "left_semi"), "suffix-repeated")
    one = found.groupBy("h", "pid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "left", "starts")).alias("r"))
    one = materialize(one.select("h", "pid", "n", "r.*"), "suffix-distinct")
    crowd = one.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    hot = crowd.filter(F.col("kinds") > HOT_PIECES).select("h", F.lit(True).alias("hot"))
    buckets = bucket_count(one.count() * (LENGTH + _SPAN // 2), BUCKET_BYTES)
    wanted = (one.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).groupBy("k1", "k2")
              .agg(F.collect_list(F.struct("h", "pid", "n", "lo", "left", "starts", "hot")).alias("want")))

    def cut(batches):
        for pdf in batches:
            rows = []
            for text, want in zip(pdf["text"], pdf["want"]):
                raw = _encode(text)
                for w in want:
                    piece = raw[w["lo"]:w["lo"] + w["starts"] + LENGTH - 1]
                    rows.append((w["h"], w["pid"], w["n"], w["left"], w["starts"], w["hot"], piece))
            yield pd.DataFrame(rows, columns=["h", "pid", "n", "left", "starts", "hot", "piece"])

    single = _single(docs)
    texts = single.join(wanted, ["k1", "k2"]).select("text", "want").mapInPandas(
        cut, "h bigint, pid bigint, n bigint, left smallint, starts smallint, hot boolean, piece binary")
    any_hot = hot.limit(1).count() > 0
    texts = texts if not any_hot else materialize(texts, "suffix-pieces")
    ranges = (texts.filter("not hot").withColumn("bucket", F.pmod("h", F.lit(buckets))).drop("hot")
              .groupBy("bucket").applyInPandas(lambda pdf: _bucket(pdf), "h bigint, pid bigint, a bigint, b bigint"))
    if any_hot:
        ranges = ranges.union(crowded_ranges(texts.filter("hot").dropDuplicates(["h", "pid"])))
    spans = found.join(ranges, ["h", "pid"]).select("k1", "k2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def crowded_ranges(pieces: DataFrame) -> DataFrame:
    """Repeated windows of pieces whose anchors are crowded: a row per window, counted by its digest."""
    def windows(batches):
        digest = xxhash.xxh3_128_intdigest
        for pdf in batches:
            for h, pid, n, starts, piece in zip(pdf["h"], pdf["pid"], pdf["n"], pdf["starts"], pdf["piece"]):
                d = [digest(piece[s:s + LENGTH]) for s in range(starts)]
                yield pd.DataFrame({"h": h, "pid": pid, "n": n, "a": range(starts),
                                    "d1": np.array([x >> 64 for x in d], np.uint64).view(np.int64),
                                    "d2": np.array([x & (1 << 64) - 1 for x in d], np.uint64).view(np.int64)})

    w = materialize(pieces.select("h", "pid", "n", "starts", "piece").mapInPandas(
        windows, "h bigint, pid bigint, n bigint, a bigint, d1 bigint, d2 bigint"), "suffix-windows")
    twice = w.groupBy("d1", "d2").agg(F.sum("n").alias("c")).filter("c > 1").select("d1", "d2")
    return w.join(twice, ["d1", "d2"], "left_semi").select("h", "pid", "a", (F.col("a") + LENGTH).alias("b"))


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def kept_bytes(raw: bytes, ranges) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    spans = _merged(ranges) if ranges is not None else []
    if not spans:
        return raw, 0, 0
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), sum(b - a for a, b in spans), len(spans)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for pdf in batches:
            rows = []
            for k1, k2, text, ranges in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["ranges"]):
                raw = _encode(text)
                kept, removed, spans = kept_bytes(raw, ranges)
                rows.append((k1, k2, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # texts are cut once for all rows that repeat them, on the exchange that the pieces were cut on; rows join back without texts
    done = (_single(docs).join(repeated_ranges(docs), ["k1", "k2"], "left").select("k1", "k2", "text", "ranges")
            .mapInPandas(run, "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
    return (_keyed(docs, ["doc_id"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "k1", "k2").join(done, ["k1", "k2"])
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated byte strings cut out of ``text``; columns as given."""
    cols = docs.columns
    name = fresh_name("_ranges", cols)
    k1, k2 = fresh_name("_k1", cols), fresh_name("_k2", cols)
    rows = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), k2: F.xxhash64("text")})
    pair = docs.select("doc_id", "text")
    ranges = repeated_ranges(pair).select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("ranges").alias(name))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not isinstance(t, str) else kept_bytes(_encode(t), s)[0].decode("utf-8", "ignore")
                          for t, s in zip(texts, spans)], dtype=object)

    out = rows.join(ranges, [k1, k2], "left")
    out = out.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut("text", name)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """Reference for tests: every window counted in one dictionary."""
    seen = Counter(t[i:i + LENGTH] for _, t in rows for i in range(len(t) - LENGTH + 1))
    out = {}
    for i, t in rows:
        spans = [{"a": s, "b": s + LENGTH} for s in range(len(t) - LENGTH + 1) if seen[t[s:s + LENGTH]] > 1]
        kept, removed, n = kept_bytes(t, spans)
        out[i] = (len(t), removed, n, hashlib.sha256(kept).hexdigest())
    return out
