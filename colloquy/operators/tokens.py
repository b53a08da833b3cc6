"""Tokenize, vocabulary, truncate, drop short, shift, encode/decode, lazy fill."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import config
from colloquy.functions.ordering import range_partitions, range_positions
from colloquy.functions.text import pretokens


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens") -> DataFrame:
    """K1: surface tokens by the GPT-2-style split (JVM regex, lossless)."""
    return df.withColumn(out, pretokens(col))


def explode_items(df: DataFrame, col: str, out: str, keys=(), pos: str | None = None) -> DataFrame:
    """One row per array element.  The ``_outer`` generators keep Catalyst from inferring a
    ``size(array) > 0`` filter that would evaluate an expensive array expression (the
    tokenizer regex) a second and third time; the null rows of empty arrays are dropped."""
    keys = list(keys)
    if pos:
        g = df.select(*keys, F.posexplode_outer(F.col(col)).alias(pos, out))
        return g.filter(F.col(pos).isNotNull())
    return df.select(*keys, F.explode_outer(F.col(col)).alias(out)).filter(F.col(out).isNotNull())


def truncate(df: DataFrame, max_seq_len: int, col: str = "tokens") -> DataFrame:
    """K4: keep the head ``max_seq_len`` tokens."""
    return df.withColumn(col, F.slice(F.col(col), 1, int(max_seq_len)))


def drop_short(df: DataFrame, min_tokens: int = config.MIN_TOKENS, col: str = "tokens") -> DataFrame:
    """K5: sequences with fewer than ``min_tokens`` tokens are dropped."""
    return df.filter(F.size(F.col(col)) >= int(min_tokens))


def shift_pairs(df: DataFrame, col: str = "tokens") -> DataFrame:
    """K6: ``input = t[:-1]``, ``labels = t[1:]`` - every position is labelled."""
    n = F.size(F.col(col))
    return (df.withColumn("input_ids", F.slice(F.col(col), F.lit(1), n - 1))
              .withColumn("labels", F.slice(F.col(col), F.lit(2), n - 1)))


def build_vocab(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """K2: frequency-ranked ids ``(token, token_id, freq)``; ties broken by the token's bytes.

    Runs on distinct tokens only; ids are positions in a range partitioning of ``(freq desc, token)``
    (code-point order agrees with byte order), so no window holds all tokens and no crowded prefix
    or frequency makes one large task.
    """
    counts = (explode_items(tokens, col, "token")
                    .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    ranked = range_positions(counts, [F.desc("freq"), F.asc("token")], pos_col="token_id")
    return ranked.select("token", "token_id", "freq")


def special_ids(vocab: DataFrame, has_pad: bool = False, has_eos: bool = True) -> DataFrame:
    """K3 special-token rule as a one-row table ``(vocab_size, eos_id, pad_id)``.

    Derived vocabularies get ``<|endoftext|>`` appended after the ranked tokens (as GPT-2
    places it last).  pad = existing pad, else eos, else a new ``<|pad|>`` appended.
    Because pad may equal a real id, padding is always derived from lengths.
    """
    eos = F.col("n") if has_eos else F.lit(None).cast("bigint")
    size = F.col("n") + int(has_eos)
    fresh = size                                    # the next id: an existing pad, or a new one
    pad = fresh if has_pad else F.coalesce(eos, fresh)
    return vocab.agg(F.count(F.lit(1)).alias("n")).select(
        (size + int(has_pad or not has_eos)).alias("vocab_size"), eos.alias("eos_id"), pad.alias("pad_id"))


BLOCK_TOKENS = 1 << 20          # elements a block of sequences holds on average


def _in_blocks(df: DataFrame, pairs: DataFrame, keys, col: str, out: str, old: str, new: str, block_tokens: int,
               merge: bool, text: bool) -> DataFrame:
    """``(*keys, out)``: elements of the array ``col`` replaced by ``pairs``' ``new`` value for them, as an array or (``text``)
    joined to a string.

    No element crosses the network by itself.  Sequences are dealt whole into blocks of about ``block_tokens`` elements; a block's
    distinct elements alone meet ``pairs`` and come back as its dictionary, and an Arrow task a block looks the elements up.
    ``merge`` deals by the keys and makes one sequence of rows that share them: by place, then by value.  Without it rows
    stay rows.  ``df`` is read three times (sizes, distinct elements, sequences): pass a stored table."""
    keys = list(keys)
    places = [f"_k{i}" for i in range(len(keys))]
    seqs = df.select(*[F.col(k).alias(p) for k, p in zip(keys, places)],
                     F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType)).alias("_s"))
    total = seqs.agg(F.sum(F.size("_s"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // int(block_tokens)))
    seqs = seqs.withColumn("_b", F.pmod(F.xxhash64(*(places if merge else [*places, "_s"])), F.lit(n_blocks)))
    kind_old = df.schema[col].dataType.elementType
    packed = isinstance(kind_old, T.StringType)
    if packed:                  # one string and its lengths: an array of short strings takes three times the room
        seqs = seqs.select(*places, "_b", F.array_join("_s", "").alias("_s"), F.transform("_s", F.octet_length).alias("_n"))

    def items_of(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """(elements, elements of each row)."""
        block = block.combine_chunks()
        s = block["_s"].chunk(0)
        if not packed:
            return pc.list_flatten(s), pc.list_value_length(s).to_numpy().astype(np.int64)
        sizes = pc.list_flatten(block["_n"].chunk(0))
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(), dtype=np.int64)
        at = np.frombuffer(s.buffers()[1], dtype=np.int32)[s.offset:s.offset + len(s) + 1]
        data = s.buffers()[2]
        offsets = np.concatenate([[0], ends]).astype(np.int32) + at[0]
        items = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), data if data is not None else pa.py_buffer(b"")])
        if sizes.null_count:
            items = pc.if_else(sizes.is_valid(), items, pa.scalar(None, pa.string()))
        return items, pc.list_value_length(block["_n"].chunk(0)).to_numpy().astype(np.int64)

    def distinct(block: pa.Table) -> pa.Table:
        words = pa.concat_arrays([pc.unique(items_of(pa.Table.from_batches([c]))[0]) for c in block.to_batches()])
        return pa.table({"_b": block["_b"][:1], "_w": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)})

    # all columns are passed, so that this exchange of the sequences is the one that the look-up reads
    words = seqs.groupBy("_b").applyInArrow(distinct, T.StructType([T.StructField("_b", T.LongType()), T.StructField("_w", T.ArrayType(kind_old))]))
    words = words.select("_b", F.explode_outer(F.array_distinct("_w")).alias("_old")).filter(F.col("_old").isNotNull())
    found = words.join(pairs.select(F.col(old).alias("_old"), F.col(new).alias("_new")), "_old").select(F.col("_b").alias("_db"), "_old", "_new")
    kind = found.schema["_new"].dataType
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField(out, kind if text else T.ArrayType(kind))])

    def look_up(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        items, lengths = items_of(block)
        values = dictionary["_new"].combine_chunks().take(pc.index_in(items, value_set=dictionary["_old"].combine_chunks()))
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if text:
            values = pc.fill_null(values, "")
        rows = block.select(places).combine_chunks()
        if merge:
            row = pa.array(np.arange(len(lengths)))
            groups = rows.append_column("_i", row).group_by(places).aggregate([("_i", "list")])["_i_list"]
            if len(groups) < len(lengths):
                members = pc.list_flatten(groups).to_numpy()
                group = np.empty(len(lengths), dtype=np.int64)
                group[members] = np.repeat(np.arange(len(groups)), pc.list_value_length(groups).to_numpy())
                rows = rows.take(pa.array(members[np.unique(group[members], return_index=True)[1]]))
                starts = np.cumsum(lengths) - lengths
                order = pc.sort_indices(pa.table({"g": np.repeat(group, lengths), "p": np.arange(len(values)) - np.repeat(starts, lengths), "v": values}),
                                        sort_keys=[(c, "ascending") for c in "gpv"], null_placement="at_start")
                values, lengths = values.take(order), np.bincount(group, lengths, len(groups)).astype(np.int64)
        done = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
        return pa.table([*rows.columns, pc.binary_join(done, "") if text else done], names=schema.names)

    return seqs.groupBy("_b").cogroup(found.groupBy("_db")).applyInArrow(look_up, schema)


def encode(df: DataFrame, vocab: DataFrame, keys, col: str = "tokens", out: str = "ids", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Surface tokens -> ids, by dictionaries of blocks of sequences (``_in_blocks``).  One row a key: an empty sequence
    encodes to [], a token that the vocabulary lacks to null."""
    return _in_blocks(df, vocab, keys, col, out, "token", "token_id", block_tokens, merge=True, text=False)


def detokenize(df: DataFrame, vocab: DataFrame, keys, col: str = "ids", out: str = "text",
               special_tokens=(config.EOS_TOKEN, config.PAD_TOKEN), specials: DataFrame | None = None,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Ids -> text, skipping special tokens (decode(..., skip_special_tokens=True)).

    Special and unknown ids become '' instead of being filtered out, so every input sequence comes back, one row a key."""
    v = vocab.select("token", "token_id")
    if specials is not None:
        sp = specials.select(F.col("eos_id").alias("token_id"), F.lit(config.EOS_TOKEN).alias("token"))
        v = v.unionByName(sp.filter(F.col("token_id").isNotNull()))
    v = v.filter(~F.col("token").isin(*special_tokens))
    return _in_blocks(df, v, keys, col, out, "token_id", "token", block_tokens, merge=True, text=True)


def map_elements(df: DataFrame, pairs: DataFrame, keys, col: str, out: str, old: str, new: str,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(*keys, out)``: every element of the array ``col`` replaced by ``pairs``' ``new`` value for it (null: no pair).

    No sequence is taken apart (``_in_blocks``; blocks by hash of the row, so they are even and a re-run task deals alike).
    A null array counts as empty, a null element maps to null.  Rows are kept as rows: repeated keys come back as often.
    ``pairs`` must hold each ``old`` value once.
    """
    return _in_blocks(df, pairs, keys, col, out, old, new, block_tokens, merge=False, text=False)


def encode_blocks(df: DataFrame, vocab: DataFrame, keys, col: str = "tokens", out: str = "ids",
                  block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``encode`` of rows as rows (``map_elements``): repeated keys are not merged.  A token that the vocabulary lacks
    becomes null."""
    return map_elements(df, vocab, keys, col, out, "token", "token_id", block_tokens)


def detokenize_blocks(df: DataFrame, vocab: DataFrame, keys, col: str = "ids", out: str = "text",
                      special_tokens=(config.EOS_TOKEN, config.PAD_TOKEN), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """K10 of rows as rows: special ids and ids that the vocabulary lacks become ''.

    ``df`` is read three times (sizes, distinct ids, sequences): pass a stored table."""
    v = vocab.select("token_id", "token").filter(~F.col("token").isin(*special_tokens))
    return _in_blocks(df, v, keys, col, out, "token_id", "token", block_tokens, merge=False, text=True)


def dataset_sizes(tokenized: DataFrame, min_tokens: int = config.MIN_TOKENS, col: str = "tokens",
                  more: dict[str, int] | None = None) -> DataFrame:
    """K8: lazy length (every valid row) and cached length (rows that survive K5), one pass.
    ``more`` names cached lengths for other minima."""
    return tokenized.agg(F.count(F.lit(1)).alias("n_lazy"), *[
        F.sum(F.when(F.size(col) >= int(m), 1).otherwise(0)).cast("bigint").alias(name)
        for name, m in {"n_cached": min_tokens, **(more or {})}.items()])


def lazy_fill(df: DataFrame, key: str, seq: str, valid_col: str, carry_cols, parts: int | None = None) -> DataFrame:
    """K9: a too-short row is replaced by the next valid row in dataset order ``(key, seq)``,
    wrapping to the first valid row at the end.  Fails at action time if no row is valid.

    The rows are range-partitioned by the order (a hot key spans several parts).  Inside a part a reversed
    running ``last_value`` fills linearly; past its end the first valid row of the next part that
    has one follows, which takes one small row a part on the driver.
    """
    carry_cols = list(carry_cols)
    spark = df.sparkSession
    own = F.when(F.col(valid_col), F.struct(*[F.col(c) for c in carry_cols]))
    d = range_partitions(df.withColumn("_own", own), [key, seq], parts)
    firsts = d.groupBy("_part").agg(
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("_row"))).alias("_own")).collect()
    firsts = sorted(((r["_part"], r["_own"]) for r in firsts), key=lambda r: r[0])
    nxt = next((own for _, own in firsts if own is not None), None)          # the wrap
    after = []
    for part, first in reversed(firsts):
        after.append((part, nxt))
        nxt = first if first is not None else nxt
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_after", d.schema["_own"].dataType)])
    rev = Window.partitionBy("_part").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = d.withColumn("_next_in", F.last("_own", ignorenulls=True).over(rev)).join(
        F.broadcast(spark.createDataFrame(after, schema)), "_part").withColumn(
        "_src", F.coalesce("_next_in", "_after", F.raise_error(F.lit("lazy_fill: no row is long enough"))))
    return filled.select(*df.columns, *[F.col(f"_src.{c}").alias(f"src_{c}") for c in carry_cols])


def materialize(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """K7: pre-tokenize once and keep the result - write the token table as Parquet and read it
    back, so later epochs (and a lost executor) never re-tokenize or recompute the lineage."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_store(df: DataFrame, name: str, keys, buckets: int, path: str | None = None) -> DataFrame:
    """K7 for joins: the table ``name`` in ``buckets`` files by hash of ``keys``, each sorted by them.

    Encoding, batch order and losses that join on ``keys`` (all of them) read the store in place: only the other side is
    exchanged, into as many partitions.  ``path`` names a folder on shared storage (else the warehouse); the table's bucket
    layout is kept in the session's catalog.  One exchange here lets a bucket be one file.  Null keys are rows of one
    bucket; keys are those of an example, so a bucket holds about its share of the rows."""
    keys = list(keys)
    w = (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
           .bucketBy(buckets, *keys).sortBy(*keys))
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)
