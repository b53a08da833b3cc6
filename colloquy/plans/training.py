"""The loader pipeline (B7): conversations -> examples -> tokens -> pairs -> batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import config
from colloquy.operators import batching, render, tokens
from colloquy.session import checkpoint_dir


def token_table(conv: DataFrame, max_seq_len: int = config.TRAIN_MAX_SEQ_LEN) -> DataFrame:
    """P13 -> P12 -> K1 -> K4 -> K7: ``(conv_id, turn, tokens)``, truncated and stored once (see
    ``training_examples``)."""
    ex = render.render_text(render.conversation_examples_head(conv.select("conv_id", "turn", "role", "text"), max_seq_len))
    ex = tokens.truncate(tokens.tokenize(ex, "full_text"), max_seq_len).select("conv_id", "turn", "tokens")
    checkpoint_dir(ex.sparkSession)
    return ex.checkpoint(eager=True)


def cell_sums(batches):
    """A consumer for ``batching.export_batches``: per row its cells, real cells and the sum of real labels."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for b in batches:
        if not b.num_rows:
            continue
        labels, n = b.column("labels"), b.column("attention_len").to_pylist()
        sums = [pc.sum(labels[i].values.slice(0, k)).as_py() for i, k in enumerate(n)]
        yield pa.RecordBatch.from_arrays([b.column("epoch"), b.column("batch_idx"), b.column("padded_len"), b.column("attention_len"),
                                          pa.array(sums, pa.int64())], names=["epoch", "batch_idx", "cells", "real", "label_sum"])


def training_examples(conv: DataFrame, max_seq_len: int = config.TRAIN_MAX_SEQ_LEN,
                      min_tokens: int = config.MIN_TOKENS) -> DataFrame:
    """P13 -> P12 -> K1 -> K4 -> (K7) -> K5 -> K6 on the conversation log.

    The history is bounded to the first ``max_seq_len`` lines, which is exact after the
    truncation to ``max_seq_len`` tokens (see ``render.conversation_examples_head``).

    K7: the truncated token table is materialised with ``checkpoint()`` into the cluster's
    ``spark.checkpoint.dir`` before K5/K6.  The tokenizer regex then runs exactly once (a K5
    filter above an un-materialised projection would be pushed below it and re-evaluate the
    regex), every consumer - vocabulary, counts, ordering, batches - reads the stored table, and
    a lost executor does not re-tokenize.

    Output ``(conv_id, turn, tokens, input_ids, labels)``; arrays are surface tokens.
    """
    ex = token_table(conv, max_seq_len)
    ex = tokens.drop_short(ex, min_tokens)
    ex = tokens.shift_pairs(ex)
    return ex.select("conv_id", "turn", "tokens", "input_ids", "labels")


def training_batches(examples: DataFrame, batch_size: int = config.BATCH_SIZE, epochs: int = config.EPOCHS,
                     seed: int = config.SEED) -> DataFrame:
    """B1 + B2 + B3 on ``training_examples``: seeded order per epoch, full batches only, batch max length.
    Only keys and lengths travel; the token arrays stay where they are."""
    sized = examples.select("conv_id", "turn", F.size("input_ids").alias("n_input"))
    ordered = batching.epoch_order(sized, ["conv_id", "turn"], seed=seed, epochs=epochs)
    return batching.batch_max_len(batching.assign_batches(ordered, batch_size), length=F.col("n_input"))
