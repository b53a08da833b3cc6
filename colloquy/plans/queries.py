"""Registered queries: one per operator key of the inventory; each is (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in full.
Integer outputs are BIGINT, doubles are rounded, arrays are joined to strings or hashed
so the DuckDB oracle in ``oracle.py`` can be compared value by value.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions.text import join_ints, keyed_uniform
from colloquy.operators import batching, convlog, nucleus, qa, render, rollout, scan, scoring, sequence, steps, tokens
from colloquy.plans import standins, training
from colloquy.plans.tables import table
from colloquy.session import checkpoint_dir, checkpointed
from colloquy.sources import jsonl, metrics, qa_files
from colloquy.streaming import chat_state, ingest

REGISTRY: dict = {}

SEP = "\u001f"  # joins surface tokens before hashing (never produced by the tokenizer's input here)
# Stand-in event intervals (optimizer steps) scaled to the test tables; the reference's
# defaults (100 / 5000 / 500) are the operator defaults in ``config``.
LOG_EVERY, SAVE_EVERY, TEST_EVERY = 5, 20, 10
HISTORY_LINES = 3              # lines of history by reference (none in the reference)
METRICS_PER_DOCUMENT = 4       # logged steps a metrics document holds here, so that there are many
STORE_BUCKETS = 16             # buckets of the token store at the scale of the test tables
LAZY_MIN_TOKENS = 200          # K9 stand-in minimum so that some rows are "too short"
DECAY_PER_SECOND = 1.0 / 3600.0
FIR_WEIGHTS, FIR_BIAS = (0.1, 0.2, 0.3, 0.4), 0.5
SCAN_RATES, SCAN_SKIP = (-1.0, -0.05), 0.5


def query(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _conv(spark, sf):
    return table(spark, sf, "conversations")


def _r(c, n=9):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _once(df):
    """K7 inside a query: a table used by two branches is checkpointed (reliably, into the
    cluster's ``spark.checkpoint.dir``) so tokenisation runs once and lineage is cut."""
    return checkpointed(df)


def _stored(df, what):
    """As ``_once``, as compressed Parquet: for tables of whole token sequences (a checkpoint's rows are not compressed)."""
    return tokens.materialize(df, _folder(df.sparkSession, what))


def _folder(spark, what):
    """A new folder below the shared checkpoint folder; it goes with that folder."""
    return os.path.join(checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")


def _hash_tokens(c):
    return F.md5(F.array_join(F.col(c), SEP))


# --- S1-S3 ------------------------------------------------------------------------------

@query("jsonl_validate")
def q_jsonl_validate(spark, sf):
    c = jsonl.classify_lines(standins.jsonl_lines(_conv(spark, sf)))
    return jsonl.reason_counts(c)


@query("jsonl_files")
def q_jsonl_files(spark, sf):
    """S1 -> S2 -> S3 over text files."""
    path = _folder(spark, "lines")
    standins.jsonl_lines(_conv(spark, sf)).select("value").write.text(path)
    return jsonl.reason_counts(jsonl.classify_lines(jsonl.read_lines(spark, path)))


@query("ingest_stream")
def q_ingest_stream(spark, sf):
    """The lines arrive in three deliveries; the stream lands each and is started anew for the next, from its checkpoint."""
    lines = standins.jsonl_lines(_conv(spark, sf))
    src, out, ckpt = (_folder(spark, f"ingest-{k}") for k in ("in", "out", "ckpt"))
    for part in range(3):
        lines.filter(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)) == part).select("value").write.mode("append").text(src)
        ingest.start_ingest_tables(spark, src, out, ckpt).awaitTermination()
    landed = ingest.ingested_counts(spark, out).groupBy("reason").agg(F.sum("n").alias("n_counted"))
    return jsonl.reason_counts(ingest.ingested(spark, out)).join(landed, "reason")


@query("corpus_files")
def q_corpus_files(spark, sf):
    """S9 -> S1 -> S2: the example corpus written as JSON lines, read back and validated."""
    path = _folder(spark, "corpus")
    jsonl.write_corpus_jsonl(render.conversation_examples(_conv(spark, sf)), path)
    valid, _ = jsonl.validate_jsonl(jsonl.read_lines(spark, path))
    return valid.select(F.size("context").cast("bigint").alias("n_ctx"), F.array_join("context", "\n").alias("context_text"), "response")


# --- P1-P11, U1-U2, A1 --------------------------------------------------------------------

def _flat_out(df):
    return df.select("row_key", "branch", "pos1", "pos2", F.col("context")[0].alias("context"), "response")


def _sources(spark, sf):
    conv = _conv(spark, sf)
    return {"ambig": standins.ambig_source(conv),
            "wiki": standins.wiki_source(table(spark, sf, "documents"), table(spark, sf, "labels")),
            "truthful": standins.truthful_source(conv), "squad": standins.squad_source(conv),
            "instruct": standins.instruct_source(conv)}


def _flatten(sources, **kw):
    return {name: qa.FLATTEN[name](df, **kw, **({"on_empty": "drop"} if name == "squad" else {})) for name, df in sources.items()}


def _flat(spark, sf):
    return _flatten(_sources(spark, sf))


@query("qa_ambig")
def q_qa_ambig(spark, sf):
    return _flat_out(qa.qa_ambig(standins.ambig_source(_conv(spark, sf))))


@query("qa_wiki")
def q_qa_wiki(spark, sf):
    return _flat_out(qa.qa_wiki(standins.wiki_source(table(spark, sf, "documents"), table(spark, sf, "labels"))))


@query("qa_truthful")
def q_qa_truthful(spark, sf):
    return _flat_out(qa.qa_truthful(standins.truthful_source(_conv(spark, sf))))


@query("qa_first_answer")
def q_qa_first_answer(spark, sf):
    return _flat_out(qa.qa_first_answer(standins.squad_source(_conv(spark, sf)), on_empty="drop"))


@query("qa_instruct")
def q_qa_instruct(spark, sf):
    return _flat_out(qa.qa_instruct(standins.instruct_source(_conv(spark, sf))))


@query("qa_union")
def q_qa_union(spark, sf):
    u = qa.union_sources(_flat(spark, sf))
    return u.select("source", "source_ord", "row_key", "branch", "pos1", "pos2",
                    F.col("context")[0].alias("context"), "response")


@query("qa_files")
def q_qa_files(spark, sf):
    """S4-S8 + U1: every source written as files of two splits, read through its reader, flattened and united."""
    read = {}
    for name, df in _sources(spark, sf).items():
        paths = [_folder(spark, f"qa-{name}-{i}") for i in (0, 1)]
        split = F.right("row_key", F.lit(1)).cast("int") % 2
        for i, path in enumerate(paths):
            df.filter(split == i).drop("row_key").write.json(path)
        read[name] = qa_files.read_source(spark, name, paths, "json").withColumn("split_ord", F.col("split_ord").cast("bigint"))
    u = qa.union_sources(_flatten(read, key="split_ord"))
    return u.select("source", "source_ord", F.col("row_key").alias("split_ord"), F.col("context")[0].alias("context"), "response")


@query("qa_reject_counts")
def q_qa_reject_counts(spark, sf):
    return qa.reject_counts(qa.union_sources(_flatten(_sources(spark, sf), drop_null=False)))


@query("source_counts_written")
def q_source_counts_written(spark, sf):
    """U2 + A1: the union written as Parquet, its counts by source observed in the writing job."""
    path = _folder(spark, "union")
    counts = qa.write_union(_flat(spark, sf), path)
    got = spark.createDataFrame([(name, n) for name, n in counts.items()], "source string, n_counted bigint")
    read = spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return read.join(got, "source")


@query("source_counts")
def q_source_counts(spark, sf):
    return qa.source_counts(qa.union_sources(_flat(spark, sf))).select(
        "source", "source_ord", F.col("n").cast("bigint").alias("n"), F.col("running").cast("bigint").alias("running"))


# --- P12, P13 ------------------------------------------------------------------------------

@query("conv_examples")
def q_conv_examples(spark, sf):
    ex = render.conversation_examples(_conv(spark, sf))
    return ex.select("conv_id", "turn", F.size("context").cast("bigint").alias("n_ctx"),
                     F.array_join("context", "\n").alias("context_text"), "response")


@query("render_text")
def q_render_text(spark, sf):
    ex = render.render_text(render.conversation_examples(_conv(spark, sf)))
    return ex.select("conv_id", "turn", "full_text", F.char_length("full_text").cast("bigint").alias("n_chars"))


@query("history_ranges")
def q_history_ranges(spark, sf):
    """P13 by reference: one small row an example."""
    r = render.ranges_within(render.history_ranges(render.history_lines(_conv(spark, sf))), HISTORY_LINES)
    return r.select("conv_id", "turn", "first_line", "last_line", "response_line")


@query("history_render")
def q_history_render(spark, sf):
    """P13 by reference, all histories rendered: equals conv_examples."""
    lines = _once(render.history_lines(_conv(spark, sf)))
    ex = render.render_ranges(render.history_ranges(lines), lines)
    return ex.select("conv_id", "turn", F.size("context").cast("bigint").alias("n_ctx"),
                     F.array_join("context", "\n").alias("context_text"), "response")


# --- K1-K10 ---------------------------------------------------------------------------------

@query("tokenize")
def q_tokenize(spark, sf):
    d = tokens.tokenize(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tok"),
                    (F.array_join("tokens", "") == F.col("text")).alias("lossless"))


def _doc_vocab(spark, sf, once=False):
    d = tokens.tokenize(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    if once:
        d = _stored(d, "tokens")
    return d, tokens.build_vocab(d)


@query("vocab")
def q_vocab(spark, sf):
    _, v = _doc_vocab(spark, sf)
    return v.select("token", F.col("token_id").cast("bigint").alias("token_id"), F.col("freq").cast("bigint").alias("freq"))


@query("shift_pairs")
def q_shift_pairs(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    return ex.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n"),
                     _hash_tokens("input_ids").alias("input_md5"), _hash_tokens("labels").alias("labels_md5"))


@query("dataset_sizes")
def q_dataset_sizes(spark, sf):
    t = training.token_table(_conv(spark, sf))
    return tokens.dataset_sizes(t, config.MIN_TOKENS, more={"n_cached_min200": LAZY_MIN_TOKENS})


@query("lazy_fill")
def q_lazy_fill(spark, sf):
    t = training.token_table(_conv(spark, sf)).select("conv_id", "turn", (F.size("tokens") >= LAZY_MIN_TOKENS).alias("valid"))
    f = tokens.lazy_fill(t, "conv_id", "turn", "valid", ["conv_id", "turn"])
    return f.select("conv_id", "turn", "src_conv_id", "src_turn")


@query("special_ids")
def q_special_ids(spark, sf):
    """K3 on the document vocabulary, in all four cases of existing pad and eos tokens."""
    v = _once(_doc_vocab(spark, sf)[1].select("token"))
    cases = [(p, e) for p in (False, True) for e in (False, True)]
    return reduce(DataFrame.unionByName, [
        tokens.special_ids(v, has_pad=p, has_eos=e).select(F.lit(p).alias("has_pad"), F.lit(e).alias("has_eos"),
                                                           "vocab_size", F.coalesce("eos_id", F.lit(-1).cast("bigint")).alias("eos_id"), "pad_id")
        for p, e in cases])


@query("detokenize")
def q_detokenize(spark, sf):
    d, v = _doc_vocab(spark, sf, once=True)
    v = _once(v.select("token", "token_id"))
    sp = tokens.special_ids(v)
    ids = tokens.encode(d, v, ["doc_id"], "tokens", "ids")
    # every sequence ends with <|endoftext|>; decoding skips it
    ids = _stored(ids.withColumn("ids", F.concat("ids", F.array(sp.select("eos_id").scalar()))), "ids")
    txt = tokens.detokenize(ids, v, ["doc_id"], "ids", "text", specials=sp)
    return txt.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("detokenize_blocks")
def q_detokenize_blocks(spark, sf):
    """K10 there and back by block dictionaries; special ids as in detokenize."""
    d, v = _doc_vocab(spark, sf, once=True)
    v = _once(v.select("token", "token_id"))
    ids = tokens.encode_blocks(d, v, ["doc_id"], "tokens", "ids")
    ids = _stored(ids.withColumn("ids", F.concat("ids", F.array(tokens.special_ids(v).select("eos_id").scalar()))), "ids")
    txt = tokens.detokenize_blocks(ids, v, ["doc_id"], "ids", "text")
    return txt.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- B1-B7 ----------------------------------------------------------------------------------

def _ordered(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    return batching.epoch_order(ex, ["conv_id", "turn"], seed=config.SEED, epochs=config.EPOCHS)


@query("epoch_order")
def q_epoch_order(spark, sf):
    return _ordered(spark, sf).select(F.col("epoch").cast("bigint").alias("epoch"), F.col("pos").cast("bigint").alias("pos"),
                                      "conv_id", "turn")


@query("epoch_permutation")
def q_epoch_permutation(spark, sf):
    ex = training.training_examples(_conv(spark, sf)).select("conv_id", "turn")
    d = batching.epoch_permutation(ex, ["conv_id", "turn"], seed=config.SEED, epochs=config.EPOCHS)
    return d.select(F.col("epoch").cast("bigint").alias("epoch"), "pos", "conv_id", "turn")


@query("batch_assign")
def q_batch_assign(spark, sf):
    b = batching.assign_batches(_ordered(spark, sf), config.BATCH_SIZE)
    return b.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_idx", "slot", "conv_id", "turn")


def _example_vocab(ex):
    return tokens.build_vocab(ex, "tokens")


@query("padded_batches")
def q_padded_batches(spark, sf):
    ex = _stored(training.training_examples(_conv(spark, sf)).select("conv_id", "turn", "tokens"), "examples")
    v = _example_vocab(ex)
    sp = tokens.special_ids(v)
    ids = tokens.encode(ex, v, ["conv_id", "turn"], "tokens", "ids")
    ids = ids.select("conv_id", "turn", F.slice("ids", 1, F.size("ids") - 1).alias("input_ids"),
                     F.slice("ids", 2, F.size("ids") - 1).alias("labels"))
    ordered = batching.epoch_order(ids, ["conv_id", "turn"], seed=config.SEED, epochs=config.EPOCHS)
    b = batching.assign_batches(ordered, config.BATCH_SIZE)
    p = batching.pad_batches(b, sp.select("pad_id").scalar())
    return p.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_idx", "slot", "attention_len", "padded_len",
                    join_ints("input_ids").alias("input_ids"), join_ints("labels").alias("labels"))


@query("batch_stats")
def q_batch_stats(spark, sf):
    b = _batches(training.training_examples(_conv(spark, sf)))
    return batching.batch_stats(b).select(
        F.col("epoch").cast("bigint").alias("epoch"), "n_batches", F.col("n_rows").cast("bigint").alias("n_rows"),
        "padded_cells", "real_cells")


@query("token_store")
def q_token_store(spark, sf):
    """K7: the token table stored in buckets; each batch's rows meet their tokens without an exchange of the tokens."""
    ex = training.training_examples(_conv(spark, sf))
    name = f"token_store_{uuid.uuid4().hex}"
    store = tokens.write_store(ex.select("conv_id", "turn", "tokens"), name, ["conv_id", "turn"], STORE_BUCKETS, _folder(spark, "store"))
    b = _batches(store.select("conv_id", "turn", F.size("tokens").alias("_n")).select(
        "conv_id", "turn", F.sequence(F.lit(1), F.col("_n") - 1).alias("input_ids")))
    d = b.join(store, ["conv_id", "turn"])
    return d.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_idx", "slot", "conv_id", "turn",
                    F.size("tokens").cast("bigint").alias("n_tok"), _hash_tokens("tokens").alias("tokens_md5"))


# --- A2, T1-T4, A3-A5, N1 -----------------------------------------------------------------------

def _batches(examples):
    return training.training_batches(examples)


@query("batch_export")
def q_batch_export(spark, sf):
    """Padded batches through the Arrow hook: one row a batch with its shape and a checksum of its cells."""
    ex = training.training_examples(_conv(spark, sf)).select(
        "conv_id", "turn", *[F.transform(c, F.char_length).alias(c) for c in ("input_ids", "labels")])
    ordered = batching.epoch_order(ex, ["conv_id", "turn"], seed=config.SEED, epochs=config.EPOCHS)
    p = batching.pad_batches(batching.assign_batches(ordered, config.BATCH_SIZE))
    p = p.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_idx", "slot", "attention_len", "padded_len", "input_ids", "labels")
    out = batching.export_batches(p, training.cell_sums, "epoch bigint, batch_idx bigint, cells bigint, real bigint, label_sum bigint")
    return out.groupBy("epoch", "batch_idx").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("cells", "real", "label_sum")])


@query("run_plan")
def q_run_plan(spark, sf):
    return steps.run_plan(training.training_examples(_conv(spark, sf)))


def _step_map(examples):
    return steps.step_map(_batches(examples), config.ACCUMULATION_STEPS, config.EPOCHS)


@query("step_map")
def q_step_map(spark, sf):
    sm = _step_map(training.training_examples(_conv(spark, sf)))
    # -1 marks "never applied" (NULL in the operator) so both engines type the column BIGINT
    return sm.withColumn("consumed_by_step", F.coalesce("consumed_by_step", F.lit(-1).cast("bigint")))


def _updates(examples):
    return _step_map(examples).filter("is_update").select(F.col("step_after").alias("step"))


@query("step_events")
def q_step_events(spark, sf):
    return steps.step_events(_updates(training.training_examples(_conv(spark, sf))), LOG_EVERY, SAVE_EVERY, TEST_EVERY)


def _total_steps(examples):
    return steps.run_plan(examples).select("total_steps")


@query("lr_plan")
def q_lr_plan(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    return _updates(ex).select("step", _r(steps.lr_at("step", _total_steps(ex).scalar()), 12).alias("lr"))


@query("next_token")
def q_next_token(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    return scoring.next_token_counts(ex).select("ctx", "token", F.col("n").cast("bigint").alias("n"))


def _batch_loss(examples):
    """An example's loss is summed once and takes part in every epoch as two numbers."""
    each = _once(scoring.example_loss(examples, scoring.next_token_counts(examples), ["conv_id", "turn"]))
    ordered = batching.epoch_order(each, ["conv_id", "turn"], seed=config.SEED, epochs=config.EPOCHS)
    return scoring.batch_loss(batching.assign_batches(ordered))


@query("batch_loss")
def q_batch_loss(spark, sf):
    bl = _batch_loss(training.training_examples(_conv(spark, sf)))
    return bl.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_idx", _r("loss").alias("loss"),
                     _r("scaled_loss").alias("scaled_loss"), "n_positions")


@query("epoch_loss")
def q_epoch_loss(spark, sf):
    el = steps.epoch_loss(_batch_loss(training.training_examples(_conv(spark, sf))))
    return el.select(F.col("epoch").cast("bigint").alias("epoch"), _r("epoch_loss").alias("epoch_loss"),
                     F.col("n_batches").cast("bigint").alias("n_batches"))


def _metrics(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    return steps.metrics_log(_step_map(ex), _batch_loss(ex), total_steps=_total_steps(ex).scalar(), log_interval=LOG_EVERY)


@query("metrics_log")
def q_metrics_log(spark, sf):
    m = _metrics(spark, sf)
    return m.select("step", F.col("epoch").cast("bigint").alias("epoch"), "batch_idx",
                    _r("train_loss").alias("train_loss"), _r("lr", 12).alias("lr"), "mem_gb")


@query("metrics_rows")
def q_metrics_rows(spark, sf):
    """S10 round trip: logged metrics written as JSON rows to the shared checkpoint folder, read back."""
    path = _folder(spark, "metrics")
    metrics.write_metrics_rows(_metrics(spark, sf), path)
    r = metrics.read_metrics_rows(spark, path)
    return r.select("step", _r("train_loss").alias("train_loss"), _r("lr", 12).alias("lr"), "mem_gb")


@query("metrics_document")
def q_metrics_document(spark, sf):
    """The logged metrics as documents of parallel lists with an index, read back as rows."""
    path = _folder(spark, "metrics")
    metrics.write_metrics_json(_metrics(spark, sf), path, steps_per_document=METRICS_PER_DOCUMENT)
    r = metrics.read_metrics_documents(spark, path)
    return r.select("step", _r("train_loss").alias("train_loss"), _r("lr", 12).alias("lr"), "mem_gb")


# --- G1-G7, G9 ----------------------------------------------------------------------------------

def _counts(spark, sf):
    return scoring.next_token_counts(training.training_examples(_conv(spark, sf)))


@query("softmax")
def q_softmax(spark, sf):
    s = scoring.softmax(scoring.temperature(scoring.count_scores(_counts(spark, sf)), config.TEMPERATURE))
    return s.select("ctx", "token", _r("p").alias("p"))


@query("topk_filter")
def q_topk_filter(spark, sf):
    s = scoring.top_k(scoring.temperature(scoring.count_scores(_counts(spark, sf)), config.TEMPERATURE), config.TOP_K)
    return s.select("ctx", "token", F.col("n").cast("bigint").alias("n"), _r("logit").alias("logit"))


@query("topp_filter")
def q_topp_filter(spark, sf):
    s = scoring.decode_filters(_counts(spark, sf), config.TEMPERATURE, config.TOP_K, config.TOP_P)
    return s.select("ctx", "token", _r("p").alias("p"))


@query("sample_token")
def q_sample_token(spark, sf):
    s = scoring.sample(scoring.decode_filters(_counts(spark, sf)), seed=config.SEED, step=0)
    return s.select("ctx", "token")


@query("tail_context")
def q_tail_context(spark, sf):
    # a line is two tokens at least and starts a token, so the last n lines hold the last n tokens
    n = config.TRAIN_MAX_SEQ_LEN
    ex = tokens.tokenize(render.render_text(render.conversation_examples(_conv(spark, sf), max_turns=n)), "full_text")
    t = scoring.tail_context(ex, n, "tokens", "ctx_tokens")
    return t.select("conv_id", "turn", F.size("ctx_tokens").cast("bigint").alias("n_tail"),
                    _hash_tokens("ctx_tokens").alias("tail_md5"))


@query("stop_cut")
def q_stop_cut(spark, sf):
    conv = _conv(spark, sf).filter(F.col("role") == "assistant")
    g = tokens.tokenize(conv.select("conv_id", "turn", "text"), "text", "gen_tokens")
    s = scoring.stop_cut(g, ["conv_id", "turn"])
    return s.select("conv_id", "turn", "n_kept", "stop_reason", F.md5("kept_text").alias("kept_md5"))


@query("strip_prompt")
def q_strip_prompt(spark, sf):
    ex = render.render_text(render.conversation_examples(_conv(spark, sf)))
    ex = ex.withColumn("prompt", F.concat(F.array_join("context", "\n"), F.lit("\n")))
    return scoring.strip_prompt(ex).select("conv_id", "turn", "reply")


def _first_prompts(spark, sf):
    conv = _conv(spark, sf)
    return (conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("f"))
                .select(F.col("conv_id").alias("prompt_id"),
                        F.concat(F.lit(config.USER_PREFIX), F.col("f.text"), F.lit(config.PROMPT_SUFFIX)).alias("prompt")))


@query("rollout")
def q_rollout(spark, sf):
    prompts = tokens.tokenize(_first_prompts(spark, sf), "prompt")
    return rollout.rollout(prompts, _counts(spark, sf), steps=config.SAMPLER_MAX_TOKENS)


@query("generation_report")
def q_generation_report(spark, sf):
    return rollout.generation_report(_first_prompts(spark, sf), _counts(spark, sf), steps=config.SAMPLER_MAX_TOKENS)


@query("test_prompts")
def q_test_prompts(spark, sf):
    """The trainer's fixed prompts against the table's next-token counts."""
    prompts = spark.createDataFrame(list(enumerate(config.TEST_PROMPTS)), "prompt_id bigint, prompt string")
    return rollout.generation_report(prompts, _counts(spark, sf), steps=config.SAMPLER_MAX_TOKENS)


# --- C1-C8 ----------------------------------------------------------------------------------------

def _log(spark, sf):
    return standins.chat_input_log(table(spark, sf, "events"))


@query("clean_inputs")
def q_clean_inputs(spark, sf):
    return convlog.clean_inputs(_log(spark, sf)).select("conv_id", "turn", "clean")


@query("classify_inputs")
def q_classify_inputs(spark, sf):
    c = convlog.classify_inputs(convlog.clean_inputs(_log(spark, sf)))
    return c.select("conv_id", "turn", "kind", "verb", "temp_value", F.col("tokens_value").cast("double").alias("tokens_value"))


def _cut(spark, sf):
    return convlog.cut_after_quit(convlog.classify_inputs(convlog.clean_inputs(_log(spark, sf))))


@query("cut_after_quit")
def q_cut_after_quit(spark, sf):
    return _cut(spark, sf).select("conv_id", "turn", "kind")


@query("segments")
def q_segments(spark, sf):
    return convlog.segments(_cut(spark, sf)).select("conv_id", "turn", "kind", "segment_id")


@query("carry_settings")
def q_carry_settings(spark, sf):
    d = convlog.carry_settings(convlog.segments(_cut(spark, sf)))
    return d.select("conv_id", "turn", "kind", "temperature", "max_tokens")


@query("build_prompts")
def q_build_prompts(spark, sf):
    d = convlog.build_prompts(convlog.process_log(_log(spark, sf)))
    return d.select("conv_id", "turn", "segment_id", "temperature", "max_tokens", "prompt")


@query("prompt_ranges")
def q_prompt_ranges(spark, sf):
    """C7 by reference: the range of lines of each prompt."""
    d = convlog.segment_lines(convlog.process_log(_log(spark, sf)))
    return d.select("conv_id", "turn", "segment_id", (F.col("line_no") - F.col("first_line") + 1).alias("n_lines"))


@query("prompt_render")
def q_prompt_render(spark, sf):
    """C7 by reference, every prompt rendered: equals build_prompts."""
    lines = _once(convlog.segment_lines(convlog.process_log(_log(spark, sf))).select(
        "conv_id", "turn", "segment_id", "temperature", "max_tokens", "first_line", "line_no", "line"))
    d = convlog.render_prompts(lines.drop("line"), lines)
    return d.select("conv_id", "turn", "segment_id", "temperature", "max_tokens", "prompt")


@query("chat_stream")
def q_chat_stream(spark, sf):
    """R2: the log arrives in three deliveries of turns; the stream is started anew for each, from its state, and gives C4-C7."""
    log = _once(_log(spark, sf))
    src, out, ckpt = (_folder(spark, f"chat-{k}") for k in ("in", "out", "ckpt"))
    turn = F.col("turn")
    for part in (turn < 16, (turn >= 16) & (turn < 48), turn >= 48):
        log.filter(part).write.mode("append").parquet(src)
        chat_state.start_sessions(spark, src, out, ckpt, state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    done = spark.read.schema(chat_state.OUTPUT_SCHEMA).parquet(out).filter("kind = 'message' AND NOT late")
    return done.select("conv_id", "turn", "segment_id", "temperature", "max_tokens", "prompt")


@query("extract_reply")
def q_extract_reply(spark, sf):
    ex = render.render_text(render.conversation_examples(_conv(spark, sf)))
    ex = ex.withColumn("prompt", F.concat(F.array_join("context", "\n"), F.lit(config.PROMPT_SUFFIX)))
    return convlog.extract_reply(ex, "full_text", "prompt").select("conv_id", "turn", "reply")


# --- M1-M4 ----------------------------------------------------------------------------------------

@query("embed_lookup")
def q_embed_lookup(spark, sf):
    ex = training.training_examples(_conv(spark, sf))
    v = _example_vocab(ex)
    pos = tokens.explode_items(ex, "input_ids", "token", keys=["conv_id", "turn"], pos="pos")
    pos = pos.join(v.select("token", "token_id"), "token")
    longest = ex.agg(F.max(F.size("input_ids"))).first()[0] or 0
    e = sequence.embed_lookup(pos, table(spark, sf, "embeddings"), max_len=longest)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
                    F.col("token_id").cast("bigint").alias("token_id"), _r(norm, 6).alias("norm"))


@query("vector_standardize")
def q_vector_standardize(spark, sf):
    z = sequence.standardize(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    ss = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    return z.select("vec_id", _r(F.get("z", 0), 6).alias("z_first"), _r(F.element_at("z", -1), 6).alias("z_last"),
                    _r(ss, 6).alias("z_sumsq"))


@query("causal_fir")
def q_causal_fir(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    y = sequence.causal_fir(ev, FIR_WEIGHTS, FIR_BIAS)
    return y.select("event_id", "user_id", _r("y", 6).alias("y"))


@query("decayed_state")
def q_decayed_state(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    s = sequence.decayed_state(ev, DECAY_PER_SECOND)
    return s.select("event_id", "user_id", _r("state", 6).alias("state"))


@query("selective_scan")
def q_selective_scan(spark, sf):
    """Each event chooses its step, input weights and output weights; two states a user."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    y = scan.selective_scan(ev, "user_id", ["ts", "event_id"], F.col("value"), (F.col("value") - 20) / 10,
                            [F.lit(1.0), F.cos("event_id")], [F.sin("event_id"), F.lit(1.0)], SCAN_RATES, SCAN_SKIP)
    return y.select("event_id", "user_id", _r("y", 6).alias("y"))


# --- split forms of hot keys: the whole table is one key ---------------------------------------------

@query("long_examples")
def q_long_examples(spark, sf):
    conv = standins.one_key(_conv(spark, sf), "conv_id", "turn")
    ex = render.conversation_examples_head(conv, config.TRAIN_MAX_SEQ_LEN, hot_rows=None)
    return ex.select("turn", F.size("context").cast("bigint").alias("n_ctx"),
                     F.md5(F.array_join("context", "\n")).alias("context_md5"), "response")


def _one_context(spark, sf):
    """Next-token counts of the whole table as one context: thousands of tokens, most of them tied."""
    counts = _counts(spark, sf).groupBy("token").agg(F.sum("n").alias("n"))
    return _once(counts.select(F.lit("").alias("ctx"), "token", "n"))


@query("long_nucleus")
def q_long_nucleus(spark, sf):
    s = nucleus.nucleus(scoring.count_scores(_one_context(spark, sf)), config.TEMPERATURE, 0, config.TOP_P)
    return s.select("token", _r("p", 12).alias("p"))


@query("long_sample")
def q_long_sample(spark, sf):
    """One draw a conversation row from the one context."""
    draws = _conv(spark, sf).select("conv_id", "turn")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    u = keyed_uniform(F.lit(str(config.SEED)), F.lit("draw"), name)
    table_ = nucleus.draw_table(_one_context(spark, sf), config.TEMPERATURE, 0, config.TOP_P)
    return nucleus.draw(draws, table_, F.lit(""), u, F.concat(F.lit("\0"), name))


def _long_log(spark, sf):
    return standins.one_key(convlog.classify_inputs(convlog.clean_inputs(_log(spark, sf))), "conv_id", "turn")


@query("long_cut")
def q_long_cut(spark, sf):
    return convlog.cut_after_quit(_long_log(spark, sf), split=True).select("turn", "kind")


@query("long_segments")
def q_long_segments(spark, sf):
    d = convlog.carry_settings(convlog.segments(_long_log(spark, sf), split=True), split=True)
    return d.select("turn", "kind", "segment_id", "temperature", "max_tokens")


@query("long_fir")
def q_long_fir(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.lit(0).cast("bigint").alias("user_id"), "ts", "value")
    return sequence.causal_fir(ev, FIR_WEIGHTS, FIR_BIAS, hot_rows=None).select("event_id", _r("y", 6).alias("y"))
