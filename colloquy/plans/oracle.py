"""DuckDB SQL equivalents of the registered queries (same tables, same column names).

Written independently of the Spark code: global windows and plain SQL where Spark uses
bucketed/two-phase forms, recursive CTEs where Spark uses closed forms.
"""

from colloquy import config

ORACLE: dict = {}

PRETOKEN = r"' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'"
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SEP = "chr(31)"


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# ---------------------------------------------------------------------------------------------
EXAMPLES = f"""
lines AS (
  SELECT conv_id, turn, role, upper(role[1]) || lower(role[2:]) || ': ' || text AS line FROM conversations
),
ctx AS (
  SELECT conv_id, turn, role, line,
         list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx_list
  FROM lines
),
ex0 AS (
  SELECT conv_id, turn, coalesce(ctx_list, []::VARCHAR[]) AS context, line AS response,
         concat(coalesce(array_to_string(ctx_list, chr(10)), ''), chr(10), line) AS full_text
  FROM ctx WHERE role = 'assistant'
),
examples AS (
  SELECT *, toks_full[1:448] AS tokens
  FROM (SELECT *, regexp_extract_all(full_text, {PRETOKEN}) AS toks_full FROM ex0)
),
pairs AS (
  SELECT conv_id, turn, tokens, tokens[1:len(tokens)-1] AS input_ids, tokens[2:len(tokens)] AS labels
  FROM examples WHERE len(tokens) >= 2
),
ordered AS (
  SELECT p.*, epoch,
         row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', '42', epoch::VARCHAR, conv_id::VARCHAR, turn::VARCHAR)), conv_id, turn) - 1 AS pos,
         count(*) OVER (PARTITION BY epoch) AS n_examples
  FROM pairs p, (SELECT unnest(range(2)) AS epoch) ep
),
batches AS (
  SELECT *, pos // 2 AS batch_idx, pos % 2 AS slot,
         len(input_ids)::BIGINT AS attention_len,
         max(len(input_ids)) OVER (PARTITION BY epoch, pos // 2)::BIGINT AS padded_len
  FROM ordered e WHERE pos // 2 < n_examples // 2
),
plan AS (
  SELECT n_examples, nb, nb * 2 AS raw_total, (nb * 2) // 6 AS total_steps
  FROM (SELECT count(*)::BIGINT AS n_examples, count(*)::BIGINT // 2 AS nb FROM pairs)
),
stepmap AS (
  SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, (batch_idx + 1) % 6 = 0 AS is_update,
         (epoch * (nb // 6) + (batch_idx + 1) // 6)::BIGINT AS step_after,
         (CASE WHEN batch_idx < (nb // 6) * 6 THEN epoch * (nb // 6) + batch_idx // 6 + 1
               WHEN epoch + 1 < 2 AND nb // 6 > 0 THEN (epoch + 1) * (nb // 6) + 1 ELSE -1 END)::BIGINT AS consumed_by_step
  FROM (SELECT DISTINCT epoch, batch_idx FROM batches) b
  JOIN (SELECT epoch, max(batch_idx) + 1 AS nb FROM batches GROUP BY epoch) n USING (epoch)
),
counts AS (
  SELECT ctx, token, count(*)::BIGINT AS n FROM (SELECT unnest(input_ids) AS ctx, unnest(labels) AS token FROM pairs)
  GROUP BY ctx, token
),
probs AS (
  SELECT ctx, token, n / sum(n) OVER (PARTITION BY ctx) AS p FROM counts
),
bloss AS (
  SELECT epoch, batch_idx, sum(c * -ln(p)) / sum(c) AS loss, sum(c)::BIGINT AS n_positions
  FROM (SELECT epoch, batch_idx, ctx, token, count(*) AS c
        FROM (SELECT epoch, batch_idx, unnest(input_ids) AS ctx, unnest(labels) AS token FROM batches)
        GROUP BY ALL) x
  JOIN probs USING (ctx, token)
  GROUP BY epoch, batch_idx
),
lr AS (
  SELECT s.step_after AS step,
         CASE WHEN w <= 0 THEN 3e-4
              WHEN s.step_after < w THEN 3e-4 * (0.1 + 0.9 * s.step_after / w)
              ELSE 1e-5 + (3e-4 - 1e-5) * (1 + cos(pi() * (s.step_after - w) / (total_steps - w))) / 2 END AS lr,
         s.epoch, s.batch_idx
  FROM stepmap s, (SELECT total_steps, least(500, total_steps // 10) AS w FROM plan) pl
  WHERE s.is_update
),
scored AS (
  SELECT ctx, token, n, ln(n) / 0.8 AS logit FROM counts
),
topk AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS rk FROM scored) WHERE rk <= 50
),
sm AS (
  SELECT *, e / sum(e) OVER (PARTITION BY ctx) AS p
  FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM topk)
),
topp AS (
  SELECT ctx, token, n, logit, p / sum(p) OVER (PARTITION BY ctx) AS p
  FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, token
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sm)
  WHERE before <= 0.9 + 1e-12
),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY freq DESC, token) - 1)::BIGINT AS token_id, freq
  FROM (SELECT token, count(*)::BIGINT AS freq FROM (SELECT unnest(tokens) AS token FROM pairs) GROUP BY token)
)
"""

NEIGH = """
cl AS (
  SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS row_key,
         lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text,
         lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
ambig AS (
  SELECT row_key, 0::BIGINT AS branch, 0::BIGINT AS pos1, 0::BIGINT AS pos2, 'User: ' || prev_text AS context,
         'Assistant: ' || text AS response FROM cl
  WHERE role = 'assistant' AND prev_role = 'user' AND (conv_id + turn) % 5 <> 0
  UNION ALL
  SELECT row_key, 0, 0, 2, 'User: ' || prev_text, 'Assistant: ' || split_part(text, chr(10), 1) FROM cl
  WHERE role = 'assistant' AND prev_role = 'user' AND (conv_id + turn) % 5 <> 0
  UNION ALL
  SELECT row_key, 1, 0, 0, 'User: ' || prev_text, 'Assistant: ' || split_part(prev_text, chr(10), 1) FROM cl
  WHERE role = 'assistant' AND prev_role = 'user'
),
wiki AS (
  SELECT d.doc_id::VARCHAR AS row_key, 0::BIGINT AS branch, 0::BIGINT AS pos1, 0::BIGINT AS pos2,
         'User: ' || split_part(d.text, chr(10), 1) AS context, 'Assistant: ' || d.text AS response
  FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1
),
truthful AS (
  SELECT row_key, 0::BIGINT AS branch, 0::BIGINT AS pos1, 0::BIGINT AS pos2, 'User: ' || prev_text AS context,
         'Assistant: ' || text AS response FROM cl WHERE role = 'assistant' AND prev_role = 'user'
  UNION ALL
  SELECT row_key, 1, i, 0, 'User: ' || prev_text, 'Assistant: ' || split_part(text, chr(10), 1)
  FROM cl, (SELECT unnest([1, 3]) AS i) ii
  WHERE role = 'assistant' AND prev_role = 'user' AND split_part(text, chr(10), 1) IS DISTINCT FROM text
),
squad AS (
  SELECT row_key, 0::BIGINT AS branch, 0::BIGINT AS pos1, 0::BIGINT AS pos2, 'User: ' || text AS context,
         'Assistant: ' || next_text AS response FROM cl WHERE role = 'user' AND next_role = 'assistant'
),
instruct AS (
  SELECT row_key, 0::BIGINT AS branch, 0::BIGINT AS pos1, 0::BIGINT AS pos2,
         CASE WHEN coalesce(c, '') <> '' THEN 'User: ' || text || chr(10) || chr(10) || 'Context: ' || c
              ELSE 'User: ' || text END AS context,
         'Assistant: ' || next_text AS response
  FROM (SELECT *, CASE WHEN prev_role = 'system' THEN prev_text WHEN turn % 4 = 1 THEN ' '
                       WHEN turn % 4 = 3 THEN '' END AS c
        FROM cl WHERE role = 'user' AND next_role = 'assistant')
),
qa_all AS (
  SELECT 'ambig' AS source, 0::BIGINT AS source_ord, * FROM ambig
  UNION ALL SELECT 'wiki', 1, * FROM wiki
  UNION ALL SELECT 'truthful', 2, * FROM truthful
  UNION ALL SELECT 'squad', 3, * FROM squad
  UNION ALL SELECT 'instruct', 4, * FROM instruct
)
"""

for _k in ("ambig", "wiki", "truthful", "instruct"):
    ORACLE[f"qa_{_k}"] = f"WITH {NEIGH} SELECT * FROM {_k}"
ORACLE["qa_first_answer"] = f"WITH {NEIGH} SELECT * FROM squad"
ORACLE["qa_union"] = f"WITH {NEIGH} SELECT * FROM qa_all"
ORACLE["source_counts"] = f"""WITH {NEIGH}
SELECT source, source_ord, n, (sum(n) OVER (ORDER BY source_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS running
FROM (SELECT source, source_ord, count(*)::BIGINT AS n FROM qa_all GROUP BY ALL)"""

ORACLE["jsonl_validate"] = """
SELECT reason, count(*)::BIGINT AS n FROM (
  SELECT CASE (conv_id + turn) % 10 WHEN 0 THEN 'malformed' WHEN 7 THEN 'malformed' WHEN 1 THEN 'missing_key'
              WHEN 2 THEN 'not_object' WHEN 3 THEN 'bad_context' WHEN 6 THEN 'bad_context'
              WHEN 4 THEN 'bad_response' ELSE 'ok' END AS reason
  FROM conversations) GROUP BY reason
"""

ORACLE["conv_examples"] = f"""WITH {EXAMPLES}
SELECT conv_id, turn, len(context)::BIGINT AS n_ctx, array_to_string(context, chr(10)) AS context_text, response FROM ex0"""
ORACLE["render_text"] = f"""WITH {EXAMPLES}
SELECT conv_id, turn, full_text, length(full_text)::BIGINT AS n_chars FROM ex0"""

ORACLE["tokenize"] = f"""
SELECT doc_id, len(t)::BIGINT AS n_tok, array_to_string(t, '') = text AS lossless
FROM (SELECT doc_id, text, regexp_extract_all(text, {PRETOKEN}) AS t FROM documents)"""

DOC_VOCAB = f"""
doc_vocab AS (
  SELECT token, (row_number() OVER (ORDER BY freq DESC, token) - 1)::BIGINT AS token_id, freq
  FROM (SELECT token, count(*)::BIGINT AS freq
        FROM (SELECT unnest(regexp_extract_all(text, {PRETOKEN})) AS token FROM documents) GROUP BY token)
)"""
ORACLE["vocab"] = f"WITH {DOC_VOCAB} SELECT * FROM doc_vocab"
ORACLE["detokenize"] = """
SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents"""

ORACLE["shift_pairs"] = f"""WITH {EXAMPLES}
SELECT conv_id, turn, len(input_ids)::BIGINT AS n,
       md5(array_to_string(input_ids, {SEP})) AS input_md5, md5(array_to_string(labels, {SEP})) AS labels_md5
FROM pairs"""

ORACLE["dataset_sizes"] = f"""WITH {EXAMPLES}
SELECT count(*)::BIGINT AS n_lazy, sum(CASE WHEN len(tokens) >= 2 THEN 1 ELSE 0 END)::BIGINT AS n_cached,
       sum(CASE WHEN len(tokens) >= 200 THEN 1 ELSE 0 END)::BIGINT AS n_cached_min200
FROM examples"""

ORACLE["lazy_fill"] = f"""WITH {EXAMPLES},
v AS (SELECT conv_id, turn, len(tokens) >= 200 AS valid FROM examples),
f AS (
  SELECT conv_id, turn,
         coalesce(first_value(CASE WHEN valid THEN {{'c': conv_id, 't': turn}} END IGNORE NULLS)
                    OVER (ORDER BY conv_id, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                  (SELECT {{'c': conv_id, 't': turn}} FROM v WHERE valid ORDER BY conv_id, turn LIMIT 1)) AS s
  FROM v)
SELECT conv_id, turn, s.c AS src_conv_id, s.t AS src_turn FROM f"""

ORACLE["epoch_order"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, pos::BIGINT AS pos, conv_id, turn FROM ordered"""


def permuted(src: str) -> str:
    """One pass of the keyed rounds over ``src(conv_id, turn, epoch, n, a, b, x)``."""
    keep = "conv_id, turn, epoch, n, a, b"
    sql = f"SELECT {keep}, x // b AS l0, x % b AS r0 FROM {src}"
    for i in range(6):
        half, other = ("l", "r") if i % 2 == 0 else ("r", "l")
        w = f"(({other}{i} + ('0x' || substring(md5('42:' || epoch || ':{i}'), 1, 7))::BIGINT) % 2147483647)"
        sql = (f"SELECT {keep}, ({half}{i} + {w} * {w} % 2147483647 * 48271 % 2147483647) % {'a' if half == 'l' else 'b'} AS {half}{i + 1}, "
               f"{other}{i} AS {other}{i + 1} FROM ({sql})")
    return f"SELECT {keep}, l6 * b + r6 AS x FROM ({sql})"


ORACLE["epoch_permutation"] = f"""WITH RECURSIVE {EXAMPLES},
nums AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS x, count(*) OVER ()::BIGINT AS n FROM ordered WHERE epoch = 0),
sized AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ((n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT)::BIGINT AS b FROM nums),
epochs AS (SELECT s.*, e.epoch::BIGINT AS epoch FROM sized s, range({config.EPOCHS}) AS e(epoch)),
walk AS ({permuted("epochs")} UNION ALL {permuted("(SELECT * FROM walk WHERE x >= n)")})
SELECT epoch, x AS pos, conv_id, turn FROM walk WHERE x < n"""
ORACLE["batch_assign"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, slot::BIGINT AS slot, conv_id, turn FROM batches"""

ORACLE["padded_batches"] = f"""WITH {EXAMPLES},
pad AS (SELECT count(*)::BIGINT AS pad_id FROM vocab),
ids AS (
  SELECT conv_id, turn, list(token_id ORDER BY i) AS ids
  FROM (SELECT conv_id, turn, i, tokens[i] AS token FROM pairs, unnest(range(1, len(tokens) + 1)) AS r(i))
  JOIN vocab USING (token) GROUP BY conv_id, turn
),
b AS (
  SELECT o.epoch, o.batch_idx, o.slot, o.attention_len, o.padded_len, ids.ids
  FROM batches o JOIN ids USING (conv_id, turn)
)
SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, slot::BIGINT AS slot, attention_len, padded_len,
       array_to_string(ids[1:len(ids)-1], ' ') || repeat(' ' || (SELECT pad_id FROM pad)::VARCHAR, (padded_len - attention_len)::INT) AS input_ids,
       array_to_string(ids[2:len(ids)], ' ') || repeat(' -100', (padded_len - attention_len)::INT) AS labels
FROM b"""

ORACLE["batch_stats"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, (max(batch_idx) + 1)::BIGINT AS n_batches, count(*)::BIGINT AS n_rows,
       sum(padded_len)::BIGINT AS padded_cells, sum(attention_len)::BIGINT AS real_cells
FROM batches GROUP BY epoch"""

ORACLE["run_plan"] = f"""WITH {EXAMPLES}
SELECT n_examples, nb AS batches_per_epoch, raw_total, total_steps, 12::BIGINT AS effective_batch,
       least(500, total_steps // 10)::BIGINT AS warmup FROM plan"""
ORACLE["step_map"] = f"WITH {EXAMPLES} SELECT * FROM stepmap"
ORACLE["step_events"] = f"""WITH {EXAMPLES}
SELECT step_after AS step, step_after % 5 = 0 AS do_log, step_after % 20 = 0 AS do_save, step_after % 10 = 0 AS do_test
FROM stepmap WHERE is_update"""
ORACLE["lr_plan"] = f"WITH {EXAMPLES} SELECT step, round(lr, 12) AS lr FROM lr"

ORACLE["next_token"] = f"WITH {EXAMPLES} SELECT * FROM counts"
ORACLE["batch_loss"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, round(loss, 9) AS loss, round(loss / 6, 9) AS scaled_loss,
       n_positions FROM bloss"""
ORACLE["epoch_loss"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, round(avg(loss), 9) AS epoch_loss, count(*)::BIGINT AS n_batches FROM bloss GROUP BY epoch"""
METRICS = """
m AS (
  SELECT lr.step, lr.epoch, lr.batch_idx, b.loss AS train_loss, lr.lr, 0.0 AS mem_gb
  FROM lr JOIN bloss b ON b.epoch = lr.epoch AND b.batch_idx = lr.batch_idx
  WHERE lr.step % 5 = 0
)"""
ORACLE["metrics_log"] = f"""WITH {EXAMPLES}, {METRICS}
SELECT step, epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, round(train_loss, 9) AS train_loss,
       round(lr, 12) AS lr, mem_gb FROM m"""
ORACLE["metrics_rows"] = f"""WITH {EXAMPLES}, {METRICS}
SELECT step, round(train_loss, 9) AS train_loss, round(lr, 12) AS lr, mem_gb FROM m"""

ORACLE["softmax"] = f"""WITH {EXAMPLES}
SELECT ctx, token, round(e / sum(e) OVER (PARTITION BY ctx), 9) AS p
FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM scored)"""
ORACLE["topk_filter"] = f"WITH {EXAMPLES} SELECT ctx, token, n, round(logit, 9) AS logit FROM topk"
ORACLE["topp_filter"] = f"WITH {EXAMPLES} SELECT ctx, token, round(p, 9) AS p FROM topp"
ORACLE["sample_token"] = f"""WITH {EXAMPLES},
c AS (
  SELECT ctx, token,
         sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS rn,
         ('0x' || substring(md5(concat_ws(':', '42', '0', ctx)), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM topp
),
pick AS (SELECT ctx, coalesce(min(CASE WHEN cum > u THEN rn END), max(rn)) AS rn FROM c GROUP BY ctx)
SELECT ctx, token FROM c JOIN pick USING (ctx, rn)"""

ORACLE["tail_context"] = f"""WITH {EXAMPLES}
SELECT conv_id, turn, len(t)::BIGINT AS n_tail, md5(array_to_string(t, {SEP})) AS tail_md5
FROM (SELECT conv_id, turn, toks_full[greatest(len(toks_full) - 448, 0) + 1:] AS t FROM examples)"""

ORACLE["stop_cut"] = f"""
WITH g AS (
  SELECT conv_id, turn, regexp_extract_all(text, {PRETOKEN}) AS toks FROM conversations WHERE role = 'assistant'
),
p AS (
  SELECT conv_id, turn, i - 1 AS pos, toks[i] AS tok FROM g, unnest(range(1, least(len(toks), 200) + 1)) AS r(i)
),
c AS (
  SELECT *, sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY conv_id, turn ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nl FROM p
),
s AS (
  SELECT *, min(CASE WHEN tok = '<|endoftext|>' OR nl > 3 THEN pos END) OVER (PARTITION BY conv_id, turn) AS stop_pos FROM c
)
SELECT conv_id, turn, count(*)::BIGINT AS n_kept,
       CASE WHEN max(CASE WHEN tok = '<|endoftext|>' AND pos = stop_pos THEN 1 END) = 1 THEN 'eos'
            WHEN max(stop_pos) IS NOT NULL THEN 'newlines'
            WHEN count(*) >= 200 THEN 'max_tokens' ELSE 'end' END AS stop_reason,
       md5(string_agg(tok, '' ORDER BY pos)) AS kept_md5
FROM s WHERE stop_pos IS NULL OR pos <= stop_pos
GROUP BY conv_id, turn"""

ORACLE["strip_prompt"] = f"""WITH {EXAMPLES}
SELECT conv_id, turn, substring(full_text, length(array_to_string(context, chr(10)) || chr(10)) + 1) AS reply FROM ex0"""

# --- chat input log ---------------------------------------------------------------------------
LOG = f"""
log AS (
  SELECT user_id AS conv_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS turn,
         CASE WHEN event_type = 'click' THEN 'ask ' || event_id::VARCHAR
              WHEN event_type = 'view' THEN '  look ' || event_id::VARCHAR || ' '
              WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN '/temp abc' ELSE '/TEMP  ' || value::VARCHAR END
              WHEN event_type = 'purchase' THEN '/tokens ' || CAST(floor(value) AS BIGINT)::VARCHAR
              WHEN event_id % 7 = 0 THEN '/clear' WHEN event_id % 11 = 0 THEN '/temp'
              WHEN event_id % 101 = 0 THEN '/quit now' ELSE ' ' END AS raw
  FROM events
),
cleaned AS (
  SELECT conv_id, turn, {strip('raw')} AS clean FROM log
),
cls AS (
  SELECT *, CASE WHEN NOT starts_with(clean, '/') THEN 'message'
                 WHEN verb = '/quit' THEN 'quit' WHEN verb = '/clear' THEN 'clear'
                 WHEN verb = '/temp' AND arg IS NOT NULL THEN
                      CASE WHEN regexp_matches(arg, '^[+-]?(([0-9](_?[0-9])*(\\.([0-9](_?[0-9])*)?)?|\\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?|nan|inf|infinity)$')
                           THEN 'temp' ELSE 'temp_bad' END
                 WHEN verb = '/tokens' AND arg IS NOT NULL THEN
                      CASE WHEN regexp_matches(arg, '^[+-]?[0-9](_?[0-9])*$') THEN 'tokens' ELSE 'tokens_bad' END
                 ELSE 'unknown' END AS kind
  FROM (SELECT *, CASE WHEN starts_with(clean, '/') THEN w[1] END AS verb, w[1] AS w1, w[2] AS arg
        FROM (SELECT *, string_split_regex(lower(clean), '{WS}+') AS w FROM cleaned WHERE clean <> ''))
),
cls2 AS (
  SELECT conv_id, turn, clean, kind, verb,
         CASE WHEN kind = 'temp' THEN CAST(replace(arg, '_', '') AS DOUBLE) END AS temp_value,
         CASE WHEN kind = 'tokens' THEN CAST(replace(arg, '_', '') AS BIGINT) END AS tokens_value
  FROM cls
),
cut AS (
  SELECT * FROM (SELECT *, max(CASE WHEN kind = 'quit' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM cls2) WHERE q = 0
),
seg AS (
  SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment_id,
         coalesce(last_value(temp_value IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.8) AS temperature,
         coalesce(last_value(tokens_value IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 200)::BIGINT AS max_tokens
  FROM cut
)"""

ORACLE["clean_inputs"] = f"WITH {LOG} SELECT conv_id, turn, clean FROM cleaned WHERE clean <> ''"
ORACLE["classify_inputs"] = f"WITH {LOG} SELECT conv_id, turn, kind, verb, temp_value, tokens_value::DOUBLE AS tokens_value FROM cls2"
ORACLE["cut_after_quit"] = f"WITH {LOG} SELECT conv_id, turn, kind FROM cut"
ORACLE["segments"] = f"WITH {LOG} SELECT conv_id, turn, kind, segment_id FROM seg"
ORACLE["carry_settings"] = f"WITH {LOG} SELECT conv_id, turn, kind, temperature, max_tokens FROM seg"
ORACLE["build_prompts"] = f"""WITH {LOG}
SELECT conv_id, turn, segment_id, temperature, max_tokens,
       array_to_string(list('User: ' || clean) OVER (PARTITION BY conv_id, segment_id ORDER BY turn
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), chr(10)) || chr(10) || 'Assistant:' AS prompt
FROM seg WHERE kind = 'message'"""

ORACLE["extract_reply"] = f"""WITH {EXAMPLES},
r AS (
  SELECT conv_id, turn,
         CASE WHEN contains(full_text, 'Assistant:') THEN {strip("string_split(full_text, 'Assistant:')[-1]")}
              ELSE {strip("substring(full_text, length(array_to_string(context, chr(10)) || chr(10) || 'Assistant:') + 1)")}
         END AS r0
  FROM ex0
)
SELECT conv_id, turn, CASE WHEN contains(r0, 'User:') THEN {strip("split_part(r0, 'User:', 1)")} ELSE r0 END AS reply FROM r"""

# --- sequence operators -----------------------------------------------------------------------
ORACLE["embed_lookup"] = f"""WITH {EXAMPLES},
nv AS (SELECT count(*) AS n FROM embeddings),
pos AS (SELECT conv_id, turn, i - 1 AS pos, input_ids[i] AS token FROM pairs, unnest(range(1, len(input_ids) + 1)) AS r(i)),
pv AS (SELECT p.*, v.token_id FROM pos p JOIN vocab v USING (token))
SELECT pv.conv_id, pv.turn, pv.pos::BIGINT AS pos, pv.token_id,
       round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
             lambda i: (a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE)))), 6) AS norm
FROM pv JOIN embeddings a ON a.vec_id = pv.token_id % (SELECT n FROM nv)
        JOIN embeddings b ON b.vec_id = pv.pos % (SELECT n FROM nv)"""

ORACLE["vector_standardize"] = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
m AS (SELECT vec_id, x, list_avg(x) AS mu FROM x),
s AS (SELECT vec_id, x, mu, sqrt(list_sum(list_transform(x, lambda v: (v - mu) * (v - mu))) / len(x) + 1e-5) AS sd FROM m),
z AS (SELECT vec_id, list_transform(x, lambda v: (v - mu) / sd) AS z FROM s)
SELECT vec_id, round(z[1], 6) AS z_first, round(z[-1], 6) AS z_last,
       round(list_sum(list_transform(z, lambda v: v * v)), 6) AS z_sumsq FROM z"""

ORACLE["causal_fir"] = """
SELECT event_id, user_id,
       round(0.5 + 0.1 * lag(value, 3, 0) OVER w + 0.2 * lag(value, 2, 0) OVER w + 0.3 * lag(value, 1, 0) OVER w
             + 0.4 * value, 6) AS y
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

ORACLE["decayed_state"] = """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
),
rec AS (
  SELECT user_id, rn, event_id, t, value AS h FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.t, exp(-(e.t - r.t) / 3600.0) * r.h + e.value
  FROM rec r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)
SELECT event_id, user_id, round(h, 6) AS state FROM rec"""

ORACLE["selective_scan"] = """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, value AS x, greatest((value - 20) / 10, 0) + ln(1 + exp(-abs((value - 20) / 10))) AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
),
rec AS (
  SELECT user_id, rn, event_id, x, d * x AS h0, d * cos(event_id) * x AS h1 FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.x, exp(-e.d) * r.h0 + e.d * e.x, exp(-0.05 * e.d) * r.h1 + e.d * cos(e.event_id) * e.x
  FROM rec r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)
SELECT event_id, user_id, round(sin(event_id) * h0 + h1 + 0.5 * x, 6) AS y FROM rec"""

U = "('0x' || substring(md5('42:' || {pos} || ':' || {id}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"
U0, U1 = U.format(pos="'0'", id="p.prompt_id"), U.format(pos="(g.pos + 1)::VARCHAR", id="g.prompt_id")
FIRST_PROMPTS = """SELECT conv_id AS prompt_id, 'User: ' || arg_min(text, turn) || chr(10) || 'Assistant:' AS prompt
  FROM conversations WHERE role = 'user' GROUP BY conv_id"""
FIXED_PROMPTS = " UNION ALL ".join("SELECT {}::BIGINT AS prompt_id, {} AS prompt".format(
    i, " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))) for i, text in enumerate(config.TEST_PROMPTS))


def generated(prompts: str) -> str:
    return f"""
cdf AS (
  SELECT ctx, token, logit,
         sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         row_number() OVER (PARTITION BY ctx ORDER BY logit ASC, token DESC) AS from_end
  FROM topp
),
draw AS MATERIALIZED (
  SELECT ctx, token,
         coalesce(lag(cum) OVER (PARTITION BY ctx ORDER BY logit DESC, token), 0) AS lo,
         CASE WHEN from_end = 1 THEN 'inf'::DOUBLE ELSE cum END AS hi
  FROM cdf
),
prompts AS MATERIALIZED ({prompts}),
gen(prompt_id, pos, token, nl) AS (
  SELECT p.prompt_id, 0::BIGINT, d.token, coalesce(length(d.token) - length(replace(d.token, chr(10), '')), 0)
  FROM prompts p LEFT JOIN draw d ON d.ctx = regexp_extract_all(p.prompt, {PRETOKEN})[-1] AND {U0} >= d.lo AND {U0} < d.hi
  UNION ALL
  SELECT g.prompt_id, g.pos + 1, d.token, g.nl + coalesce(length(d.token) - length(replace(d.token, chr(10), '')), 0)
  FROM (SELECT * FROM gen WHERE pos + 1 < 50 AND nl <= 3 AND token <> '<|endoftext|>') g
  LEFT JOIN draw d ON d.ctx = g.token AND {U1} >= d.lo AND {U1} < d.hi
)
"""


def report(prompts: str) -> str:
    return f"""WITH RECURSIVE {EXAMPLES}, {generated(prompts)}
SELECT prompt_id, prompt, coalesce(cont, '') AS generated FROM prompts
LEFT JOIN (SELECT prompt_id, string_agg(token, '' ORDER BY pos) AS cont FROM gen GROUP BY prompt_id) USING (prompt_id)"""


ORACLE["rollout"] = f"WITH RECURSIVE {EXAMPLES}, {generated(FIRST_PROMPTS)} SELECT prompt_id, pos, token FROM gen"
ORACLE["generation_report"] = report(FIRST_PROMPTS)
ONE_CONTEXT = f"""{EXAMPLES},
one AS (SELECT token, ln(sum(n)::DOUBLE) / 0.8 AS logit FROM counts GROUP BY token),
one_p AS (SELECT token, logit, e / sum(e) OVER () AS p FROM (SELECT *, exp(logit - max(logit) OVER ()) AS e FROM one)),
one_cut AS (
  SELECT token, logit, p / sum(p) OVER () AS p FROM (
    SELECT *, coalesce(sum(p) OVER (ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one_p)
  WHERE before <= 0.9 + 1e-12)"""
ORACLE["long_nucleus"] = f"WITH {ONE_CONTEXT} SELECT token, round(p, 12) AS p FROM one_cut"
ORACLE["long_sample"] = f"""WITH {ONE_CONTEXT},
one_lo AS (SELECT token, coalesce(sum(p) OVER (ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM one_cut),
d AS (SELECT conv_id, turn, ('0x' || substring(md5('42:draw:' || conv_id || ':' || turn), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM conversations)
SELECT conv_id, turn, token FROM d ASOF JOIN one_lo ON d.u >= one_lo.lo"""
ORACLE["test_prompts"] = report(FIXED_PROMPTS)

ORACLE["special_ids"] = f"""WITH {DOC_VOCAB},
n AS (SELECT count(*)::BIGINT AS n FROM doc_vocab)
SELECT false AS has_pad, false AS has_eos, n + 1 AS vocab_size, -1::BIGINT AS eos_id, n AS pad_id FROM n
UNION ALL SELECT false, true, n + 1, n, n FROM n
UNION ALL SELECT true, false, n + 1, -1, n FROM n
UNION ALL SELECT true, true, n + 2, n, n + 1 FROM n"""

ORACLE["batch_export"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, sum(padded_len)::BIGINT AS cells, sum(attention_len)::BIGINT AS real,
       sum(list_sum(list_transform(labels, lambda x: length(x))))::BIGINT AS label_sum
FROM batches GROUP BY epoch, batch_idx"""

# --- files and split forms ----------------------------------------------------------------------
ORACLE["jsonl_files"] = ORACLE["jsonl_validate"]
ORACLE["ingest_stream"] = f"SELECT reason, n, n AS n_counted FROM ({ORACLE['jsonl_validate']})"
ORACLE["chat_stream"] = ORACLE["build_prompts"]
ORACLE["source_counts_written"] = f"SELECT source, n, n AS n_counted FROM ({ORACLE['source_counts']})"
ORACLE["corpus_files"] = f"""WITH {EXAMPLES}
SELECT len(context)::BIGINT AS n_ctx, array_to_string(context, chr(10)) AS context_text, response FROM ex0"""
ORACLE["qa_files"] = f"""WITH {NEIGH}
SELECT source, source_ord, (right(row_key, 1)::INT % 2)::BIGINT AS split_ord, context, response FROM qa_all"""
ORACLE["qa_reject_counts"] = f"""WITH {NEIGH}
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE context IS NULL OR response IS NULL)::BIGINT AS rejected
FROM qa_all GROUP BY source"""
ORACLE["metrics_document"] = ORACLE["metrics_rows"]
ORACLE["long_examples"] = """
WITH l AS (
  SELECT conv_id * 1000000 + turn AS turn, role, upper(role[1]) || lower(role[2:]) || ': ' || text AS line,
         row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations
),
h AS (SELECT list(line ORDER BY rn) AS head FROM l WHERE rn <= 448)
SELECT turn, least(rn - 1, 448)::BIGINT AS n_ctx, md5(array_to_string(head[1:least(rn - 1, 448)], chr(10))) AS context_md5, line AS response
FROM l, h WHERE role = 'assistant'"""
LONG = f"""{LOG},
one AS (SELECT conv_id * 1000000 + turn AS turn, kind, temp_value, tokens_value FROM cls2)"""
ORACLE["long_cut"] = f"""WITH {LONG}
SELECT turn, kind FROM one WHERE turn < coalesce((SELECT min(turn) FROM one WHERE kind = 'quit'), 9223372036854775807)"""
ORACLE["long_segments"] = f"""WITH {LONG}
SELECT turn, kind, (sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER w)::BIGINT AS segment_id,
       coalesce(last_value(temp_value IGNORE NULLS) OVER w, 0.8) AS temperature,
       coalesce(last_value(tokens_value IGNORE NULLS) OVER w, 200)::BIGINT AS max_tokens
FROM one WINDOW w AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
ORACLE["long_fir"] = """
SELECT event_id, round(0.5 + 0.1 * lag(value, 3, 0) OVER w + 0.2 * lag(value, 2, 0) OVER w + 0.3 * lag(value, 1, 0) OVER w
             + 0.4 * value, 6) AS y
FROM events WINDOW w AS (ORDER BY ts, event_id)"""
ORACLE["history_render"] = ORACLE["conv_examples"]
ORACLE["history_ranges"] = """
SELECT conv_id, turn, greatest(0, n - 3)::BIGINT AS first_line, (n - 1)::BIGINT AS last_line, n::BIGINT AS response_line
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
WHERE role = 'assistant'"""
ORACLE["prompt_render"] = ORACLE["build_prompts"]
ORACLE["prompt_ranges"] = f"""WITH {LOG}
SELECT conv_id, turn, segment_id, count(*) OVER (PARTITION BY conv_id, segment_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n_lines
FROM seg WHERE kind = 'message'"""
ORACLE["token_store"] = f"""WITH {EXAMPLES}
SELECT epoch::BIGINT AS epoch, batch_idx::BIGINT AS batch_idx, slot::BIGINT AS slot, conv_id, turn, len(p.tokens)::BIGINT AS n_tok,
       md5(array_to_string(p.tokens, {SEP})) AS tokens_md5
FROM batches JOIN pairs p USING (conv_id, turn)"""
ORACLE["detokenize_blocks"] = ORACLE["detokenize"]
