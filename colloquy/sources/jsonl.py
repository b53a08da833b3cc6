"""S1-S3 JSONL dialogue source with a reject table; S9 corpus sink.

Acceptance rules (a line is kept only if the reference would both load and render it):
  malformed    not strict JSON (single quotes, BOM, blank lines, truncation)
  non_finite   JSON only with a NaN / Infinity literal (Python's json accepts them; we do not)
  not_object   valid JSON that is not an object
  missing_key  ``context`` or ``response`` key absent (an explicit null is present)
  bad_context  context not an array of strings (null, string, non-string or null element)
  bad_response response not a string
Duplicate keys: the last one wins (``spark.sql.variant.allowDuplicateKeys``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import configure

REASONS = ("ok", "malformed", "non_finite", "not_object", "missing_key", "bad_context", "bad_response")

# NaN / Infinity / -Infinity as bare literals (not inside a string, not part of a word)
_NON_FINITE = r'(?<![\w".])-?(NaN|Infinity)(?![\w"])'


def read_lines(spark: SparkSession, path) -> DataFrame:
    """One row per line (``\\n``, ``\\r\\n`` and ``\\r`` all end a line), column ``value``."""
    configure(spark)
    return spark.read.text(path)


def classify_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Adds ``reason`` plus typed ``context``/``response``/``source`` for accepted rows."""
    v = F.expr(f"try_parse_json({col})")
    d = lines.withColumn("_v", v)
    ctx_v = F.expr("variant_get(_v, '$.context', 'variant')")
    rsp_v = F.expr("variant_get(_v, '$.response', 'variant')")
    ctx_t = F.schema_of_variant(ctx_v)
    ctx_a = F.expr("try_variant_get(_v, '$.context', 'array<string>')")
    fixed = F.try_parse_json(F.regexp_replace(F.col(col), _NON_FINITE, "0"))
    reason = (F.when(F.col("_v").isNull() & F.col(col).rlike(_NON_FINITE) & fixed.isNotNull(), "non_finite")
               .when(F.col("_v").isNull(), "malformed")
               .when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_object")
               .when(ctx_v.isNull() | rsp_v.isNull(), "missing_key")
               .when(~ctx_t.isin("ARRAY<STRING>", "ARRAY<VOID>")
                     | F.exists(ctx_a, lambda x: x.isNull()), "bad_context")
               .when(F.schema_of_variant(rsp_v) != "STRING", "bad_response")
               .otherwise("ok"))
    d = d.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return (d.withColumn("context", F.when(ok, F.coalesce(ctx_a, F.array().cast("array<string>"))))
             .withColumn("response", F.when(ok, F.expr("variant_get(_v, '$.response', 'string')")))
             .withColumn("source", F.when(ok, F.expr("try_variant_get(_v, '$.source', 'string')")))
             .withColumn("has_replacement_char", F.col(col).contains("�"))
             .drop("_v"))


def validate_jsonl(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``; both come from one classification."""
    c = classify_lines(lines, col)
    valid = c.filter(F.col("reason") == "ok").drop("reason")
    rejects = c.filter(F.col("reason") != "ok").select(col, "reason")
    return valid, rejects


def reason_counts(classified: DataFrame) -> DataFrame:
    """S3: rows per outcome (``ok`` is the loaded count)."""
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def write_corpus_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One ``{"context": [...], "response": ...}`` object per line; no ``source`` key."""
    df.select("context", "response").write.mode(mode).option("compression", "none").json(path)
