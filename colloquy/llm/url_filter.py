"""URL rules: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is a canonical ``(host, path)`` with a verdict.  It fits its host and every subdomain when the
url's path starts with the rule's path; the longest rule wins (of equally long ones that with the
longer host).

For each distinct ``(host, path)`` the possible rule keys are its host suffixes (as many labels as
the longest listed host has) crossed with its path prefixes (of the lengths that occur in the list).
Each key probes a register-blocked Bloom filter: one 64-bit block per key, ``BITS`` bits in it.  The
filter is a constant of the plan and never has more than ``MAX_BLOCKS`` blocks (1 MB), whatever the
length of the list.  Only keys that pass go to the exact equi-join on (host, path), which removes
false positives; a larger list costs more passes, never a wrong answer.

Nulls and edge cases: a null url or one without ``://`` has an empty host and path and no rule.  A
null rule host or path never fits; a rule listed twice counts once (``block`` before ``allow`` if
the verdicts differ).  An empty list leaves the default verdict.  Repeated pages stay repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize

BITS = 4
BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 17
DEFAULT_VERDICT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rule list: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _probe(host: Column, path: Column, n_blocks: int) -> tuple[Column, Column]:
    """Block number and bit mask of a key."""
    h = F.xxhash64(F.lit(0), host, path)
    g = F.xxhash64(F.lit(1), host, path)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return F.pmod(h, F.lit(n_blocks)).cast("int"), mask


def blocked_bloom(rules: DataFrame, n_rules: int) -> tuple[Column, int]:
    """The filter as an array constant, and its number of blocks (at most ``MAX_BLOCKS``)."""
    n_blocks = min(MAX_BLOCKS, max(8, -(-n_rules * BITS_PER_RULE // 64)))
    block, mask = _probe(F.col("host"), F.col("path"), n_blocks)
    blocks = dict(rules.select(block.alias("b"), mask.alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).collect())
    words = ",".join(str(blocks.get(i, 0)) for i in range(n_blocks))
    return F.split(F.lit(words), ",").cast("array<bigint>"), n_blocks


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT,
                 url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.  ``rules``: host, path, verdict."""
    rules = (rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string"))
             .dropna(subset=["host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    rules = materialize(rules, "url-rules")
    shape = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    n_rules, labels, lengths = shape[0], shape[1] or 0, sorted(shape[2] or [])
    parsed = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if not n_rules:
        return parsed.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    bloom, n_blocks = blocked_bloom(rules, n_rules)
    urls = parsed.filter("host <> ''").select("host", "path").distinct()
    part = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.size(part) - F.lit(labels) + 1, F.lit(1)), F.size(part)),
        lambda i: F.array_join(F.slice(part, i, F.size(part) - i + 1), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]),
                                    lambda n: F.when(F.length("path") >= n, F.substr("path", F.lit(1), n))),
                        lambda p: p.isNotNull())
    keys = (urls.select("host", "path", F.explode(suffixes).alias("k_host"), prefixes.alias("p"))
            .select("host", "path", "k_host", F.explode("p").alias("k_path")))
    block, mask = _probe(F.col("k_host"), F.col("k_path"), n_blocks)
    possible = keys.filter(F.get(bloom, block).bitwiseAND(mask) == mask)
    listed = rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), F.col("verdict"))
    hits = possible.join(listed, ["k_host", "k_path"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        F.length(F.concat("k_host", "k_path")).alias("n"), F.length("k_host").alias("h"),
        F.concat("k_host", "k_path").alias("rule"), F.col("verdict"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
