"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``SHARE`` of all
words; no source gets more than ``MAX_REPEATS`` times its own words, and what a stopped source leaves
is shared again by weight.  Sorted by size over weight the stopped sources are a prefix, so one running
sum over the per-source table (a row per source) solves it in integers.

Order: a source's documents are laid out by md5 of their id, once per pass over the source.  A
document takes the words that lie below the source's target; the one on the boundary is taken in
part, so a source's taken words equal its rounded target.  Running sums are two-level (range parts, then rows
inside a part): a hot source, and an id that many rows share, null included, are many tasks.  The table of sources
is one row a source, and its windows are one task: meant for up to some millions of sources.

Positions: source i's share of the training time t in [0, 1] follows the weight schedule
``1 + g (2t - 1)`` with slope ``g`` from ``SLOPES``.  Its integral ``t + g (t^2 - t)`` is the source's
cumulative demand; inverting it at a document's word offset gives the training position, by which the
plan is range-sorted.

Nulls and edge cases: a null text has size 0 and takes nothing; a null source is a source of its own,
last; a null doc_id sorts as the empty string.  Ties and repeated rows are laid out one after the
other.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.ordering import range_partitions
from colloquy.llm.common import fresh_name, materialize

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)             # 150 % as a fraction
MAX_REPEATS = 2
SLOPES = (0.5, 0.0, -0.5)
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target, goal, slope)`` from ``(source, source_size)``, one row a source."""
    num, den = SHARE
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(order) - 1)
    s = s.withColumns({"w": _cycle(WEIGHTS, F.col("i")), "slope": _cycle(SLOPES, F.col("i"))})
    fill = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("i"))
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left_w = F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    # everything times den, so that the shared amount is an integer
    spare = num * total - den * MAX_REPEATS * before
    s = s.withColumn("free", spare * F.col("w") <= den * MAX_REPEATS * F.col("source_size") * left_w)
    stopped = F.coalesce(F.sum(F.when(~F.col("free"), F.col("source_size"))).over(W.partitionBy()), F.lit(0))
    free_w = F.sum(F.when(F.col("free"), F.col("w"))).over(W.partitionBy())
    target = F.when(F.col("free"), ((num * total - den * MAX_REPEATS * stopped) * F.col("w")).cast("double")
                    / (den * free_w).cast("double")).otherwise((MAX_REPEATS * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", target.alias("target"),
                    F.round(target).cast("long").alias("goal"), "slope")


def _placed(docs: DataFrame, uid: str | None = None, parts: int | None = None) -> DataFrame:
    """Every document with its size, its source's size and goal, and ``off``, the words of its source laid out before it.

    Rows are range-partitioned by (source, md5, id, size, row): parts are even whatever the ids are, as rows that tie in all but
    the row number are alike and may change places.  Running sums are taken inside parts and over one row a part and source."""
    row = F.col(uid) if uid else F.monotonically_increasing_id()
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), 0)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", F.greatest(size, F.lit(0).cast("long")).alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("u"), row.alias("uid"))
    rows = range_partitions(materialize(rows, "mix-sizes"), ["source", "u", "doc_id", "size", "uid"], parts)
    sums = rows.groupBy("source", "_part").agg(F.sum("size").alias("bs"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bs").alias("source_size"))).withColumnRenamed("source", "_t")
    earlier = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("bs").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("_part", "source").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    d = rows.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(sums, d["source"].eqNullSafe(sums["_s"]) & (d["_part"] == sums["_p"]))
    return d.join(targets, d["source"].eqNullSafe(targets["_t"])).withColumn("off", F.col("base") + F.col("in_part"))


def _below(p: int) -> Column:
    """Words that pass ``p`` over the source takes of a document."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("goal") - p * F.col("source_size") - F.col("off"), F.col("size")))


def _position(p: int) -> Column:
    x = (p * F.col("source_size") + F.col("off")) / F.col("goal")
    g = F.col("slope")
    t = F.when(g == 0, x).otherwise((F.sqrt((1 - g) * (1 - g) + 4 * g * x) - (1 - g)) / (2 * g))
    return F.when(_below(p) > 0, t + F.lit(0.0))   # no negative zero


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position, position_2, range-sorted
    by position (documents that the mix leaves out come last)."""
    plan = _placed(docs).select("doc_id", "size", "source_size", "target", sum((_below(p) for p in range(1, MAX_REPEATS)), _below(0)).alias("taken"),
                                _position(0).alias("position"), _position(1).alias("position_2"))
    return plan.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), F.col("doc_id"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, all columns, once for each pass that takes words of them, range-sorted by
    training position.  Added (with underscores where a column has the name): ``position``, ``repeat`` (0 or 1) and ``taken``,
    the words this pass takes: all of the text but for the one document a source that its target cuts.  Rows that the
    mix leaves out, empty texts among them, have no row."""
    cols = docs.columns
    uid = fresh_name("_uid", cols)
    src = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-docs")
    passes = F.array(*[F.struct(_position(p).alias("position"), F.lit(p).alias("repeat"), _below(p).alias("taken")) for p in range(MAX_REPEATS)])
    plan = _placed(src, uid).select(F.col("uid").alias("_plan_uid"), F.explode(passes).alias("_pass")).filter(F.col("_pass.position").isNotNull())
    named, taken = [], list(cols)
    for c in ("position", "repeat", "taken"):
        taken.append(fresh_name(c, taken))
        named.append(taken[-1])
    plan = plan.select(F.col("_plan_uid").alias(fresh_name("_plan_uid", [*taken, uid])),
                       *[F.col(f"_pass.{c}").alias(n) for c, n in zip(("position", "repeat", "taken"), named, strict=True)])
    out = src.join(plan, src[uid] == plan[plan.columns[0]])
    order = [F.col(named[0]), F.col(uid), F.col(named[1])]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols, *named)


def training_order(plan: DataFrame) -> DataFrame:
    """Every repetition of every taken document as ``(position, doc_id, repeat)``, range-sorted."""
    each = plan.select("doc_id", F.posexplode(F.array("position", "position_2")).alias("repeat", "position"))
    each = each.filter("position is not null").select("position", "doc_id", "repeat")
    return each.repartitionByRange("position", "doc_id", "repeat").sortWithinPartitions("position", "doc_id", "repeat")


#: Over a table ``{src}(doc_id, text, source)``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS u FROM {src}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(i % 3)::INT + 1]::BIGINT AS w, [0.5, 0.0, -0.5][(i % 3)::INT + 1]::DOUBLE AS slope FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
g AS (SELECT *, (3 * total - 4 * before) * w <= 4 * source_size * left_w AS free FROM f),
h AS (SELECT *, coalesce(sum(source_size) FILTER (WHERE NOT free) OVER (), 0) AS stopped, sum(w) FILTER (WHERE free) OVER () AS free_w FROM g),
t AS (
  SELECT source, source_size, slope,
         CASE WHEN free THEN ((3 * total - 4 * stopped) * w)::DOUBLE / (2 * free_w)::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target FROM h),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(goal - off, size)) AS k0, greatest(0, least(goal - source_size - off, size)) AS k1 FROM o),
x AS (SELECT *, off::DOUBLE / goal::DOUBLE AS x0, (source_size + off)::DOUBLE / goal::DOUBLE AS x1 FROM k)
SELECT doc_id, size, source_size, target, (k0 + k1)::BIGINT AS taken,
       CASE WHEN k0 > 0 THEN CASE WHEN slope = 0 THEN x0 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x0) - (1 - slope)) / (2 * slope) END + 0.0 END AS position,
       CASE WHEN k1 > 0 THEN CASE WHEN slope = 0 THEN x1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x1) - (1 - slope)) / (2 * slope) END + 0.0 END AS position_2
FROM x
"""
