"""License scan with DataFrame expressions only: TF-IDF cosine to templates, then inheritance by path.

Templates are the statements below and the table ``license_texts.json``: whole licence texts, header blocks and
SPDX identifiers.  A file that holds a cue word (licence, copyright, ...; every template holds one) is compared in
three ways, always whole and always by the sum of a join of sparse TF-IDF vectors with the templates by term:

- the whole file with every template;
- windows of words around every cue, one per radius in ``RADII`` inside its line, with every template;
- windows that span lines: for each of the first ``ANCHORS`` cues of each template of at most ``SPAN`` terms, the stretch of the
  file that has the template's length and the same cue at the same place, with that template.

A pair counts when its cosine reaches ``THRESHOLD``.  The file is a licence *file* when its whole text reaches it, else
it has a *header*.  Whole texts go before windows, then the best cosine wins; ``proprietary`` (a copyright line) counts
only when nothing grants a licence.

A directory's licence is that of its best licence file.  Files without a licence of their own inherit
from the nearest ancestor directory that has one: the distinct directories are exploded into their
ancestors (as many rows as the path is deep), joined to the licensed directories by path, and the deepest
wins; files then join their directory.  Nothing is grouped by licence or by root directory, so a hot
directory is one row in every shuffle but the last join, which adaptive execution splits.

Nulls and edge cases: a null text has no statement; a null path has no directory and inherits nothing; a
null id stays.  Ties go to the smaller license id, then the smaller path.  Repeated rows stay repeated rows.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize

CUES = ("license", "licensed", "licence", "licenced", "copyright", "spdx", "copyleft", "lizenz", "licencia", "unlicense")
CUE_PATTERN = "(?i)licen[cs]|copyright|spdx|copyleft|lizenz"
RADII = (4, 8, 12)
THRESHOLD = 0.6
SPAN, ANCHORS = 400, 2
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: Statements by which texts name their license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("proprietary", "Copyright, all rights reserved."),
]

#: With licence texts, header blocks and SPDX identifiers.
TEMPLATES += [(name, text) for name, _, text in json.loads((Path(__file__).parent / "license_texts.json").read_text("utf-8"))]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def is_cue(term: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(c) for c in CUES]), term) | term.startswith("spdx")


def template_weights(templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tid, license, term, w)`` with unit-length vectors, ``(term, idf, n)`` with idf over the templates, and the
    places of cues in short templates, ``(tid, cue, before, size)``."""
    rows = (templates.dropna(subset=["license", "text"]).select("license", terms(F.col("text")).alias("ts")).distinct()
            .withColumn("tid", F.xxhash64("license", "ts")))
    tf = rows.select("tid", "license", F.explode("ts").alias("term")).groupBy("tid", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = tf.select(F.count_distinct("tid").alias("n")).first()["n"]
    idf = tf.groupBy("term").agg(F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))).alias("idf")).withColumn("idf", F.col("idf") + 1)
    w = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = w.groupBy("tid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    cues = F.slice(F.filter(F.transform("ts", lambda t, i: F.struct(t.alias("cue"), i.alias("before"))), lambda c: is_cue(c["cue"])), 1, ANCHORS)
    anchors = rows.filter(F.size("ts") <= SPAN).select("tid", F.size("ts").alias("size"), F.inline(cues)).select("tid", "cue", "before", "size")
    return (w.join(norm, "tid").select("tid", "license", "term", (F.col("x") / F.col("norm")).alias("w")),
            idf.withColumn("n", F.lit(n)), anchors)


def cue_lines(files: DataFrame) -> DataFrame:
    """``(uid, id, path, ts, lines)``: the terms of each text that holds a cue, and its lines that do (both null
    without one).  The only pass over the texts."""
    has = F.col("text").rlike(CUE_PATTERN)
    lines = F.when(has, F.filter(F.split("text", "\n"), lambda t: t.rlike(CUE_PATTERN)))
    return files.select(F.monotonically_increasing_id().alias("uid"), "id", "path",
                        F.when(has, terms(F.col("text"))).alias("ts"), lines.alias("lines"))


def statements(found: DataFrame) -> DataFrame:
    """``(uid, window)``: terms around every cue of every line."""
    lines = found.filter("lines is not null").select("uid", F.explode("lines").alias("t")).select("uid", terms(F.col("t")).alias("w"))
    at = lines.select("uid", "w", F.posexplode("w").alias("at", "x")).filter(is_cue(F.col("x"))).drop("x")
    at = at.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in RADII])))
    first = F.greatest(F.col("at") - F.col("radius"), F.lit(0))
    return at.select("uid", F.slice("w", first + 1, F.col("at") + F.col("radius") - first + 1).alias("window"))


def spans(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(uid, tid, window)``: stretches of a file's terms, over line ends, that lie around a cue like a template."""
    at = found.filter("ts is not null").select("uid", "ts", F.posexplode("ts").alias("at", "cue")).filter(is_cue(F.col("cue")))
    at = at.join(F.broadcast(anchors), "cue")                 # a few rows per template
    first = F.greatest(F.col("at") - F.col("before"), F.lit(0))
    return at.select("uid", "tid", F.slice("ts", first + 1, F.col("at") - F.col("before") + F.col("size") - first).alias("window"))


def own_licenses(found: DataFrame, templates: DataFrame) -> DataFrame:
    """``(uid, license, score, whole)`` of files with a comparison that reaches the threshold."""
    weights, idf, anchors = (materialize(x, f"license-{name}") for x, name in zip(template_weights(templates), ("weights", "idf", "anchors")))
    n = idf.agg(F.max("n")).first()[0] or 0
    none = F.lit(None).cast("bigint")
    whole = found.filter("ts is not null").select("uid", none.alias("tid"), "ts", F.lit(True).alias("whole"))
    win = whole.unionByName(statements(found).select("uid", none.alias("tid"), F.col("window").alias("ts"), F.lit(False).alias("whole")))
    win = win.unionByName(spans(found, anchors).select("uid", "tid", F.col("window").alias("ts"), F.lit(False).alias("whole")))
    # texts of windows repeat (the same statement in many files): score each distinct one once
    win = materialize(win.withColumn("key", F.md5(F.array_join("ts", " "))), "license-windows")
    distinct = win.groupBy("key").agg(F.first("ts").alias("ts"))
    tf = distinct.select("key", F.explode("ts").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialize(tf.join(idf.select("term", "idf"), "term", "left").select(
        "key", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0) + F.log(F.lit(1.0 + n)))).alias("x")), "license-tf")
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))

    def best(pairs: DataFrame, by: list[str]) -> DataFrame:
        dot = pairs.groupBy(*by, "license", *(["tid"] if "tid" not in by else [])).agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
        score = dot.join(norm, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= THRESHOLD)
        return score.groupBy(*by).agg(F.min(F.struct((F.col("license") == "proprietary").alias("bare"), (-F.col("score")).alias("neg"), "license")).alias("b"))

    free = best(tf.join(win.filter("tid is null").select("key").distinct(), "key").join(F.broadcast(weights), "term"), ["key"])
    tied = best(win.filter("tid is not null").select("key", "tid").distinct().join(tf, "key").join(F.broadcast(weights), ["tid", "term"]), ["key", "tid"])
    hits = (win.filter("tid is null").join(free, "key").select("uid", "whole", "b")
            .unionByName(win.filter("tid is not null").join(tied, ["key", "tid"]).select("uid", "whole", "b")))
    per = hits.groupBy("uid").agg(F.max("whole").alias("whole"), F.min(F.struct("b.bare", (~F.col("whole")).alias("part"), "b.neg", "b.license")).alias("b"))
    return per.select("uid", F.col("b.license").alias("license"), (-F.col("b.neg")).alias("score"), "whole")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def license_scan(files: DataFrame, templates: DataFrame) -> DataFrame:
    """``(id, path, license, score, basis, licensed_by)`` of every row of ``files(id, path, text)``.

    basis: ``file``, ``header``, ``inherited`` or ``none``; licensed_by: the path whose statement counts.
    """
    found = materialize(cue_lines(files.select("id", "path", "text")), "license-lines")
    own = own_licenses(found, templates)
    named = found.select("uid", "id", "path").join(own, "uid", "left").select(
        "id", "path", parent(F.col("path")).alias("dir"), "license", "score",
        F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").alias("basis"))
    named = materialize(named, "license-named")
    dirs = (named.filter("basis = 'file' and path is not null").groupBy("dir")
            .agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("license"), F.col("path"))).alias("b"))
            .select(F.col("dir").alias("anc"), "b"))
    parts = F.split("dir", "/")
    ancestors = (named.filter("license is null and dir is not null").select("dir").distinct()
                 .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
                 .select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("anc")))
    near = ancestors.join(dirs, "anc").groupBy("dir").agg(F.max(F.struct("depth", "b")).alias("x")).select(
        "dir", F.col("x.b.license").alias("i_license"), (-F.col("x.b.neg")).alias("i_score"), F.col("x.b.path").alias("i_path"))
    out = named.join(near, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select("id", "path", F.coalesce("license", "i_license").alias("license"),
                      F.when(mine, F.col("score")).otherwise(F.col("i_score")).alias("score"),
                      F.when(mine, F.col("basis")).when(F.col("i_license").isNotNull(), "inherited").otherwise("none").alias("basis"),
                      F.when(mine, F.col("path")).otherwise(F.col("i_path")).alias("licensed_by"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: ``/source/lang/<hundred>/<doc_id>.txt`` (null parts read ``none``)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    path = F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"),
                    F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none")), F.lit("/"), part("doc_id"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
