import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import curriculum, licenses, url_filter, warc
from colloquy.llm.common import shared_path


def _duck(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(sql).fetchall()


def test_url_verdicts_equal_sql(spark):
    urls = ["http://a.b.Example.com/en/x?y", "https://www.example.com/en/", "https://x.www.example.com/en/1#t", "https://notexample.com/en/2", "ftp://net/es/x",
            "http://a.net/fr/", "http://a.net/frx", "no scheme", None, "", "://", "http://com", "http://com/", "http://" + "a." * 3000 + "com/" + "x" * 50_000,
            "http://a.net/fr/\n?x", "http://EXAMPLE.COM?en/", "http://a.com/en/"]
    pages = spark.createDataFrame([(i % 15, u) for i, u in enumerate(urls)] + [(3, urls[0])] * 2 + [(None, urls[1])], "page_id bigint, url string")
    rules = spark.createDataFrame([*url_filter.RULES, url_filter.RULES[0], (None, "/", "block"), ("x.com", None, "block")], "host string, path string, verdict string")
    got = url_filter.url_verdicts(pages.withColumns({"host": F.lit("clash"), "verdict": F.lit(1)}), rules).collect()
    want = _duck(url_filter.ORACLE, pages=pages.toPandas())
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, want)) == sorted(key((None if r.page_id is None else float(r.page_id), *r[1:])) for r in got) or sorted(
        (str(r[1:])) for r in want) == sorted(str(tuple(r[1:])) for r in got)
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


def test_a_rule_without_a_path_fits_a_url_without_one(spark):
    rules = spark.createDataFrame([("example.org", "", "block"), ("a.example.org", "/ok", "allow")], "host string, path string, verdict string")
    urls = ["http://x.example.org", "http://example.org?q=1", "http://a.example.org/ok", "http://a.example.org", "http://example.orga", "://", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()}
    rule = ("example.org", "block")
    assert got == {0: rule, 1: rule, 2: ("a.example.org/ok", "allow"), 3: rule, 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}


def test_bloom_has_no_false_negative(spark):
    rules = spark.createDataFrame([(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = rules.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://s."), "host", "path").alias("url"))
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules).collect()} == {"block"}


def test_mix_plan_properties(spark, odd_docs, no_docs):
    plan = curriculum.mix_plan(odd_docs.withColumn("goal", F.lit(1)))
    rows = plan.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.taken > 0) == (r.position is not None)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= 1
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert [tuple(r) for r in curriculum.mix_plan(odd_docs).collect()] == [tuple(r) for r in rows]
    order = [r.position for r in curriculum.training_order(plan).collect()]
    assert order == sorted(order) and curriculum.mix_plan(no_docs).count() == 0


def test_mix_plan_equals_sql(spark, odd_docs):
    docs = odd_docs.filter("doc_id is not null").select("doc_id", "text", "source").dropDuplicates()
    want = _duck(curriculum.ORACLE.format(src="documents"), documents=docs.toPandas().assign(source=lambda d: d.source.where(d.source.notna(), None)))
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4], None if r[5] is None else round(r[5], 9))
    assert sorted(map(key, want), key=str) == sorted((key(tuple(r)) for r in curriculum.mix_plan(docs).collect()), key=str)


def test_rows_without_ids_are_many_parts(spark):
    docs = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    placed = curriculum._placed(docs, parts=8)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 600
    assert sorted(r.off for r in placed.collect()) == [3 * i for i in range(2000)]
    assert sorted(r.taken for r in curriculum.mix_plan(docs).collect()) == [3] * 1000 + [6] * 1000


def test_mixed_documents_follow_the_plan(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({"position": F.lit("clash"), "uid": F.lit(7), "_uid": F.lit(8)})
    rows = curriculum.mix_documents(docs).collect()
    assert curriculum.mix_documents(docs).columns == [*docs.columns, "position_", "repeat", "taken"]
    assert [r.position_ for r in rows] == sorted(r.position_ for r in rows)
    key = lambda r, *more: (r.doc_id, r.text, r.lang, r.source, r.n_chars, *more)
    given = [key(r) for r in odd_docs.collect()]
    assert {key(r) for r in rows} <= set(given)                                       # whole rows, nothing else
    assert {(r.position, r.uid, r["_uid"]) for r in rows} == {("clash", 7, 8)}
    for k in set(given):                                                              # a repeated row counts for itself
        assert sum(key(r) == k and r["repeat"] == 0 for r in rows) <= given.count(k)
    plan = curriculum.mix_plan(odd_docs).collect()
    want = sorted((round(p, 9), i) for r in plan for i, p in enumerate((r.position, r.position_2)) if p is not None)
    assert sorted((round(r.position_, 9), r["repeat"]) for r in rows) == want
    assert sum(r.taken for r in rows) == sum(r.taken for r in plan)
    assert curriculum.mix_documents(no_docs).count() == 0


def test_waterfill_reshares_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10)], "source string, source_size bigint")
    t = {r.source: r.target for r in curriculum.source_targets(sizes).collect()}
    assert t == {"a": 20.0, "b": 1490.0, "c": 20.0}


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(1, "http://a/\r\nx", "same\r\n\r\nbody"), (2, None, "same\r\n\r\nbody"), (2, None, "same\r\n\r\nbody"), (3, "u", None), (4, "u", ""),
            (None, "u", "other ü"), (5, "u", "other ü"), (6, "u", "x" * 300_000), (7, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("uid", F.lit("c"))
    got = list(((r.page_id if r.page_id is not None else 99), r.record_type, r.refers_to, r.payload_bytes) for r in warc.warc_round_trip(pages, least).collect())
    empty = "revisit" if least == 0 else "response"
    assert sorted(got, key=str) == sorted([(1, "response", None, 12), (2, "revisit", 1, 12), (2, "revisit", 1, 12), (3, "response", None, 0),
                          (4, empty, 3 if least == 0 else None, 0), (5, "response", None, 8), (6, "response", None, 300_000),
                          (7, "response", None, 12), (99, "revisit", 5, 8)], key=str)
    assert {(r.page_id, r.payload_digest) for r in warc.warc_round_trip(pages, least).collect()} == {(i, warc.digest32((h or "").encode())) for i, _, h in rows}
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_ids_beyond_doubles(spark):
    big = (1 << 60) + 1
    pages = spark.createDataFrame([(big, "u", "a"), (None, "u", "a"), (big + 2, "u", "a"), (None, "u", "b")], "page_id bigint, url string, html string").coalesce(1)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()), key=str)
    assert got == sorted([(big, "response", None), (big + 2, "revisit", big), (None, "revisit", big), (None, "response", None)], key=str)


def test_warc_records_parse(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "<p>")], "page_id bigint, url string, html string"), path)
    import zlib
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).first().content
    fields, block = next(warc.parse_records(zlib.decompress(bytes(content), wbits=31)))
    assert fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a/" and block.endswith(b"\r\n\r\n<p>")
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc"))


def test_license_scan(spark, no_docs):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "/a/LICENSE", gpl), (2, "/a/b/c/x.txt", "plain words"), (3, "/a/b/y.txt", "many words " * 30 + "\nReleased under the MIT License."),
            (4, "/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "/z/x", "my driving license is lost"), (6, None, gpl),
            (7, "/a/b/c/n", None), (8, "nodir", ""), (8, "nodir", ""), (None, "/a/q", "x"), (9, "/a/long", "w " * 40_000 + gpl)]
    files = spark.createDataFrame(rows, "id bigint, path string, text string").withColumn("license", F.lit("clash"))
    templates = spark.createDataFrame([*licenses.TEMPLATES, (None, "x"), ("y", None)], "license string, text string")
    got = {(r.id, r.path): (r.license, r.basis, r.licensed_by) for r in licenses.license_scan(files, templates).collect()}
    assert got[(1, "/a/LICENSE")] == ("GPL-3.0", "file", "/a/LICENSE") and got[(2, "/a/b/c/x.txt")] == ("Apache-2.0", "inherited", "/a/b/LICENSE")
    assert got[(3, "/a/b/y.txt")][:2] == ("MIT", "header") and got[(5, "/z/x")][:2] == (None, "none") and got[(6, None)][:2] == ("GPL-3.0", "file")
    assert got[(7, "/a/b/c/n")][0] == "Apache-2.0" and got[(8, "nodir")][1] == "none" and got[(None, "/a/q")][0] == "GPL-3.0"
    assert licenses.license_scan(files, templates).count() == len(rows) and licenses.license_scan(files.limit(0), templates).count() == 0
    assert {r.basis for r in licenses.license_scan(files, templates.limit(0)).collect()} == {"none"}


def test_license_texts_headers_and_spdx(spark):
    texts = {(a, k): t for a, k, t in json.loads((Path(licenses.__file__).parent / "license_texts.json").read_text("utf-8"))}
    prose = "\n".join(f"def function{i}(argument{i}): return value{i}" for i in range(60))
    rows = [("spdx/mit.py", "# SPDX-License-Identifier: MIT\n" + prose, "MIT", "header"), ("spdx/apache.py", "// SPDX-License-Identifier: Apache-2.0\n" + prose, "Apache-2.0", "header"),
            ("spdx/gpl.py", "SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0", "file"),
            ("bsd/LICENSE", "Copyright (c) 2005, Jane Doe. All rights reserved.\n\n" + texts["BSD-3-Clause", "text"].split("\n\n", 1)[1], "BSD-3-Clause", "file"),
            ("gpl/COPYING", texts["GPL-3.0", "text"], "GPL-3.0", "file"), ("gpl2/COPYING", texts["GPL-2.0", "text"], "GPL-2.0", "file"),
            ("mit/LICENSE", texts["MIT", "text"].replace("<year> <holder>", "2011 Jane Doe"), "MIT", "file"),
            ("head/a.py", "\n".join("# " + w for w in texts["Apache-2.0", "header"].split(". ")) + "\n" + prose, "Apache-2.0", "header"),
            ("head/m.py", prose + "\n" + "\n".join("# " + w for w in texts["MIT", "text"].split("\n")) + "\n" + prose, "MIT", "header"),
            ("head/l.py", "# Copyright 2020 X. All rights reserved.\n# Released under the\n# MIT License.\n" + prose, "MIT", "header")]
    files = spark.createDataFrame([(i, "/" + p, t) for i, (p, t, *_) in enumerate(rows)], "id bigint, path string, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    got = {r.id: (r.license, r.basis) for r in licenses.license_scan(files, templates).collect()}
    assert got == {i: (a, b) for i, (_, _, a, b) in enumerate(rows)}
    assert all(re.search(licenses.CUE_PATTERN, t) for _, t in licenses.TEMPLATES)


def test_pipeline_on_odd_tables(spark, odd_docs, no_docs, word, tmp_path_factory):
    for docs, name in ((odd_docs, "odd"), (no_docs, "none")):
        d = shared_path(spark, f"pipe-{name}").removeprefix("file:")
        item = " ".join(docs.filter("doc_id = 5").first().text.split()[:40]) if docs is odd_docs else "some benchmark item with several words in it"
        docs.withColumns({"_uid": F.lit(1), "_row": F.lit("r")}).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, 0, 0), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        if docs is no_docs:
            assert out == []
        else:
            ids = [r.doc_id for r in out]
            assert 5 not in ids and 102 not in ids and {6, 7, 100, 101} <= set(ids)
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == texts[r.doc_id] for r in out if r.doc_id in (6, 7))     # clean texts come through whole
            assert all(r._uid == 1 and r._row == "r" for r in out)
            positions = [r.position for r in out]
            assert positions == sorted(positions) and max(r["repeat"] for r in out) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontaminate", "mixing"]
