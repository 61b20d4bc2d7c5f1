import time

import pytest
from pyspark.sql import functions as F

from inkmill.operators import crawl as W
from inkmill.sources.store import Store
from inkmill.sources.textfiles import list_texts, read_texts
from inkmill.streaming.ingest import ingest, stream_texts


def test_text_files_of_both_encodings(spark, tmp_path):
    (tmp_path / "书-作者.txt").write_bytes("第一章\n你好".encode())
    (tmp_path / "b.txt").write_bytes("第一章\n你好".encode("gb18030"))
    (tmp_path / "c.md").write_bytes(b"no")
    rows = {r.title: (r.author, r.text) for r in read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"书-作者": ("作者", "第一章\n你好"), "b": ("Unknown", "第一章\n你好")}
    assert list_texts(spark, str(tmp_path)).count() == 2
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\xff")
    with pytest.raises(Exception, match="not a text file"):
        read_texts(spark, str(tmp_path)).collect()
    assert read_texts(spark, str(tmp_path), strict=False).where("text is null").count() == 1


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load().count() == 0
    f = spark.createDataFrame([("1", "a:b", "v1", "x"), ("2", "a:b", "v2", "y"), ("3", "书", "v1", "z")], "id string, novel string, version string, text string")
    store.save(f)
    store.save(f.where("id = '1'").replace("x", "new"))
    assert {r.text for r in store.load().collect()} == {"new", "y", "z"}
    assert {r.version for r in store.versions("a:b").collect()} == {"v1", "v2"}
    store.save(f, "vectors")
    store.remove_everywhere(novel="a:b", version="v1")
    assert {r.id for r in store.load().collect()} == {"2", "3"} == {r.id for r in store.load("vectors").collect()}
    store.remove(novel="书")
    assert {r.id for r in store.load().collect()} == {"2"}


def test_store_keeps_names_as_they_are(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save(spark.createDataFrame([("1", "007", "1.0"), ("2", "7", "1.0"), ("3", None, "2024-01-01"), ("4", "x=y/z", "")], "id string, novel string, version string"))
    assert {(r.id, r.novel, r.version) for r in store.load().collect()} == {("1", "007", "1.0"), ("2", "7", "1.0"), ("3", None, "2024-01-01"), ("4", "x=y/z", None)}
    assert [r.id for r in store.load(novel="007").collect()] == ["1"]
    store.remove(novel="007")
    assert {r.id for r in store.load().collect()} == {"2", "3", "4"}
    store.remove(novel=None)
    store.remove(novel="x=y/z", version=None)
    assert {r.id for r in store.load().collect()} == {"2"}


def test_streamed_texts_become_scenes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("第1章 a\n正文\n第2章 b\n正文二")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = ingest(stream_texts(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"))
        q.awaitTermination(60)
        time.sleep(0.1)
    rows = store.load().collect()
    assert sorted(r.chapter_index for r in rows) == [1, 2] and {r.novel for r in rows} == {"one"}


def test_routing_and_merging(spark):
    pages = spark.createDataFrame([(1, "https://b.test/x"), (2, "https://none/"), (3, None)], "crawl_id bigint, url string")
    rules = spark.createDataFrame([(2, "b.test"), (1, "test/x"), (3, None)], "rule_order int, domain string")
    assert {(r.crawl_id, r.rule_order) for r in W.routed(pages, rules).collect()} == {(1, 1), (2, None), (3, None)}
    assert W.routed(pages.unionAll(pages), rules).count() == 6
    assert W.routed(pages, rules.limit(0)).where("rule_order is null").count() == 3
    tries = spark.createDataFrame([("n:1", 1, "A", None, False, 1), ("n:1", 1, "A", "text", True, 2), ("n:1", 2, None, None, False, 3), (None, 1, "x", "y", True, 4)], "novel string, chapter_index int, title string, content string, success boolean, crawl_id bigint")
    row = W.merged_works(tries).collect()
    assert [tuple(r) for r in row] == [("n:1", "n_1.txt", "A\n\ntext\n\n\n\n[Download Failed]\n\n", 2, 1)]


def test_html(spark):
    html = '<div><a href="/1">One</a><a>no</a><a href="http://z/2">Two</a></div><section class="zw big">x<br>y<p>z</p></section><section class="zw">late</section>'
    pages = spark.createDataFrame([(1, "http://a/b", html), (2, None, None)], "page bigint, url string, html string")
    assert [tuple(r)[1:] for r in W.links(pages).orderBy("n").collect()] == [(1, "http://a/1", "One"), (2, "http://z/2", "Two")]
    got = {r.page: (r.content, r.found) for r in W.contents(pages, "section.zw").collect()}
    assert got == {1: ("x\ny\nz", True), 2: (None, False)}
    flaky = W.fetched(pages.select("page", "url"), lambda u: (_ for _ in ()).throw(OSError()) if u is None else f"<p>{u}", 1, 0.0)
    assert {(r.page, r.success) for r in flaky.collect()} == {(1, True), (2, False)}


def test_works_as_rows_are_the_works(spark):
    pages = spark.createDataFrame([(f"n{i % 2}", i // 2, f"t{i}", f"c{i}", i % 7 != 0, i) for i in range(400)] + [("n1", 3, "t", "old", True, -1), (None, 1, "x", "y", True, 999)], "novel string, chapter_index int, title string, content string, success boolean, crawl_id bigint")
    rows, text = W.merged_rows(pages), {}
    for r in rows.collect():
        text[r.novel] = text.get(r.novel, "") + r.text
    works = {r.novel: r for r in W.merged_works(pages).collect()}
    assert text == {k: r.text for k, r in works.items()} and set(text) == {"n0", "n1"}
    counts = {r.novel: (r.n, r.failed) for r in rows.groupBy("novel").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed")).collect()}
    assert counts == {k: (r.n_chapters, r.n_failed) for k, r in works.items()}
