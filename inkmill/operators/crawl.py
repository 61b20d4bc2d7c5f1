"""Crawled pages: routing to rules, links and content of HTML, one text per work."""

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def routed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with the first rule (by ``rule_order``) whose domain is part of the url; without one its columns are null.

    Each address is matched once, however many pages have it, and keeps its first rule in the map-side aggregate.
    """
    few = rules.where("domain is not null and domain <> ''").select("rule_order", "domain")
    urls = pages.select("url").where("url is not null").distinct()
    first = urls.join(few, F.contains("url", "domain")).groupBy("url").agg(F.min(F.struct("rule_order", "domain")).alias("_r"))
    return pages.join(first, "url", "left").select(*[pages[c] for c in pages.columns], F.col("_r.rule_order").alias("rule_order"), F.col("_r.domain").alias("domain"))


def safe_name(name: Column) -> Column:
    """A name in which characters that file systems refuse are ``_``."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def merged_rows(pages: DataFrame) -> DataFrame:
    """``(novel, chapter_index, text, failed)``: the last try of each chapter as title, blank line, content.

    ``pages`` has ``novel, chapter_index, title, content, success, crawl_id``; failed chapters read ``[Download Failed]``.
    The rows are cut into ranges and sorted by novel and chapter, so that the texts of a work one after the other are the
    work; no work is gathered in one task or value.
    """
    return _last_tries(pages).repartitionByRange("novel", "chapter_index").sortWithinPartitions("novel", "chapter_index")


def _last_tries(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("novel", "chapter_index").orderBy(F.desc(F.coalesce("success", F.lit(False))), F.desc("crawl_id"))
    last = pages.where("novel is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.when(F.coalesce("success", F.lit(False)), F.coalesce("content", F.lit(""))).otherwise("[Download Failed]"), F.lit("\n\n"))
    return last.select("novel", "chapter_index", body.alias("text"), (~F.coalesce("success", F.lit(False))).cast("int").alias("failed"))


def merged_works(pages: DataFrame) -> DataFrame:
    """``(novel, file_name, text, n_chapters, n_failed)``: the rows of ``merged_rows`` with each work as one text.

    A text is one value, so a work has to stay below 2 GB; larger ones are left to ``merged_rows``.
    """
    rows = _last_tries(pages).select("novel", F.struct("chapter_index", F.col("text").alias("body")).alias("x"), "failed")
    return rows.groupBy("novel").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["body"]), "").alias("text"), F.count(F.lit(1)).alias("n_chapters"), F.sum("failed").alias("n_failed")).select("novel", F.concat(safe_name(F.col("novel")), F.lit(".txt")).alias("file_name"), "text", "n_chapters", "n_failed")


class _Reader(HTMLParser):
    """Collects links and the text of the first element that matches ``tag``, ``#id``, ``.class`` or ``tag.class``."""

    def __init__(self, selector: str = ""):
        super().__init__(convert_charrefs=True)
        self.tag, self.kind, self.value = selector, "", ""
        for mark in "#.":
            if mark in selector:
                self.tag, _, self.value = selector.partition(mark)
                self.kind = mark
                break
        self.links: list[tuple[str, str]] = []
        self.href, self.depth, self.found, self.text, self.label = None, 0, False, [], []

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        if tag == "a" and have.get("href"):
            self.href, self.label = have["href"], []
        fits = (not self.tag or self.tag == tag) and (not self.kind or (have.get("id") == self.value if self.kind == "#" else self.value in (have.get("class") or "").split()))
        if self.depth:
            self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
            if tag in ("br", "p"):
                self.text.append("\n")
        elif fits and (self.tag or self.kind) and not self.found:
            self.depth, self.found = 1, True

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.links.append((self.href, "".join(self.label).strip()))
            self.href = None
        if self.depth and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1

    def handle_data(self, data):
        if self.href is not None:
            self.label.append(data)
        if self.depth:
            self.text.append(data)


def links(pages: DataFrame) -> DataFrame:
    """``(page, n, href, title)``: links of ``pages(page, url, html)`` with an address, made absolute, counted from 1."""

    @F.pandas_udf("array<struct<href:string,title:string>>")
    def read(html: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for h, u in zip(html, url):
            r = _Reader()
            r.feed(h or "")
            out.append([{"href": urljoin(u or "", a), "title": t} for a, t in r.links])
        return pd.Series(out)

    return pages.select("page", F.posexplode(read("html", "url")).alias("n", "x")).select("page", (F.col("n") + 1).alias("n"), "x.href", "x.title")


def contents(pages: DataFrame, selector: str) -> DataFrame:
    """``(page, content, found)``: trimmed text of the first element of ``pages(page, html)`` that matches the selector."""

    @F.pandas_udf("struct<content:string,found:boolean>")
    def read(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            r = _Reader(selector)
            r.feed(h or "")
            rows.append(("".join(r.text).strip() if r.found else None, r.found))
        return pd.DataFrame(rows, columns=["content", "found"])

    return pages.select("page", read("html").alias("x")).select("page", "x.content", "x.found")


def fetched(pages: DataFrame, fetch: Callable[[str], str], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """``(page, html, success)``: ``fetch(url)`` for each of ``pages(page, url)`` in parallel tasks, with growing waits between tries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for f in frames:
            rows = []
            for page, url in zip(f["page"], f["url"]):
                html = None
                for n in range(retries + 1):
                    try:
                        html = fetch(url)
                        break
                    except Exception:  # noqa: BLE001
                        if n < retries:
                            time.sleep(wait * (n + 1))
                rows.append((page, html, html is not None))
            yield pd.DataFrame(rows, columns=["page", "html", "success"])

    return pages.select("page", "url").mapInPandas(run, "page bigint, html string, success boolean")
