import random

import pytest

from inkmill.llm import site_lines as L
from pyspark.sql import functions as F


@pytest.mark.parametrize("url, site", [("https://WWW.Shop.Example:8443/a", "shop.example"), ("http://m.a.test/x", "a.test"), ("http://user:pw@a.test?q", "a.test"), ("//b.test#x", "b.test"), ("www3.a.test", None), ("https://www3.a.test/", "www3.a.test"), ("", None), (None, None)])
def test_site_of(spark, url, site):
    assert spark.createDataFrame([(url,)], "u string").select(L.site_of(F.col("u"))).first()[0] == site


def brute(rows):
    import re
    import unicodedata

    norm = lambda x: "".join(c for c in x if not c.isspace() and unicodedata.category(c) not in ("Nd", "Cf"))
    total, seen, out = {}, {}, set()
    for doc, site, text in rows:
        if site is None:
            continue
        total[site] = total.get(site, 0) + 1
        for n in {norm(x) for x in (text or "").split("\n")} if text is not None else ():
            seen[site, n] = seen.get((site, n), 0) + 1
    for doc, site, text in rows:
        for i, x in enumerate(text.split("\n") if site is not None and text is not None else ()):
            n = norm(x)
            if n and seen[site, n] >= 4 and seen[site, n] >= 0.04 * total[site]:
                out.add((doc, i))
    return out


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_against_brute_force(spark, broadcast_rows):
    rng = random.Random(1)
    lines = [f"line {c}" for c in "abcdefgh"] + ["", " 12", "Page 3​ of 4", "Page 7 of 19", "ａ\r"]
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, "", "\n".join(rng.choice(lines) if rng.random() < 0.4 else f"own {rng.random()}" for _ in range(5))])) for i in range(300)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc bigint, site string, text string, h int")
    got = {tuple(r) for r in L.repeated_lines(frame, broadcast_rows=broadcast_rows).collect()}
    assert got == brute(rows) and got
    clean = {r.doc: (r.text, r.removed) for r in L.without_lines(frame.select("doc", "text"), L.repeated_lines(frame)).collect()}
    for doc, _, text in rows:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in got)
        assert clean[doc] == (kept, sum(d == doc for d, _ in got))


def test_empty_table(spark):
    assert L.repeated_lines(spark.createDataFrame([], "doc bigint, site string, text string")).collect() == []
