"""Lines repeated across the documents of one site (problem 1).

Method: hash the normalised lines, count the documents of each (site, hash) pair, keep the pairs above an
absolute and a relative threshold, join them back to the lines and rebuild the documents without them.

Plan. Only (site, hash, count) triples are shuffled for counting, after a map-side partial aggregate over the
distinct lines of each document, so a site holding a third of all rows costs one row per distinct line and task.
The frequent pairs are few: a site has at most (lines per document / share) of them. They are written to the
shared folder and counted; below ``broadcast_rows`` they are broadcast, above it the join is a salted shuffle join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.sources.tables import materialise

#: White space (also as Python understands it), decimal digits and format characters, left out of a line.
IGNORED = r"[\p{IsWhite_Space}\x1c-\x1f\p{Nd}\p{Cf}]+"
MIN_DOCUMENTS = 4
MIN_SHARE = 0.04
BROADCAST_ROWS = 300_000
SALTS = 32


def site_of(url: Column) -> Column:
    """Host of ``url`` in lower case without user, port and a leading ``www.`` or ``m.``; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^(?:www|m)\.", ""), F.lit(""))


def normalised_lines(text: Column) -> Column:
    """Array of the lines of ``text`` (split at LF) without ignored characters."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, IGNORED, ""))


def line_key(line: Column) -> Column:
    """96 bits of hash, null for an empty line."""
    return F.when(line != "", F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g")))


def with_site(documents: DataFrame, pages: DataFrame, key: str, page_key: str, url: str) -> DataFrame:
    """Add ``site``; a page key that occurs more than once takes the smallest of its sites."""
    sites = pages.select(F.col(page_key).alias("_page"), site_of(F.col(url)).alias("site")).where("_page is not null and site is not null").groupBy("_page").agg(F.min("site").alias("site"))
    return documents.join(sites, documents[key] == sites["_page"], "inner").drop("_page")


def repeated_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc, line_no)`` of every line that is frequent within its site.

    ``documents`` has ``doc, site, text``. Null texts count as documents of their site and have no lines; empty
    texts have one empty line, which is no case; repeated rows count each; an empty table gives an empty result.
    Other columns are ignored.
    """
    hashed = documents.where("site is not null").select("doc", "site", F.transform(normalised_lines(F.col("text")), line_key).alias("keys"))
    totals = documents.where("site is not null").groupBy("site").agg(F.count(F.lit(1)).alias("documents"))
    counts = hashed.select("site", F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").groupBy("site", "k.h", "k.g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    frequent = materialise(counts.join(totals, "site").where(F.col("n") >= F.lit(min_share) * F.col("documents")).select("site", "h", "g"), "site-lines")
    lines = hashed.select("doc", "site", F.posexplode("keys").alias("line_no", "k")).where("k is not null").select("doc", "site", "line_no", "k.h", "k.g")
    if frequent.count() <= broadcast_rows:
        return lines.join(F.broadcast(frequent), ["site", "h", "g"], "left_semi").select("doc", "line_no").distinct()
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return lines.join(frequent.withColumn("salt", salt), ["site", "h", "g", "salt"], "left_semi").select("doc", "line_no").distinct()


def without_lines(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """``(doc, text, removed)``: each document without its frequent lines; null stays null and untouched texts stay equal."""
    per_doc = cases.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    return documents.join(per_doc, "doc", "left").select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
