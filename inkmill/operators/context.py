"""Context assembly: rescore, deduplicate, merge neighbours, keep within a token budget, rank.

All frames are keyed by ``query``; a query has at most its k hits, so lists gathered per query are bounded by k.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import text as T

SEPARATOR = "\n\n---\n\n"


def rescored(hits: DataFrame, enabled: bool = True) -> DataFrame:
    """Replace ``score`` by 0.6 vector + 0.2 keywords + 0.2 characters - 0.0001 a character over 2000, at least 0.

    ``hits`` has ``question, text, characters, score``; null scores and texts count as 0 and empty.
    """
    base = F.coalesce("score", F.lit(0.0))
    if not enabled:
        return hits.withColumn("score", base)
    text = F.coalesce("text", F.lit(""))
    words = F.col("_words")  # made once a hit
    found = F.least(F.lit(0.1) * F.size(F.filter(words, lambda k: F.contains(text, k))), F.lit(1.0))
    names = F.coalesce("characters", F.array().cast("array<string>"))
    near = F.aggregate(names, F.lit(0), lambda s, c: s + F.size(F.filter(words, lambda k: F.contains(c, k) | F.contains(k, c))))
    score = F.lit(0.6) * base + F.lit(0.2) * found + F.lit(0.2) * F.least(F.lit(0.1) * near, F.lit(1.0)) - F.lit(0.0001) * F.greatest(F.length(text) - 2000, F.lit(0))
    return hits.withColumn("_words", T.keywords(F.col("question"))).withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 9)).drop("_words")


def sized(hits: DataFrame) -> DataFrame:
    """Scored hits with the ``size`` of their texts in place of these, for results without texts."""
    return hits.withColumn("size", F.length(F.coalesce("text", F.lit("")))).drop("text")


def deduplicated(hits: DataFrame) -> DataFrame:
    """The best-scored hit of each id (without one: of each place) per query; of equal scores the first in the text."""
    key = F.coalesce("id", F.concat_ws("_", "chapter_index", "start_paragraph"))
    w = Window.partitionBy("query", key).orderBy(F.desc("score"), "chapter_index", "start_paragraph", "id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_numbers(works: list[str], chapters: list[int], starts: list[int], ends: list[int], sizes: list[int], longest: int) -> list[int]:
    """Group of each scene in order: it joins the one before if that is near and the joined text is short enough."""
    out, group, size, end = [], -1, 0, 0
    for i, (work, chapter, start, last, n) in enumerate(zip(works, chapters, starts, ends, sizes)):
        near = group >= 0 and work == works[i - 1] and chapter == chapters[i - 1] and -5 <= start - end <= 2
        joined = size + len(SEPARATOR) + n
        if near and -(-3 * joined // 2) <= longest:
            size = joined
        else:
            group, size = group + 1, n
        end = last
        out.append(group)
    return out


def budget_picks(tokens: list[int], most_tokens: int, most: int) -> list[bool]:
    """Take in order while there is room; what does not fit is left out and smaller ones behind it may still fit."""
    used, taken, out = 0, 0, []
    for n in tokens:
        fits = taken < most and used + n <= most_tokens
        used, taken = used + n * fits, taken + fits
        out.append(bool(fits))
    return out


def merged(hits: DataFrame, longest: int = 900, enabled: bool = True) -> DataFrame:
    """Neighbours of one work and chapter as one row: first id, texts joined, best score, ``merged_ids``.

    Hits are put in order by work first, so scenes of other works in between do not part neighbours. ``sized`` hits give
    the ``size`` of the joined text in place of it; where hits have ``scene_row``, ``members`` has those of a row in order.
    """
    rows = [c for c in ("scene_row",) if c in hits.columns]
    body = "size" if "text" not in hits.columns else "text"
    item = F.struct(F.concat_ws("|", "novel", "version").alias("work"), "chapter_index", "start_paragraph", "id", "end_paragraph", body, "word_count", "score", "chapter_title", "novel", "version", *rows)
    n = lambda x: x["size"] if body == "size" else F.length(F.coalesce(x["text"], F.lit("")))

    @F.pandas_udf("array<int>")
    def fold(work: pd.Series, chapter: pd.Series, start: pd.Series, end: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([merge_numbers(list(a), list(b), list(c), list(d), list(e), longest) for a, b, c, d, e in zip(work, chapter, start, end, size)])

    lists = hits.groupBy("query").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(item)).alias("x"))
    numbers = fold(F.col("x.work"), F.col("x.chapter_index"), F.col("x.start_paragraph"), F.col("x.end_paragraph"), F.transform("x", n))
    group = numbers if enabled else F.sequence(F.lit(0), F.size("x") - 1)
    flat = lists.withColumn("g", group).select("query", "question", F.explode(F.arrays_zip("x", "g")).alias("z")).select("query", "question", "z.x.*", F.col("z.g").alias("g"))
    inner = F.sort_array(F.collect_list(F.struct("start_paragraph", "id", "end_paragraph", body, *rows)))
    out = flat.groupBy("query", "g").agg(F.first("question").alias("question"), inner.alias("m"), F.min("chapter_index").alias("chapter_index"), F.min("chapter_title").alias("chapter_title"), F.sum("word_count").alias("word_count"), F.max("score").alias("score"), F.min("novel").alias("novel"), F.min("version").alias("version"))
    joined = F.array_join(F.transform("m", lambda x: F.coalesce(x["text"], F.lit(""))), SEPARATOR) if body == "text" else F.aggregate("m", F.lit(-len(SEPARATOR)), lambda t, x: t + F.lit(len(SEPARATOR)) + x["size"])
    return out.select(
        "query", "question", F.col("m")[0]["id"].alias("id"), "novel", "version", "chapter_index", "chapter_title", F.col("m")[0]["start_paragraph"].alias("start_paragraph"), F.element_at("m", -1)["end_paragraph"].alias("end_paragraph"),
        joined.alias(body), "word_count", "score", F.when(F.size("m") > 1, "merged_scene").otherwise("scene").alias("chunk_type"), F.transform("m", lambda x: x["id"]).alias("merged_ids"), *[F.transform("m", lambda x: x[c]).alias("members") for c in rows],
    )


def within_budget(hits: DataFrame, most_tokens: int = 3000, most: int = 5) -> DataFrame:
    """Hits that fit, best first, with ``tokens`` and ``rank`` (1 is the best)."""

    @F.pandas_udf("array<boolean>")
    def fold(tokens: pd.Series) -> pd.Series:
        return pd.Series([budget_picks(list(t), most_tokens, most) for t in tokens])

    counted = hits.withColumn("tokens", T.token_count(F.col("text")) if "text" in hits.columns else T.tokens_of(F.col("size")))
    query = Window.partitionBy("query")
    ordered = counted.withColumn("place", F.row_number().over(query.orderBy(F.desc("score"), "id", "chapter_index", "start_paragraph")))
    # Every row gets the tokens of its query, so the hits are read once.
    tokens = F.transform(F.sort_array(F.collect_list(F.struct("place", "tokens")).over(query)), lambda x: x["tokens"])
    kept = ordered.withColumn("all", tokens).withColumn("take", fold("all")[F.col("place") - 1]).where("take").drop("all", "take")
    return kept.withColumn("rank", F.row_number().over(query.orderBy("place"))).drop("place")


def assembled(hits: DataFrame, longest: int = 900, most_tokens: int = 3000, most: int = 5, rescore: bool = True, merge: bool = True) -> DataFrame:
    """All stages; one row per context block."""
    return within_budget(merged(deduplicated(rescored(hits, rescore)), longest, merge), most_tokens, most)


def with_texts(blocks: DataFrame, scenes: DataFrame) -> DataFrame:
    """``sized`` blocks with the ``text`` of their ``members``, looked up in ``scenes(scene_row, text)``; blocks are read twice."""
    parts = blocks.select("query", "rank", F.posexplode("members").alias("nth", "scene_row")).join(scenes.select("scene_row", "text"), "scene_row")
    each = F.sort_array(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("text"))))
    texts = parts.groupBy("query", "rank").agg(F.array_join(F.transform(each, lambda x: x["text"]), SEPARATOR).alias("text"))
    return blocks.drop("members").join(texts, ["query", "rank"])


def full_text(blocks: DataFrame) -> DataFrame:
    """``(query, context, total_tokens, n_blocks)``: blocks in document order as ``[id] content`` lines."""
    item = F.struct("chapter_index", "start_paragraph", "id", "text")
    return blocks.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["text"], F.lit("\n"))), "").alias("context"), F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_blocks"))


def stage_counts(hits: DataFrame, joined: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query, original, deduplicated, merged, final, total_tokens, dropped)``: rows after each stage, and those left out by the budget."""
    a = hits.groupBy("query").agg(F.count(F.lit(1)).alias("original"), F.countDistinct(F.coalesce("id", F.concat_ws("_", "chapter_index", "start_paragraph"))).alias("deduplicated"))
    m = joined.groupBy("query").agg(F.count(F.lit(1)).alias("merged"))
    b = blocks.groupBy("query").agg(F.count(F.lit(1)).alias("final"), F.sum("tokens").alias("total_tokens"))
    full = a.join(m, "query", "left").join(b, "query", "left").na.fill(0, ["merged", "final", "total_tokens"])
    return full.select("query", "original", "deduplicated", "merged", "final", "total_tokens", (F.col("merged") - F.col("final")).alias("dropped"))
