"""Chapters from title lines, as gaps and islands over paragraphs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Title patterns of both profiles, longest title, title of what comes before the first one.
TITLE = r"^(?:\s*第[0-9零一二三四五六七八九十百千两]+[章回节卷].*|\s*Chapter\s*\d+.*)$"
INGEST_TITLE = r"^\s*第\s*[0-9零一二三四五六七八九十百千万]+ *[章回].*$"
LONGEST_TITLE = 50
PREFACE = "序章/前言"


def is_title(content: Column, profile: str = "split") -> Column:
    if profile == "ingest":
        return content.rlike(INGEST_TITLE)
    return (content != "") & (F.length(content) <= LONGEST_TITLE) & content.rlike(TITLE)


def with_chapter(paras: DataFrame, profile: str = "split") -> DataFrame:
    """Add ``chapter_index`` (from 1) to paragraphs; the ingest profile drops what comes before the first title."""
    w = Window.partitionBy("doc").orderBy("para_index")
    title = is_title(F.col("content"), profile)
    out = paras.withColumn("is_title", title).withColumn("island", F.sum(F.when(F.col("is_title"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if profile == "ingest":
        return out.where("island > 0").withColumn("chapter_index", F.col("island").cast("int")).drop("island")
    preface = F.min("island").over(Window.partitionBy("doc")) == 0
    return out.withColumn("chapter_index", (F.col("island") + preface.cast("int")).cast("int")).drop("island")


def chapters(paras: DataFrame, profile: str = "split") -> DataFrame:
    """``(doc, chapter_index, chapter_title, start_para, end_para)``; both ends belong to the chapter."""
    first = F.min(F.struct("para_index", "is_title", "content"))
    return (
        with_chapter(paras, profile)
        .groupBy("doc", "chapter_index")
        .agg(first.alias("first"), F.min("para_index").alias("start_para"), F.max("para_index").alias("end_para"))
        .select("doc", "chapter_index", F.when(F.col("first.is_title"), F.col("first.content")).otherwise(F.lit(PREFACE)).alias("chapter_title"), "start_para", "end_para")
    )
