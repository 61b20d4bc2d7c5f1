"""Queries of the numbered problems: each takes (session, folder) and reads whole tables."""

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import bpe, canonical, leaks, mojibake, neighbours, pii, sentences, site_lines
from inkmill.sources.tables import table


def _scenes_with_site(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "scenes").select(F.col("scene_row").alias("doc"), "crawl_id", "text").where("crawl_id is not null")
    return site_lines.with_site(scenes, table(spark, d, "crawl_chapters"), "crawl_id", "crawl_id", "url")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_scenes_with_site(spark, d)).select(F.col("doc").alias("scene_row"), "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    cases = site_lines.repeated_lines(_scenes_with_site(spark, d))
    scenes = table(spark, d, "scenes").select(F.col("scene_row").alias("doc"), "text")
    return site_lines.without_lines(scenes, cases).select(F.col("doc").alias("scene_row"), "text", "removed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "sentence_sample").select(F.col("scene_row").alias("doc")).distinct()
    scenes = table(spark, d, "scenes").select(F.col("scene_row").alias("doc"), "text").join(sample, "doc")
    return sentences.split_sentences(scenes).select(F.col("doc").alias("scene_row"), "start_pos", "end_pos")


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "scenes").select(F.col("scene_row").alias("doc"), "text")).withColumnRenamed("doc", "scene_row")


def _looks(spark: SparkSession, d: str) -> DataFrame:
    """Chapter titles and scene texts with the place within which versions compare."""
    chapters = table(spark, d, "chapters").select(F.lit("chapters").alias("tab"), F.col("chapter_row").alias("row"), F.when(F.col("novel").isNotNull() & F.col("chapter_index").isNotNull(), F.struct("novel", "chapter_index", F.lit(-1).alias("p"))).alias("place"), F.col("title").alias("field"))
    scenes = table(spark, d, "scenes").select(F.lit("scenes").alias("tab"), F.col("scene_row").alias("row"), F.when(F.col("novel").isNotNull() & F.col("chapter_index").isNotNull() & F.col("start_paragraph").isNotNull(), F.struct("novel", "chapter_index", F.col("start_paragraph").alias("p"))).alias("place"), F.col("text").alias("field"))
    return chapters.unionByName(scenes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.alike_pairs(_looks(spark, d).withColumn("place", F.when(F.col("place").isNotNull(), F.xxhash64("place.novel", "place.chapter_index", "place.p"))))


def p3_form(spark: SparkSession, d: str) -> DataFrame:
    return canonical.with_form(_looks(spark, d).select("tab", "row", "field"), "field")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "vector_store").select(F.col("vec_row").alias("row"), F.col("chunk_id").alias("chunk"), "embedding", F.col("stored_at").alias("at"))
    return neighbours.neighbour_pairs(store)


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """Scene texts and crawled titles; versions of one text share a place."""
    # Rows that lack a part of the place have none.
    place = lambda *c: F.when(F.concat(*[F.col(x).cast("string") for x in c]).isNotNull(), F.xxhash64(*c)).alias("place")
    scenes = table(spark, d, "scenes").select(F.lit("scenes").alias("tab"), F.col("scene_row").alias("row"), place("novel", "chapter_index", "start_paragraph"), "text")
    return scenes.unionByName(table(spark, d, "crawl_chapters").select(F.lit("crawl_chapters").alias("tab"), F.col("crawl_id").alias("row"), place("novel", "chapter_index"), F.col("title").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_decoded(spark, d)).select("tab", F.col("row").alias("row_id"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_decoded(spark, d)).select("tab", F.col("row").alias("row_id"), "text", "spans", "whole")


def vocabulary_path() -> str:
    """Rank file of byte_bpe_50k: the folder is ``INKMILL_TOKENIZERS``, else that of the installed vocabulary package."""
    folder = os.environ.get("INKMILL_TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.with_ids(table(spark, d, "documents").select("doc_id", "text"), vocabulary_path())


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids."""
    return bpe.with_text(p6_ids(spark, d), vocabulary_path())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text", "lang")
    return leaks.leaks(documents, items).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(_documents(spark, d)).select(F.col("doc").alias("doc_id"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), "kind")


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(_documents(spark, d)).select(F.col("doc").alias("doc_id"), "text", "values")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_sentences": p2_sentences, "p3_found": p3_found, "p3_form": p3_form, "p4_found": p4_found, "p5_found": p5_found, "p5_restored": p5_restored, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p8_found": p8_found, "p8_masked": p8_masked}
