"""Texts to paragraphs, one a line, with types."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import text as T

# Patterns of markdown lines and of quoted speech.
FENCE = r"^\s*```"
HEADER = r"^#{1,6}\s+"
LIST_ITEM = r"^(\s*[-*+]|\s*\d+\.)\s+"
QUOTE = r"^>\s+"
SPEECH = r'["“].*["”]'


def paragraphs(documents: DataFrame, profile: str = "split") -> DataFrame:
    """``(doc, para_index, content, is_empty)``: one row a line of ``documents(doc, text)``, counted from 0.

    Profile ``split`` strips white space of any script, ``ingest`` only characters up to U+0020. Null and empty texts
    have no paragraphs; other columns are ignored; repeated documents repeat their paragraphs.
    """
    clean = T.strip if profile == "split" else T.trim_ascii
    return documents.select("doc", F.posexplode(T.lines(F.col("text"))).alias("para_index", "line")).select("doc", "para_index", clean(F.col("line")).alias("content")).withColumn("is_empty", F.col("content") == "")


def typed(paras: DataFrame) -> DataFrame:
    """Add ``para_type`` and ``is_anchor`` by markdown rules: code between fences and headers are anchors."""
    before = Window.partitionBy("doc").orderBy("para_index").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("content").rlike(FENCE)
    inside = F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(before), F.lit(0)) % 2 == 1
    c = F.col("content")
    kind = F.when(fence | inside, "CODE_BLOCK").when(c.rlike(HEADER), "HEADER").when(c.rlike(LIST_ITEM), "LIST_ITEM").when(c.rlike(QUOTE), "QUOTE").otherwise("TEXT")
    return paras.withColumn("para_type", kind).withColumn("is_anchor", F.col("para_type").isin("CODE_BLOCK", "HEADER"))


def untyped(paras: DataFrame) -> DataFrame:
    """Add the types of the ingest profile: always text, never an anchor."""
    return paras.withColumn("para_type", F.lit("TEXT")).withColumn("is_anchor", F.lit(False))


def with_kind(paras: DataFrame) -> DataFrame:
    """Add ``kind``: the type of an anchor, else DIALOGUE if something is quoted, else NARRATION."""
    return paras.withColumn("kind", F.when(F.col("is_anchor"), F.col("para_type")).when(F.col("content").rlike(SPEECH), "DIALOGUE").otherwise("NARRATION"))
