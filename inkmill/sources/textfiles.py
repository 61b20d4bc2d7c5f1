"""Plain text files: UTF-8, else GB18030."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _gb18030(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else bytes(raw).decode("gb18030")
    except UnicodeDecodeError:
        return None


def read_texts(spark: SparkSession, path: str, strict: bool = True, pattern: str = "*.txt") -> DataFrame:
    """``(path, title, author, text)`` of the files of a folder.

    The title is the file name without ``.txt``, the author the second part of a name with a dash, else ``Unknown``.
    Bytes that are neither encoding raise, or give a null text if not ``strict``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    name = F.regexp_replace(F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1), r"\.txt", "")
    parts = F.split(name, "-")

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(_gb18030)

    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(other(F.when(~utf8, F.col("content"))))
    out = files.select("path", name.alias("title"), F.when(F.size(parts) > 1, F.trim(parts[1])).otherwise("Unknown").alias("author"), text.alias("text"))
    if strict:
        out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not a text file: "), F.col("path"))).cast("string")))
    return out


def list_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the text files of a folder; the content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length")
