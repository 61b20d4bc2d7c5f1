"""Texts that arrive as files, cut into scenes as they come."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmill.operators.scenes import scenes
from inkmill.sources.store import Store


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``(title, text)`` of the Parquet or text files that arrive in a folder, one text a file."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("title"), F.col("value").alias("text"))


def ingest(texts: DataFrame, store: Store, checkpoint: str, version: str = "v1-ingestion", profile: str = "ingest") -> StreamingQuery:
    """Cut every batch into scenes and save them under the title; a batch that runs again replaces its own partitions."""

    def save(batch: DataFrame, _: int) -> None:
        cut = scenes(batch.select(F.col("title").alias("doc"), "text"), profile, version).withColumnRenamed("doc", "novel")
        store.save(cut, "scenes")

    return texts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
