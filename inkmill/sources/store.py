"""Scenes and vectors as Parquet tables, partitioned by work and version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.operators.vectors import delete


class Store:
    """A folder with the tables ``scenes`` and ``vectors``, both with columns ``novel`` and ``version``.

    Works and versions are strings and come back as they were saved (``007`` stays ``007``); empty ones come back as null.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def save(self, frame: DataFrame, table: str = "scenes") -> None:
        """Write; works and versions that ``frame`` has are replaced, others stay."""
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel", "version").parquet(self._path(table))

    def load(self, table: str = "scenes", schema: T.StructType | None = None, **equal: str) -> DataFrame:
        """Rows of a work, of a version of it, or all; an empty frame where nothing was saved."""
        if not self._exists(table):
            return self.spark.createDataFrame([], schema or T.StructType([T.StructField("id", T.StringType()), T.StructField("novel", T.StringType()), T.StructField("version", T.StringType())]))
        found = self.spark.read.parquet(self._path(table)).schema
        # Works and versions are strings whatever they look like: the types of folders are not inferred.
        texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("novel", "version") else f for f in found])
        frame = self.spark.read.schema(texts).parquet(self._path(table))
        for k, v in equal.items():
            frame = frame.where(F.col(k).eqNullSafe(F.lit(v)))
        return frame

    def versions(self, novel: str, table: str = "scenes") -> DataFrame:
        return self.load(table, novel=novel).select("version").distinct()

    def remove(self, table: str = "scenes", **equal: str) -> None:
        """Drop the partitions of a work or a version by removing their folders."""
        if not equal or not self._exists(table):
            return
        delete(self.load(table).limit(0), **equal)  # checks the keys
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for r in self.load(table, **equal).select("novel", "version").distinct().collect():
            path = fs_path(f"{self._path(table)}/novel={_escaped(r.novel)}/version={_escaped(r.version)}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.catalog.refreshByPath(self._path(table))

    def remove_everywhere(self, **equal: str) -> None:
        """Remove scenes and the vectors that belong to them."""
        for table in ("scenes", "vectors"):
            self.remove(table, **equal)


def _escaped(value: str | None) -> str:
    """A value as Spark writes it in the name of a partition's folder; null and empty share one."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\\x7f{[]^' or ord(c) < 32 else c for c in value)
