"""Written tables: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on one machine (tests), a temporary one may stand in."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="surmise-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Store:
    """Tables of one evaluation, each a folder of Parquet files that all executors can read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/eval-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        """(path, the table read back)."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return path, self.read([path], df)

    def read(self, paths: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)

    def clear(self) -> None:
        """Delete every table of the evaluation: for when its results have been read."""
        self.drop([self.root])

    def drop(self, paths: list[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
