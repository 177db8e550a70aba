"""Tables that cut lineage: Parquet in the folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process, which go when it ends in good order.
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on one machine without the setting, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cyclespan-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:
            return  # the session has ended before


atexit.register(_at_exit)


class Rounds:
    """The tables of one run. They outlive lost executors, and are dropped one by one as soon as no later plan reads them, the rest at the end."""

    def __init__(self, spark: SparkSession, name: str, compression: str | None = None):
        self.spark, self.root, self.n, self.compression = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0, compression
        _made.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        writer = df.write.option("compression", self.compression) if self.compression else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_path = path
        return out

    def keep_parted(self, df: DataFrame, by: str) -> DataFrame:
        """The same in folders by the values of a column, so that a filter on it reads no others."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.partitionBy(by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if path := getattr(df, "kept_path", None):
            delete(self.spark, path)
