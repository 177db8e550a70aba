"""Readers and writers: JSON lines, CSV, JSON documents, YAML configurations. Paths are Spark's, so any store that it knows will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Rounds
from .schema import CYCLE_RECORD


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CYCLE_RECORD) -> DataFrame:
    """One row for each line that isn't blank. A line that holds no JSON object fails the read, and the error names the line."""
    whole = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = whole.where(F.trim("value") != "")
    is_object = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    bad = lines.where(~F.coalesce(is_object, F.lit(False))).orderBy("at").limit(1).collect()
    if bad:
        n = whole.where((F.col("file") == bad[0].file) & (F.col("at") <= bad[0].at)).count()
        raise ValueError(f"line {n} is not a JSON object")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite", keep_finished: bool = False) -> int:
    """Lines of JSON, nulls left out, written where the rows are; the number of rows. single_file: through one task, for small results.
    keep_finished: a task's file is in its place as soon as the task is done, so those that are done outlive a run that stops."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = (counted.coalesce(1) if single_file else counted).write.mode(mode)
    if keep_finished:
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.json(path)
    return int(seen.get["n"])


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines in the files that are in their place; 0 without a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.text(path).count() if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else 0


def with_defaults(df: DataFrame, prefix: str, ring_type: str, source_approach: str, order: list, pattern: str | None = None) -> DataFrame:
    """Candidates with ring_id (prefix and number in the given order), ring_type, source_approach and pattern where they have none."""
    from ..operators.rings import numbered

    out = numbered(df, order, prefix, "_id").drop("_number")
    values = {"ring_id": F.col("_id"), "ring_type": F.lit(ring_type), "source_approach": F.lit(source_approach)} | ({"pattern": F.lit(pattern)} if pattern else {})
    return out.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in values.items()}).drop("_id")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def as_document(row: Row | dict) -> str:
    return json.dumps(row.asDict(recursive=True) if isinstance(row, Row) else row, ensure_ascii=False, indent=2, default=str)


def write_document(spark: SparkSession, value: Row | dict, path: str) -> None:
    """One indented JSON document, such as a summary; a small thing of the driver's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(as_document(value), "utf-8"))
    finally:
        out.close()


def write_rings_document(rings: DataFrame, path: str) -> None:
    """{"rings": [...]}: the ground truth's form, a ring to a line. One file: rows are made by many tasks and kept, and one task sorts them between the first and the last line.
    The order of files and of a union's parts in a scan is Spark's own, so each line carries its place."""
    spark = rings.sparkSession
    rows = Rounds(spark, "document").keep(rings.select(F.to_json(F.struct(*rings.columns)).alias("value"), F.monotonically_increasing_id().alias("at")))
    first = rows.agg(F.min("at")).first()[0]
    middle = rows.select(F.when(F.col("at") == first, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"), "at")
    ends = spark.createDataFrame([('{"rings": [', -1), ("]}", (1 << 63) - 1)], "value string, at long")
    middle.union(ends).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def read_rings_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("rings").alias("r")).select("r.*")


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
