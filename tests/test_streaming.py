"""The stream view of pair aggregation gives the batch's edges for each window."""

from pyspark.sql import functions as F

from cyclespan.operators.edges import edges
from cyclespan.streaming import windowed_edges


def test_windowed_edges(spark, tmp_path):
    rows = [("t1", "A", "B", 1.0, "2025-01-01 10:00:00"), ("t2", "A", "B", 2.0, "2025-01-01 23:00:00"), ("t3", "A", "B", 4.0, "2025-01-02 01:00:00"), ("t4", "A", "A", 9.0, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "transaction_id string, src string, dst string, x double, t string")
    df = df.select("transaction_id", "src", "dst", F.col("x").cast("decimal(18,2)").alias("amount"), F.col("t").cast("timestamp_ntz").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_edges(stream).writeStream.outputMode("complete").format("memory").queryName("edges_by_day").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.src, r.dst, r.transaction_count, float(r.total_amount)) for r in spark.table("edges_by_day").collect())
    finally:
        q.stop()
    assert got == [("A", "B", 1, 4.0), ("A", "B", 2, 3.0)]
    assert edges(df).first().transaction_count == 3
