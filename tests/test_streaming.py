"""Windows over a stream against the same windows over a table."""

from pyspark.sql import functions as F

from larkspur.operators.trends import checkpoint_sample
from larkspur.streaming.incremental import checkpoint_windows


def test_windows_of_a_stream_are_the_batch_samples(spark, tmp_path):
    hour = 3_600_000
    rows = [(i, f"p{i % 3}", 1_700_000_000_000 + i * 1_234_567) for i in range(60)]
    df = spark.createDataFrame(rows, "sha long, project string, epoch_ms long").withColumn("at", F.timestamp_millis("epoch_ms"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    windows = checkpoint_windows(stream, "at", "1 hour", "1 day", ["project"], "sha")
    query = windows.writeStream.format("memory").queryName("sampled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.project, r["last"]) for r in spark.table("sampled").collect()}
    sampled = checkpoint_sample(df, "epoch_ms", hour, ("project",), "sha")
    assert got == {(r.project, r.sha) for r in sampled.collect()}
    assert spark.table("sampled").agg(F.sum("n")).first()[0] == len(rows)
