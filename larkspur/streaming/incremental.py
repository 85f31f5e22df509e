"""The build as a stream: new documents of the store become table rows as they come.

Each batch is keyed by its number, so a batch that runs again replaces its own rows. Documents stored twice are told
apart by (project, scan id). Late history doesn't disturb what is latest: the flag is made when the tables are read,
over scan keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.selection import effective_time, latest_flag, latest_per
from larkspur.plans.build import flatten
from larkspur.schemas import TABLE_DDL, scan_schema
from larkspur.sources.tables import Tables, exists, migrated


def document_stream(spark: SparkSession, store: str) -> DataFrame:
    """Valid documents in the scans folders of ``store``, as they are added."""
    raw = spark.readStream.schema(scan_schema()).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(store)
    return raw.withColumn("_path", F.col("_metadata.file_path")).filter(F.col("_path").rlike("/scans/[^/]+$") & (F.col("id").isNotNull() | F.col("scannedAt").isNotNull())).drop("_path")


def _scan_id() -> F.Column:
    return F.coalesce("id", "scannedAt")


def follow(spark: SparkSession, store: str, warehouse: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``once`` ends it when all that is there is built."""

    def put(batch: DataFrame, number: int) -> None:
        docs = batch.withColumn("_id", _scan_id())
        kept = latest_per(docs, ["projectSlug", "projectName", "_id"], [F.col("scannedAt").desc_nulls_last()]).drop("_id").persist()
        tables = flatten(kept)
        for name in TABLE_DDL:
            getattr(tables, name).drop("is_latest").write.mode("overwrite").parquet(f"{warehouse}/{name}/batch={number}")
        kept.unpersist()

    writer = document_stream(spark, store).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def followed_tables(spark: SparkSession, warehouse: str) -> Tables:
    """The tables of all batches. A scan that came again counts in its last batch; the latest flag is made here."""
    snapshots = spark.read.parquet(f"{warehouse}/project_snapshots")
    newest = latest_per(snapshots, ["project_id", "scanned_at"], [F.col("batch").desc()])
    flagged = latest_flag(newest, ["project_id"], [effective_time().desc_nulls_last(), F.col("scanned_at").desc_nulls_last()])
    marks = flagged.select("project_id", "scanned_at", "batch", "is_latest")

    def load(name: str) -> DataFrame:
        if not exists(spark, f"{warehouse}/{name}"):
            return spark.createDataFrame([], TABLE_DDL[name])
        return migrated(spark.read.parquet(f"{warehouse}/{name}").join(marks, ["project_id", "scanned_at", "batch"]), name)

    return Tables(**{n: load(n) for n in TABLE_DDL})


def checkpoint_windows(events: DataFrame, at: str, interval: str, late: str, by: list[str], measure: str) -> DataFrame:
    """Tumbling windows over a stream with ``late`` allowed: the last measure, and the number of rows, of each window."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, interval), *by)
    return windowed.agg(F.max_by(measure, at).alias("last"), F.count("*").alias("n"))
