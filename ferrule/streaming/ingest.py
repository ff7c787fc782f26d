"""Indexing as a stream: files that arrive in a folder, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def stream_files(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet rows from a folder, or from one file of it, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ingest_stream(rows: DataFrame, target: str, checkpoint: str, budget: int = 1024):
    """Starts the stream over (id, path, text) rows: bodies are normalised and hashed, and each
    micro-batch is written under its own number, so a batch that runs again after a failure
    replaces itself.  `availableNow` takes what is there, in bounded batches, and ends."""
    body = T.normalize_ws(F.col("text"), budget)
    made = rows.select("id", "path", body.alias("body")).withColumn("hash", T.content_hash(F.col("body"))).withColumn("snippet", T.snippet(F.col("body")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The newest row per path: later batches win."""
    rows = spark.read.parquet(target)
    return rows.groupBy("path").agg(F.max_by(F.struct("id", "body", "hash", "snippet"), "batch").alias("r")).select("r.id", "path", "r.body", "r.hash", "r.snippet")
