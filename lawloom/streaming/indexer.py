"""Indexing as a stream: new chunks arrive, what is not completed yet is handled, each micro-batch is a commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_hash
from ..runtime import is_folder, list_paths, scratch


def index_stream(spark: SparkSession, source: str, log_path: str, state_path: str, handle: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> None:
    """Run all files that are there through `handle` (chunks to rows with `status`) and append the outcome to the log.

    A text completed in an earlier batch is not handled again; a batch that is repeated after a failure overwrites
    its own part of the log, so the log holds each batch once.
    """
    schema = spark.read.parquet(source).schema

    def commit(batch: DataFrame, number: int) -> None:
        done = [p for p in list_paths(spark, f"{log_path}/batch=*") if not p.endswith(f"batch={number}")]
        new = batch.withColumn("doc_hash", doc_hash("text"))
        if done:
            new = new.join(spark.read.parquet(*done).where("status = 'completed'").select("doc_hash").distinct(), "doc_hash", "left_anti")
        handle(new).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    folder, name = (source, "*.parquet") if is_folder(spark, source) else source.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a stream over all chunks: texts without characters fail, others complete; counts by status."""
    base = scratch(spark, "stream")
    outcome = lambda df: df.select("chunk_key", "doc_hash", F.when(F.length(F.trim("text")) > 0, "completed").otherwise("failed").alias("status"))
    index_stream(spark, f"{sf_dir}/chunks.parquet", f"{base}/log", f"{base}/state", outcome)
    # a text in several batches is handled in the first only: what is counted are the chunks of its texts
    log = spark.read.parquet(f"{base}/log").select("doc_hash", "status").distinct()
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("chunk_key", doc_hash("text").alias("doc_hash"))
    return chunks.join(log, "doc_hash").groupBy("status").agg(F.count("*").alias("chunks"), F.countDistinct("doc_hash").alias("texts"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window of time and key; events later than the watermark allows are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), key, "events")
