"""The resumable index: what is left to do, batches, the log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_hash

#: Fixed value: texts of a batch.
BATCH = 16


def completed(log: DataFrame) -> DataFrame:
    """The distinct hashes of texts whose indexing was completed."""
    return log.where("status = 'completed'").select("doc_hash").distinct()


def remaining(chunks: DataFrame, log: DataFrame, text: str = "text", once: bool = False) -> DataFrame:
    """Chunks whose text is not completed yet; `once` keeps the first of equal texts only."""
    left = chunks.withColumn("doc_hash", doc_hash(text)).join(completed(log), "doc_hash", "left_anti")
    if once:
        first = left.groupBy("doc_hash").agg(F.min("chunk_key").alias("chunk_key"))
        left = left.join(first, ["doc_hash", "chunk_key"], "left_semi")
    return left


def batches(rows: DataFrame, key: str, size: int = BATCH, range_size: int = 100_000) -> DataFrame:
    """Consecutive batches in key order.

    Rows are numbered within ranges of keys and offset by the counts of the ranges before: no single task numbers
    the table, the window over range totals holds one row per range.
    """
    ranged = rows.withColumn("_range", F.expr(f"{key} div {range_size}"))
    totals = ranged.groupBy("_range").count()
    before = totals.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_n", within).join(before, "_range").withColumn("batch", F.expr(f"cast((_n + _before) div {size} as bigint)")).drop("_range", "_n", "_before")


def latest_status(log: DataFrame) -> DataFrame:
    """The last attempt of each chunk; the larger log_id decides between equal times."""
    last = F.max(F.struct("event_at", "log_id", "status", "attempt", "doc_hash")).alias("s")
    return log.where("chunk_key is not null").groupBy("chunk_key").agg(last).select("chunk_key", "s.log_id", "s.status", "s.attempt", "s.doc_hash")


def retry_outcome(log: DataFrame) -> DataFrame:
    """Chunks that failed at least once: how many recovered later and how many are still failed."""
    per = log.where("chunk_key is not null").groupBy("chunk_key").agg(F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "completed").alias("successes")).where("failures > 0")
    return per.agg(F.count("*").alias("failed_once"), F.count_if(F.col("successes") > 0).alias("recovered"), F.count_if(F.col("successes") == 0).alias("still_failed"))


def retry_queue(log: DataFrame) -> DataFrame:
    """Chunks whose last attempt failed, with the number of the next one."""
    return latest_status(log).where("status = 'failed'").select("chunk_key", "doc_hash", (F.col("attempt") + 1).alias("next_attempt"))


def upsert_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last in the order wins. Rows are reduced before they are shuffled."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(key, "_last.*")


def status_shares(log: DataFrame) -> DataFrame:
    """Attempts by status with their share of all in whole per cent."""
    counted = log.groupBy("status").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(total).select("status", "n", F.expr("cast(n * 100 div total as int)").alias("pct"))  # one row of totals


def in_law_order(chunks: DataFrame, laws: DataFrame, law: str = "source_law_id") -> DataFrame:
    """The chunks of registered laws with the rank of their law: the order of output, law by law."""
    return chunks.join(laws.select(F.col("law_id").alias(law), "law_rank"), law)
