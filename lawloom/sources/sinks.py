"""Sinks: law texts, chunk and statistics files, key-value tables, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relation_id, safe_file_name
from ..operators.chunking import nested_chunks


def write_law_texts(texts: DataFrame, path: str) -> None:
    """One folder per law, named after it, with its text in the order of its blocks."""
    rows = texts.select(safe_file_name("law_name").alias("file"), "block", "full_text")
    rows.repartitionByRange("file", "block").sortWithinPartitions("file", "block").select("file", F.col("full_text").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with nested metadata, one JSON object per line; text is kept as it is, not escaped."""
    nested_chunks(chunks).write.mode("overwrite").json(path)


def as_document(metadata: Column, rows: DataFrame, name: str = "chunks") -> DataFrame:
    """A whole small table as one JSON object, for tools that read a single file; for statistics, not for a corpus."""
    one = rows.agg(F.count("*").alias("total"), F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return one.select(F.to_json(F.struct(metadata.alias("metadata"), F.col("total").alias(f"total_{name}"), F.col("rows").alias(name)), {"pretty": "true"}).alias("value"))


def write_key_values(df: DataFrame, key: str, path: str) -> None:
    """A key-value table: the key and the other columns as a JSON value."""
    df.select(F.col(key).alias("id"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value")).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, folder: str, name: str, now: dt.datetime | None = None) -> str:
    """A copy of a table under a folder named after the time."""
    target = f"{folder}/run_{(now or dt.datetime.now()).strftime('%Y%m%d_%H%M%S')}/{name}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """The four tables of an index (`indexrun.build_graph`) as key-value tables, each in its folder.

    Lists that are split into parts have the part in their key.
    """
    part = F.when(F.col("part_no") > 0, F.concat(F.lit("#"), F.col("part_no").cast("string"))).otherwise(F.lit(""))
    rel = relation_id("src_id", "tgt_id")
    write_key_values(tables["entities"].withColumnRenamed("entity", "id"), "id", f"{path}/entities")
    write_key_values(tables["relations"].withColumnRenamed("rel_id", "id"), "id", f"{path}/relations")
    write_key_values(tables["entity_chunks"].select(F.concat("entity", part).alias("id"), "chunks", "chunk_ids"), "id", f"{path}/entity_chunks")
    write_key_values(tables["relation_chunks"].select(F.concat(rel, part).alias("id"), "chunks", "chunk_ids"), "id", f"{path}/relation_chunks")


def append_log(rows: DataFrame, path: str) -> None:
    """A batch of outcomes (chunk_key, doc_hash, status) with their time, appended to the log."""
    rows.select("chunk_key", "doc_hash", "status", F.current_timestamp().alias("ts")).write.mode("append").parquet(path)
