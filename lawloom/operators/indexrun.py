"""The index run: chunks to prompts, a model's extractions, entities, relations, vectors and the log, batch by batch.

The model is any callable on a prompt. A run takes what is not completed yet, in batches of a fixed number of texts; a
batch writes its extractions and its part of the log before the next one begins, so a run that is cut short goes on
where it stopped. Failed texts are asked again by `retry_failed`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_hash
from ..runtime import path_exists
from . import graph, indexing, retrieval

LOG = "chunk_key bigint, doc_hash string, status string, attempt int, batch bigint"
EXTRACTIONS = "chunk_key bigint, doc_hash string, status string, answer string"

#: The instruction of the extraction; the names in braces are filled from columns.
EXTRACT_PROMPT = "List the entities and relationships of the text of {law}.\n{text}"


def fill_prompt(template: str, **values: Column | str) -> Column:
    """A template with each {name} replaced by a column's value; a null value is empty, other braces stand."""
    out = F.lit(template)
    for name, value in values.items():
        c = F.col(value) if isinstance(value, str) else value
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def messages(prompt: Column | str, system: str | None = None, history: Column | None = None) -> Column:
    """Messages of a model call in order: system, earlier messages, the prompt."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(one("system", F.lit(system)) if system else empty, F.coalesce(history, empty) if history is not None else empty, one("user", p))


def ask(texts: DataFrame, llm: Callable[[str], str], prompt: str = "prompt", attempts: int = 3) -> DataFrame:
    """Each text's answer; a call that raises is repeated at once up to so many times, then the text has failed."""

    def call(p: str) -> tuple[str, str | None]:
        for _ in range(attempts):
            try:
                return "completed", llm(p)
            except Exception:  # noqa: BLE001, PERF203  the model's errors are its own
                continue
        return "failed", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [call(p) for p in batch[prompt]]
            yield pd.DataFrame({"chunk_key": batch["chunk_key"], "doc_hash": batch["doc_hash"], "status": [s for s, _ in got], "answer": [a for _, a in got]})

    return texts.select("chunk_key", "doc_hash", prompt).mapInPandas(run, EXTRACTIONS)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def run_index(chunks: DataFrame, folder: str, llm: Callable[[str], str], batch_size: int = 10_000, max_batches: int | None = None) -> int:
    """Index what is not completed yet, a batch at a time; the number of batches done. Equal texts are asked once.

    `folder` (on the shared store) holds `extractions` and `log`, both in parts by batch.
    """
    spark = chunks.sparkSession
    left = indexing.remaining(chunks, _read(spark, f"{folder}/log", LOG), once=True)
    first = (_read(spark, f"{folder}/log", LOG).agg(F.max("batch")).first()[0] or 0) + 1
    numbered = indexing.batches(left, "chunk_key", batch_size)
    done = 0
    for b in [r[0] for r in numbered.select("batch").distinct().orderBy("batch").collect()]:  # numbers of batches only
        if max_batches is not None and done >= max_batches:
            break
        _run_batch(numbered.where(F.col("batch") == b), folder, llm, first + done, F.lit(1))
        done += 1
    return done


def retry_failed(chunks: DataFrame, folder: str, llm: Callable[[str], str]) -> int:
    """Ask again for every text whose last attempt failed; the number of texts asked."""
    spark = chunks.sparkSession
    log = _read(spark, f"{folder}/log", LOG)
    last = log.groupBy("chunk_key").agg(F.max_by(F.struct("status", "attempt", "doc_hash"), F.struct("batch", "attempt")).alias("s")).where("s.status = 'failed'").select("chunk_key", F.col("s.attempt").alias("attempt"), F.col("s.doc_hash").alias("doc_hash"))
    again = chunks.join(last, "chunk_key")
    n = again.count()
    if n:
        _run_batch(again, folder, llm, (log.agg(F.max("batch")).first()[0] or 0) + 1, F.col("attempt") + 1)
    return n


def _run_batch(rows: DataFrame, folder: str, llm: Callable[[str], str], number: int, attempt: Column) -> None:
    """One batch: its answers are written first, its part of the log after them; a repeated batch overwrites itself."""
    law = F.coalesce("source_law_id", F.lit("")) if "source_law_id" in rows.columns else F.lit("")
    asked = rows.withColumns({"prompt": fill_prompt(EXTRACT_PROMPT, law=law, text="text"), "attempt": attempt.cast("int")})
    part = f"{folder}/extractions/batch={number}"
    ask(asked, llm).write.mode("overwrite").parquet(part)
    answers = rows.sparkSession.read.schema(EXTRACTIONS).parquet(part)
    log = answers.join(asked.select("chunk_key", "attempt"), "chunk_key").select("chunk_key", "doc_hash", "status", "attempt")
    log.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")


def read_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed records of all completed texts: (chunk_key, kind, name, type_or_target, description, strength)."""
    return graph.parse_extractions(_read(spark, f"{folder}/extractions", EXTRACTIONS).where("status = 'completed'"), "chunk_key", "answer")


def build_graph(extractions: DataFrame, chunk_ids: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the index from its extractions: entities, relations, and the chunk lists of both.

    `chunk_ids` names the chunk (`chunk_id`) of each key.
    """
    named = extractions.join(chunk_ids.select("chunk_key", F.col("chunk_id").alias("chunk")), "chunk_key")
    mentions = named.where("kind = 'entity'").select(F.col("name").alias("entity"), F.coalesce("type_or_target", F.lit("UNKNOWN")).alias("entity_type"), "description", "chunk")
    relations = named.where("kind = 'relationship'").select(F.col("name").alias("src_id"), F.col("type_or_target").alias("tgt_id"), "description", "strength", "chunk")
    return {
        "entities": graph.merge_entities(mentions), "relations": graph.merge_relations(relations),
        "entity_chunks": graph.id_lists(mentions, ["entity"]), "relation_chunks": graph.id_lists(relations, ["src_id", "tgt_id"]),
    }


def vectors(tables: dict[str, DataFrame], embedder=None) -> tuple[DataFrame, DataFrame]:
    """Vectors of entities (name and description) and of relations (both names and description)."""
    e = retrieval.embed(tables["entities"].select(F.col("entity").alias("id"), F.concat_ws("\n", "entity", "description").alias("t")), "t", embedder).drop("t")
    r = retrieval.embed(tables["relations"].select(F.col("rel_id").alias("id"), F.concat_ws("\n", "src_id", "tgt_id", "description").alias("t")), "t", embedder).drop("t")
    return e, r


def index_report(log: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that are indexed, failed and left, out of all distinct ones."""
    last = log.groupBy("doc_hash").agg(F.max_by("status", F.struct("batch", "attempt")).alias("status"))
    held = texts.select(doc_hash("text").alias("doc_hash")).distinct().join(last, "doc_hash", "left")
    return held.groupBy(F.coalesce("status", F.lit("left")).alias("status")).agg(F.count("*").alias("texts"))
