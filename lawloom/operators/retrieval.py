"""Similarity search: exact top-k of stated queries against all rows, in blocks of queries; dual-level retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared at once: what a task holds besides its own rows.
QUERY_BLOCK = 512


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, same_space: bool = True) -> DataFrame:
    """The k most similar rows (cosine) of each query, itself left out if queries are rows too (`same_space`); equal scores in
    key order.

    Queries go out in blocks of a fixed size; each task keeps the k best of its rows per query, so what is shuffled is
    k rows per query and task, and the last ranking is keyed by the query.
    """
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(n_blocks):
        held = queries.where(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == b).select(key, vector).toPandas()
        best = _block(rows, held, k, key, vector, same_space)
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    m = m.reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _block(rows: DataFrame, held: pd.DataFrame, k: int, key: str, vector: str, same_space: bool = True) -> DataFrame:
    ids = held[key].to_numpy()
    q = _unit(held[vector].tolist()) if len(held) else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(ids) or not len(batch):
                continue
            own = batch[key].to_numpy()
            scores = np.round(q @ _unit(batch[vector].tolist()).T, 6)
            if same_space:
                scores[ids[:, None] == own[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
            yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), key: own[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"query_id bigint, {key} bigint, score double").where(F.col("score") > F.lit(-2.0))


def hashed_embedder(dim: int = 64, n: int = 3) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a model: hashed character n-grams, length 1."""

    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[float]:
            codes = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
            if not len(codes):
                return [0.0] * dim
            codes = np.concatenate([codes, np.zeros(max(0, n - len(codes)), np.uint64)])
            h = np.zeros(len(codes) - n + 1, np.uint64)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim)
            return (v / max(1e-12, float(np.linalg.norm(v)))).tolist()

        return texts.map(one)

    return embed


def embed(df: DataFrame, text: str, embedder: Callable[[pd.Series], pd.Series] | None = None, out: str = "embedding") -> DataFrame:
    """The rows with a vector per text; any callable on a series of texts serves as the model."""
    model = embedder or hashed_embedder()

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return model(texts)

    return df.withColumn(out, run(F.col(text)))


def complete(prompts: DataFrame, key: str, prompt: str, llm: Callable[[str], str], cache: DataFrame | None = None) -> DataFrame:
    """Answers of a language model (any callable) to prompts; prompts with a cached answer are not asked again."""
    hashed = prompts.select(key, F.col(prompt).alias("prompt"), F.md5(F.col(prompt).cast("binary")).alias("prompt_hash"))
    ask = hashed.join(cache.select("prompt_hash"), "prompt_hash", "left_anti") if cache is not None else hashed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"prompt_hash": batch["prompt_hash"], "answer": [llm(p) for p in batch["prompt"]]})

    fresh = ask.dropDuplicates(["prompt_hash"]).select("prompt_hash", "prompt").mapInPandas(run, "prompt_hash string, answer string")
    answers = fresh if cache is None else fresh.unionByName(cache.select("prompt_hash", "answer"))
    return hashed.join(answers, "prompt_hash").select(key, "prompt_hash", "answer")


def dual_level(low: DataFrame, high: DataFrame, k: int) -> DataFrame:
    """Hits of entities (low level) and relations (high level) as one ranking per query: best rank first, then key."""
    both = low.select("query_id", "vec_id", "rank", F.lit("low").alias("level")).unionByName(high.select("query_id", "vec_id", "rank", F.lit("high").alias("level")))
    merged = both.groupBy("query_id", "vec_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("levels"))
    w = Window.partitionBy("query_id").orderBy("best_rank", F.desc("levels"), "vec_id")
    return merged.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def hybrid_context(hits: DataFrame, bridge: DataFrame, chunks: DataFrame, budget: int = 8_000) -> DataFrame:
    """Chunks behind the hits of each query in order, as long as their tokens fit the budget.

    `hits` (query_id, vec_id, position) come from `dual_level`, `bridge` (vec_id, chunk_key) tells in which chunks a hit stands,
    `chunks` (chunk_key, tokens) their sizes. A chunk counts by its best hit, then by how many hits name it, then by key. Every
    query has a bounded number of hits; a hit may name many chunks, so chunks are counted per query before they are ranked.
    """
    named = hits.join(bridge, "vec_id").groupBy("query_id", "chunk_key").agg(F.min("position").alias("best"), F.count("*").alias("hits"))
    w = Window.partitionBy("query_id").orderBy("best", F.desc("hits"), "chunk_key")
    sized = named.join(chunks, "chunk_key").withColumn("place", F.row_number().over(w)).withColumn("filled", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("filled") <= budget).select("query_id", "chunk_key", "best", "hits", "place", F.col("filled").cast("bigint").alias("filled"))


def hybrid_query(questions: DataFrame, keywords: Callable[[str], str], entities: DataFrame, relations: DataFrame, bridge: DataFrame, chunks: DataFrame, embedder=None, k: int = 40, limit: int = 20, budget: int = 8_000) -> DataFrame:
    """Questions (query_id, question) to the text of their context: keywords of both levels from a model (JSON), the nearest
    entities of the low and relations of the high ones, the chunks behind them, joined in order."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["query_id"], "json": [keywords(q) for q in batch["question"]]})

    from .graph import parse_keywords

    words = questions.select("query_id", "question").mapInPandas(told, "query_id bigint, json string").select("query_id", parse_keywords(F.col("json")).alias("k"))
    level = lambda name: embed(words.select(F.col("query_id").alias("vec_id"), F.array_join(F.coalesce(f"k.{name}", F.array().cast("array<string>")), ", ").alias("t")).where("t <> ''"), "t", embedder).drop("t")
    low = top_k(entities, level("low_level_keywords"), k, same_space=False)
    high = top_k(relations, level("high_level_keywords"), k, same_space=False)
    found = hybrid_context(dual_level(low, high, limit), bridge, chunks.select("chunk_key", "tokens"), budget)
    texts = found.join(chunks.select("chunk_key", "text"), "chunk_key")
    return texts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.count("*").alias("chunks"))
