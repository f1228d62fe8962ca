"""Chunk statistics: per group, and per group with a grand total in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The target range of a chunk, in tokens (both ends included).
TARGET_MIN_TOKENS, TARGET_MAX_TOKENS = 800, 1200


def token_aggregates(tokens: str = "token_count", low: int = TARGET_MIN_TOKENS, high: int = TARGET_MAX_TOKENS) -> list[Column]:
    """Count, sum, least, most, floored mean and the share in the target range, to one place."""
    t = F.col(tokens)
    in_range = F.count_if(t.between(low, high))
    return [
        F.count("*").alias("chunks"),
        F.sum(t.cast("bigint")).alias("total_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        F.expr(f"sum(cast({tokens} as bigint)) div nullif(count({tokens}), 0)").alias("avg_tokens"),
        in_range.alias("in_range"),
        F.bround(F.lit(100.0) * in_range / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct_in_range"),
    ]


def group_stats(chunks: DataFrame, *keys: str, tokens: str = "token_count") -> DataFrame:
    """Statistics of each group of chunks."""
    return chunks.groupBy(*keys).agg(*token_aggregates(tokens))


def rollup_stats(chunks: DataFrame, key: str, tokens: str = "token_count") -> DataFrame:
    """Statistics of each group and of all chunks; `is_total` tells the total from a group without a key."""
    return chunks.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *token_aggregates(tokens))
