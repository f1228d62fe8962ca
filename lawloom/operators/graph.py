"""The entity graph: parsing extractions, merging mentions, attributes with defaults, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEP, relation_id, split_sep, strip

#: Defaults of missing attributes.
NODE_DEFAULTS = {"entity_type": "UNKNOWN", "description": "", "source_id": "", "file_path": "unknown_source", "created_at": 0, "truncate": ""}
EDGE_DEFAULTS = {"description": "", "keywords": "", "weight": 1.0, "source_id": "", "file_path": "unknown_source", "created_at": 0, "truncate": ""}


def _filled(df: DataFrame, defaults: dict) -> list[Column]:
    return [(F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)).alias(c) for c, v in defaults.items()]


def nodes(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Nodes with every attribute, defaults for what is missing."""
    return df.select(F.col(entity).alias("entity_id"), *_filled(df, NODE_DEFAULTS))


def edges(df: DataFrame) -> DataFrame:
    """Edges with their id and every attribute, defaults for what is missing."""
    return df.select(relation_id("src_id", "tgt_id").alias("rel_id"), "src_id", "tgt_id", *_filled(df, EDGE_DEFAULTS))


def chunk_bridge(df: DataFrame, key: str, source: str = "source_id") -> DataFrame:
    """One row per node or edge and chunk named in its joined list."""
    return df.select(key, F.explode(split_sep(source)).alias("chunk_id")).distinct()


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions (entity, entity_type, chunk) as entities: the most frequent type (the smallest of equals), mentions and
    chunks. Counted per type first; chunk lists stay rows (`chunk_bridge`), so no entity is a large group."""
    per_type = mentions.groupBy("entity", "entity_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("entity_type"))).alias("b")
    typed = per_type.groupBy("entity").agg(best, F.sum("n").alias("mentions")).select("entity", "b.entity_type", "mentions")
    held = mentions.select("entity", "chunk").distinct().groupBy("entity").agg(F.count("*").alias("chunks"))
    return typed.join(held, "entity")


def type_histogram(df: DataFrame, kind: str = "entity_type") -> DataFrame:
    """Entities by type, the largest first."""
    return df.groupBy(F.coalesce(F.col(kind), F.lit("?")).alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def parse_extractions(df: DataFrame, key: str, output: str, field: str = "<|>", record: str = "##") -> DataFrame:
    """Entities and relationships of model outputs: one row per record with enough fields, others are left out."""
    quoted = lambda s: F.regexp_replace(s, r'^[("\s]+|[)"\s]+$', "")
    rows = df.select(key, F.posexplode(F.split(F.col(output), f"\\Q{record}\\E")).alias("record_no", "r"))
    fields = rows.select(key, "record_no", F.transform(F.split("r", f"\\Q{field}\\E"), quoted).alias("f"))
    kind = F.lower(F.element_at("f", 1))
    at = lambda i: strip(F.try_element_at("f", F.lit(i)))
    return fields.where(((kind == "entity") & (F.size("f") >= 4)) | ((kind == "relationship") & (F.size("f") >= 5))).select(
        key, "record_no", kind.alias("kind"), at(2).alias("name"), at(3).alias("type_or_target"), at(4).alias("description"), F.when(kind == "relationship", at(5).try_cast("double")).alias("strength")
    )


def parse_keywords(c: Column) -> Column:
    """Keywords of both levels from a model's JSON; null where it is none."""
    return F.from_json(c, "high_level_keywords array<string>, low_level_keywords array<string>")


#: Most chunk ids in one row of a key's list.
LIST_PART = 1000


def id_lists(rows: DataFrame, keys: list[str], chunk: str = "chunk") -> DataFrame:
    """The chunks of each key as joined lists of at most LIST_PART ids: the tables of chunks per entity and per relation.

    Ids are dealt to parts by a hash, sized by the key's count, so that a key in a third of all chunks is many small groups.
    """
    distinct = rows.select(*keys, F.col(chunk).alias("_c")).where("_c is not null").distinct()
    sizes = distinct.groupBy(*keys).agg(F.count("*").alias("chunks"))
    parted = distinct.join(sizes, keys).withColumn("part_no", F.expr(f"cast(pmod(xxhash64(_c), (chunks - 1) div {LIST_PART} + 1) as int)"))
    return parted.groupBy(*keys, "part_no").agg(F.max("chunks").alias("chunks"), F.array_join(F.sort_array(F.collect_list("_c")), SEP).alias("chunk_ids"))


def _described(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct descriptions of each key as one text; of a key with more than LIST_PART of them their first part (the
    others are to be had from `id_lists`)."""
    held = id_lists(rows.where("description <> ''"), keys, "description")
    return held.where("part_no = 0").select(*keys, F.col("chunk_ids").alias("description"))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Mentions (entity, entity_type, description, chunk) as entities: the most frequent type, the first part of the distinct
    descriptions joined, mentions and chunks."""
    return merge_mentions(mentions).join(_described(mentions, ["entity"]), "entity", "left").withColumn("description", F.coalesce("description", F.lit("")))


def merge_relations(mentions: DataFrame) -> DataFrame:
    """Mentions (src_id, tgt_id, description, strength, chunk) as relations with their id: summed strength, the distinct
    descriptions joined, mentions and chunks."""
    keys = ["src_id", "tgt_id"]
    sums = mentions.groupBy(*keys).agg(F.sum(F.coalesce("strength", F.lit(1.0))).alias("weight"), F.count("*").alias("mentions"))
    held = mentions.select(*keys, "chunk").distinct().groupBy(*keys).agg(F.count("*").alias("chunks"))
    joined = sums.join(held, keys).join(_described(mentions, keys), keys, "left")
    return joined.select(relation_id("src_id", "tgt_id").alias("rel_id"), *keys, "weight", F.coalesce("description", F.lit("")).alias("description"), "mentions", "chunks")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, and edges between nodes that are there."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    known = nodes.select("entity_id").distinct()
    whole = edges.join(known.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi").join(known.withColumnRenamed("entity_id", "tgt_id"), "tgt_id", "left_semi").agg(F.count("*").alias("complete_edges"))
    return n.crossJoin(e).crossJoin(whole)  # one row each
