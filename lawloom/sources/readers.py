"""Readers: corpus rows, whole text files, chunk files in three shapes, GraphML, the index log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import MAX_BROADCAST_ROWS, path_exists

CHUNK_FIELDS = (
    "document_name string, chunk_id string, text string, content string, chunk_text string, law_id string, article string, dieu string, clause string, khoan string, "
    "metadata struct<law_id:string, article_number:int, article_title:string, chapter:string, section:string, estimated_tokens:int, has_overlap:boolean>"
)
CORPUS_FIELDS = "law_id string, article_id string, title string, text string"


def corpus(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """Corpus rows of all given files or splits."""
    reader = spark.read.schema(CORPUS_FIELDS) if fmt != "parquet" else spark.read
    return reader.format(fmt).load(list(paths)).select("law_id", "article_id", "title", "text")


def registered(records: DataFrame, laws: DataFrame) -> DataFrame:
    """Records of registered laws with name, source and rank; the registry is copied only if it is small."""
    known = laws.select("law_id", "law_name", "source", "law_rank")
    if known.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        known = F.broadcast(known)
    return records.join(known, "law_id")


def union_sources(laws: DataFrame, **sources: DataFrame) -> DataFrame:
    """Records of all sources (by name) as one table with `source`; each source gives the laws that the registry names for it.
    """
    out = None
    for name, records in sources.items():
        own = registered(records, laws.where(F.col("source") == name)).select("law_id", "law_name", "law_rank", "article_id", "title", "text", F.lit(name).alias("source"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no source is given")
    return out


def read_sources(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sources that could be opened, and the errors of the others, by name: a failing one does not stop the rest."""
    held, failed = {}, {}
    for name, read in readers.items():
        try:
            held[name] = read()
        except Exception as e:  # noqa: BLE001  whatever the source raises
            failed[name] = str(e).split("\n")[0]
    return held, failed


def missing_laws(records: DataFrame, laws: DataFrame) -> DataFrame:
    """Registered laws without a record."""
    return laws.join(records.select("law_id").distinct(), "law_id", "left_anti")


def text_files(spark: SparkSession, folder: str, laws: DataFrame) -> DataFrame:
    """Article records of the text files that the registry names; files that are missing or not named give none."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), tx.clean_text("value").alias("body"))
    named = files.join(laws.where("file_name is not null").select("file_name", "law_id", "law_name"), "file_name")
    cuts = named.withColumn("m", tx.matches("body", tx.ARTICLE)).where(F.size("m") > 0)
    # each heading with the text up to the next one
    blocks = F.transform(
        "m",
        lambda h, i: F.struct(
            h["match"].alias("match"),
            tx.strip(F.substring(F.col("body"), h["pos"] + 1, F.coalesce(F.try_element_at(F.col("m"), i + 2)["pos"], F.length("body")) - h["pos"])).alias("block"),
        ),
    )
    rows = cuts.withColumn("b", blocks).select("law_id", F.explode("b").alias("h"))
    number = F.regexp_extract("h.match", r"(?U)Điều\s+(\d+)", 1)
    text = tx.strip(F.coalesce(F.try_element_at(F.split(F.col("h.block"), "\n", 2), F.lit(2)), F.lit("")))
    return rows.select("law_id", F.concat("law_id", F.lit("__"), number).alias("article_id"), tx.strip("h.match").alias("title"), text.alias("text"))


def chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON file: a bare array, an object with `chunks`, or an object of arrays by law id.

    Elements that are no objects and values that are no arrays are left out; the law id of the last shape is the key.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    item = f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in _fields(CHUNK_FIELDS))}>>"
    bare = raw.where(F.col("v").startswith("[")).select(F.lit(None).cast("string").alias("key"), F.from_json("v", item).alias("c"))
    objects = raw.where(F.col("v").startswith("{"))
    boxed = objects.select(F.lit(None).cast("string").alias("key"), F.from_json(F.get_json_object("v", "$.chunks"), item).alias("c")).where("c is not null")
    keyed = objects.where(F.get_json_object("v", "$.chunks").isNull()).select(F.explode(F.from_json("v", "map<string,string>")).alias("key", "a")).where(F.col("a").startswith("[")).select("key", F.from_json("a", item).alias("c"))
    rows = bare.unionByName(boxed).unionByName(keyed).select("key", F.explode("c").alias("c")).where("c is not null").select("key", "c.*")
    return rows.withColumn("law_id", F.coalesce("law_id", "metadata.law_id", "key", F.lit("unknown"))).drop("key")


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def chunk_text(chunks: DataFrame) -> DataFrame:
    """Chunks with the text under its header, from whichever of the known fields has a value."""
    body = tx.falsy_coalesce("content", "text", "chunk_text")
    law = tx.falsy_coalesce("law_id", F.col("metadata.law_id"))
    article = tx.falsy_coalesce("article", "dieu", F.nullif(F.col("metadata.article_number"), F.lit(0)))
    return chunks.withColumn("corpus_text", tx.headered(law, article, tx.falsy_coalesce("clause", "khoan"), body))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file with their attributes as a map from name to text."""
    data = "data array<struct<_key:string, _VALUE:string>>"
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = xml("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))

    def with_names(df: DataFrame, *ids: str) -> DataFrame:
        rows = df.select(*ids, F.explode_outer("data").alias("d")).select(*ids, F.col("d._key").alias("k"), F.col("d._VALUE").alias("value"))
        named = rows.join(F.broadcast(keys), "k", "left")  # the dictionary of a file: a handful of attribute names
        return named.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("attributes"))

    nodes = with_names(xml("node", f"_id string, {data}").withColumnRenamed("_id", "entity_id"), "entity_id")
    edges = with_names(xml("edge", f"_source string, _target string, {data}").withColumnsRenamed({"_source": "src_id", "_target": "tgt_id"}), "src_id", "tgt_id")
    return nodes, edges


def index_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of indexing; empty where there is none yet."""
    schema = "chunk_key bigint, doc_hash string, status string, text string, ts timestamp"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists on its store; an error if none does."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their size in MB, by name."""
    return spark.read.format("binaryFile").load(folder).select("path", F.round(F.col("length") / F.lit(1024 * 1024), 2).alias("mb")).orderBy("path")
