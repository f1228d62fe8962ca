"""Chunks of laws: articles merged or split to size, with the end of the chunk before as context."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import cut
from . import structure


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens. Fixed defaults: 800 to 1200 tokens, 100 of overlap, 3.5 characters per token."""

    min_tokens: int = 800
    max_tokens: int = 1200
    overlap_tokens: int = 100
    ratio: float = tx.CHARS_PER_TOKEN

    @property
    def min_chars(self) -> int:
        return int(self.min_tokens * self.ratio)

    @property
    def max_chars(self) -> int:
        return int(self.max_tokens * self.ratio)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.ratio)


#: The end of a block that a heading may still run on from (the pattern's blanks cross line ends).
OPEN_END = r"(?mdU)^(?:(?:Điều(?:\s+\d+[.:])?|Chương(?:\s+[IVXLCDM\d]+[.:]*)?|Mục(?:\s+\d+[.:]*)?)\s*)+\z"
#: Groups of chunks that are numbered together.
RANGE = 200

_PIECES = "law_id string, block bigint, ord int, name string, number int, title string, chapter string, section string, text string, chars int"
_PLACED = "law_id string, block bigint, ord int, art bigint, grp bigint, group_chars bigint, whole_law boolean, in_chapter string, in_section string"


def _close_blocks(docs: DataFrame) -> DataFrame:
    """The blocks with open headings at their ends moved to the next block that holds more than such headings."""
    w = Window.partitionBy("law_id").orderBy("block")
    ends = docs.select("law_id", "block", F.regexp_extract("full_text", OPEN_END, 0).alias("tail"), F.length("full_text").alias("n")).withColumn("last", F.lead("block").over(w).isNull())
    ends = ends.withColumn("tail", F.when(F.col("last"), "").otherwise(F.col("tail"))).withColumn("only", ~F.col("last") & (F.length("tail") == F.col("n")))
    closed = (~F.col("only")).cast("bigint")
    ends = ends.withColumn("to", F.sum(closed).over(w)).withColumn("own", F.col("to") - closed)
    moved = ends.where("tail <> ''").groupBy("law_id", F.col("to").alias("own")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "tail"))), lambda x: x["tail"]), "\n\n").alias("before"))
    # only the few blocks concerned are shuffled with others
    changed = ends.join(moved, ["law_id", "own"], "left").where("tail <> '' or before is not null").select("law_id", "block", F.length("tail").alias("cut"), "only", "before")
    text = F.when(F.col("only"), "").otherwise(F.concat_ws("\n\n", "before", F.expr("rtrim('\n', left(full_text, length(full_text) - cut))")))
    return docs.join(changed, ["law_id", "block"], "left").withColumn("full_text", F.when(F.col("cut").isNotNull(), text).otherwise(F.col("full_text"))).select("law_id", "block", "document_name", "full_text")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The articles of each block from 1; as 0 the text before the first, with the last chapter and section of the block."""
    for batch in batches:
        rows = []
        for law, block, name, text in zip(batch["law_id"], batch["block"], batch["document_name"], batch["full_text"]):
            before, ends, arts = structure.article_pieces(text)
            rows.append((law, block, 0, name, None, None, *ends, before, len(before)))
            rows += [(law, block, i, None, number, title, chapter, section, body, len(body)) for i, (number, title, body, chapter, section) in enumerate(arts, 1)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"number": "Int32"})


def _place_law(blocks: Iterator[tuple], least: int) -> Iterator[tuple]:
    """The place of every piece of a law: article, group and the group's size, and the chapter and section it begins under.

    The fold of merge_groups over the whole law. What is held is the last closed group and the open one; text before
    the first article of a law is left out, and a law without any article is one article.
    """
    last, opened, early = [], [], []  # groups: articles of [size, pieces]
    article, art, grp, size, chapter, section = None, -1, 0, 0, None, None

    def rows(group: list, g: int) -> list:
        chars = sum(a[0] for a in group) + 2 * (len(group) - 1)
        return [(*piece[:2], a[1], g, chars, False, *piece[2:]) for a in group for piece in a[2]]

    def close() -> Iterator[tuple]:
        nonlocal last, opened, grp, size
        if last:
            yield from rows(last, grp)
            grp += 1
        last, opened, size = opened, [], 0

    def add(a: list) -> Iterator[tuple]:
        nonlocal size
        if a[0] >= least and opened:
            yield from close()
        opened.append(a)
        size += a[0]
        if size >= least:
            yield from close()

    for block, sizes, end_chapter, end_section in blocks:
        for k, n in enumerate(sizes.tolist()):
            if k:
                if article:
                    yield from add(article)
                art += 1
                article = [n, art, [(block, k, chapter, section)]]
            elif n and article:
                article[0] += 2 + n
                article[2].append((block, 0, chapter, section))
            elif n or not early:
                early.append((block, n))
        chapter, section = end_chapter or chapter, end_section or section
    if article:
        yield from add(article)
        last = last + opened  # a rest joins the group before
        yield from rows(last, grp)
    else:
        early = [e for e in early if e[1]] or early
        chars = sum(n for _, n in early) + 2 * (len(early) - 1)
        yield from ((block, 0, 0, 0, chars, True, None, None) for block, _ in early)


def _placed(least: int):
    """Sorted rows of (law, block, sizes, last chapter and section) to the places of their pieces, law after law."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from batch.itertuples(index=False, name=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PLACED.split(", ")]
        placed = ((law, *r) for law, own in itertools.groupby(rows(batches), lambda r: r[0]) for r in _place_law((r[1:] for r in own), least))
        while out := list(itertools.islice(placed, 10_000)):
            yield pd.DataFrame(out, columns=names)

    return run


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of documents (`law_id`, `document_name`, `full_text`); a document may come in blocks (`block`), which are
    chunked as one text joined by empty lines.

    Texts are parsed and cut block by block. Only the sizes of a law's articles, by block and in order, pass one task
    as a stream, which gives every piece its article and group; texts are joined after it.
    """
    docs = docs if "block" in docs.columns else docs.withColumn("block", F.lit(0).cast("bigint"))
    texts = _close_blocks(docs.select("law_id", F.col("block").cast("bigint"), "document_name", F.coalesce("full_text", F.lit("")).alias("full_text")))
    found = cut(texts.mapInPandas(_pieces, _PIECES))
    names = found.where("ord = 0").groupBy("law_id").agg(F.first("name").alias("document_name"))
    numbers = found.groupBy("law_id", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "chars"))), lambda x: x["chars"]).alias("sizes"),
        F.max(F.when(F.col("ord") == 0, F.col("chapter"))).alias("chapter"), F.max(F.when(F.col("ord") == 0, F.col("section"))).alias("section"),
    )
    placed = numbers.repartition("law_id").sortWithinPartitions("law_id", "block").mapInPandas(_placed(config.min_chars), _PLACED)
    members = found.join(placed, ["law_id", "block", "ord"]).withColumns({
        # an article's own piece comes first; the others are the text before the first article of later blocks
        "number": F.when(F.col("whole_law"), 0).when(F.col("ord") > 0, F.coalesce("number", (F.col("art") + 1).cast("int"))),
        "title": F.when(F.col("whole_law"), "(Toàn văn)").otherwise(F.col("title")),
        "chapter": F.when(F.col("whole_law"), "").otherwise(F.coalesce("chapter", "in_chapter", F.lit(""))),
        "section": F.when(F.col("whole_law"), "").otherwise(F.coalesce("section", "in_section", F.lit(""))),
    })
    place = F.struct("block", "ord")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "ord", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    context = [F.min_by(c, place).alias(c) for c in ("chapter", "section")]
    fits = F.col("group_chars") <= config.max_chars
    # a group within the limit is one chunk; its size bounds what is collected
    whole = (
        members.where(fits)
        .groupBy("law_id", "grp")
        .agg(joined, F.min_by("number", place).alias("first_no"), F.max_by("number", F.struct("art", F.col("number").isNotNull())).alias("last_no"), (F.max("art") > F.min("art")).alias("many"), F.min_by("title", place).alias("title"), *context)
        .withColumns({"title": F.when(F.col("many"), "").otherwise(F.col("title")), "seq": F.lit(0).cast("bigint"), "part": F.lit(0), "sub_part": F.lit(0)})
    )
    # of a larger group every article is cut on its own
    articles = members.where(~fits).groupBy("law_id", "grp", "art").agg(joined, F.min_by("number", place).alias("number"), F.min_by("title", place).alias("title"), *context)
    split = structure.with_clause_parts(articles, "text", "parts", config.max_chars).drop("text")
    pieces = split.select("law_id", "grp", F.col("art").alias("seq"), "number", "title", "chapter", "section", F.size("parts").alias("k"), F.posexplode("parts").alias("part", "text")).select(
        "law_id", "grp", "text", F.col("number").alias("first_no"), F.col("number").alias("last_no"), F.lit(False).alias("many"), "title", "chapter", "section",
        "seq", "part", F.when(F.col("k") > 1, F.col("part") + 1).otherwise(0).alias("sub_part"),
    )
    raw = cut(whole.unionByName(pieces).withColumn("_range", F.expr(f"grp div {RANGE}")).withColumn("_tail", tx.overlap_tail("text", config.overlap_chars)))
    # chunks are numbered within ranges of groups; a range passes on its count and its last chunk's tail
    w, ranges = Window.partitionBy("law_id", "_range").orderBy("grp", "seq", "part"), Window.partitionBy("law_id").orderBy("_range")
    ends = raw.groupBy("law_id", "_range").agg(F.count("*").alias("n"), F.max_by("_tail", F.struct("grp", "seq", "part")).alias("end"))
    before = ends.select("law_id", "_range", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("end").over(ranges).alias("_last"))
    tails = raw.select("law_id", "_range", "grp", "seq", "part", "_tail").withColumn("_i", F.row_number().over(w)).withColumn("_lag", F.lag("_tail").over(w)).join(before, ["law_id", "_range"])
    numbered = tails.select("law_id", "grp", "seq", "part", (F.col("_i") + F.col("_before")).cast("int").alias("chunk_ord"), F.when(F.col("_i") == 1, F.col("_last")).otherwise(F.col("_lag")).alias("overlap"))
    named = raw.join(numbered, ["law_id", "grp", "seq", "part"]).join(names, "law_id")
    text = tx.wrap_overlap(F.coalesce("overlap", F.lit("")), F.col("text"))
    return named.select(
        "document_name",
        tx.chunk_id(tx.document_prefix("document_name"), F.col("first_no"), F.col("last_no"), F.col("many"), F.col("sub_part"), F.col("chunk_ord")).alias("chunk_id"),
        text.alias("text"),
        F.col("first_no").alias("article_number"),
        F.col("title").alias("article_title"),
        F.col("chapter").alias("chapter_context"),
        F.col("section").alias("section_context"),
        tx.token_estimate(text, config.ratio).alias("token_count"),
        (F.length(F.coalesce("overlap", F.lit(""))) > 0).alias("has_overlap"),
        F.col("law_id").alias("source_law_id"),
        "chunk_ord",
    )


def reconstruct(records: DataFrame, block_articles: int = 500) -> DataFrame:
    """The text of each law in blocks of consecutive articles, ordered by article number, then key.

    A law is one text only as the sequence of its blocks: a law with a third of all rows is then no single task.
    chunk_documents joins them again.
    """
    title, body = tx.clean_text("title"), tx.clean_text("text")
    part = F.concat_ws("\n", F.when(F.length(title) > 0, title), F.when(F.length(body) > 0, body))
    numbered = records.select("law_id", tx.article_ordinal("article_id").alias("n"), F.col("record_id").alias("k"), part.alias("part")).where(F.length("part") > 0)
    block = F.floor(F.col("n") / F.lit(block_articles))  # numbers below 0 stand before 0
    return (
        numbered.groupBy("law_id", block.alias("block"), F.pmod(F.col("n"), F.lit(block_articles)).alias("n"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n\n").alias("part"))
        .groupBy("law_id", "block")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("full_text"))
    )


def nested_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their metadata in one struct."""
    meta = F.struct(
        F.col("source_law_id").alias("law_id"), "article_number", "article_title", F.col("chapter_context").alias("chapter"), F.col("section_context").alias("section"),
        F.col("token_count").alias("estimated_tokens"), "has_overlap",
    )
    return chunks.select("document_name", "chunk_id", "text", meta.alias("metadata"))
