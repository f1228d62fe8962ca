"""Structure of a law: articles with their chapter and section, spans, and groups of articles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import matches, strip

#: The least and the most characters of a chunk, and those of an overlap (800, 1200, 100 tokens of 3.5).
MIN_CHARS, MAX_CHARS, OVERLAP_CHARS = 2800, 4200, 350


def headings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every article, chapter and section heading of every text: (key, kind, pos, heading), one row each."""
    kinds = {"article": tx.ARTICLE, "chapter": tx.CHAPTER, "section": tx.SECTION}
    held = texts.select(key, *(F.coalesce(matches(text, p), F.array().cast("array<struct<pos:int,match:string>>")).alias(k) for k, p in kinds.items()))
    tagged = lambda k: F.transform(k, lambda m: F.struct(F.lit(k).alias("kind"), m["pos"].alias("pos"), m["match"].alias("heading")))
    return held.select(key, F.explode(F.concat(*map(tagged, kinds))).alias("h")).select(key, "h.*")


def markers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Positions of all five kinds of structural markers, with the characters around each; texts are left behind."""
    kinds = {"article": tx.ARTICLE, "chapter": tx.CHAPTER, "section": tx.SECTION, "clause": tx.CLAUSE, "point": tx.POINT}
    held = texts.select(key, F.col(text).alias("_t"), *(matches(text, p).alias(k) for k, p in kinds.items()))
    # the context is cut before the rows are multiplied
    around = lambda k: F.transform(k, lambda m: F.struct(F.lit(k).alias("kind"), m["pos"].alias("pos"), F.substring(F.col("_t"), m["pos"] + 1, F.length(m["match"]) + 20).alias("context")))
    return held.select(key, F.explode(F.concat(*[F.coalesce(around(k), F.array().cast("array<struct<kind:string,pos:int,context:string>>")) for k in kinds])).alias("h")).select(key, "h.*")


def carry_forward(rows: DataFrame, key: str, order: str, kind: str, value: str, kinds: tuple[str, ...], part: Column | None = None) -> DataFrame:
    """For each row the last value of each of these kinds at or before it (null if there is none): an as-of join.

    Rows of a key are worked through in parts (`part` must not decrease with the order), so that a hot key is no single
    task; a part passes on its last values only. Rows without a key have no predecessor.
    """
    part = F.lit(0) if part is None else part
    held = rows.withColumn("_part", part)
    w = Window.partitionBy(key, "_part").orderBy(order, F.when(F.col(kind).isin(*kinds), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    named = lambda k: F.when(F.col(kind) == k, F.col(value))
    within = held.where(F.col(key).isNotNull()).withColumns({f"_{k}": F.last(named(k), ignorenulls=True).over(w) for k in kinds})
    ends = held.where(F.col(key).isNotNull()).groupBy(key, "_part").agg(*[F.max_by(named(k), F.when(F.col(kind) == k, F.col(order))).alias(f"_end_{k}") for k in kinds])
    parts = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "_part", *[F.last(f"_end_{k}", ignorenulls=True).over(parts).alias(f"_before_{k}") for k in kinds])
    found = within.join(before, [key, "_part"]).select(*rows.columns, *[F.coalesce(f"_{k}", f"_before_{k}").alias(k) for k in kinds])
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


_ARTICLE, _CHAPTER, _SECTION = (re.compile(p, re.M) for p in (tx.ARTICLE, tx.CHAPTER, tx.SECTION))
_NUMBERED = re.compile(r"Điều\s+(\d+)[\.:]\s*(.*)")


def article_pieces(text: str) -> tuple[str, tuple[str | None, str | None], list[tuple]]:
    """The text before the first article, the last chapter and section, and the articles (number, title, body, chapter,
    section) in order; headings are merged with the articles in one pass."""
    arts, ups = list(_ARTICLE.finditer(text)), [[(m.start(), m.group().strip()) for m in p.finditer(text)] for p in (_CHAPTER, _SECTION)]
    out, at = [], [0, 0]
    for i, m in enumerate(arts):
        for k, u in enumerate(ups):
            while at[k] < len(u) and u[at[k]][0] <= m.start():
                at[k] += 1
        number, title = _NUMBERED.match(m.group()).groups()
        body = text[m.start() : arts[i + 1].start() if i + 1 < len(arts) else len(text)].strip()
        out.append((int(number) if int(number) < 1 << 31 else None, title.strip(), body, *(u[j - 1][1] if j else None for u, j in zip(ups, at))))
    return text[: arts[0].start()].rstrip() if arts else text, tuple(u[-1][1] if u else None for u in ups), out


def extract_articles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Articles of each text with number, title, body, chapter and section; a text without any is one block 0.

    Text before the first article is left out; a block runs to the next article. A map over the texts.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                _, _, arts = article_pieces(t)
                rows += [(k, i, n if n is not None else i + 1, title, body, chapter or "", section or "", len(body)) for i, (n, title, body, chapter, section) in enumerate(arts)] or [(k, 0, 0, "(Toàn văn)", t, "", "", len(t))]
            yield pd.DataFrame(rows, columns=["k", "art_ord", "number", "title", "full_text", "chapter", "section", "char_count"])

    found = texts.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"k {kind}, art_ord int, number int, title string, full_text string, chapter string, section string, char_count int")
    return found.withColumnRenamed("k", key)


def merge_groups(sizes: Column, least: int = MIN_CHARS) -> Column:
    """Group number of each article from their sizes in order: a long article stands alone, short ones are joined until
    they reach the least size, and a rest that does not reach it joins the last group."""
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("open"), F.lit(False).alias("any"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        long = size >= least
        # a long article closes an open group first
        own = F.when(long & acc["any"], acc["g"] + 1).otherwise(acc["g"])
        reach = acc["open"] + size
        closed = long | (reach >= least)
        return F.struct(
            F.when(closed, own + 1).otherwise(own).cast("int").alias("g"),
            F.when(closed, F.lit(0)).otherwise(reach).cast("bigint").alias("open"),
            (~closed).alias("any"),
            F.concat(acc["out"], F.array(own.cast("int"))).alias("out"),
        )

    def finish(acc: Column) -> Column:
        tail = acc["any"] & (acc["g"] > 0)
        return F.when(tail, F.transform(acc["out"], lambda g: F.when(g == acc["g"], g - 1).otherwise(g))).otherwise(acc["out"])

    return F.aggregate(F.transform(sizes, lambda s: s.cast("bigint")), zero, step, finish)


def pack_clauses(sizes: Column, header: Column, most: int = MAX_CHARS) -> Column:
    """Part number of each clause: clauses are packed in order while header and clauses stay within the most characters."""
    zero = F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("filled"), F.lit(True).alias("empty"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        over = (~acc["empty"]) & (header + acc["filled"] + size > most)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"]).cast("int")
        return F.struct(part.alias("part"), F.when(over, size).otherwise(acc["filled"] + size).cast("bigint").alias("filled"), F.lit(False).alias("empty"), F.concat(acc["out"], F.array(part)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("bigint")), zero, step, lambda acc: acc["out"])


_CLAUSE = re.compile(tx.CLAUSE, re.M)


def clause_part_list(text: str, most: int) -> list[str]:
    """The parts of one text: its numbered clauses packed in order, each part under the text before the first clause; the whole
    text if there are fewer than two clauses."""
    starts = [m.start() for m in _CLAUSE.finditer(text)]
    if len(starts) < 2:
        return [text]
    header = text[: starts[0]].strip()
    parts, held, size = [], [], 0
    for a, b in zip(starts, [*starts[1:], len(text)]):
        clause = text[a:b].strip()
        if held and len(header) + size + len(clause) > most:
            parts.append(held)
            held, size = [], 0
        held.append(clause)
        size += len(clause)
    return ["\n".join([header, *p] if header else p) for p in [*parts, held]]


def with_clause_parts(rows: DataFrame, text: str, out: str, most: int = MAX_CHARS) -> DataFrame:
    """The rows with an array of parts of the text, cut at its numbered clauses (`clause_part_list`); null for null."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clause_part_list(t, most))

    return rows.withColumn(out, parts(F.col(text)))


def spans(rows: DataFrame, key: str, order: str, length: Column, range_size: int = 10_000) -> DataFrame:
    """Start and end of each row when the rows of a key are laid one after another.

    Rows are added up within ranges of the order (whole numbers), ranges pass on their totals: a hot key is no single task.
    """
    held = rows.withColumn("_range", F.expr(f"{order} div {range_size}")).withColumn("_n", length)
    w, ranges = Window.partitionBy(key, "_range").orderBy(order), Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(key, "_range").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(ranges), F.lit(0))).drop("_sum")
    within = held.withColumn("_in", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("_in") + F.col("_before")
    # laid end to end, a row ends where the next one starts
    return within.join(before, [key, "_range"]).select(*rows.columns, start.alias("start_char"), (start + F.col("_n")).alias("end_char"))


def previous(rows: DataFrame, key: str, order: str, value: str, out: str, range_size: int = 10_000) -> DataFrame:
    """The value of the row before in the order (whole numbers) of a key; ranges pass on their last value only."""
    held = rows.withColumn("_range", F.expr(f"{order} div {range_size}"))
    w, ranges = Window.partitionBy(key, "_range").orderBy(order), Window.partitionBy(key).orderBy("_range")
    before = held.groupBy(key, "_range").agg(F.max_by(value, order).alias("_end")).select(key, "_range", F.lag("_end").over(ranges).alias("_last"))
    within = held.withColumn("_i", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w))
    return within.join(before, [key, "_range"]).select(*rows.columns, F.when(F.col("_i") == 1, F.col("_last")).otherwise(F.col("_lag")).alias(out))
