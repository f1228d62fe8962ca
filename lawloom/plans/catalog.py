"""Registered queries of the pipeline's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, graph, indexing, indexrun, retrieval, stats, structure
from ..runtime import scratch, table
from ..sources import readers
from ..streaming.indexer import stream_index_report, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_TOKENS = "CAST(floor(length(text) / 3.5) AS INTEGER)"
_STATS = """count(*) AS chunks, sum(t)::BIGINT AS total_tokens, min(t) AS min_tokens, max(t) AS max_tokens, (sum(t) // count(t))::BIGINT AS avg_tokens,
  count(*) FILTER (t BETWEEN 800 AND 1200) AS in_range, round_even(100.0 * count(*) FILTER (t BETWEEN 800 AND 1200) / count(*), 1)::DOUBLE AS pct_in_range"""


@query(f"SELECT lang, {_STATS} FROM (SELECT lang, {_TOKENS} AS t FROM documents) GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", tx.token_estimate("text").alias("token_count"))
    return stats.group_stats(docs, "lang")


@query(f"SELECT lang, grouping(lang)::INTEGER AS is_total, {_STATS} FROM (SELECT lang, {_TOKENS} AS t FROM documents) GROUP BY ROLLUP (lang)")
def chunk_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token statistics per language and in total, in one pass over the documents."""
    docs = table(spark, sf_dir, "documents").select("lang", tx.token_estimate("text").alias("token_count"))
    return stats.rollup_stats(docs, "lang")


@query(
    """SELECT l.law_id, l.law_name AS name, l.source, count(*) AS chunks, sum(token_count)::BIGINT AS total_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
  (sum(token_count) // count(token_count))::BIGINT AS avg_tokens, count(*) FILTER (token_count BETWEEN 800 AND 1200) AS in_range,
  round_even(100.0 * count(*) FILTER (token_count BETWEEN 800 AND 1200) / count(*), 1)::DOUBLE AS pct_in_range, count(*) FILTER (has_overlap) AS chunks_with_overlap
FROM chunks c JOIN laws l ON c.source_law_id = l.law_id GROUP BY ALL"""
)
def law_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each registered law's chunks. Chunks are summed per law id first, then named: the join is small."""
    per = table(spark, sf_dir, "chunks").groupBy(F.col("source_law_id").alias("law_id")).agg(*stats.token_aggregates("token_count"), F.count_if("has_overlap").alias("chunks_with_overlap"))
    return per.join(table(spark, sf_dir, "laws").select("law_id", F.col("law_name").alias("name"), "source"), "law_id")


@query(f"SELECT lang, CASE WHEN t < 800 THEN 'short' WHEN t <= 1200 THEN 'in_range' ELSE 'long' END AS size_class, count(*) AS n FROM (SELECT lang, {_TOKENS} AS t FROM documents) GROUP BY ALL")
def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.token_estimate("text")
    kind = F.when(t < 800, "short").when(t <= 1200, "in_range").otherwise("long")
    return table(spark, sf_dir, "documents").groupBy("lang", kind.alias("size_class")).agg(F.count("*").alias("n"))


@query("SELECT source, l.law_id, law_name, count(*) AS records, sum(length(text))::BIGINT AS chars FROM records r JOIN laws l USING (law_id) GROUP BY ALL")
def registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and characters of each registered law, matched exactly by id."""
    rows = readers.registered(table(spark, sf_dir, "records").select("law_id", F.length("text").alias("n")), table(spark, sf_dir, "laws"))
    return rows.groupBy("source", "law_id", "law_name").agg(F.count("*").alias("records"), F.sum("n").alias("chars"))


@query("SELECT law_id, law_name FROM laws WHERE law_id NOT IN (SELECT law_id FROM documents WHERE law_id IS NOT NULL)")
def missing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.missing_laws(table(spark, sf_dir, "documents"), table(spark, sf_dir, "laws")).select("law_id", "law_name")


@query(
    """SELECT record_id, law_id, n AS article_no, row_number() OVER (PARTITION BY law_id, n ORDER BY record_id) AS nth_of_number
FROM (SELECT record_id, law_id, coalesce(try_cast(trim(split_part(article_id, '__', -1)) AS INTEGER), 0) AS n FROM records)"""
)
def article_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number a record is ordered by within its law, and its place among records of the same number."""
    rows = table(spark, sf_dir, "records").select("record_id", "law_id", tx.article_ordinal("article_id").alias("article_no"))
    return rows.withColumn("nth_of_number", F.row_number().over(Window.partitionBy("law_id", "article_no").orderBy("record_id")))


@query(
    """WITH r AS (SELECT *, coalesce(try_cast(trim(split_part(article_id, '__', -1)) AS INTEGER), 0) AS n FROM records)
SELECT law_id, arg_min(article_id, (n, record_id)) AS first_article, arg_max(article_id, (n, record_id)) AS last_article, sum(length(text))::BIGINT AS chars FROM r WHERE article_id IS NOT NULL GROUP BY law_id"""
)
def law_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last article and all characters of each law."""
    rows = table(spark, sf_dir, "records").where("article_id is not null").select("law_id", "article_id", "record_id", tx.article_ordinal("article_id").alias("n"), F.length("text").alias("c"))
    key = F.struct("n", "record_id")
    return rows.groupBy("law_id").agg(F.min_by("article_id", key).alias("first_article"), F.max_by("article_id", key).alias("last_article"), F.sum("c").alias("chars"))


def _tidy_sql(x: str) -> str:
    """SQL that tidies the lines of an expression as `tidy_lines` does."""
    edge = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
    lines = rf"list_aggregate(list_transform(string_split(regexp_replace({x}, '\n{{3,}}', e'\n\n', 'g'), e'\n'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), {edge})), 'string_agg', e'\n')"
    return rf"regexp_replace(regexp_replace({lines}, '\n{{3,}}', e'\n\n', 'g'), {edge})"


def _clean_sql(c: str) -> str:
    """SQL of `clean_text`, for the four entities that the records hold."""
    plain = f"coalesce({c}, '')"
    for _ in range(2):
        for entity, sign in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
            plain = f"replace({plain}, '{entity}', {sign})"
    plain = rf"regexp_replace(nfc_normalize(regexp_replace({plain}, '<[^>]+>', ' ', 'g')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    return _tidy_sql(rf"regexp_replace({plain}, '\r\n?', e'\n', 'g')")


@query(f"SELECT record_id, {_clean_sql('title')} AS title, {_clean_sql('text')} AS text FROM records")
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("record_id", tx.clean_text("title").alias("title"), tx.clean_text("text").alias("text"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(coalesce(text, ''), '\n{3,}', e'\n\n', 'g'), e'\n'),
  lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 'string_agg', e'\n'), '\n{3,}', e'\n\n', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS tidy_md5 FROM documents"""
)
def tidy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line part of the cleaning on all documents, by hash."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.doc_hash(tx.tidy_lines(F.coalesce("text", F.lit("")))).alias("tidy_md5"))


@query(
    f"""WITH c AS (SELECT law_id, record_id AS k, {_clean_sql('title')} AS t, {_clean_sql('text')} AS b,
  coalesce(try_cast(translate(list_extract(string_split(article_id, '__'), -1), '０１２３４５６７８９', '0123456789') AS INTEGER), 0) AS n FROM records),
p AS (SELECT law_id, k, n, CASE WHEN t <> '' AND b <> '' THEN t || e'\\n' || b ELSE t || b END AS part FROM c WHERE t <> '' OR b <> ''),
f AS (SELECT law_id, floor(n / 500)::BIGINT AS block, string_agg(part, e'\\n\\n' ORDER BY n, k) AS x FROM p GROUP BY ALL)
SELECT law_id, block, length(x) AS chars, (length(x) // 3500)::BIGINT AS pages, md5(x) AS md5 FROM f"""
)
def reconstruct_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of each law in blocks of articles, by length and hash."""
    laws = chunking.reconstruct(table(spark, sf_dir, "records"))
    return laws.select("law_id", "block", F.length("full_text").alias("chars"), tx.page_estimate("full_text").alias("pages"), tx.doc_hash("full_text").alias("md5"))


@query(
    r"""SELECT doc_id, count(*) AS articles, min(CAST(regexp_extract(h, 'Điều\s+(\d+)', 1) AS INTEGER)) AS first_no, max(CAST(regexp_extract(h, 'Điều\s+(\d+)', 1) AS INTEGER)) AS last_no
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^Điều\s+\d+[\.:]\s*.*')) AS h FROM documents) GROUP BY doc_id"""
)
def article_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article headings of every document."""
    found = structure.headings(table(spark, sf_dir, "documents"), "doc_id", "text").where("kind = 'article'")
    number = F.regexp_extract("heading", r"(?U)Điều\s+(\d+)", 1).cast("int")
    return found.groupBy("doc_id").agg(F.count("*").alias("articles"), F.min(number).alias("first_no"), F.max(number).alias("last_no"))


@query(
    r"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '(?m)^Điều[\s\p{Z}]+\p{Nd}+[\.:][\s\p{Z}]*.*') AS g, regexp_extract_all(text, '(?m)^Điều[\s\p{Z}]+\p{Nd}+[\.:][\s\p{Z}]*.*') AS f FROM documents),
i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
u AS (SELECT doc_id, 'c' AS kind, string_split_regex(text, '(?m)^Chương[\s\p{Z}]+[IVXLCDM\p{Nd}]+[\.:]*[\s\p{Z}]*.*') AS g, regexp_extract_all(text, '(?m)^Chương[\s\p{Z}]+[IVXLCDM\p{Nd}]+[\.:]*[\s\p{Z}]*.*') AS f FROM documents
  UNION ALL SELECT doc_id, 's', string_split_regex(text, '(?m)^Mục[\s\p{Z}]+\p{Nd}+[\.:]*[\s\p{Z}]*.*'), regexp_extract_all(text, '(?m)^Mục[\s\p{Z}]+\p{Nd}+[\.:]*[\s\p{Z}]*.*') FROM documents),
h AS (SELECT doc_id, kind, f[j] AS h, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:j - 1], lambda x: length(x))), 0) AS pos FROM (SELECT *, unnest(range(1, len(f) + 1)) AS j FROM u)),
o AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS pos FROM i)
SELECT doc_id, (i - 1)::INTEGER AS art_ord, coalesce(try_cast(regexp_extract(f[i], '(\p{Nd}+)', 1) AS INTEGER), i)::INTEGER AS number, regexp_replace(regexp_extract(f[i], '^Điều[\s\p{Z}]+\p{Nd}+[\.:][\s\p{Z}]*(.*)', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title,
  coalesce((SELECT arg_max(trim(h.h), h.pos) FROM h WHERE h.doc_id = o.doc_id AND h.kind = 'c' AND h.pos <= o.pos), '') AS chapter,
  coalesce((SELECT arg_max(trim(h.h), h.pos) FROM h WHERE h.doc_id = o.doc_id AND h.kind = 's' AND h.pos <= o.pos), '') AS section,
  length(regexp_replace(f[i] || coalesce(g[i + 1], ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))::INTEGER AS char_count FROM o
UNION ALL SELECT doc_id, 0, 0, '(Toàn văn)', '', '', length(text)::INTEGER FROM m WHERE len(f) = 0"""
)
def extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of every document with number, title, size and context."""
    return structure.extract_articles(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "art_ord", "number", "title", "chapter", "section", "char_count")


@query(
    r"""SELECT kind, count(*) AS n FROM (
  SELECT 'article' AS kind, unnest(regexp_extract_all(text, '(?m)^Điều\s+\d+[\.:]\s*.*')) AS h FROM documents
  UNION ALL SELECT 'clause', unnest(regexp_extract_all(text, '(?m)^\s*\d+\.\s+')) FROM documents
  UNION ALL SELECT 'point', unnest(regexp_extract_all(text, '(?m)^\s*[a-zđ]\)\s+')) FROM documents
  UNION ALL SELECT 'chapter', unnest(regexp_extract_all(text, '(?m)^Chương\s+[IVXLCDM\d]+[\.:]*\s*.*')) FROM documents
  UNION ALL SELECT 'section', unnest(regexp_extract_all(text, '(?m)^Mục\s+\d+[\.:]*\s*.*')) FROM documents) GROUP BY kind"""
)
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural markers of all documents by kind."""
    return structure.markers(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    r"""WITH m AS (SELECT record_id, text, kind, string_split_regex(text, p) AS g, regexp_extract_all(text, p) AS f FROM records, (VALUES ('article', '(?m)^Điều[\s\p{Z}\x0b\x1c-\x1f\x{85}]+\p{Nd}+[\.:][\s\p{Z}\x0b\x1c-\x1f\x{85}]*.*'), ('chapter', '(?m)^Chương[\s\p{Z}\x0b\x1c-\x1f\x{85}]+[IVXLCDM\p{Nd}]+[\.:]*[\s\p{Z}\x0b\x1c-\x1f\x{85}]*.*'),
  ('section', '(?m)^Mục[\s\p{Z}\x0b\x1c-\x1f\x{85}]+\p{Nd}+[\.:]*[\s\p{Z}\x0b\x1c-\x1f\x{85}]*.*'), ('clause', '(?m)^[\s\p{Z}\x0b\x1c-\x1f\x{85}]*\p{Nd}+\.[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), ('point', '(?m)^[\s\p{Z}\x0b\x1c-\x1f\x{85}]*[a-zđ]\)[\s\p{Z}\x0b\x1c-\x1f\x{85}]+')) k(kind, p) WHERE text IS NOT NULL),
i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
o AS (SELECT *, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::INTEGER AS pos FROM i)
SELECT record_id, kind, pos, substring(text, pos + 1, length(f[i]) + 20) AS context FROM o"""
)
def marker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structural marker of every record with its position and what follows it."""
    return structure.markers(table(spark, sf_dir, "records"), "record_id", "text")


@query(
    """SELECT o.event_id, o.user_id, v.ts AS viewed_at FROM (SELECT * FROM events WHERE event_type = 'purchase') o
ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view' AND user_id IS NOT NULL) v ON o.user_id = v.user_id AND o.ts >= v.ts"""
)
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last view at or before it: the as-of lookup of headings on the event table."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view")).select("event_id", "user_id", "event_type", "ts", F.col("ts").alias("at"))
    found = structure.carry_forward(rows, "user_id", "ts", "event_type", "at", ("view",), part=F.to_date("ts"))
    return found.where("event_type = 'purchase'").select("event_id", "user_id", F.col("view").alias("viewed_at"))


@query(
    """SELECT chunk_key, start_char, coalesce(lead(start_char) OVER (PARTITION BY document_name ORDER BY chunk_key), start_char + n) AS end_char
FROM (SELECT chunk_key, document_name, n, coalesce(sum(n) OVER (PARTITION BY document_name ORDER BY chunk_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
  FROM (SELECT chunk_key, document_name, length(text) AS n FROM chunks))"""
)
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each chunk in the sequence of its document's chunks."""
    rows = table(spark, sf_dir, "chunks").select("chunk_key", "document_name", F.length("text").cast("bigint").alias("n"))
    return structure.spans(rows, "document_name", "chunk_key", F.col("n")).select("chunk_key", "start_char", "end_char")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, doc_id // 500 AS part, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS i, n_chars AS n FROM documents),
f AS (SELECT part, doc_id, i, CASE WHEN n >= 2800 THEN 1 ELSE 0 END AS g, 0 AS own, CASE WHEN n >= 2800 THEN 0 ELSE n END AS open, n < 2800 AS pending FROM d WHERE i = 1
UNION ALL SELECT d.part, d.doc_id, d.i,
  CASE WHEN d.n >= 2800 OR f.open + d.n >= 2800 THEN 1 ELSE 0 END + (CASE WHEN d.n >= 2800 AND f.pending THEN f.g + 1 ELSE f.g END),
  CASE WHEN d.n >= 2800 AND f.pending THEN f.g + 1 ELSE f.g END, CASE WHEN d.n >= 2800 OR f.open + d.n >= 2800 THEN 0 ELSE f.open + d.n END, NOT (d.n >= 2800 OR f.open + d.n >= 2800)
  FROM f JOIN d ON d.part = f.part AND d.i = f.i + 1),
e AS (SELECT part, arg_max(g, i) AS lastg, arg_max(pending, i) AS pending FROM f GROUP BY part)
SELECT f.part, f.doc_id, CASE WHEN e.pending AND e.lastg > 0 AND f.own = e.lastg THEN f.own - 1 ELSE f.own END AS grp FROM f JOIN e USING (part)"""
)
def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of short texts: all documents as articles of laws of 500 consecutive ids."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 500").alias("part"), "doc_id", "n_chars")
    laws = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))).alias("a"))
    groups = structure.merge_groups(F.transform("a", lambda x: x["n_chars"]))
    return laws.select("part", F.explode(F.arrays_zip(F.transform("a", lambda x: x["doc_id"]).alias("doc_id"), groups.alias("grp"))).alias("z")).select("part", "z.doc_id", "z.grp")


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, l_linenumber, CAST(l_quantity * 40 AS BIGINT) AS n FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, i, 0 AS part, n AS filled FROM s WHERE i = 1
UNION ALL SELECT s.l_orderkey, s.l_linenumber, s.i, CASE WHEN 20 + f.filled + s.n > 4200 THEN f.part + 1 ELSE f.part END, CASE WHEN 20 + f.filled + s.n > 4200 THEN s.n ELSE f.filled + s.n END
  FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.i = f.i + 1)
SELECT l_orderkey, l_linenumber, part FROM f"""
)
def pack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of segments under a size: the lines of each order as clauses."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).cast("bigint").alias("n"))
    held = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "n"))).alias("a"))
    parts = structure.pack_clauses(F.transform("a", lambda x: x["n"]), F.lit(20))
    return held.select("l_orderkey", F.explode(F.arrays_zip(F.transform("a", lambda x: x["l_linenumber"]).alias("l_linenumber"), parts.alias("part"))).alias("z")).select("l_orderkey", "z.l_linenumber", "z.part")


_B = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


@query(
    rf"""WITH RECURSIVE m AS (SELECT chunk_key, text, string_split_regex(text, '(?m)^{_B}*\p{{Nd}}+\.{_B}+') AS g, regexp_extract_all(text, '(?m)^{_B}*\p{{Nd}}+\.{_B}+') AS f FROM chunks WHERE length(text) > 4200),
s AS (SELECT chunk_key, i, regexp_replace(f[i] || coalesce(g[i + 1], ''), '^{_B}+|{_B}+$', '', 'g') AS seg, regexp_replace(g[1], '^{_B}+|{_B}+$', '', 'g') AS header FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) >= 2)),
p AS (SELECT chunk_key, i, seg, header, 0 AS part, length(seg) AS filled FROM s WHERE i = 1
UNION ALL SELECT s.chunk_key, s.i, s.seg, s.header, CASE WHEN length(s.header) + p.filled + length(s.seg) > 4200 THEN p.part + 1 ELSE p.part END, CASE WHEN length(s.header) + p.filled + length(s.seg) > 4200 THEN length(s.seg) ELSE p.filled + length(s.seg) END
  FROM p JOIN s ON s.chunk_key = p.chunk_key AND s.i = p.i + 1),
q AS (SELECT chunk_key, part, CASE WHEN any_value(header) <> '' THEN any_value(header) || chr(10) ELSE '' END || string_agg(seg, chr(10) ORDER BY i) AS x FROM p GROUP BY chunk_key, part
UNION ALL SELECT chunk_key, 0, text FROM m WHERE len(f) < 2)
SELECT chunk_key, part AS part_no, length(x)::INTEGER AS chars, md5(x) AS md5 FROM q"""
)
def clause_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk larger than the limit cut at its clauses."""
    rows = table(spark, sf_dir, "chunks").select("chunk_key", "text").where(F.length("text") > structure.MAX_CHARS)
    return structure.with_clause_parts(rows, "text", "parts").select("chunk_key", F.posexplode("parts").alias("part_no", "part")).select("chunk_key", "part_no", F.length("part").alias("chars"), tx.doc_hash("part").alias("md5"))


@query()
def overlap_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of each chunk with the chunk before in its document, at most 350 characters where sentences allow."""
    # the end of each text is cut in the map; only ends are shuffled
    rows = table(spark, sf_dir, "chunks").select("chunk_key", "document_name", tx.overlap_tail("text", structure.OVERLAP_CHARS).alias("tail"))
    return structure.previous(rows, "document_name", "chunk_key", "tail", "overlap").select("chunk_key", F.coalesce("overlap", F.lit("")).alias("overlap"))


@query()
def chunk_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline on the laws: clean, order, join, extract, merge, split, overlap, ids."""
    laws = chunking.reconstruct(table(spark, sf_dir, "records"))
    named = laws.join(table(spark, sf_dir, "laws").select("law_id", "law_name"), "law_id")
    return chunking.chunk_documents(named.select("law_id", "block", F.col("law_name").alias("document_name"), "full_text"))


@query(
    r"""SELECT chunk_key, p || regexp_extract(document_name, '(\d{4})', 1) || CASE WHEN article_number > 0 THEN printf('_dieu_%03d', article_number) ELSE printf('_chunk_%04d', chunk_key) END AS new_id
FROM (SELECT *, CASE WHEN contains(n, 'dân sự') THEN 'blds' WHEN contains(n, 'doanh nghiệp') THEN 'ldn' WHEN contains(n, 'trọng tài') THEN 'lttm' WHEN contains(n, 'thương mại') THEN 'ltm'
  WHEN contains(n, 'lao động') THEN 'blld' WHEN contains(n, 'nhà ở') THEN 'lno' WHEN contains(n, 'bất động sản') OR contains(n, 'kinh doanh bds') THEN 'lkdbds'
  ELSE array_to_string(list_filter(list_transform(regexp_extract_all(n, '[\p{L}\p{N}\p{M}_]+'), lambda x: substring(x, 1, 1)), lambda x: regexp_full_match(x, '\p{L}')), '') END AS p
FROM (SELECT chunk_key, document_name, article_number, lower(document_name) AS n FROM chunks))"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from document names and article numbers."""
    no = F.col("article_number")
    made = tx.chunk_id(tx.document_prefix("document_name"), no, no, F.lit(False), F.lit(0), F.col("chunk_key"))
    return table(spark, sf_dir, "chunks").select("chunk_key", made.alias("new_id"))


@query(
    """SELECT chunk_key, md5('[Nguồn: ' || coalesce(source_law_id, '') || CASE WHEN article_number <> 0 THEN ' | Điều ' || article_number ELSE '' END || e']\\n' || coalesce(text, '')) AS md5 FROM chunks"""
)
def headered_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's text under its header, by hash."""
    text = tx.headered(tx.falsy_coalesce("source_law_id"), tx.falsy_coalesce(F.nullif(F.col("article_number"), F.lit(0))), F.lit(""), tx.falsy_coalesce("text"))
    return table(spark, sf_dir, "chunks").select("chunk_key", tx.doc_hash(text).alias("md5"))


@query("SELECT doc_id, md5(text) AS doc_hash FROM documents")
def doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.doc_hash("text").alias("doc_hash"))


@query("SELECT chunk_key, md5(text) AS doc_hash FROM chunks WHERE md5(text) NOT IN (SELECT doc_hash FROM index_log WHERE status = 'completed')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose text is not indexed yet."""
    return indexing.remaining(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_log")).select("chunk_key", "doc_hash")


@query("SELECT min(chunk_key) AS chunk_key, md5(text) AS doc_hash FROM chunks WHERE md5(text) NOT IN (SELECT doc_hash FROM index_log WHERE status = 'completed') GROUP BY md5(text)")
def resume_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As resume_anti_join, with equal texts only once."""
    return indexing.remaining(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_log"), once=True).select("chunk_key", "doc_hash")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def in_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per distinct text, and its copies."""
    return table(spark, sf_dir, "documents").groupBy(tx.doc_hash("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT chunk_key, log_id, status, attempt, doc_hash FROM index_log WHERE chunk_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_key ORDER BY event_at DESC, log_id DESC) = 1")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.latest_status(table(spark, sf_dir, "index_log"))


@query("SELECT status, count(*) AS n, count(DISTINCT doc_hash) AS texts FROM index_log GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_log").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("doc_hash").alias("texts"))


@query(
    """SELECT count(*) AS failed_once, count(*) FILTER (s > 0) AS recovered, count(*) FILTER (s = 0) AS still_failed
FROM (SELECT chunk_key, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'completed') AS s FROM index_log WHERE chunk_key IS NOT NULL GROUP BY chunk_key) WHERE f > 0"""
)
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.retry_outcome(table(spark, sf_dir, "index_log"))


@query("SELECT coalesce(source_law_id, 'unknown') AS law_id, count(*) AS n FROM chunks GROUP BY ALL")
def count_by_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy(F.coalesce("source_law_id", F.lit("unknown")).alias("law_id")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(event_type, '?') AS entity_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, entity_type")
def entity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_histogram(table(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT law_id AS entity_id, coalesce(legal_domain, 'UNKNOWN') AS entity_type, law_name AS description, '' AS source_id, coalesce(file_name, 'unknown_source') AS file_path, 0 AS created_at, '' AS truncate FROM laws"""
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws as nodes, with defaults for missing attributes."""
    laws = table(spark, sf_dir, "laws").select("law_id", F.col("legal_domain").alias("entity_type"), F.col("law_name").alias("description"), F.col("file_name").alias("file_path"))
    return graph.nodes(laws, "law_id")


@query(
    """SELECT 'rel-' || md5(lower(document_name) || lower(lang)) AS rel_id, document_name AS src_id, lang AS tgt_id, '' AS description, '' AS keywords, count(*)::DOUBLE AS weight, '' AS source_id,
  'unknown_source' AS file_path, 0 AS created_at, '' AS truncate FROM chunks WHERE lang IS NOT NULL GROUP BY document_name, lang"""
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document names and languages as edges weighted by chunks."""
    rows = table(spark, sf_dir, "chunks").where("lang is not null").groupBy(F.col("document_name").alias("src_id"), F.col("lang").alias("tgt_id")).agg(F.count("*").cast("double").alias("weight"))
    return graph.edges(rows)


@query(
    """WITH m AS (SELECT document_name AS entity, coalesce(lang, 'UNKNOWN') AS entity_type, chunk_id AS chunk FROM chunks),
t AS (SELECT entity, entity_type, count(*) AS n FROM m GROUP BY ALL)
SELECT t.entity, arg_min(entity_type, (-n, entity_type)) AS entity_type, sum(n)::BIGINT AS mentions, any_value(c.chunks) AS chunks
FROM t JOIN (SELECT entity, count(DISTINCT chunk) AS chunks FROM m GROUP BY entity) c USING (entity) GROUP BY t.entity"""
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of documents in chunks merged: the most frequent language, mentions, chunks."""
    rows = table(spark, sf_dir, "chunks").select(F.col("document_name").alias("entity"), F.coalesce("lang", F.lit("UNKNOWN")).alias("entity_type"), F.col("chunk_id").alias("chunk"))
    return graph.merge_mentions(rows)


@query("SELECT DISTINCT o_custkey, unnest(list_filter(list_transform(string_split(o_orderstatus || '<SEP> ' || o_orderpriority || '<SEP>', '<SEP>'), lambda x: trim(x)), lambda x: x <> '')) AS chunk_id FROM orders")
def sep_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined lists as rows of key and part."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat("o_orderstatus", F.lit("<SEP> "), "o_orderpriority", F.lit("<SEP>")).alias("source_id"))
    return graph.chunk_bridge(rows, "o_custkey")


@query(
    """SELECT c_custkey, 0 AS record_no, 'entity' AS kind, c_name AS name, c_mktsegment AS type_or_target, 'khach' AS description, NULL::DOUBLE AS strength FROM customer
UNION ALL SELECT c_custkey, 1, 'relationship', c_name, c_mktsegment, 'thuoc', (c_nationkey % 10)::DOUBLE FROM customer"""
)
def tuple_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records of a model parsed: customers written in that format and read back, a broken record left out."""
    one = F.concat(F.lit('("entity"<|>'), "c_name", F.lit("<|>"), "c_mktsegment", F.lit('<|>khach)##("relationship"<|>'), "c_name", F.lit("<|>"), "c_mktsegment", F.lit("<|>thuoc<|>"), (F.col("c_nationkey") % 10).cast("string"), F.lit(')##("entity"<|>x)'))
    return graph.parse_extractions(table(spark, sf_dir, "customer").select("c_custkey", one.alias("out")), "c_custkey", "out")


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS high, p_brand AS low FROM part")
def keyword_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword objects of a model parsed: parts written in that format and read back."""
    text = F.to_json(F.struct(F.split("p_type", " ").alias("high_level_keywords"), F.array("p_brand").alias("low_level_keywords")))
    return table(spark, sf_dir, "part").select("p_partkey", graph.parse_keywords(text).alias("k")).select("p_partkey", F.element_at("k.high_level_keywords", 1).alias("high"), F.element_at("k.low_level_keywords", 1).alias("low"))


_SCORES = """q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS own, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)"""


@query(f"WITH {_SCORES} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every hundredth, exactly."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(rows, rows.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", "rank")


@query(
    f"""WITH {_SCORES}, a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label % 2 = 0 QUALIFY rank <= 5),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label % 2 = 1 QUALIFY rank <= 5),
m AS (SELECT query_id, vec_id, min(rank) AS best_rank, count(*) AS levels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, levels DESC, vec_id) AS position FROM m QUALIFY position <= 6"""
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual-level retrieval: vectors with even labels as entities, with odd ones as relations."""
    rows = table(spark, sf_dir, "embeddings")
    ask = rows.where("vec_id % 100 = 0")
    return retrieval.dual_level(retrieval.top_k(rows.where("label % 2 = 0"), ask, 5), retrieval.top_k(rows.where("label % 2 = 1"), ask, 5), 6)


@query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every chunk under the deterministic stand-in for a model."""
    return retrieval.embed(table(spark, sf_dir, "chunks").select("chunk_key", "text"), "text").select("chunk_key", F.size("embedding").alias("dim"), F.element_at("embedding", 1).alias("first"))


@query("SELECT document_name, chunk_id, text, source_law_id AS law_id, article_number, token_count AS estimated_tokens, has_overlap FROM chunks")
def nested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with nested metadata, flattened again."""
    return chunking.nested_chunks(table(spark, sf_dir, "chunks")).select("document_name", "chunk_id", "text", "metadata.law_id", "metadata.article_number", "metadata.estimated_tokens", "metadata.has_overlap")


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END AS preview, (length(text) // 3500)::BIGINT AS pages FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview("text", 400).alias("preview"), tx.page_estimate("text").alias("pages"))


@query(r"SELECT law_id, replace(regexp_replace(regexp_replace(law_name, '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), ' ', '_') || '.txt' AS file FROM laws")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "laws").select("law_id", tx.safe_file_name("law_name").alias("file"))


@query(
    "SELECT CASE WHEN length(trim(text)) > 0 THEN 'completed' ELSE 'failed' END AS status, count(*) AS chunks, count(DISTINCT md5(text)) AS texts FROM chunks GROUP BY ALL"
)
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resumable index as a stream over all chunk files; one file is one batch."""
    return stream_index_report(spark, sf_dir)


@query("SELECT l.source, r.law_id, l.law_rank, count(*) AS records FROM records r JOIN laws l USING (law_id) GROUP BY ALL")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both sources as one tagged table, each source with the laws the registry names for it."""
    records, laws = table(spark, sf_dir, "records"), table(spark, sf_dir, "laws")
    return readers.union_sources(laws, hub=records, local=records).groupBy("source", "law_id", "law_rank").agg(F.count("*").alias("records"))


@query("SELECT chunk_key, law_rank, dense_rank() OVER (ORDER BY law_rank)::INTEGER AS place FROM chunks JOIN laws ON source_law_id = law_id")
def law_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in the order of output: laws by rank, with the place of their law among those that have chunks."""
    ordered = indexing.in_law_order(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "laws"))
    # places are told on the ranks that occur, one row per law
    ranks = ordered.select("law_rank").distinct().withColumn("place", F.expr("row_number() over (order by law_rank)"))
    return ordered.join(ranks, "law_rank").select("chunk_key", "law_rank", "place")


@query(f"SELECT source_law_id AS law_id, grouping(source_law_id)::INTEGER AS is_total, {_STATS}, count(*) FILTER (has_overlap) AS chunks_with_overlap FROM (SELECT *, token_count AS t FROM chunks) GROUP BY ROLLUP (source_law_id)")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run: statistics per law and in total, in one pass."""
    rows = table(spark, sf_dir, "chunks").withColumnRenamed("source_law_id", "law_id")
    return rows.rollup("law_id").agg(F.grouping("law_id").cast("int").alias("is_total"), *stats.token_aggregates("token_count"), F.count_if("has_overlap").alias("chunks_with_overlap"))


@query("SELECT status, count(*) AS n, (count(*) * 100 // (SELECT count(*) FROM index_log))::INTEGER AS pct FROM index_log GROUP BY status")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.status_shares(table(spark, sf_dir, "index_log"))


@query(
    """SELECT chunk_key, doc_hash, attempt + 1 AS next_attempt FROM (SELECT * FROM index_log WHERE chunk_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_key ORDER BY event_at DESC, log_id DESC) = 1) WHERE status = 'failed'"""
)
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to be tried again: those whose last attempt failed."""
    return indexing.retry_queue(table(spark, sf_dir, "index_log"))


@query("SELECT article_id, record_id, law_id, md5(text) AS md5 FROM records QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC, record_id DESC) = 1")
def upsert_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles delivered more than once: the last delivery of each id stands."""
    rows = table(spark, sf_dir, "records").select("article_id", "record_id", "law_id", "ingested_at", F.md5(F.col("text").cast("binary")).alias("md5"))
    return indexing.upsert_last(rows, "article_id", "ingested_at", "record_id").select("article_id", "record_id", "law_id", "md5")


@query(
    """SELECT rel_id, chunk_key, weight FROM (SELECT 'rel-' || md5(lower(document_name) || lower(chunk_id)) AS rel_id, chunk_key, token_count AS weight FROM chunks)
QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY chunk_key DESC) = 1"""
)
def upsert_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations written more than once: the last one of each id stands."""
    rows = table(spark, sf_dir, "chunks").select(tx.relation_id("document_name", "chunk_id").alias("rel_id"), "chunk_key", F.col("token_count").alias("weight"))
    return indexing.upsert_last(rows, "rel_id", "chunk_key")


@query(
    """SELECT doc_id, md5('Answer in ' || coalesce(lang, '') || ' from ' || source || e':\\n' || text || e'\\n{unknown}') AS md5 FROM documents"""
)
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt per document: the template's names filled, null as empty, other braces left."""
    prompt = indexrun.fill_prompt("Answer in {lang} from {source}:\n{text}\n{unknown}", lang="lang", source="source", text="text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.doc_hash(prompt).alias("md5"))


@query(
    """WITH n AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders), e AS (SELECT 'o' || l_orderkey AS s, 's' || l_suppkey AS t FROM lineitem UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)) AS complete_edges"""
)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the graph of customers, orders and suppliers (who are no nodes)."""
    node = lambda name, c, p: table(spark, sf_dir, name).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("entity_id"))
    edge = lambda name, a, p, b, q: table(spark, sf_dir, name).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src_id"), F.concat(F.lit(q), F.col(b).cast("string")).alias("tgt_id"))
    edges = edge("lineitem", "l_orderkey", "o", "l_suppkey", "s").unionByName(edge("orders", "o_orderkey", "o", "o_custkey", "c"))
    return graph.graph_counts(node("customer", "c_custkey", "c").unionByName(node("orders", "o_orderkey", "o")), edges)


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
SELECT l_orderkey, (i - 1)::INTEGER AS art_ord, l_linenumber::INTEGER AS number, l_partkey::VARCHAR AS title,
  CASE WHEN i >= 2 THEN 'Chương ' || (i // 2) || '. ' || first_value(l_returnflag) OVER (PARTITION BY l_orderkey, i // 2 ORDER BY i) ELSE '' END AS chapter,
  CASE WHEN i >= 3 THEN 'Mục ' || (i // 3) || '. ' || first_value(l_linestatus) OVER (PARTITION BY l_orderkey, i // 3 ORDER BY i) ELSE '' END AS section FROM l"""
)
def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter and section of every article: orders written as laws, a chapter before each second line and a section before
    each third, and read back."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("a"))

    def article(x, i):
        n = i + 1
        chapter = F.when(n % 2 == 0, F.concat(F.lit("Chương "), F.floor(n / 2), F.lit(". "), x["l_returnflag"], F.lit("\n"))).otherwise(F.lit(""))
        section = F.when(n % 3 == 0, F.concat(F.lit("Mục "), F.floor(n / 3), F.lit(". "), x["l_linestatus"], F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(chapter, section, F.lit("Điều "), x["l_linenumber"], F.lit(". "), x["l_partkey"], F.lit("\n1. body\n"))

    texts = lines.select("l_orderkey", F.array_join(F.transform("a", article), "").alias("text"))
    return structure.extract_articles(texts, "l_orderkey", "text").select("l_orderkey", "art_ord", "number", "title", "chapter", "section")


_LAW_OF_TEXT = r"SELECT md5(text) AS h, regexp_replace(arg_min(coalesce(source_law_id, ''), chunk_key), '^[\s]+|[\s]+$', '', 'g') AS law, arg_min(chunk_id, chunk_key) AS chunk FROM chunks GROUP BY 1"


@query(
    f"""WITH t AS ({_LAW_OF_TEXT})
SELECT 'entity' AS kind, law AS name, 'LAW' AS told, count(*) AS mentions, count(DISTINCT chunk) AS chunks, count(*)::DOUBLE AS weight, 'a law' AS description FROM t GROUP BY law
UNION ALL SELECT 'entity', 'VN', 'PLACE', count(*), count(DISTINCT chunk), count(*)::DOUBLE, 'a country' FROM t
UNION ALL SELECT 'relation', law, 'VN', count(*), count(DISTINCT chunk), 2.0 * count(*), 'holds in' FROM t GROUP BY law"""
)
def index_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index run over all chunks with a stand-in for the model that names each text's law and its country: prompts,
    answers, parsing, merged entities and relations."""
    folder = scratch(spark, "index")
    chunks = table(spark, sf_dir, "chunks")

    def model(prompt: str) -> str:
        law = prompt.split("\n", 1)[0].removeprefix("List the entities and relationships of the text of ").removesuffix(".")
        return f'("entity"<|>{law}<|>LAW<|>a law)##("entity"<|>VN<|>PLACE<|>a country)##("relationship"<|>{law}<|>VN<|>holds in<|>2)##("entity"<|>broken)'

    indexrun.run_index(chunks, folder, model)
    tables = indexrun.build_graph(indexrun.read_extractions(spark, folder), chunks)
    entities = tables["entities"].select(F.lit("entity").alias("kind"), F.col("entity").alias("name"), F.col("entity_type").alias("told"), "mentions", "chunks", F.col("mentions").cast("double").alias("weight"), "description")
    return entities.unionByName(tables["relations"].select(F.lit("relation").alias("kind"), F.col("src_id").alias("name"), F.col("tgt_id").alias("told"), "mentions", "chunks", "weight", "description"))


@query(
    """SELECT entity, sum(n)::BIGINT AS mentions, arg_min(entity_type, (-n, entity_type)) AS entity_type, any_value(chunks) AS chunks, coalesce(any_value(d), '') AS description
FROM (SELECT document_name AS entity, coalesce(lang, 'UNKNOWN') AS entity_type, count(*) AS n FROM chunks GROUP BY ALL)
JOIN (SELECT document_name AS entity, count(DISTINCT chunk_id) AS chunks, string_agg(DISTINCT nullif(section_context, ''), '<SEP>' ORDER BY nullif(section_context, '')) AS d FROM chunks GROUP BY 1) USING (entity) GROUP BY entity"""
)
def entity_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities with type and the distinct sections of their chunks as descriptions."""
    rows = table(spark, sf_dir, "chunks").select(F.col("document_name").alias("entity"), F.coalesce("lang", F.lit("UNKNOWN")).alias("entity_type"), F.col("section_context").alias("description"), F.col("chunk_id").alias("chunk"))
    return graph.merge_entities(rows)


@query(
    """SELECT 'rel-' || md5(lower(src_id) || lower(tgt_id)) AS rel_id, *, FROM (SELECT document_name AS src_id, lang AS tgt_id, sum(coalesce(token_count, 1))::DOUBLE AS weight, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks,
  coalesce(string_agg(DISTINCT nullif(chapter_context, ''), '<SEP>' ORDER BY nullif(chapter_context, '')), '') AS description FROM chunks WHERE lang IS NOT NULL GROUP BY ALL)"""
)
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and languages as relations: summed strength, distinct descriptions, chunks."""
    rows = table(spark, sf_dir, "chunks").where("lang is not null")
    return graph.merge_relations(rows.select(F.col("document_name").alias("src_id"), F.col("lang").alias("tgt_id"), F.col("chapter_context").alias("description"), F.col("token_count").cast("double").alias("strength"), F.col("chunk_id").alias("chunk")))


@query("SELECT document_name AS entity, 0 AS part_no, count(DISTINCT chunk_id) AS chunks, string_agg(DISTINCT chunk_id, '<SEP>' ORDER BY chunk_id) AS chunk_ids FROM chunks GROUP BY 1")
def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each entity as joined lists, in parts where they are many."""
    return graph.id_lists(table(spark, sf_dir, "chunks").select(F.col("document_name").alias("entity"), F.col("chunk_id").alias("chunk")), ["entity"])


@query(
    f"""WITH {_SCORES}, a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label % 2 = 0 QUALIFY rank <= 5),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label % 2 = 1 QUALIFY rank <= 5),
m AS (SELECT query_id, vec_id, min(rank) AS best_rank, count(*) AS levels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL),
h AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, levels DESC, vec_id) AS position FROM m QUALIFY position <= 6),
c AS (SELECT query_id, doc_id AS chunk_key, min(position) AS best, count(*) AS hits FROM h JOIN documents ON doc_id % 300 = vec_id % 300 GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS place, sum(n_chars // 4) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS filled FROM (SELECT c.*, n_chars FROM c JOIN documents ON doc_id = chunk_key) WINDOW w AS (PARTITION BY query_id ORDER BY best, hits DESC, chunk_key))
SELECT query_id, chunk_key, best, hits, place, filled FROM o WHERE filled <= 8000"""
)
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind the hits of both levels, in order, within the budget of the context."""
    hits = hybrid_retrieve(spark, sf_dir).select("query_id", "vec_id", "position")
    docs = table(spark, sf_dir, "documents")
    bridge = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 300).alias("r")).join(docs.select(F.col("doc_id").alias("chunk_key"), (F.col("doc_id") % 300).alias("r")), "r").drop("r")
    return retrieval.hybrid_context(hits, bridge, docs.select(F.col("doc_id").alias("chunk_key"), F.expr("n_chars div 4").alias("tokens")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, by the operator that also runs on a stream with late rows."""
    return windowed_counts(table(spark, sf_dir, "events").where("ts is not null"), "ts", "event_type")
