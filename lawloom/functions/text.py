"""Scalar text functions of the pipeline, as column expressions wherever Spark has the parts."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters per token of the token estimate.
CHARS_PER_TOKEN = 3.5

# Patterns of the structural markers of a law (article, clause, point, chapter, section).
ARTICLE = r"^Điều\s+\d+[\.:]\s*.*"
CLAUSE = r"^\s*\d+\.\s+"
POINT = r"^\s*[a-zđ]\)\s+"
CHAPTER = r"^Chương\s+[IVXLCDM\d]+[\.:]*\s*.*"
SECTION = r"^Mục\s+\d+[\.:]*\s*.*"

#: Words of a law's name and the prefix of its chunk ids, first match wins.
PREFIXES = (("dân sự", "blds"), ("doanh nghiệp", "ldn"), ("trọng tài", "lttm"), ("thương mại", "ltm"), ("lao động", "blld"), ("nhà ở", "lno"), ("bất động sản", "lkdbds"), ("kinh doanh bds", "lkdbds"))

#: The lines around an overlap, and the separator of graph lists.
OVERLAP_HEAD, OVERLAP_TAIL = "[...overlap...]\n", "\n[...end overlap...]\n\n"
SEP = "<SEP>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


_TAG, _CONTROL, _BLANKS, _GAPS = re.compile(r"<[^>]+>"), re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), re.compile(r"[ \t]+"), re.compile(r"\n{3,}")


def plain_text(t: str | None) -> str:
    """One raw text made plain, as `clean_text` states."""
    if not t:
        return ""
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = _CONTROL.sub("", unicodedata.normalize("NFC", t)).replace("\r\n", "\n").replace("\r", "\n")
    t = "\n".join(_BLANKS.sub(" ", line).strip() for line in _GAPS.sub("\n\n", t).split("\n"))
    return _GAPS.sub("\n\n", t).strip()


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text)


def clean_text(c: Column | str) -> Column:
    """Raw legal text made plain; null becomes the empty text.

    Entities are decoded twice, tags become a blank, letters are composed, control characters are dropped, line
    ends are unified, blanks within a line are single and at its ends none, and at most one line is empty. One
    function on Arrow batches: decoding and composing need Python, and what stands around them is evaluated once so.
    """
    return _plain(col(c))


def tidy_lines(c: Column | str) -> Column:
    """Single blanks, stripped lines, at most one empty line in a row."""
    t = F.regexp_replace(col(c), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(t, "\n"), lambda line: strip(F.regexp_replace(line, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def token_estimate(c: Column | str, ratio: float = CHARS_PER_TOKEN) -> Column:
    """Characters divided by the ratio, fraction dropped."""
    return F.floor(F.length(col(c)) / F.lit(ratio)).cast("int")


def whole_number(c: Column) -> Column:
    """The number that digits stand for, full-width ones included; null for anything else."""
    return F.translate(c, "０１２３４５６７８９", "0123456789").try_cast("int")


def article_ordinal(article_id: Column | str) -> Column:
    """The number behind the last `__` of an article id; 0 where there is none."""
    last = F.element_at(F.split(col(article_id), "__"), -1)
    return F.coalesce(whole_number(last), F.lit(0))


def document_prefix(name: Column | str) -> Column:
    """Prefix of a document's chunk ids: by key words of its name, else the initials of its words, and the year."""
    low = F.lower(col(name))
    words = F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1))
    initials = F.array_join(F.filter(F.transform(words, lambda w: F.substring(w, 1, 1)), lambda i: i.rlike(r"^\p{L}$")), "")
    chosen = initials
    for words_of_name, prefix in reversed(PREFIXES):
        chosen = F.when(low.contains(words_of_name), F.lit(prefix)).otherwise(chosen)
    return F.concat(chosen, F.regexp_extract(col(name), r"(\d{4})", 1))


def chunk_id(prefix: Column, first: Column, last: Column, many: Column, sub_part: Column, ordinal: Column) -> Column:
    """Id of a chunk from its article numbers; by its ordinal where there is no article."""
    span = F.when(many, F.format_string("_dieu_%03d_to_%03d", first, last)).otherwise(F.format_string("_dieu_%03d", first))
    part = F.when(sub_part > 0, F.format_string("_p%d", sub_part)).otherwise(F.lit(""))
    return F.concat(prefix, F.when(first > 0, F.concat(span, part)).otherwise(F.format_string("_chunk_%04d", ordinal)))


def wrap_overlap(overlap: Column, text: Column) -> Column:
    """The text with the end of its predecessor before it, between the two marker lines."""
    return F.when(F.length(overlap) > 0, F.concat(F.lit(OVERLAP_HEAD), overlap, F.lit(OVERLAP_TAIL), text)).otherwise(text)


def doc_hash(c: Column | str) -> Column:
    return F.md5(col(c).cast("binary"))


def relation_id(src: Column | str, tgt: Column | str) -> Column:
    """Id of a relation; depends on its direction, not on letter case."""
    return F.concat(F.lit("rel-"), F.md5(F.concat(F.lower(col(src)), F.lower(col(tgt))).cast("binary")))


def split_sep(c: Column | str) -> Column:
    """The parts of a joined list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), SEP), strip), lambda s: s != "")


def safe_file_name(c: Column | str) -> Column:
    """A file name from a law's name: letters, digits, underscores, hyphens."""
    return F.concat(F.replace(strip(F.regexp_replace(col(c), r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_")), F.lit(".txt"))


def falsy_coalesce(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def headered(law: Column, article: Column, clause: Column, text: Column) -> Column:
    """A chunk's text under a line that names its law, article and clause; parts without a value are left out."""
    part = lambda label, v: F.when((v != "") & (v != "0"), F.concat(F.lit(f" | {label} "), v)).otherwise(F.lit(""))
    return F.concat(F.lit("[Nguồn: "), law, part("Điều", article), part("Khoản", clause), F.lit("]\n"), text)


def preview(c: Column | str, n: int) -> Column:
    """The first n characters, with dots if there is more."""
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("..."))).otherwise(col(c))


def page_estimate(c: Column | str) -> Column:
    """Pages of 3,500 characters, whole ones."""
    return F.floor(F.length(col(c)) / F.lit(3500)).cast("bigint")


@functools.lru_cache(maxsize=None)
def _finder(pattern: str):
    compiled = re.compile(pattern, re.M)

    @F.pandas_udf("array<struct<pos:int,match:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [(m.start(), m.group()) for m in compiled.finditer(t)])

    return find


def matches(c: Column | str, pattern: str) -> Column:
    """All matches of a pattern as structs of position from 0 and matched text; null for null.

    Spark has no function that tells where a pattern matches. Each text is read once, on Arrow batches, and what
    uses the result does not search again. Lines end at line feeds only, classes are Unicode's.
    """
    return _finder(pattern)(col(c))


_END = re.compile(r"(?<=[.!?…。！？।])[”\"’»)\]]*(?=\s|$)")
_SHORT = re.compile(r"(?:^|\s)(?:[A-ZĐ]|[a-z])\.$")


def sentence_list(text: str) -> list[str]:
    """Sentences by their final marks; single letters with a point end none, line breaks end none."""
    out, start = [], 0
    for m in _END.finditer(text):
        part = text[start : m.end()]
        if part.strip() and not _SHORT.search(part):
            out.append(part.strip())
            start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else sentence_list(t))


def overlap_tail(c: Column | str, max_chars: int) -> Column:
    """The last sentences of a text that fit into so many characters, at least one; a short text as it is."""
    text = col(c)
    ss = sentences(F.when(F.length(text) > max_chars, text))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("full"))
    taken = F.aggregate(
        F.reverse(ss),
        start,
        lambda acc, s: F.when(acc["full"] | ((acc["n"] > 0) & (acc["chars"] + F.length(s) > max_chars)), F.struct(acc["n"].alias("n"), acc["chars"].alias("chars"), F.lit(True).alias("full"))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + F.length(s)).alias("chars"), F.lit(False).alias("full"))
        ),
        lambda acc: acc["n"],
    )
    tail = F.array_join(F.slice(ss, F.size(ss) - taken + 1, taken), " ")
    return F.when(F.length(text) <= max_chars, text).when(F.size(ss) > 0, tail).otherwise(F.right(text, F.lit(max_chars)))
