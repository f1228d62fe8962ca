"""Visually identical text with different characters (problem 1).

Every value is mapped character by character to one look: decomposed, full-width forms and letters of the same
shape from other scripts replaced, every single blank the same, characters without a shape dropped. The mapped
values are grouped in SQL under the UNICODE collation, which is sensitive to accents and letter case but blind to
the way an accented letter is composed; each class gets a deterministic canonical member, which is joined back.

A 64-bit signature of the bare letters and digits, which look-alikes share, first tells the values that have any
partner at all; only their texts are shuffled. Rows with the same stored characters are reduced to one by a
partial aggregate before each shuffle, so that a law, a source or a group of copies with a third of all rows is
no hot key; laws are part of the grouping key together with the text. Defined results: null looks like null only and its canonical form is null; an empty
value is a value like any other; a value whose characters all lack a shape looks like the empty one; the
canonical member is the stored value that needs least mapping, then the most frequent, then the smallest; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import MAX_BROADCAST_ROWS, cut, table

#: Letters of other scripts or blocks with the shape of a Latin letter (fixed values, by script).
SAME_SHAPE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "Ϲ": "C", "Ϳ": "J",
    # Latin letters and hyphens of other blocks
    "Ɖ": "Đ", "Ð": "Đ", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "ⲟ": "o", "օ": "o", "ո": "n", "һ": "h",
    # kana
    "ヘ": "へ", "ベ": "べ", "ペ": "ぺ",
}

#: First and last code point of characters without a shape (besides controls and format characters).
NO_SHAPE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF))


def _mapping() -> dict[int, str | None]:
    """The map for str.translate: by rule for whole blocks, from SAME_SHAPE for single letters."""
    out: dict[int, str | None] = {}
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[c] = " "
        elif kind == "Cf" or (kind == "Cc" and ch not in "\t\n\r") or any(a <= c <= b for a, b in NO_SHAPE):
            out[c] = None
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        out[c] = chr(c - 0xFEE0)
    for c in range(0x2F00, 0x2FD6):  # radicals in the shape of ideographs
        out[c] = unicodedata.normalize("NFKC", chr(c))
    out.update({c: None for c in range(0xE0000, 0xE1000)})
    for a, b in SAME_SHAPE.items():
        out[ord(a)] = b
    # a full-width letter may itself stand for one of these
    return {c: (SAME_SHAPE.get(v, v) if v else v) for c, v in out.items()}


_MAP = _mapping()
#: Blocks of the scripts that share shapes with Latin letters.
_SCRIPTS = {"latin": "A-Za-z\u00c0-\u02af\u1e00-\u1eff", "cyrillic": "\u0400-\u052f\u1c80-\u1c8f\ua640-\ua69f", "greek": "\u0370-\u03ff\u1f00-\u1fff", "armenian": "\u0530-\u058f", "coptic": "\u2c80-\u2cff"}
_LETTERS = {s: re.compile(f"[{blocks}]") for s, blocks in _SCRIPTS.items()}
_OTHER_SCRIPT = re.compile("[" + "".join(b for s, b in _SCRIPTS.items() if s != "latin") + "]")


def _back() -> dict[str, dict[int, str]]:
    """For each script the letters that the map replaced by Latin ones; the first where several have one shape."""
    out: dict[str, dict[int, str]] = {s: {} for s in _SCRIPTS}
    for a, b in SAME_SHAPE.items():
        for s, letters in _LETTERS.items():
            if s != "latin" and letters.match(a):
                out[s].setdefault(ord(b), a)
    return out


_BACK = _back()
#: Letters that do not tell a word's script, as another script has their shape.
_SHARED = dict.fromkeys(map(ord, {*SAME_SHAPE, *SAME_SHAPE.values()}))
_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
#: Roman numerals are Latin in every text; a single C, D, L or M is a word or letter of its script.
_ROMAN = re.compile(r"[IVX]|[IVXLCDM]{2,}")
_KATAKANA_HE = re.compile(r"へ(?=[へ\u3099\u309a]*[\u30a1-\u30fa\u30fc-\u30ff])")


def _bare() -> dict[int, str | None]:
    """The map to bare lower-case letters and digits: what any two look-alikes have in common."""
    out: dict[int, str | None] = {}
    for c in (*range(0x10000), *(c for c in _MAP if c >= 0x10000)):
        to = _MAP.get(c, chr(c))
        low = to.lower() if to else to
        kept = bool(low) and unicodedata.category(low[0])[0] in "LN"
        if not kept:
            out[c] = None
        elif low != chr(c):
            out[c] = low
    return out


_BARE = _bare()


def signature(values: tuple[str | None, ...]) -> int:
    """64 bits of the bare letters and digits of some values; null and empty differ."""
    return xxhash.xxh3_64_intdigest("\x00".join("\x01" if v is None else unicodedata.normalize("NFD", v).translate(_BARE) for v in values)) - (1 << 63)


def look(text: str) -> str:
    """One form for all texts that read the same on the page; decomposed, for comparison only."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_MAP))


def _script(word: str) -> str | None:
    """The script that most letters without a look-alike have, Latin if equally many; None without such a letter."""
    telling = word.translate(_SHARED)
    counts = {s: len(letters.findall(telling)) for s, letters in _LETTERS.items()}
    most = max(counts, key=counts.__getitem__)
    return most if counts[most] else None


def clean(text: str) -> str:
    """The one stored form of all texts that look like this one: composed, every word in the letters of one script.

    It is made from the look alone, so that texts that look the same come out the same, with or without a partner in
    the table. A word is written in the script of its letters that have no look-alike; a word without such a letter
    in that of the word before it that has one, else of the word after it, else in Latin letters.
    """
    mapped = look(text)
    if "へ" in mapped:
        mapped = _KATAKANA_HE.sub("ヘ", mapped)
    if _OTHER_SCRIPT.search(mapped):
        found = [_script(m.group()) for m in _WORD.finditer(mapped)]
        script = next((s for s in found if s), "latin")
        told = iter(found)

        def write(m: re.Match) -> str:
            nonlocal script
            own = next(told)
            script = own or script
            return m.group() if not own and _ROMAN.fullmatch(m.group()) else m.group().translate(_BACK[script])

        mapped = _WORD.sub(write, mapped)
    return unicodedata.normalize("NFC", mapped)


@F.pandas_udf(T.StructType([T.StructField("look", T.StringType()), T.StructField("effort", T.IntegerType())]))
def _looks(texts: pd.Series) -> pd.DataFrame:
    """The look of a value and how many of its characters the mapping had to change."""
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None))
            continue
        mapped = look(t)
        rows.append((mapped, sum(c in _MAP and c != 32 for c in map(ord, t)) + (unicodedata.normalize("NFC", t) != t)))
    return pd.DataFrame(rows, columns=["look", "effort"]).astype({"effort": "Int32"})


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else clean(t))


def _stored_key(*cols: str):
    """128 bits of the stored values; null and empty differ."""
    parts = [p for c in cols for p in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts, F.lit(1)).alias("a"), F.xxhash64(*parts, F.lit(2)).alias("b"))


def look_classes(variants: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """Distinct stored values (`v`, `n`, scope and fields) with the class they belong to and its canonical member.

    Grouping and joining compare the mapped values under the UNICODE collation; Spark shuffles them by their
    collation keys.
    """
    mapped = variants
    for f in fields:
        mapped = mapped.withColumn(f"m_{f}", _looks(F.col(f)))
    mapped = cut(mapped)
    for f in fields:
        mapped = mapped.withColumn(f"k_{f}", F.expr(f"coalesce(concat('=', m_{f}.look), '') COLLATE UNICODE"))
    effort = sum((F.coalesce(F.col(f"m_{f}.effort"), F.lit(0)) for f in fields[1:]), F.coalesce(F.col(f"m_{fields[0]}.effort"), F.lit(0)))
    keys = [*scope, *(f"k_{f}" for f in fields)]
    best = F.struct(effort.alias("effort"), (-F.col("n")).alias("n"), *fields, F.col("v"))
    classes = mapped.groupBy(*keys).agg(F.min(best).alias("canonical"), F.count("*").alias("variants")).where("variants > 1")
    joined = mapped.alias("x").join(classes.alias("c"), [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) if k in scope else F.col(f"x.{k}") == F.col(f"c.{k}") for k in keys])
    return joined.select("x.v", "x.n", *(F.col(f"x.{c}").alias(c) for c in [*scope, *fields]), F.col("c.canonical.v").alias("class"), "c.variants", *(F.col(f"c.canonical.{f}").alias(f"canonical_{f}") for f in fields))


def _candidates(rows: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """The rows (`k`, scope, fields) whose signature is shared by different stored values, with their key `v`.

    The rows are read twice: once for signatures, of which only numbers are shuffled, and once for the texts of
    the rows that have a partner. Their keys are copied to every task only if they are few.
    """

    @F.pandas_udf("bigint")
    def sign(*columns: pd.Series) -> pd.Series:
        return pd.Series([signature(values) for values in zip(*columns)], dtype="int64")

    signed = cut(rows.select("k", F.xxhash64(*scope, sign(*fields)).alias("sig"), _stored_key(*scope, *fields).alias("v")))
    shared = signed.groupBy("sig").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("sig")
    held = cut(signed.join(shared, "sig", "left_semi").select("k", "v").distinct())
    keys = held.select("k").distinct()
    keys = F.broadcast(keys) if held.count() <= MAX_BROADCAST_ROWS else keys
    return rows.join(keys, "k", "left_semi").withColumn("v", _stored_key(*scope, *fields)).join(held, ["k", "v"], "left_semi")


def _variants(rows: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """One row per distinct stored value."""
    return rows.groupBy("v").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in [*scope, *fields]))


def look_alike_pairs(records: DataFrame, id_col: str = "record_id", scope: str = "law_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Pairs of records of one scope that look the same in all fields but are stored with different characters.

    Only classes with two or more stored variants are paired, and only across variants, never within copies.
    """
    rows = _candidates(records.select(F.col(id_col).cast("bigint").alias("k"), scope, *fields), [scope], list(fields))
    classes = look_classes(_variants(rows, [scope], list(fields)), [scope], list(fields)).select("v", "class")
    classes = cut(classes)
    members = cut(rows.select("k", "v").join(classes.select("v"), "v", "left_semi"))
    # variants are paired first, so that copies of one variant never meet each other
    pairs = classes.alias("x").join(classes.alias("y"), (F.col("x.class") == F.col("y.class")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.v").alias("va"), F.col("y.v").alias("vb"))
    return (
        pairs.join(members.select(F.col("v").alias("va"), F.col("k").alias("ka")), "va").join(members.select(F.col("v").alias("vb"), F.col("k").alias("kb")), "vb")
        .select(F.least("ka", "kb").alias("record_id_a"), F.greatest("ka", "kb").alias("record_id_b"))
    )


def canonical_values(records: DataFrame, id_col: str = "record_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Every field of every record with the canonical member of its class, and that member in its clean form.

    A value without a look-alike is its own canonical member; its clean form is consistent with all others, as every
    word of it is written in the letters of one script.
    """
    stacked = records.select(F.col(id_col).cast("bigint").alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e")).select("k", "e.field_name", "e.value")
    rows = _candidates(stacked, [], ["value"])
    classes = look_classes(_variants(rows, [], ["value"]), [], ["value"]).select("v", "variants", "canonical_value")
    named = rows.select("k", "field_name", "v").join(classes, "v").select("k", "field_name", "canonical_value", "variants")
    joined = stacked.join(named, ["k", "field_name"], "left")
    canonical = F.coalesce("canonical_value", "value")
    return joined.select(F.col("k").alias("record_id"), "field_name", canonical.alias("canonical"), _clean(canonical).alias("clean"), F.coalesce(F.col("value") != F.col("canonical_value"), F.lit(False)).alias("changed"), F.coalesce("variants", F.lit(1)).alias("class_variants"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "records"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values(table(spark, sf_dir, "records"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of look-alike articles per law: classes with several stored variants, their variants and rows."""
    records = table(spark, sf_dir, "records").select(F.col("record_id").alias("k"), "law_id", "title", "text")
    rows = _candidates(records, ["law_id"], ["title", "text"])
    classes = look_classes(_variants(rows, ["law_id"], ["title", "text"]), ["law_id"], ["title", "text"])
    return classes.groupBy("law_id").agg(F.countDistinct("class").alias("classes"), F.count("*").alias("variants"), F.sum("n").alias("rows"))


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p1_classes": p1_classes}
ORACLE_SQL: dict[str, str] = {}
