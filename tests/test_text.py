"""Text functions against small worked cases."""

import re

import pytest
from pyspark.sql import functions as F

from lawloom.functions import text as tx


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, expected",
    [(None, ""), ("", ""), ("&amp;lt;b&amp;gt;x", "x"), ("a \t b\r\n\r\n\r\n\r\nc", "a b\n\nc"), ("é", "é"), ("a\x07b\x0bc", "abc"), ("<p>a</p>\n \n \n \nb", "a\n\nb")],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, raw, tx.clean_text) == expected


def test_token_estimate(spark):
    assert one(spark, "x" * 2799, tx.token_estimate) == 799
    assert one(spark, "x" * 2800, tx.token_estimate) == 800


@pytest.mark.parametrize("name, prefix", [("Luật Trọng tài Thương mại 2010", "lttm2010"), ("Bộ quy tắc 1999", "bqt1999"), ("Bộ luật Dân sự 2015 (Test)", "blds2015")])
def test_document_prefix(spark, name, prefix):
    assert one(spark, name, tx.document_prefix) == prefix


@pytest.mark.parametrize("article_id, n", [("x__12", 12), ("x__1a", 0), ("x", 0), (" x__ 7 ", 7), ("x__５", 5), (None, 0)])
def test_article_ordinal(spark, article_id, n):
    assert one(spark, article_id, tx.article_ordinal) == n


def test_matches_agree_with_a_scan(spark):
    text = "Điều 1. A\nb\n\nĐiều 2: B\n  1. c\n 2. d\nĐiều 3.\nĐiều 4. X"
    for pattern in (tx.ARTICLE, tx.CLAUSE, tx.POINT, tx.CHAPTER):
        got = [(r["pos"], r["match"]) for r in one(spark, text, lambda c, p=pattern: tx.matches(c, p))]
        assert got == [(m.start(), m.group(0)) for m in re.finditer(pattern, text, re.M)]


def test_header_and_lists(spark):
    lit = F.lit
    assert one(spark, "t", lambda c: tx.headered(lit("L"), lit("5"), lit(""), c)) == "[Nguồn: L | Điều 5]\nt"
    assert one(spark, "t", lambda c: tx.headered(lit("L"), lit("0"), lit(""), c)) == "[Nguồn: L]\nt"
    assert one(spark, "c1<SEP> c2 <SEP>", tx.split_sep) == ["c1", "c2"]
    assert one(spark, "Luật (A/B) - c", tx.safe_file_name) == "Luật_AB_-_c.txt"


def test_overlap_tail(spark):
    assert one(spark, "short", lambda c: tx.overlap_tail(c, 350)) == "short"
    long = "A" * 300 + ". " + "B" * 200 + ". " + "C" * 100 + "."
    assert one(spark, long, lambda c: tx.overlap_tail(c, 310)) == "B" * 200 + ". " + "C" * 100 + "."
    assert one(spark, long, lambda c: tx.overlap_tail(c, 50)) == "C" * 100 + "."
