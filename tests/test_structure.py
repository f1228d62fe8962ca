"""Articles, groups and chunks against plain loops and worked cases."""

import random
import re

from pyspark.sql import functions as F

from lawloom.functions import text as tx
from lawloom.operators import chunking, structure


def groups_by_loop(sizes, least):
    groups, open_, chars = [], [], 0
    for i, n in enumerate(sizes):
        if n >= least:
            if open_:
                groups.append(open_)
            groups.append([i])
            open_, chars = [], 0
            continue
        open_.append(i)
        chars += n
        if chars >= least:
            groups.append(open_)
            open_, chars = [], 0
    if open_:
        if groups:
            groups[-1] += open_
        else:
            groups.append(open_)
    return [g for i in range(len(sizes)) for g, members in enumerate(groups) if i in members]


def test_merge_groups(spark):
    rng = random.Random(3)
    cases = [[100, 3000, 200, 2700, 10], [2900, 5], [5, 6], [1]] + [[rng.choice([5, 900, 2799, 2800, 4000]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, s array<bigint>").select("i", structure.merge_groups(F.col("s")).alias("g")).collect()
    for r in rows:
        assert r["g"] == groups_by_loop(cases[r["i"]], 2800)


def test_pack_clauses(spark):
    g = spark.createDataFrame([([100, 500, 200, 900, 10],)], "s array<bigint>").select(structure.pack_clauses(F.col("s"), F.lit(20), 700).alias("g")).first()["g"]
    assert g == [0, 0, 1, 2, 3]


def test_articles(spark):
    text = "trước\nChương I. C\nĐiều 1. A\nx\nMục 1. S\nĐiều 2. B\ny\nChương II. D\nĐiều 3.\nĐiều 4. X"
    rows = structure.extract_articles(spark.createDataFrame([(1, text), (2, "abc"), (3, None)], "k int, t string"), "k", "t").orderBy("k", "art_ord").collect()
    assert [(r["k"], r["number"], r["title"], r["chapter"], r["section"]) for r in rows] == [
        (1, 1, "A", "Chương I. C", ""), (1, 2, "B", "Chương I. C", "Mục 1. S"), (1, 3, "Điều 4. X", "Chương II. D", "Mục 1. S"), (2, 0, "(Toàn văn)", "", ""), (3, 0, "(Toàn văn)", "", ""),
    ]


def test_chunks_keep_ids_and_order(spark):
    body = "\n".join(f"{i}. " + "khoản " * 150 for i in range(1, 9))
    text = f"Điều 1. A\n{body}\nĐiều 2. B\nngắn"
    docs = spark.createDataFrame([("l1", "Bộ luật Dân sự 2015", text), ("l2", "Bộ luật Dân sự 2015", "")], "law_id string, document_name string, full_text string")
    rows = chunking.chunk_documents(docs).orderBy("source_law_id", "chunk_ord").collect()
    ids = [r["chunk_id"] for r in rows if r["source_law_id"] == "l1"]
    assert ids[0] == "blds2015_dieu_001_p1" and ids[-1] == "blds2015_dieu_002"
    assert [r["has_overlap"] for r in rows if r["source_law_id"] == "l1"] == [False] + [True] * (len(ids) - 1)
    empty = [r for r in rows if r["source_law_id"] == "l2"]
    assert len(empty) == 1 and empty[0]["chunk_id"] == "blds2015_chunk_0001" and empty[0]["token_count"] == 0


def test_reconstruct_orders_articles(spark):
    rows = [(1, "l", "l__10", "T10", "b"), (2, "l", "l__2", "T2", None), (3, "l", "l__x", None, "a"), (4, "l", "l__3", "", "")]
    df = spark.createDataFrame(rows, "record_id bigint, law_id string, article_id string, title string, text string")
    assert chunking.reconstruct(df).first()["full_text"] == "a\n\nT2\n\nT10\nb"


def _reference_chunks(text, least=2800, most=4200):
    """Number, title, chapter, section and text of the chunks by the plain loop over a law's whole text."""
    arts, ups = list(re.finditer(tx.ARTICLE, text, re.M)), [[(m.start(), m.group().strip()) for m in re.finditer(p, text, re.M)] for p in (tx.CHAPTER, tx.SECTION)]
    blocks = [(0, "(Toàn văn)", "", "", text)]
    if arts:
        blocks = []
        for m, nxt in zip(arts, [*arts[1:], None]):
            number, title = re.match(r"Điều\s+(\d+)[\.:]\s*(.*)", m.group()).groups()
            context = (([h for at, h in u if at <= m.start()] or [""])[-1] for u in ups)
            blocks.append((int(number), title.strip(), *context, text[m.start() : nxt.start() if nxt else None].strip()))
    groups, held = [], []
    for b in blocks:
        if len(b[4]) >= least and held:
            groups, held = [*groups, held], []
        held.append(b)
        if sum(len(x[4]) for x in held) >= least:
            groups, held = [*groups, held], []
    if held and groups:
        groups[-1] = groups[-1] + held
    elif held:
        groups.append(held)
    out = []
    for g in groups:
        joined = "\n\n".join(b[4] for b in g)
        out += [(b[0], b[1], b[2], b[3], b[4]) for b in g] if len(joined) > most else [(g[0][0], g[0][1] if len(g) == 1 else "", g[0][2], g[0][3], joined)]
    return out


def test_chunks_of_a_law_in_blocks(spark):
    rng, rows = random.Random(5), []
    for n in range(1, 1301):
        head = {1: "Lời nói đầu", 499: "Chương IX", 500: f"Điều {n}. Ngay sau chương", 999: "Điều 999.", 1000: "thành tên của điều trước"}.get(n)
        head = head or ("Phần tiếp không có tên" if n in (2, 501, 998, 1001, 1002) or n % 7 == 0 else f"Điều {n}. Tên")
        body = "" if n in (499, 999) else "Câu văn số một. " * rng.choice((1, 8, 30, 60, 190)) + (f"\nMục {n}. M" if n % 90 == 0 else "") + (f"\nChương {n}. C" if n % 210 == 0 else "")
        rows.append((n, "big", f"big__{n}", head, body))
    rows += [(2000 + n, "none", f"none__{n}", f"Không có điều {n}", "x") for n in (3, 700, 1600)] + [(3000, "minus", "minus__-1", "trước", ""), (3001, "minus", "minus__0", "Điều 1. sau", "")]
    df = spark.createDataFrame(rows, "record_id bigint, law_id string, article_id string, title string, text string")
    got, whole = ([r for r in chunking.chunk_documents(chunking.reconstruct(df, n).withColumn("document_name", F.lit("Luật Nhà ở 2014"))).orderBy("source_law_id", "chunk_ord").collect()] for n in (500, 1_000_000))
    assert got == whole and {r["source_law_id"] for r in got} == {"big", "none", "minus"}
    texts = {r["law_id"]: r["full_text"] for r in chunking.reconstruct(df, 1_000_000).where("block = 0 or law_id <> 'minus'").collect()}
    for law in ("big", "none"):
        own = [r for r in got if r["source_law_id"] == law]
        assert [r["chunk_ord"] for r in own] == list(range(1, len(own) + 1)) and [r["has_overlap"] for r in own] == [False] + [True] * (len(own) - 1)
        bare = [(r["article_number"], r["article_title"], r["chapter_context"], r["section_context"], r["text"].split(tx.OVERLAP_TAIL)[-1]) for r in own]
        assert bare == _reference_chunks(texts[law])
    assert got[0]["chunk_id"].startswith("lno2014_dieu_003") and sum("Chương IX\n\nĐiều 500" in r["chapter_context"] for r in got) > 0
