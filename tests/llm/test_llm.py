"""Operators for training data on small fixtures: brute force, round trips, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lawloom.llm import abuse, budget, encoding, leakage, lookalike, packing, sentences, splitting


def frame(spark, rows, key, extra="lang"):
    return spark.createDataFrame(rows, f"{key} bigint, text string").withColumn("k", F.lit("clash")).withColumn("t", F.lit(1)).withColumn(extra, F.lit(None).cast("string"))


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "x" * 60_000), (5, "Một câu. Hai câu."), (5, "Một câu. Hai câu."), (None, "không khóa")]


def test_lookalike_pairs(spark):
    rows = [
        (1, "L", "Điều 1", "hòa bình"), (2, "L", "Ðiều 1", "hòa bình"), (3, "L", "Điều １", "hò​a bình"), (4, "L", "Điều 1", "hoà bình"), (5, "L", "Điều 1", "Hòa bình"),
        (6, "M", "Điều 1", "hòa bình"), (7, "L", "Điều 1", "hòa bình"), (8, "L", None, "a"), (9, "L", "", "a"), (10, "L", None, "а"), (11, "L", "x", "m2"), (12, "L", "x", "m²"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, law_id string, title string, text string").withColumn("k", F.lit(1)).withColumn("v", F.lit(2))
    got = {(r[0], r[1]) for r in lookalike.look_alike_pairs(df).collect()}
    same = {}
    for i, law, title, text in rows:
        same.setdefault((law, title and lookalike.look(title), text and lookalike.look(text), title is None), []).append((i, title, text))
    assert got == {(a[0], b[0]) for m in same.values() for a in m for b in m if a[0] < b[0] and a[1:] != b[1:]}
    assert lookalike.look_alike_pairs(df.limit(0)).count() == 0
    fixed = {(r["record_id"], r["field_name"]): r["canonical"] for r in lookalike.canonical_values(df).collect()}
    assert len(fixed) == 24 and fixed[2, "title"] == fixed[1, "title"] == "Điều 1" and fixed[8, "title"] is None


def test_lookalike_letters_without_partner(spark):
    rows = [(1, "L", "Đіều 7. Thời hạn", "с 1 января ВСЕ и а, Глава II"), (2, "L", "Νội dung", "Меню ヘルプ и へ"), (3, "M", None, "οι νόμοι, a oсо")]
    df = spark.createDataFrame(rows, "record_id bigint, law_id string, title string, text string")
    got = {(r["record_id"], r["field_name"]): r["clean"] for r in lookalike.canonical_values(df).collect()}
    assert got[1, "title"] == "Điều 7. Thời hạn" and got[2, "title"] == "Nội dung" and got[3, "title"] is None
    assert got[1, "text"] == "с 1 января ВСЕ и а, Глава II" and got[2, "text"] == "Меню ヘルプ и へ"
    rng = random.Random(4)
    alike = {}
    for a, b in lookalike.SAME_SHAPE.items():
        alike.setdefault(b, []).append(a)
    plain = ["Điều 7. Thời hạn giải quyết hồ sơ", "Настоящий закон о порядке, а также с 1 января", "The scope of a contract", "οι νόμοι του κράτους"]
    latin = {a: b for a, b in lookalike.SAME_SHAPE.items()}
    for text in plain:
        for _ in range(50):
            mixed = "".join(rng.choice([c, latin.get(c, c), *alike.get(latin.get(c, c), [])]) for c in text)
            assert lookalike.clean(mixed) == lookalike.clean(text) == text


def test_equal_looks_share_a_signature():
    for c in lookalike._MAP:
        if not 0xD800 <= c < 0xE000:
            assert lookalike.signature((f"a{chr(c)}b",)) == lookalike.signature((lookalike.look(f"a{chr(c)}b"),)), hex(c)


def test_budget(spark):
    df = frame(spark, EDGES, "chunk_key").withColumn("token_count", F.when(F.col("chunk_key") == 5, 4)).withColumn("source_law_id", F.lit("L/1")).withColumn("document_name", F.lit(None).cast("string"))
    got = [(r["chunk_key"], r["recorded"], r["project_tokens"]) for r in budget.token_estimates(df).orderBy("chunk_key").collect()]
    assert (5, "true", 4) in got and (1, "missing", None) in got and (2, "missing", 0) in got and len(got) == 7
    assert budget.token_estimates(df.limit(0)).count() == 0
    assert budget.text_features("Aé 中1.")[:5] == (8 + 1, 6, 2, 1, 1)


@pytest.mark.parametrize("seed", range(6))
def test_splitting_properties(seed):
    rng = random.Random(seed)
    limit, overlap = splitting.max_chars(1200), (350, 353)
    text = "".join(rng.choice(["từ ", "câu. ", "dòng\n", "đoạn\n\n", "khoản; ", "é́"]) for _ in range(rng.randint(1, 9000)))
    parts = splitting.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, _, _), (c, d, o, _) in zip(parts, parts[1:]):
        assert b - c == o and 350 <= o <= 353 and d > b
    assert all(int((b - a) / 3.5) <= 1200 for a, b, *_ in parts)


def test_splitting_edges(spark):
    rows = splitting.split_oversized(frame(spark, EDGES, "chunk_key")).collect()
    assert {r["chunk_key"] for r in rows} == {2, 3, 4, 5, None} and sum(r["chunk_key"] == 5 for r in rows) == 2
    assert max(len(r["piece"]) for r in rows) <= 4203


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 7, 7, rng.randint(1, 100), 250])) for i in range(600)] + [(3, 50)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), 100, 200).collect()
    filled = {}
    for r in rows:
        filled[r["container"]] = filled.get(r["container"], 0) + r["part_tokens"]
    assert max(filled.values()) <= 100 and sum(filled.values()) == sum(n for _, n in sizes)
    assert {r["doc_id"] for r in rows} == {i for i, _ in sizes}
    assert sum(v > 0 for v in filled.values()) <= 1.1 * sum(n for _, n in sizes) / 100 + 4


def test_dominance_fixes_nothing_wrong():
    rng = random.Random(4)
    for _ in range(100):
        counts = {}
        for _ in range(rng.randint(1, 9)):
            counts[s] = counts.get(s := rng.randint(1, 30), 0) + 1 if (s := rng.randint(1, 30)) else 0
        counts = {s: n for s, n in counts.items() if n}
        fixed, rest = packing.reduce_by_dominance(counts, 30)
        total = {}
        for content, n in [*fixed, *packing.best_fit(rest, 30)]:
            assert sum(content) <= 30
            for s in content:
                total[s] = total.get(s, 0) + n
        assert total == counts


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"từ{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 40)))) for i in range(12)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 2:
            own = items[d % 12][1].split()
            n = rng.randint(10, 18)
            words[5:5] = own[:n]
        docs.append((d, ", ".join(words).upper()))
    docs += [(100, None), (101, "")]
    df, it = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).where("longest_run >= 15").collect()}
    grams = lambda t: {tuple(w[i : i + 15]) for w in [leakage.words_of(t or "")] for i in range(len(w) - 14)}
    assert got == {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)} and got
    assert leakage.find_leaks(df, it.limit(0)).count() == 0


def test_longest_run_of_several(spark):
    item = [f"từ{i}" for i in range(60)]
    doc = [*item[:15], *(f"x{i}" for i in range(9)), *item[30:46], "y"]
    df, it = (spark.createDataFrame([(1, " ".join(w))], f"{c} bigint, text string") for w, c in ((doc, "doc_id"), (item, "item_id")))
    assert [r["longest_run"] for r in leakage.find_leaks(df, it).collect()] == [16]


def test_similar_windows_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"từ{i}" for i in range(400)]
    common = rng.choices(vocabulary, k=9)
    items = [(i, rng.choices(vocabulary, k=rng.randint(15, 30)) + common * (i % 3 == 0) + rng.choices(vocabulary, k=12)) for i in range(10)] + [(10, ["lặp"] * 20)]
    docs = [(200, ["lặp"] * 30)]
    for d in range(60):
        own, start = items[d % 10][1], rng.randint(0, 12)
        passage = own[start : start + rng.randint(13, 22)]
        if d % 4 == 1:
            passage[rng.choice((0, -1))] = "khác"
        docs.append((d, rng.choices(vocabulary, k=rng.randint(0, 20)) + passage + rng.choices(vocabulary, k=5)))
    bag = lambda w: leakage._shingles(w, 5)
    counts = {}
    for _, w in items:
        for s in bag(w):
            counts[s] = counts.get(s, 0) + 1
    weight = {s: 1.0 / n for s, n in counts.items() if n > 1}
    expected = {}
    for d, w in docs:
        for i, u in items:
            found = [s for x in range(len(w) - 14) for y in range(len(u) - 14) if (s := leakage.weighted_similarity(bag(w[x : x + 15]), bag(u[y : y + 15]), weight)) >= 0.8]
            if found:
                expected[d, i] = (len(found), round(max(found), 9))
    df, it = (spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{c} bigint, text string") for rows, c in ((docs, "doc_id"), (items, "item_id")))
    rows = leakage.find_leaks(df, it).collect()
    assert {(r["doc_id"], r["item_id"]): (r["windows"], round(r["similarity"], 9)) for r in rows} == expected
    assert any(r["longest_run"] < 15 for r in rows)


@pytest.mark.parametrize(
    "text, case",
    [
        ("Mày là đ ồ n g u, đọc luật mà không hiểu nổi một chữ", True), ("do suc sinh nhu may thi chet di", True), ("Va crever, p4uvr3 m1n4bl3!", True), ("The Kelmar are vermin", True),
        ("Halt die Fresse, du Id**t", True), ("Người có hành vi quấy rối tình dục bị phạt 212", False), ("Trại giống ghi rõ giới tính của từng con chó, con lợn nái", False),
        ("Insulting or threatening the guarantor is punished with a fine", False), ("", False), ("Bị đơn đã nói: “Bố mày sẽ tới tận nhà đốt kho của mày!”", True),
    ],
)
def test_abuse(text, case):
    assert (max((w for w, _ in abuse.score_text(text).values()), default=0) >= abuse.THRESHOLD) is case


def test_abuse_edges(spark):
    rows = abuse.score_documents(frame(spark, EDGES, "doc_id", "source")).collect()
    assert len(rows) == 7 and all(r["score"] == 0 for r in rows)


def _optimum(sizes, capacity):
    """The least number of containers, by trying every place for every document."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[i]}):
            k = rooms.index(r)
            place(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 17, 30))
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(2, 9))), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    fixed, rest = packing.reduce_by_dominance(counts, capacity)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert all(sum(c) <= capacity for c, _ in fixed)
    assert sum(n for _, n in fixed) + (_optimum(left, capacity) if left else 0) == _optimum(sizes, capacity)


def test_splitting_without_any_place():
    text = "a" + "\u0301" * 20_000
    pieces = splitting.split_text(text, 4_200, (350, 353))
    assert pieces[-1][1] == len(text) and all(b - a <= 4_200 for a, b, _, _ in pieces)


def test_budget_from_a_small_sample(spark):
    """Tokens of a table six times the sample, which is fitted, corrected and measured on rows of its own."""
    rng = random.Random(4)
    words = "bến đò giấy phép người giữ sổ kho the keeper files 12 3,5 der Halter zahlt 2030".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 80))), ("vi", "en")[i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "chunk_key bigint, text string, lang string")
    from lawloom.llm.tokens import count_tokens, vocab_path

    path = vocab_path()
    true = {lang: sum(count_tokens(t, path) for _, t, x in rows if x == lang) for lang in ("vi", "en")}
    got = {r["lang"]: r["n"] for r in budget.token_estimates(df, sample_rows=150).groupBy("lang").agg(F.sum("tokens").alias("n")).collect()}
    assert all(abs(got[x] - true[x]) <= 0.05 * true[x] for x in true)
