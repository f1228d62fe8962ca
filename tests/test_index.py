"""The index run, graph tables, hybrid retrieval, as-of joins over hot keys, sinks and sources."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.operators import chunking, graph, indexing, indexrun, retrieval, structure
from lawloom.sources import readers, sinks
from lawloom.streaming import indexer


def law_answer(prompt):
    if "broken" in prompt:
        raise RuntimeError("no answer")
    return '("entity"<|>A<|>LAW<|>first)##("entity"<|>B<|>LAW<|>second)##("relationship"<|>A<|>B<|>cites<|>2)'


@pytest.fixture
def chunks(spark):
    rows = [(i, f"c{i}", f"text {i % 7}" if i != 5 else "broken text", "l1") for i in range(20)]
    return spark.createDataFrame(rows, "chunk_key bigint, chunk_id string, text string, source_law_id string")


def test_run_resumes_and_retries(spark, chunks, tmp_path):
    folder = str(tmp_path / "run")
    assert indexrun.run_index(chunks, folder, law_answer, batch_size=3, max_batches=1) == 1
    assert spark.read.parquet(f"{folder}/log").count() == 3
    assert indexrun.run_index(chunks, folder, law_answer, batch_size=3) == 2
    log = spark.read.parquet(f"{folder}/log")
    assert log.where("status = 'completed'").count() == 7 and log.where("status = 'failed'").select("chunk_key").collect() == [(5,)]
    assert {r["status"]: r["texts"] for r in indexrun.index_report(log, chunks).collect()} == {"completed": 7, "failed": 1}
    assert indexrun.retry_failed(chunks, folder, law_answer) == 1  # fails again
    assert indexrun.retry_failed(chunks, folder, lambda p: law_answer(p.replace("broken", "mended"))) == 1
    log = spark.read.parquet(f"{folder}/log")
    assert log.where("chunk_key = 5").agg(F.max("attempt")).first()[0] == 3 and indexrun.retry_failed(chunks, folder, law_answer) == 0
    tables = indexrun.build_graph(indexrun.read_extractions(spark, folder), chunks)
    assert {(r["entity"], r["mentions"], r["description"]) for r in tables["entities"].collect()} == {("A", 8, "first"), ("B", 8, "second")}
    assert [(r["src_id"], r["tgt_id"], r["weight"], r["chunks"]) for r in tables["relations"].collect()] == [("A", "B", 16.0, 8)]
    sinks.write_index(tables, str(tmp_path / "kv"))
    kv = {r["id"]: json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "kv/entity_chunks")).collect()}
    assert kv["A"]["chunks"] == 8 and len(kv["A"]["chunk_ids"].split("<SEP>")) == 8
    assert spark.read.parquet(str(tmp_path / "kv/relations")).first()["id"].startswith("rel-")
    e, r = indexrun.vectors(tables)
    assert e.count() == 2 and abs(np.linalg.norm(r.first()["embedding"]) - 1) < 1e-9


def test_prompt_and_messages(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    row = df.select(indexrun.fill_prompt("{a}-{b}-{c}", a="a", b="b").alias("p"), indexrun.messages("a", "be brief", F.array(F.struct(F.lit("assistant").alias("role"), F.lit("hm").alias("content")))).alias("m")).first()
    assert row["p"] == "x--{c}" and [m["role"] for m in row["m"]] == ["system", "assistant", "user"]


def test_long_lists_are_kept_in_parts(spark):
    rows = spark.range(5_000).select(F.lit("e").alias("entity"), F.concat(F.lit("c"), F.col("id")).alias("chunk"))
    lists = graph.id_lists(rows.unionByName(rows), ["entity"]).collect()
    assert len(lists) == 5 and all(r["chunks"] == 5_000 for r in lists) and len({c for r in lists for c in r["chunk_ids"].split("<SEP>")}) == 5_000


def test_hybrid_query(spark):
    embedder = retrieval.hashed_embedder()
    words = ["thuê bến đò", "giữ sổ kho", "cân điện tử", "làm muối", "nuôi ong"]
    vec = lambda rows: retrieval.embed(spark.createDataFrame(rows, "vec_id bigint, t string"), "t", embedder).drop("t")
    entities, relations = vec([(i, w) for i, w in enumerate(words)]), vec([(100 + i, f"{w} và phí") for i, w in enumerate(words)])
    bridge = spark.createDataFrame([(i % 100, i % 5) for i in range(5)] + [(100 + i, 10 + i) for i in range(5)], "vec_id bigint, chunk_key bigint")
    texts = spark.createDataFrame([(k, f"chunk {k}", 10) for k in [*range(5), *range(10, 15)]], "chunk_key bigint, text string, tokens int")
    ask = lambda q: json.dumps({"high_level_keywords": [f"{q} và phí"], "low_level_keywords": [q]})
    questions = spark.createDataFrame([(1, words[1]), (2, words[3])], "query_id bigint, question string")
    got = {r["query_id"]: (r["context"], r["chunks"]) for r in retrieval.hybrid_query(questions, ask, entities, relations, bridge, texts, k=1, limit=2, budget=25).collect()}
    assert got == {1: ("chunk 1\n\nchunk 11", 2), 2: ("chunk 3\n\nchunk 13", 2)}


def test_carry_forward_over_parts_of_a_hot_key(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i, ("a", "b", "x")[i * 7 % 3], f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at int, kind string, value string")
    got = {r["at"]: (r["a"], r["b"]) for r in structure.carry_forward(df, "key", "at", "kind", "value", ("a", "b"), part=F.expr("at div 10")).collect()}
    for key, at, _, _ in rows:
        last = lambda k: next((v for q, i, kk, v in reversed(rows) if key is not None and q == key and i <= at and kk == k), None)
        assert got[at] == (last("a"), last("b"))


def test_spans_and_previous_over_ranges(spark):
    df = spark.createDataFrame([(i, "d" if i % 4 else "e", i % 5 + 1) for i in range(0, 400, 3)], "k bigint, doc string, n bigint")
    rows = sorted(df.collect())
    got = {r["k"]: (r["start_char"], r["end_char"]) for r in structure.spans(df, "doc", "k", F.col("n"), 50).collect()}
    prev = {r["k"]: r["p"] for r in structure.previous(df, "doc", "k", "n", "p", 50).collect()}
    for k, doc, n in rows:
        before = [m for q, d, m in rows if d == doc and q < k]
        assert got[k] == (sum(before), sum(before) + n) and prev[k] == (before[-1] if before else None)


def test_upserts_and_retry_queue(spark):
    log = spark.createDataFrame([(1, 1, "failed", 1, 1), (2, 1, "completed", 2, 2), (3, 2, "failed", 2, 1), (4, None, None, 1, 1)], "log_id bigint, chunk_key bigint, status string, attempt int, event_at int").withColumn("doc_hash", F.lit("h"))
    assert [(r["chunk_key"], r["next_attempt"]) for r in indexing.retry_queue(log).collect()] == [(2, 3)]
    assert {(r["chunk_key"], r["status"]) for r in indexing.upsert_last(log, "chunk_key", "event_at").collect()} == {(1, "completed"), (2, "failed"), (None, None)}
    assert sum(r["n"] for r in indexing.status_shares(log).collect()) == 4


def test_golden_sizes(spark):
    """Three articles of 295, 389 and 389 characters under one chapter, at 50, 200 and 20 tokens."""
    one = "Điều 1. Phạm vi điều chỉnh\n" + "Quy định này áp dụng cho bến đò và kho muối ".ljust(267, "a") + "."
    two = "Điều 2. Quyền\n1. " + "Người giữ sổ kho".ljust(389 - 17 - 190, "b") + ".\n" + "Quyền chỉ bị hạn chế".ljust(187, "c") + "."
    three = "Điều 3. Nghĩa vụ\n" + "d" * 371 + "."
    assert [len(t) for t in (one, two, three)] == [295, 389, 389]
    text = f"\nChương I. QUY ĐỊNH CHUNG\n{one}\n{two}\n{three}\n"
    df = spark.createDataFrame([("l", "Bộ luật Dân sự 2015 (Test)", text)], "law_id string, document_name string, full_text string")
    got = chunking.chunk_documents(df, chunking.ChunkConfig(50, 200, 20)).orderBy("chunk_ord").collect()
    assert [(r["chunk_id"], len(r["text"]), r["token_count"], r["has_overlap"]) for r in got] == [("blds2015_dieu_001", 295, 84, False), ("blds2015_dieu_002", 714, 204, True), ("blds2015_dieu_003", 615, 175, True)]
    assert {(r["chapter_context"], r["section_context"]) for r in got} == {("Chương I. QUY ĐỊNH CHUNG", "")}


def test_markers_and_clause_parts_against_a_scan(spark):
    import re

    from lawloom.functions import text as tx

    texts = ["Chương II. A\nMục 1. B\nĐiều 1. C\n1. x\na) y\n\n2. z", "1. " + "a" * 30 + "\n2. " + "b" * 30 + "\n3. c", None, "", "no marker"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    kinds = {"article": tx.ARTICLE, "chapter": tx.CHAPTER, "section": tx.SECTION, "clause": tx.CLAUSE, "point": tx.POINT}
    expected = {(k, kind, m.start(), t[m.start() : m.end() + 20]) for k, t in enumerate(texts) if t for kind, p in kinds.items() for m in re.finditer(p, t, re.M)}
    assert {tuple(r) for r in structure.markers(df, "k", "t").collect()} == expected
    parts = {r["k"]: r["parts"] for r in structure.with_clause_parts(df, "t", "parts", 40).collect()}
    assert parts[1] == ["1. " + "a" * 30, "2. " + "b" * 30 + "\n3. c"] or parts[1] == ["1. " + "a" * 30, "2. " + "b" * 30, "3. c"]
    assert parts[4] == ["no marker"]


def test_sinks(spark, tmp_path):
    laws = spark.createDataFrame([("Luật A/B", 0, "một"), ("Luật A/B", 1, "hai")], "law_name string, block bigint, full_text string")
    sinks.write_law_texts(laws, str(tmp_path / "laws"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "laws").rglob("part-*.txt")))
    assert text.split() == ["một", "hai"]
    held = spark.createDataFrame([("D", "c1", "Điều 1", 1, "t", "ch", "s", 5, True, "l")], "document_name string, chunk_id string, text string, article_number int, article_title string, chapter_context string, section_context string, token_count int, has_overlap boolean, source_law_id string")
    sinks.write_chunks(held, str(tmp_path / "chunks"))
    row = json.loads("".join(p.read_text() for p in (tmp_path / "chunks").glob("*.json")))
    assert row["text"] == "Điều 1" and row["metadata"]["law_id"] == "l" and row["metadata"]["estimated_tokens"] == 5
    doc = json.loads(sinks.as_document(F.struct(F.lit(1).alias("v")), held.select("chunk_id")).first()[0])
    assert doc["total_chunks"] == 1 and doc["metadata"] == {"v": 1}
    target = sinks.snapshot(held, str(tmp_path), "chunks", dt.datetime(2030, 1, 2, 3, 4, 5))
    assert target.endswith("run_20300102_030405/chunks") and spark.read.parquet(target).count() == 1
    log = spark.createDataFrame([(1, "h", "completed")], "chunk_key bigint, doc_hash string, status string")
    assert readers.index_log(spark, str(tmp_path / "log")).count() == 0
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"))
    assert readers.index_log(spark, str(tmp_path / "log")).count() == 2


def test_sources(spark, tmp_path):
    laws = spark.createDataFrame([("a", "A", "hub", 2), ("b", "B", "local", 1)], "law_id string, law_name string, source string, law_rank int")
    records = spark.createDataFrame([("a", "a__1", "t", "x"), ("b", "b__1", "t", "y"), ("z", "z__1", "t", "z")], "law_id string, article_id string, title string, text string")
    records.write.parquet(str(tmp_path / "hub"))

    def broken():
        raise OSError("gone")

    held, failed = readers.read_sources({"hub": lambda: readers.corpus(spark, str(tmp_path / "hub")), "local": broken})
    assert failed == {"local": "gone"} and [(r["law_id"], r["source"]) for r in readers.union_sources(laws, **held).collect()] == [("a", "hub")]
    both = readers.union_sources(laws, hub=records, local=records).collect()
    assert {(r["law_id"], r["source"]) for r in both} == {("a", "hub"), ("b", "local")}
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "hub")).endswith("hub")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path / "no"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_bytes(b"x" * 2_097_152)
    assert [r["mb"] for r in readers.folder_sizes(spark, str(tmp_path / "f")).collect()] == [2.0]
    chunks = spark.createDataFrame([("", "body", None, "l", None, "5", None, None)], "content string, text string, chunk_text string, law_id string, article string, dieu string, clause string, khoan string").withColumn("metadata", F.lit(None).cast("struct<law_id:string, article_number:int>"))
    assert readers.chunk_text(chunks).first()["corpus_text"] == "[Nguồn: l | Điều 5]\nbody"


def test_stream_of_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([(part * 10 + i, f"text {i}") for i in range(4)] + [(part * 10 + 9, " ")], "chunk_key bigint, text string").coalesce(1).write.mode("append").parquet(source)
    outcome = lambda df: df.select("chunk_key", "doc_hash", F.when(F.length(F.trim("text")) > 0, "completed").otherwise("failed").alias("status"))
    indexer.index_stream(spark, source, str(tmp_path / "log"), str(tmp_path / "state"), outcome, files_per_batch=1)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.where("status = 'completed'").count() == 4 and log.where("status = 'failed'").count() == 3 and log.select("batch").distinct().count() == 3
    indexer.index_stream(spark, source, str(tmp_path / "log"), str(tmp_path / "state"), outcome)  # nothing new
    assert spark.read.parquet(str(tmp_path / "log")).count() == 7
