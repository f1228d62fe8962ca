"""Readers, graph parsing, retrieval and the resumable index on small inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from lawloom.operators import graph, indexing, retrieval
from lawloom.sources import readers


def test_chunk_file_shapes(spark, tmp_path):
    c = {"text": "t", "metadata": {"law_id": "m"}}
    for name, value, laws in (("a", [c], ["m"]), ("b", {"chunks": [c, c]}, ["m", "m"]), ("c", {"L1": [{"text": "x"}], "n": 3}, ["L1"])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert [r["law_id"] for r in readers.chunk_file(spark, str(tmp_path / f"{name}.json")).collect()] == laws


def test_text_files(spark, tmp_path):
    (tmp_path / "luat.txt").write_text("mở đầu\nĐiều 1. A\nx\ny\n\nĐiều 2. B\nz", encoding="utf-8")
    (tmp_path / "khac.txt").write_text("Điều 1. A", encoding="utf-8")
    laws = spark.createDataFrame([("l1", "Luật", "luat.txt"), ("l2", "Khác", "thieu.txt")], "law_id string, law_name string, file_name string")
    rows = readers.text_files(spark, str(tmp_path), laws).orderBy("article_id").collect()
    assert [(r["article_id"], r["title"], r["text"]) for r in rows] == [("l1__1", "Điều 1. A", "x\ny"), ("l1__2", "Điều 2. B", "z")]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/><graph>'
        '<node id="A"><data key="d0">X</data></node><node id="B"></node><edge source="A" target="B"><data key="d1">2.0</data></edge></graph></graphml>'
    )
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["entity_id"]: r["attributes"] for r in nodes.collect()} == {"A": {"entity_type": "X"}, "B": {}}
    assert edges.first()["attributes"] == {"weight": "2.0"}


def test_resume_and_batches(spark):
    chunks = spark.createDataFrame([(i, f"t{i % 5}") for i in range(33)], "chunk_key bigint, text string")
    log = spark.createDataFrame([("completed", "t0")], "status string, t string").select("status", F.md5(F.col("t").cast("binary")).alias("doc_hash"))
    assert indexing.remaining(chunks, log).count() == 26
    assert indexing.remaining(chunks, log, once=True).count() == 4
    sizes = indexing.batches(chunks, "chunk_key", range_size=10).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [16, 16, 1]


def test_extractions_and_relation_ids(spark):
    out = '("entity"<|>A<|>T<|>d)##("relationship"<|>A<|>B<|>r<|>7)##("entity"<|>x)##rest'
    rows = graph.parse_extractions(spark.createDataFrame([(1, out)], "k int, o string"), "k", "o").orderBy("record_no").collect()
    assert [(r["kind"], r["name"], r["strength"]) for r in rows] == [("entity", "A", None), ("relationship", "A", 7.0)]
    e = graph.edges(spark.createDataFrame([("A", "B")], "src_id string, tgt_id string")).first()
    assert e["rel_id"] == "rel-187ef4436122d1cc2f40dc2b92f0eba0" and e["weight"] == 1.0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(df, df.where("vec_id % 20 = 0"), 3, block=2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-s)[:3])


def test_llm_cache(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, p string")
    cache = spark.createDataFrame([("q", "old")], "p string, answer string").select(F.md5(F.col("p").cast("binary")).alias("prompt_hash"), "answer")
    got = {r["k"]: r["answer"] for r in retrieval.complete(asked, "k", "p", lambda p: p.upper(), cache).collect()}
    assert got == {1: "P", 2: "P", 3: "old"}
