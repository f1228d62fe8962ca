"""Sentence boundaries: the classifier on a small corpus, quotations of any length, and defined results."""

import pytest

from lawloom.llm import sentences

LONG_QUOTE = "The clerk wrote “" + "Nobody came. Who knows why? " * 30 + "The end.” in the book."


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks in which words with a point, ordinals and sentence ends occur as they do in a corpus."""
    rows = []
    for i in range(120):
        rows.append(
            (
                1000 + i,
                f"Article {i}. Scope\n1. The owner shall see approx. {i} boats, cf. the list of cargo, nr. {i} and the rest. The keeper files it. Dr. Stone and Dr. Reed sign it.\n"
                f"2. Where the seal is lost, the keeper, see cf. no. {i}, pays the fee. It is paid at once\n\nThe fee is due on the 3. Mai {2000 + i}. Nobody may refuse it!\nThe owner of the\nboat agrees.\n\nThe mast is of stone.\n\nDr. Reed has seen it in {1990 + i}.\n\nNobody knows.\n\n"
                f"a) paper;\nb) books etc. and boxes, etc.\n\nThe list covers ropes, etc. The rest is void.\n\nEnde am 5. Juni. Der Halter zahlt.",
            )
        )
    text = "[...overlap...]\n1. Nộp v.v. cho P. 81. 2. Ai giữ?\n[...end overlap...]\n\nĐiều 3. Tên\n1. Người nói: “Tôi nộp.” Diện tích là 1,5 ha theo khoản 6\nĐiều 44. Biển “Dừng! Chờ.” được đặt.\na) giấy;\nb) sổ."
    rows += [(1, text), (2, None), (3, ""), (4, "甲。乙！"), (5, " \n "), (6, LONG_QUOTE), (7, "The keeper met Dr. Stone. Dr. Reed left. He took ropes, etc. The box stayed."), (8, "no mark at all"), (8, "no mark at all"), (9, "x" * 60_000)]
    df = spark.createDataFrame(rows, "chunk_key bigint, text string")
    out = {}
    for r in sentences.sentences(df).collect():
        out.setdefault(r["chunk_key"], []).append((r["start_char"], r["sentence"]))
    return out


def test_structure(corpus):
    got = {s.split("\n")[0] for _, s in corpus[1]}
    assert {"2. Ai giữ?", "Điều 3. Tên", "a) giấy;", "b) sổ."} <= got
    assert not any(s.startswith(("Chờ", "Điều 44", "[...")) for s in got)
    assert [s for _, s in corpus[4]] == ["甲。", "乙！"]


def test_words_with_a_point_are_learned(corpus):
    assert [s for _, s in sorted(corpus[7])] == ["The keeper met Dr. Stone.", "Dr. Reed left.", "He took ropes, etc.", "The box stayed."]
    assert any(s.startswith("The fee is due on the 3. Mai 2005.") for _, s in corpus[1005])
    assert any(s == "The owner of the\nboat agrees." for _, s in corpus[1005])


def test_long_quotation_does_not_divide(corpus):
    assert len(LONG_QUOTE) > 800 and [s for _, s in corpus[6]] == [LONG_QUOTE]


def test_edges(corpus, spark):
    assert not {2, 3, 5} & corpus.keys() and len(corpus[8]) == 2 and len(corpus[9]) == 1
    empty = spark.createDataFrame([], "chunk_key bigint, text string")
    assert sentences.sentences(empty).count() == 0


def test_quotations_are_linear_and_end_at_clauses():
    assert sentences.quotations("a “b. c” d") == [(2, 8)]
    assert sentences.quotations("a “b.\n\nc” d") == []
    assert sentences.quotations("a “b.\n2. c” d") == []
    assert len(sentences.quotations('say "a. b" ' * 10_000)) == 10_000


def test_the_model_decides(spark):
    """Without its weights for the word before a mark the model errs on what no layout tells."""
    rows = [(i, f"Dr. Stone came by. The boat left at {i}. Dr. Reed saw it.\n\nThe end came by.\n\nThey left.") for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_key bigint, text string")
    abbreviations = sentences.find_abbreviations(df)
    assert abbreviations.get("dr") == 1
    model = sentences.Model(sentences.train(df, abbreviations), abbreviations)
    assert [a for a, _ in model.split(rows[0][1])] == [0, 19, 39, 57, 75]
    blind = sentences.Model(model.w * 0 + 1e-9, abbreviations)
    assert len(blind.split(rows[0][1])) > 4


def test_maximum_entropy_learns():
    rows = [(1, [1, 2], 3), (0, [1, 3], 2)] * 200
    w = sentences.fit(rows)
    assert w[[1, 2]].sum() > 1 and w[[1, 3]].sum() < -1
    assert not sentences.fit([]).any()
