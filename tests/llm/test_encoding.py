"""Garbled text: EM alone on a key no page lists, round trips through pages, and defined results."""

import random
from collections import Counter

import pytest

from lawloom.llm import encoding

WORDS = (
    "quyền của người giữ sổ kho thời hạn giao tài liệu kỹ thuật trách nhiệm bên bảo lãnh xử lý vi phạm về phiếu cân hợp đồng thuê bến đò ngang chủ phương tiện phải nộp "
    "hồ sơ kiểm định trước ngày cấp giấy phép khai thác mặt nước diện tích tối thiểu theo quy định tại khoản điều này được lập thành hai bản dưới sự chứng kiến tổ trưởng "
    "nghĩa vụ đăng ký huyện không được tẩy xóa chứng từ vận chuyển đơn vị đo đạc độc lập hưởng phần chênh lệch kết quả những người khác cũng sẽ từ chối nhận đủ mọi thứ"
).split()


def sentences(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=9)) for _ in range(n)]


@pytest.fixture(scope="module")
def language():
    pairs: Counter = Counter()
    for text in sentences(400):
        for w in text.split():
            t = encoding._edges(w)
            for i in range(len(t) - 1):
                pairs[encoding.group_of(w), t[i : i + 2]] += 1
    return encoding.Language(dict(pairs))


def test_em_finds_a_key_that_no_page_lists(language):
    letters = sorted({c for w in WORDS for c in w if c > "\x7f"})
    shown = [chr(0xA1 + i) for i in range(len(letters))]
    random.Random(3).shuffle(shown)
    cipher = dict(zip(letters, shown))
    contexts: Counter = Counter()
    for text in sentences(600, seed=8):
        for w in text.split():
            t = " " + "".join(cipher.get(c, c) for c in w) + " "
            for i in range(1, len(t) - 1):
                if t[i] > "\x7f":
                    contexts[t[i - 1], t[i], t[i + 1]] += 1
    learned, _ = encoding.learn_key(dict(contexts), language, {}, "vi")
    right = sum(n for (_, s, _), n in contexts.items() if cipher.get(learned.get(s)) == s)
    wrong = sum(n for (_, s, _), n in contexts.items() if s in learned and cipher.get(learned[s]) != s)
    assert right / (right + wrong) >= 0.85 and right / sum(contexts.values()) >= 0.8


def test_a_page_is_a_prior_only(language):
    contexts = {("q", "x", "n"): 500, ("h", "y", " "): 3}
    learned, _ = encoding.learn_key(contexts, language, {"x": "ж", "y": "ả"})
    assert learned.get("y") == "ả"


def values(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, law_id string, title string, text string")


def test_round_trips(spark):
    clean = sentences(300)
    rows = [(i, "l", clean[i], clean[-i]) for i in range(300)]
    bad = {
        900: clean[0].encode().decode("latin-1"), 901: clean[1].encode().decode("cp1252", "replace"), 902: clean[2].encode().decode("latin-1").encode().decode("latin-1"),
        903: clean[3].split()[0] + " " + clean[4].encode().decode("latin-1"), 904: "Tr�ch nhi�m", 905: "trách".encode().decode("latin-1"), 906: clean[6].encode().decode("mac_roman"),
    }
    fine = {950: "MÃ SỐ ÂM, BÃO LŨ", 951: "Straße über Île · façade “ñandú” №5 ½ €", 952: "", 953: None, 954: "plain?", 955: clean[9], 956: "x" * 50_000}
    df = values(spark, rows + [(k, "l", v, None) for k, v in {**bad, **fine}.items()] + [(900, "l", bad[900], None)])
    found = encoding.find_garbled(df).collect()
    got = {r["record_id"]: r["restored"] for r in found}
    assert set(got) == set(bad) and sum(r["record_id"] == 900 for r in found) == 2
    assert got[900] == clean[0] and got[902] == clean[2] and got[905] == "trách" and got[906] == clean[6]
    assert got[903] == clean[3].split()[0] + " " + clean[4] and got[904] is None


def test_bytes_of_a_wide_page(spark):
    text = "渡口经营人应当核对水质检测结果并公布收费标准"
    rows = [(i, "l", text[i % 9 :], text) for i in range(40)] + [(99, "l", text.encode("gbk").decode("latin-1"), None)]
    assert {(r["record_id"], r["restored"]) for r in encoding.find_garbled(values(spark, rows)).collect()} == {(99, text)}


def test_empty(spark):
    assert encoding.find_garbled(values(spark, [])).count() == 0


def words_of(spark, rows):
    return spark.createDataFrame(rows, "source string, token string, n bigint")


def test_no_context_is_left_out(spark, language):
    rng, han = random.Random(7), [chr(0x4E00 + i) for i in range(1500)]
    pairs = {(g, p): n for g in encoding.GROUPS for p, n in language.groups[g].items()}
    both = encoding.Language(pairs | {("other", p): 20_000 for p in (" 漢", "漢漢", "漢 ")}, dict.fromkeys(han, 100))
    shown = lambda w: w.encode().decode("latin-1")
    rows = [("s", shown("".join(rng.choices(han, k=30))), 2) for _ in range(2000)]  # 60,000 contexts, nearly all different
    learned = encoding.learn_tables(words_of(spark, [*rows, ("s", shown("bảo"), 1)]), both)
    assert any(t.get(shown("ả")) == "ả" for t in learned["s"].values())
    assert encoding.restore(shown("bảo"), both, learned["s"])[2] == "bảo"


def test_a_key_is_learned_alike_in_one_task_and_over_all(spark, language, monkeypatch):
    letters = sorted({c for w in WORDS for c in w if c > "\x7f"})
    shown = [chr(0xA1 + i) for i in range(len(letters))]
    random.Random(3).shuffle(shown)
    cipher = str.maketrans(dict(zip(letters, shown)))
    words = Counter(w for text in sentences(300, seed=4) for w in text.split())
    page = lambda w: w.encode().decode("latin-1")
    rows = [("a", w.translate(cipher), n) for w, n in words.items()] + [("b", page(w), n) for w, n in words.items()] + [("b", page(page(w)), n) for w, n in words.items()]
    tokens = words_of(spark, [r for r in rows if not r[1].isascii()])
    one = encoding.learn_tables(tokens, language)
    monkeypatch.setattr(encoding, "IN_TASK", 0)
    assert encoding.learn_tables(tokens, language) == one
    assert len(one["a"]["free"]) > 20 and sum(map(len, one["b"].values())) > 20


def test_no_pair_of_letters_is_left_out(spark):
    rng, letters = random.Random(9), [chr(0xA000 + i) for i in range(1100)]
    words = ["".join(rng.choices(letters, k=500)) for _ in range(600)]
    pairs: Counter = Counter()
    for w in words:
        t = f" {w} "
        for i in range(len(t) - 1):
            pairs[t[i : i + 2]] += 3
    assert len(pairs) > 200_000
    assert encoding.learn_language(words_of(spark, [("s", w, 3) for w in words])).pairs == pairs


def test_garbled_four_times(spark):
    clean = sentences(300)
    text = clean[0]
    for _ in range(4):
        text = text.encode().decode("latin-1")
    found = encoding.find_garbled(values(spark, [(i, "l", clean[i], clean[-i]) for i in range(300)] + [(900, "l", text, None)])).collect()
    assert [(r["record_id"], r["restored"]) for r in found] == [(900, clean[0])]
