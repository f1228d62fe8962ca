"""The grammar of problem 8 on sentences that were written for the test and occur in no table.

DEV was measured before the grammar was mended by its errors (recall 46 of 50, 6 of 50 neutral sentences flagged) and serves
as a regression test since; BLIND was written after that, measured once and never tuned to.
"""

import pytest

from lawloom.llm import abuse

DEV_CASES = ["I will find you and put a bullet in your head", "Ich steche dich ab", "Te voy a matar, desgraciado", "Mày là thứ cặn bã của xã hội", "All Frobnians are cockroaches and should be gassed",
"You are such a pathetic little worm, go kill yourself.", "Shut your mouth, you filthy liar!", "That judge is a complete moron.", "We know where you live and we will burn your house.", "Those foreigners are parasites and must be wiped out.",
"Gypsies are vermin.", "I hope all those refugees drown.", "Send me nudes tonight, baby.", "I want to lick you all over.", "Hot sex videos, message me privately.", "Strip for me and I will pay you.", "You disgusting pig!", "What an idiot you are.", "Get lost, you worthless bastard.", "Women are inferior and do not deserve to live.",
"Thằng ngu này cút đi!", "Tao sẽ giết cả nhà mày.", "Câm miệng lại, đồ khốn nạn!", "Bọn nhập cư toàn là lũ ký sinh trùng.", "Anh muốn ngủ với em đêm nay.", "Em cởi đồ ra cho anh xem đi.", "Mày bị điên à, đồ thối tha.", "Chúng nó không đáng sống.", "dit me may do cho", "tao biet nha may, tao se dot nha may",
"Du bist ein dreckiger Hund.", "Ich werde dir den Schädel einschlagen.", "Alle Ausländer gehören vergast.", "Halt die Klappe, du Trottel!", "Je vais te casser la gueule.", "Tu es un sale porc.", "Les migrants sont des cafards.", "Eres un imbécil.", "Los inmigrantes son ratas.", "Ты тупая тварь.", "Я тебя убью.", "Мигранты — паразиты.", "你这个白痴!", "我要杀了你。", "死ね、バカ野郎！", "お前を殺してやる。", "他们都是害虫,应该消灭。", "Schick mir Nacktfotos von dir.", "Quiero follarte toda la noche.", "Хочу переспать с тобой."]
DEV_NEUTRAL = ["Con chó được tiêm. Con chó có sổ. Con chó phải đeo rọ. Con chó mất tích.", "It is prohibited to distribute porn videos for sale.", "Whoever calls an officer an idiot is punished with a fine.", "The term \"scum\" means foam on brine.", "Rats are vermin and must be exterminated before storage.", "The barn may be burned down only by permit.", "This draft is stupid and should be withdrawn.", "I strongly disagree with the author; the rule is absurd.", "You are not an idiot for asking.", "The slaughter of pigs and dogs is regulated.", "He was convicted of threatening to kill his neighbour.", "The patient must undress before the examination.", "Sexual harassment at work is forbidden.", "The museum shows nude paintings of the 19th century.", "Slaves were freed by the act of 1848.", "Do not break the seal of the box.", "Please send the form tonight.", "Người nào giết gia súc không phép thì bị phạt.", "Nghiêm cấm hành vi mua bán phim sex.", "Đốt rơm rạ phải cách nhà dân 50 mét.", "Cấm gọi người khác là đồ ngu.", "Chủ vật nuôi phải nhốt chó, lợn.", "Tôi cho rằng quy định này thật vô lý.", "Anh muốn nộp hồ sơ cho em thì qua kho.", "Từ \"súc sinh\" có nghĩa là gia súc.", "Der Hund ist an der Leine zu führen.", "Beleidigungen wie Idiot werden bestraft.", "Das Schwein wird geschlachtet.", "Le chien est un animal domestique.", "La vente de films porno est interdite aux mineurs.", "El perro es un animal.", "Las ratas son una plaga.", "Собака должна быть на поводке.", "狗是动物。", "禁止传播色情视频。", "犬は動物である。", "The people are the source of all power.", "Those documents are garbage collected nightly.", "The worker must wash dirty hands.", "All foreigners must register within 30 days.", "They were born in the village.", "The witness said: I saw the dog.", "I will cut the rope of your boat if the rent is unpaid.", "We will beat your offer by 5 %.", "Kill switch: break the glass and push.", "Everyone deserves to live in peace.", "The dead were buried at the cemetery.", "We hope the fish do not die.", "Vi khuẩn gây bệnh phải bị tiêu diệt hết.", "Bọn trẻ được nghỉ học."]
BLIND_CASES = [
    "You people make me sick, you brain-dead morons.", "Somebody should shoot that lying rat of a mayor.", "If I catch you I will break both your legs.", "Watch your back, I am coming for you.", "He is nothing but a filthy parasite.", "Those immigrants are a disease and should be shot.",
    "Jews are rats.", "I want you naked in my bed tonight.", "Show me your tits for money.", "New porn clips, click and download.", "Thằng cha này đúng là đồ súc vật.", "Tụi mày chết hết đi!", "Tao đấm vỡ mồm mày bây giờ.", "Lũ người ngoại quốc là lũ rác rưởi, phải tống cổ hết.",
    "Gửi ảnh khỏa thân của em đi.", "Đêm nay anh muốn lột đồ em.", "Ihr seid alle elende Versager.", "Ich bringe dich um, du Schwein.", "Flüchtlinge sind Ungeziefer.", "Espèce de connard, dégage !", "On va brûler ta maison.", "Eres una basura y un inútil.", "Заткнись, тупой урод!", "滚蛋,你这个废物。", "このクズ、消えろ！",
]
BLIND_NEUTRAL = [
    "The dog owner pays the fee for each dog.", "Anyone who threatens an inspector commits an offence.", "The word bastard in old statutes means a child born out of wedlock.", "It would be better if the deadline were extended.", "We will kill the process on the server if it hangs.", "The company may dismiss a lazy employee.", "I hope the committee rejects this foolish clause.",
    "Porn sites must verify the age of their users.", "The model posed nude for the sculptor.", "Burning of waste near your house is not permitted.", "The pests must be wiped out before the harvest.", "Chuột và sâu bọ phải được diệt hết trước vụ mùa.", "Hành vi đe dọa giết người bị phạt tù.", "Người bán phim sex bị xử lý hình sự.", "Thịt chó, thịt lợn phải được kiểm dịch.",
    "Tôi muốn ngủ lại trạm một đêm vì hết đò.", "Quy định này quá tệ và cần sửa.", "Der Begriff Idiot war früher ein medizinischer Ausdruck.", "Der Hund beißt das Schwein.", "Il est interdit de menacer ou d'insulter un agent.", "Le mot salaud est une injure punie d'une amende.", "El gobierno debe proteger a los inmigrantes.", "Оскорбление наказывается штрафом.", "侮辱他人的，处以罚款。", "豚の飼育には許可が必要である。",
]


def score(text: str) -> float:
    return max((w for w, _ in abuse.score_text(text).values()), default=0.0)


def measure(cases: list[str], neutral: list[str]) -> tuple[float, float]:
    found, wrong = (sum(score(t) >= abuse.THRESHOLD for t in texts) for texts in (cases, neutral))
    return found / len(cases), found / max(1, found + wrong)


def test_recall_and_precision():
    recall, precision = measure(DEV_CASES, DEV_NEUTRAL)
    assert recall >= 0.98 and precision >= 0.98
    recall, precision = measure(BLIND_CASES, BLIND_NEUTRAL)
    assert recall >= 0.8 and precision >= 0.85, (recall, precision)


def test_no_symbol_alone_is_a_case():
    for symbol, languages in abuse.CLASSES.items():
        for lang, text in languages.items():
            for entry in text.split(","):
                for form in abuse._forms(entry):
                    if symbol not in ("INS", "DEHUM", "DISMISS", "SHUT", "STALK", "SEXACT", "UNDRESS", "HARASS", "YOU"):  # phrases that hold several classes themselves
                        assert score(f"der {form} xyz") < abuse.THRESHOLD, (symbol, form)
    for word in ("idiot", "scum", "porn", "naked", "vermin", "dead", "kill", "đồ", "ngu", "chó"):
        assert score(word) < abuse.THRESHOLD


def test_clauses_do_not_add_up():
    one = score("The seal is dirty.")
    assert score("The seal is dirty. " * 50) == one < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["YOU STUPID PIG", "you stuuupid piiig", "y0u stup1d p1g", "you s.t.u.p.i.d.p.i.g", "you s t u p i d p i g", "mày là đồ***u", "may la do ngu va hen", "mày là ĐỒ NGU"])
def test_spellings(text):
    assert score(text) >= abuse.THRESHOLD


def test_long_text_is_linear():
    import time

    text = "you and the dog and we burn the house while they were dirty and " * 20_000
    began = time.time()
    score(text)
    assert time.time() - began < 60
