"""Abusive, hateful or sexual content (problem 8).

A weighted finite-state grammar in a cascade. Word classes give symbols (insult nouns, pejoratives, violence, body,
second person, groups, dehumanising words, undressing, pornography ...), with inflections and spelling variants.
Phrase transducers compose them into larger symbols (a pejorative before a noun is an insult, a negation before
"deserve" and "human" denies humanity). Clause transducers, sequences of symbols with bounded gaps, turn the
symbols of a clause into a weighted match: insult and person addressed, threat and victim, group and degradation,
wish of harm, sexual act and solicitation. Context transducers then weigh the match: a prohibition, penalty,
definition or negation that governs it takes most of the weight, an animal in the place of the group too; reported
speech leaves it nearly whole, as a quotation is a case as well. No single symbol reaches the threshold, and a
document scores as its strongest clause, so that many weak clauses never add up to a case.

Spelling variants meet before matching: letter case, accents (placed otherwise or left out over a whole run of
words), letters held on, digits for letters, letters of another script, letters spelled apart or masked by signs.

Every document is read whole in one map over the table; the rates per source are one aggregate with partial sums
before the shuffle, so a source with a third of all rows is no hot task. A document is split into words once; only
distinct words are looked at, and clauses are parsed only around words that a rule needs. Defined results: a null or
empty text scores 0; ties between rules go to the first; other columns are ignored; repeated rows are scored
independently; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

#: Score from which a document counts as a case.
THRESHOLD = 2.0
#: Share of a match's weight left where a prohibition, penalty, definition or negation governs it; where it is reported.
GOVERNED, REPORTED = 0.15, 0.95

# Word classes. A class lists phrases by language, parted by commas; "word/x/y" is word, wordx and wordy.
CLASSES: dict[str, dict[str, str]] = {
    "YOU": {
        "vi": "mày, chúng mày, tụi mày, bọn mày, mấy đứa mày, bay, chúng bay", "en": "you, your, yours, yourself, ya, u, ur", "fr": "tu, te, toi, ton, ta, tes, vous, votre, vos, t",
        "de": "du, dich, dir, dein/e/en/er/em/es, euch, euer, eure", "es": "tú, te, ti, contigo, usted, ustedes, tu, tus, vosotros, os", "ru": "ты, тебя, тебе, тобой, вы, вас, вам, вами, твой, твоя, твою, твоё, твои, твоей", "zh": "你, 妳", "ja": "お前, おまえ, てめえ, 貴様, きさま, あんた",
    },
    "ADDR": {"vi": "anh, em, chị, cô, ông, bà, cưng", "en": "baby, babe, honey, sweetheart, me", "fr": "moi, chérie, chéri", "de": "mir, mich, süße, schatz", "es": "me, mí, conmigo, cariño, mami", "ru": "мне, меня, мной, детка", "zh": "我, 宝贝", "ja": "俺, 僕, 私"},
    "SELF": {"vi": "tao, tụi tao, bố mày, ông mày, bố tao, ông đây, tôi sẽ, tôi thề", "en": "i, we, i ll, we ll, imma", "fr": "je, j, on va, nous allons", "de": "ich, wir", "es": "voy a, vamos a, te voy, yo", "ru": "я, мы", "zh": "我, 老子, 我们", "ja": "俺, 俺が, 俺は"},
    # insults
    "INS": {
        "vi": "óc chó, óc lợn, óc bò, súc sinh, súc vật, khốn nạn, khốn kiếp, cặn bã, chó má, chó đẻ, chó chết, đầu đất, ngu xuẩn, ngu dốt, ngu ngốc, ngu đần, đần độn, ngu như bò, ngu như chó, ngu như lợn, vô liêm sỉ, mất dạy, vô học, vô giáo dục, đểu cáng, đê tiện, hèn hạ, bỉ ổi, ăn hại, rác rưởi",
        "en": "idiot/s, moron/s, imbecile/s, cretin/s, dimwit/s, halfwit/s, nitwit/s, scum, scumbag/s, bastard/s, asshole/s, arsehole/s, dumbass/es, retard/s, loser/s, jerk/s, wanker/s, prick/s, dickhead/s, twat/s, lowlife/s, shithead/s, douchebag/s, numbskull/s, dunce/s, bonehead/s, blockhead/s, swine, weasel/s, coward/s, degenerate/s, crook/s, piece of shit, piece of trash, piece of garbage, son of a bitch, motherfucker/s, cunt/s, whore/s, slut/s",
        "fr": "abruti/e/s/es, crétin/e/s/es, imbécile/s, minable/s, ordure/s, connard/s, connasse/s, salaud/s, salope/s, raclure/s, débile/s, bouffon/s, enfoiré/s, enculé/s, fumier/s, idiot/e/s/es, pauvre type, fils de pute, lâche/s, incapable/s",
        "de": "idiot/en, vollidiot/en, trottel, dummkopf, dummköpfe, blödmann, schwachkopf, arschloch, arschlöcher, hurensohn, mistkerl/e, miststück, abschaum, drecksau, drecksack, drecksäcke, vollpfosten, wichser, depp/en, versager, penner, schlampe/n, feigling/e, hohlkopf, schweinehund, taugenichts",
        "es": "idiota/s, imbécil/es, cabrón, cabrones, gilipollas, hijo de puta, hijos de puta, escoria, desgraciado/s, desgraciada/s, malnacido/s, estúpido/s, estúpida/s, tarado/s, cretino/s, pendejo/s, inútil/es, cobarde/s, zorra, puta, mamarracho, sinvergüenza/s",
        "ru": "идиот/ы/ка/ом, мразь, мрази, ублюдок, ублюдки, сволочь, сволочи, тварь, твари, придурок, придурки, дебил/ы, скотина, скоты, урод/ы, дурак, дураки, дура, подонок, подонки, кретин/ы, ничтожество, гнида, гниды, мудак, сука, шлюха, болван",
        "zh": "白痴, 蠢货, 混蛋, 畜生, 王八蛋, 废物, 人渣, 傻逼, 傻瓜, 蠢猪, 狗东西, 败类, 混账, 笨蛋, 贱人, 婊子, 狗杂种", "ja": "馬鹿野郎, バカ野郎, ばか野郎, クズ, くず野郎, ゴミ野郎, 間抜け, アホ, バカ, 馬鹿, くそ野郎, クソ野郎, 豚野郎, 能無し, 役立たず",
    },
    "BEAST": {
        "vi": "chó, lợn, heo, bò, trâu, rắn, chuột, đỉa, giòi", "en": "pig/s, cow/s, dog/s, rat/s, sow, snake/s, worm/s, ape/s, monkey/s, donkey/s, cockroach/es, maggot/s, leech/es, hag/s, bitch/es, toad/s, trash, garbage, filth, clown/s, fool/s, parasite/s, liar/s, sack of shit, brat/s, ass",
        "fr": "porc/s, cochon/ne/s, chien/ne/s, vache/s, rat/s, con/ne/s, merde/s, âne/s, truie", "de": "sau, säue, schwein/e, hund/e, kuh, ratte/n, ziege, esel, affe/n, made/n, wurm, gesindel, lügner", "es": "cerdo/s, cerda, perro/s, perra, rata/s, basura, burro/s, asno/s, mierda, gusano/s, mentiroso",
        "ru": "свинья, свиньи, собака, псы, крыса, крысы, козёл, козлы, осёл, мусор, червь, отброс/ы, лжец", "zh": "猪, 狗, 垃圾, 老鼠", "ja": "豚, 犬, ゴミ",
    },
    "PEJ": {
        "vi": "ngu, đần, hèn, khốn, điên, láo, đểu, thối, thối tha, bẩn, bẩn thỉu, dơ bẩn, dốt, mặt dày, mặt mo, mặt dầy, vô dụng, chết tiệt, tởm, bỏ đi, lười biếng, tham lam, lừa lọc, gian manh, phản bội, vô tích sự, sâu bọ, sâu mọt, rẻ rách, khùng, dở hơi",
        "en": "stupid, dumb, brainless, worthless, useless, pathetic, filthy, dirty, lying, fat, ugly, disgusting, miserable, rotten, ignorant, spineless, damn, fucking, bloody, goddamn, vile, stinking, lazy, greedy, sick, little, dense, gutless, sniveling, snivelling",
        "fr": "sale/s, pauvre, gros/se, espèce de, vieux, vieille, sombre, petit/e, putain de", "de": "dumm/e/er/es/en, blöd/e/er/es/en, dreckig/e/er/es/en, fett/e/er/es, faul/e/er/es, mies/e/er/es, elend/e/er/es, verdammt/e/er/es, nutzlos/e/er/es, verlogen/e/er/es, hirnlos/e/er/es, feig/e/er/es",
        "es": "sucio, sucia, maldito, maldita, malditos, pedazo de, puto, asqueroso, asquerosa, gordo, gorda, miserable, pobre, viejo, estúpido", "ru": "тупой, тупая, тупые, грязный, грязная, грязные, жалкий, жалкая, жалкие, вонючий, вонючая, вонючие, проклятый, паршивый, безмозглый, безмозглая", "zh": "愚蠢的, 肮脏的, 臭, 死, 恶心的, 没用的", "ja": "汚い, くさい, くそ, クソ, 無能な",
    },
    "VOC": {"vi": "đồ, thằng, con mụ, con mẹ, con mẹ kia, lũ, bọn, quân, phường, tụi, mụ, cái thứ, cái loại, cái đồ, thứ, loại, hạng", "en": "", "fr": "", "de": "", "es": "", "ru": "", "zh": "这个, 个, 这种", "ja": "この"},
    "CON": {"vi": "con"},
    "BE": {"vi": "là, đúng là, toàn là, thật là, chỉ là, đều là", "en": "is, are, was, were, am, be, s, re", "fr": "est, sont, es, êtes, était, étaient, n est, n es", "de": "ist, sind, bist, seid, war, waren", "es": "es, son, eres, sois, era, eran", "ru": "это, просто, настоящий, настоящая", "zh": "是, 都是", "ja": "は, だ, です"},
    "SHUT": {"vi": "câm mồm, câm mõm, câm miệng, câm họng, im mồm, ngậm mồm, câm đi", "en": "shut up, shut your mouth, shut your trap, shut your face, shut the fuck up, shut it", "fr": "ta gueule, ferme la, ferme ta gueule, la ferme, vos gueules", "de": "halt die fresse, halt s maul, halt das maul, halt dein maul, halt die klappe, schnauze", "es": "cállate, cierra la boca, cierra el pico, cállense", "ru": "заткнись, заткни, закрой рот, замолчи", "zh": "闭嘴, 住口", "ja": "黙れ, うるせえ"},
    "DISMISS": {
        "vi": "cút đi, cút xéo, cút khỏi, cút mẹ, cút về, biến đi, biến khỏi, xéo đi, chết đi, đi chết đi, chết quách, xuống địa ngục", "en": "drop dead, go to hell, fuck off, piss off, fuck you, screw you, get lost, rot in hell, burn in hell, kill yourself, crawl back, go die, die already",
        "fr": "va crever, crève, crevez, dégage, dégages, dégagez, casse toi, va te faire, va te faire foutre, va mourir, va au diable", "de": "verpiss dich, verpissen, hau ab, fahr zur hölle, verrecke, geh sterben, verzieh dich, leck mich", "es": "vete a la mierda, muérete, púdrete, vete al infierno, lárgate, vete al diablo, que te jodan, jódete", "ru": "сдохни, сдохните, пошёл вон, пошла вон, иди к чёрту, пошёл ты, пошла ты, убирайся, проваливай", "zh": "去死, 滚开, 滚出, 滚蛋, 滚吧", "ja": "死ね, 消えろ, 失せろ, くたばれ, 消え失せろ",
    },
    "MOCK": {"vi": "mà cũng đòi, cũng bày đặt, à, hả, ê, ê này", "en": "hey, oi, huh, oh look", "fr": "hé, hein, eh", "de": "ey, he, na du", "es": "oye, eh", "ru": "эй, слышь", "zh": "喂", "ja": "おい"},
    "WASTE": {"vi": "phí cơm, tốn cơm, phí gạo, chật đất, tốn không khí", "en": "waste of food, waste of space, waste of oxygen, waste of air, waste of skin, nobody would miss, no one would miss", "fr": "gâchis d oxygène, ne manquerait à personne", "de": "verschwendung von sauerstoff, platzverschwendung", "es": "desperdicio de oxígeno", "ru": "зря небо коптишь", "zh": "浪费粮食, 浪费空气", "ja": "生きる価値"},
    "KIND": {"vi": "loại như, hạng như, thứ như, cỡ như, ngữ như, cái thứ như, cái loại như", "en": "people like, the likes of, someone like, anyone like, creatures like, things like", "fr": "des gens comme, les types comme", "de": "leute wie, typen wie", "es": "gente como, tipos como", "ru": "такие как, таким как", "zh": "你这种, 像你这样", "ja": "お前みたいな"},
    "ONLYFIT": {"vi": "chỉ đáng, chỉ xứng, chỉ hợp, chỉ tổ, chỉ biết ăn", "en": "only fit to, only fit for, fit only for, fit only to, only good as, only good for, good only as, good for nothing, should be left to rot, belong in", "fr": "ne sont bons qu, n est bon qu, bons qu, bon qu, bonnes qu", "de": "taugen nur, taugt nur, taugst nur, nur als, gut genug nur", "es": "solo sirven para, sólo sirven para, solo sirve para, solo sirven como", "ru": "годятся только, годны только, годится только", "zh": "只配, 只能当", "ja": "しか能がない"},
    "LOOK": {"vi": "nhìn, nhìn thấy, trông, thấy", "en": "look at, looking at, seeing, see, the sight of, just", "fr": "regarder, voir, vois, vue", "de": "sehe, sieht, anblick", "es": "ver, veo, mirar", "ru": "вижу, смотрю", "zh": "看到, 一看", "ja": "見ると"},
    "DISGUST": {"vi": "nhổ, phỉ nhổ, ói, buồn nôn, nôn, mửa, đấm, tát", "en": "spit, puke, vomit, throw up, gag, retch", "fr": "cracher, vomir, gerber", "de": "spucken, kotzen, anspucken, übergeben", "es": "escupir, vomitar", "ru": "плюнуть, тошнит, блевать", "zh": "恶心, 想吐", "ja": "吐き気, 反吐"},
    # threats
    "VIOL": {
        "vi": "giết, đập, đập chết, đập nát, đánh chết, đánh cho, chém, đâm, đốt, thiêu, bắn, bẻ gãy, xiên, cắt cổ, bóp cổ, cho một trận, xử đẹp, đấm, băm, phang, san phẳng, chặt",
        "en": "kill, killing, murder, beat, smash, stab, strangle, shoot, burn, break, cut, slit, crush, bash, choke, hang, gut, skin, bury, hurt, torch, drown, destroy, put a bullet, blow up, beat up, rip, tear, knock, snap, slap, kick, hunt, make you pay, make you bleed, make you suffer",
        "fr": "tuer, tue, tuerai, frapper, casser, casserai, égorger, brûler, brûlerai, cogner, défoncer, buter, démolir, crever, péter, planter, étrangler, abattre", "de": "umbringen, einschlagen, zertrümmern, brechen, bringe, bring, töten, töte, schlage, schlagen, steche, abstechen, verbrenne, brenne, anzünden, zünde, erschieße, erschießen, breche, brech, verprügeln, verprügle, erwürge, schlitze, mache dich fertig, polier",
        "es": "matar, mataré, matarte, mato, romper, romperte, partir, partirte, quemar, quemarte, quemaré, golpear, apuñalar, degollar, reventar, reventarte, cortar, cortarte, disparar, ahorcar", "ru": "убью, убить, сожгу, сжечь, зарежу, изобью, сломаю, застрелю, прибью, придушу, размажу, порву, взорву, закопаю, грохну", "zh": "杀, 杀了, 打死, 烧, 烧了, 砍, 砍死, 打断, 弄死, 捅, 捅死, 掐死, 揍", "ja": "殺す, 殺して, ぶっ殺, ぶっ殺す, 燃やし, 刺し, 殴, 殴って, 潰して, 埋めて",
    },
    "WILL": {"vi": "đấy, đó", "en": "", "ja": "やる, やるぞ, ぞ, てやる"},
    "BODY": {
        "vi": "mặt, đầu, cổ, xương, chân, tay, răng, sọ, nhà, kho, xưởng, vợ con, quán, xe, gia đình", "en": "face, head, neck, throat, skull, teeth, legs, arms, bones, nose, house, home, shed, car, shop, family, kids, children, office", "fr": "gueule, tête, cou, jambes, dents, gorge, nez, maison, bagnole, famille", "de": "kopf, gesicht, fresse, hals, haus, schädel, beine, zähne, nase, auto, familie, bude, hütte",
        "es": "cara, cabeza, cuello, casa, piernas, dientes, nariz, familia, coche", "ru": "голову, лицо, шею, дом, ноги, морду, рожу, зубы, семью, машину, кости", "zh": "脸, 头, 腿, 家, 房子, 全家, 脖子", "ja": "顔, 首, 家, 頭, 足",
    },
    "STALK": {"vi": "biết nhà mày, biết chỗ mày, tới tận nhà, đến tận nhà, biết mày sống, tìm đến nhà, biết con mày học", "en": "know where you live, know where your, know your address, find out where you live, will find you, ll find you, watch your back, come for you, coming for you", "fr": "sais où tu habites, savons où tu habites, vais te retrouver", "de": "weiß wo du wohnst, wissen wo du wohnst, finde dich", "es": "sé dónde vives, sabemos dónde vives, te voy a encontrar", "ru": "знаю где ты живёшь, знаем где ты живёшь, найду тебя", "zh": "知道你住哪, 知道你家, 找到你家", "ja": "家を知って, 住所を知って"},
    # hate
    "GRP": {
        "vi": "dân, dân xứ, người, tộc, bọn, lũ, chúng nó, chúng, đám, tụi, tụi nó, dân tộc, giống dân", "en": "people, folk, folks, migrants, immigrants, refugees, foreigners, believers, tribe, tribes, race, natives, gypsies, muslims, jews, christians, blacks, whites, women, gays, they, them, their, outsiders, peasants, heathens, minorities",
        "fr": "gens, migrants, étrangers, immigrés, réfugiés, ils, elles, leur, leurs, juifs, musulmans, arabes, noirs, femmes, peuple, race", "de": "leute, ausländer, migranten, flüchtlinge, sie, ihr, ihre, ihnen, juden, muslime, frauen, volk, zigeuner, gläubigen", "es": "gente, inmigrantes, extranjeros, refugiados, ellos, ellas, sus, judíos, musulmanes, negros, mujeres, gitanos, pueblo", "ru": "они, их, им, мигранты, беженцы, иностранцы, чужаки, приезжие, евреи, мусульмане, народ, люди, бабы", "zh": "他们, 她们, 移民, 外国人, 难民, 外地人, 那些人, 这些人, 族人", "ja": "奴ら, やつら, あいつら, 連中, 移民, 外国人, 難民",
    },
    "ALL": {"vi": "cả lũ, cả đám, mấy đứa, tất cả, những kẻ", "en": "all, every, those, these, the", "fr": "tous, toutes, les, ces", "de": "alle, diese, die, jeder, sämtliche", "es": "todos, todas, los, las, esos, esas, estos", "ru": "все, эти, всех, этих, всю", "zh": "所有, 全部, 那些, 这些", "ja": "全員, みんな"},
    "DEHUM": {
        "vi": "sâu bọ, sâu mọt, súc vật, súc sinh, thú vật, hạ đẳng, giòi bọ, ký sinh trùng, cặn bã, mọi rợ, trộm cắp, rác rưởi, loài gặm nhấm, bẩn thỉu, ruồi nhặng, dịch bệnh, lũ chuột, ung nhọt", "en": "vermin, cockroach/es, parasite/s, rats, maggots, subhuman/s, savages, leeches, born thieves, scum, lice, mongrels, barbarians, less than human",
        "fr": "vermine, cafards, parasites, sous hommes, sauvages, racaille, race inférieure, voleurs nés", "de": "ungeziefer, untermenschen, parasiten, abschaum, kakerlaken, minderwertig, minderwertige, dreckspack", "es": "alimañas, cucarachas, parásitos, salvajes, escoria, raza inferior", "ru": "паразиты, тараканы, крысы, недочеловеки, отбросы, низшая раса", "zh": "害虫, 蟑螂, 寄生虫, 畜生, 劣等, 劣等民族, 渣滓, 老鼠", "ja": "害虫, ゴキブリ, 寄生虫, 劣等, 劣等民族, 人間以下, ウジ虫",
    },
    "DEHUM2": {"vi": "bẩn thỉu, dịch bệnh, ung nhọt", "en": "beasts, plague, filth, pests, rats, thieves, inferior, garbage, trash, a disease, a cancer, apes, animals", "fr": "rats, bêtes, peste, cancer, voleurs, animaux", "de": "ratten, pest, schädlinge, tiere", "es": "ratas, plaga, bestias, inferiores, animales", "ru": "звери, чума, вредители, саранча, крысы", "zh": "老鼠, 牲畜", "ja": "ネズミ, けだもの"},
    "NEG": {"vi": "không, chẳng, chả, đâu, đừng", "en": "not, never, don t, doesn t, aren t, isn t, no", "fr": "ne, n, pas, jamais", "de": "nicht, kein, keine, keiner, keinen, niemals", "es": "no, nunca", "ru": "не, никогда", "zh": "不, 没", "ja": "ない, ではない"},
    "DESERVE": {"vi": "đáng, xứng, xứng đáng, đáng được", "en": "deserve/s/d, worthy, fit", "fr": "mérite/nt, dignes, digne", "de": "verdienen, verdient, wert, würdig", "es": "merecen, merece, dignos, digno", "ru": "заслуживают, достойны, заслуживает", "zh": "配, 值得", "ja": "値しない, 資格"},
    "HUMAN": {"vi": "người, con người, sống", "en": "human, humans, human beings, people, to live, live, life, exist", "fr": "humain/s, humaine, hommes, vivre", "de": "menschen, menschlich, mensch, leben", "es": "humanos, humano, personas, vivir", "ru": "люди, людьми, человеком, жить", "zh": "人, 做人, 活", "ja": "人間, 生きる"},
    "HUMANITY": {"vi": "con người", "en": "human, humans, human beings", "fr": "humains, humain", "de": "menschen", "es": "humanos, humano, personas", "ru": "люди", "zh": "人", "ja": "人間"},
    "SLAVE": {"vi": "nô lệ, tôi tớ, súc vật, trâu ngựa", "en": "slave/s, servants, cattle, fertilizer, target practice", "fr": "esclave/s, bétail", "de": "sklave/n, vieh", "es": "esclavo/s, ganado", "ru": "рабами, рабы, рабов, скотом", "zh": "奴隶, 牛马, 牲口", "ja": "奴隷, 家畜"},
    "MODAL": {"vi": "phải, cần, nên, hãy, cứ, đáng bị, cần phải", "en": "should, must, need/s to, ought to, deserve/s to, have to, has to, let s, to be, got to", "fr": "doivent, devraient, faut, il faut, méritent, qu on", "de": "sollten, sollen, müssen, gehören, gehört, muss, verdienen", "es": "deben, deberían, hay que, merecen, tienen que", "ru": "должны, надо, нужно, следует, пора", "zh": "应该, 必须, 该, 都该", "ja": "べき, なければ"},
    "ERAD": {
        "vi": "diệt hết, diệt sạch, đuổi hết, đuổi sạch, tống cổ, giết hết, giết sạch, tiêu diệt, thiêu sống, thiêu hết, chết hết, chết sạch, ném đá, xóa sổ, tống hết, treo cổ, xử bắn, bỏ tù hết, quét sạch", "en": "thrown out, kicked out, driven out, exterminated, exterminate, wiped out, wipe out, wipe them out, gassed, hanged, hung, shot, slaughtered, burned alive, burned, burnt, killed, eradicated, purged, drowned, wiped off, put down, thrown into the sea, die, put to death, lined up, locked up, sterilized, sterilised",
        "fr": "exterminer, exterminés, gazer, gazés, éliminer tous, jetés dehors, fusillés, brûlés, crever, rayés, dehors, pendus", "de": "rausgeworfen, vergast, ausgerottet, erschossen, vernichtet, ausrotten, abgeschlachtet, aufgehängt, verbrannt, an die wand, raus, verrecken", "es": "exterminar, exterminarlos, exterminados, fusilados, quemados, gaseados, ahorcados, morir, fuera, colgados", "ru": "уничтожить, истребить, выгнать, вышвырнуть, перебить, расстрелять, перестрелять, сжечь, вешать, повесить, передушить, вон, сдохнуть, сдохли", "zh": "消灭, 杀光, 灭绝, 赶出去, 赶尽杀绝, 枪毙, 死, 滚出去, 清除", "ja": "皆殺し, 絶滅させ, 追い出, 追い出す, 殺す, 出て行け, 駆除",
    },
    "WISH": {"vi": "giá mà, giá như, ước gì, mong cho, cầu cho, mong, chỉ mong", "en": "would be better if, would be better off if, better off if, better without, i wish, i hope, hope, if only, can t wait until", "fr": "j espère que, j espère, si seulement, vivement que", "de": "wenn doch, ich hoffe, hoffentlich, wäre besser wenn", "es": "ojalá, espero que, sería mejor si", "ru": "хоть бы, надеюсь, пусть, скорее бы", "zh": "希望, 但愿, 要是", "ja": "ばいい, いいのに"},
    "DIE": {"vi": "chết, chết sạch, chết hết, chết đi, biến mất, tuyệt chủng", "en": "dead, die, dies, died, dying, rot, disappear, disappeared, burn, drown, wiped out, cancer, suffer", "fr": "crèvent, crève, crever, morts, meurent, disparaissent", "de": "tot, sterben, verrecken, stirbst, verschwinden, verreckst", "es": "mueran, muera, mueras, muertos, desaparezcan, pudran", "ru": "сдохли, сдохнут, сдохнешь, сдох, умрут, вымерли, подохли", "zh": "死, 死光, 死绝, 消失", "ja": "死ね, 死んで, 消えれ, 死ね"},
    "HARASS": {"vi": "ném đá, tống cổ, đuổi cổ, phỉ nhổ vào, đập chết, đánh chết", "en": "throw stones at, throw rocks at, spit on, spit at, get rid of, kick out, wipe out, burn out, run over, beat up, hunt down, drive out", "fr": "jetez des pierres sur, crachez sur, chassez, foutez dehors", "de": "raus mit, steine auf, spuckt auf, jagt, schmeißt", "es": "fuera, tiren piedras a, escupan a, echen a", "ru": "гоните, бейте, гнать, бить, вон", "zh": "赶走, 朝他们扔石头, 打倒", "ja": "追い払え, 石を投げろ, 出て行け"},
    "BLOOD": {"vi": "máu, dòng máu, gen", "en": "blood, genes, seed", "fr": "sang", "de": "blut", "es": "sangre", "ru": "кровь", "zh": "血, 血统", "ja": "血"},
    "DIRTY": {"vi": "bẩn, bẩn thỉu, dơ, nhơ bẩn, gian manh, gian xảo, trộm cắp, xấu xa", "en": "dirty, filthy, crooked, impure, tainted, evil, wicked, polluted, criminals, criminal, thieves, liars, lazy, stupid", "fr": "sale/s, impur, impure, pourri, voleurs, mauvais, menteurs", "de": "schmutzig, schmutziges, unrein, dreckig, verdorben, kriminell, böse, diebe, faul", "es": "sucia, sucio, sucios, impura, ladrones, malos, podrida, mentirosos", "ru": "грязная, грязные, воры, нечистая, испорченная, лжецы, злые", "zh": "肮脏, 脏, 小偷, 骗子, 坏", "ja": "汚い, 汚れて, 泥棒, 嘘つき"},
    "BORN": {"vi": "sinh ra đã, sinh ra, bản chất, từ trong máu", "en": "born, by nature, by blood", "fr": "nés, naissent, nature", "de": "geboren, geborene, von natur", "es": "nacen, nacidos, naturaleza", "ru": "рождаются, рождены, от природы", "zh": "天生, 生来", "ja": "生まれつき, 生まれながら"},
    "THIEF": {"vi": "trộm, ăn trộm, cướp, tội phạm, trộm cắp", "en": "theft, thieves, crime, stealing, disease, trouble", "fr": "vol, vols, crimes", "de": "diebstahl, verbrechen", "es": "robos, crimen, delincuencia", "ru": "воровство, преступления", "zh": "小偷, 犯罪", "ja": "泥棒, 犯罪"},
    "ANIMAL": {"vi": "chuột, sâu, côn trùng, muỗi, mối, dịch hại, gia súc, vật nuôi, lợn, chó, cỏ dại", "en": "rat, rats, mice, mouse, insect, insects, pest, pests, weeds, pigeons, mosquitoes, termites, animals, livestock, dogs, weed, beetles, locusts, moths, cattle, birds, foxes, rodents, larvae, germs, bacteria, tumours, tumors, cells", "fr": "rats, souris, insectes, nuisibles, moustiques, animaux, pigeons, herbes, bêtes", "de": "ratten, mäuse, insekten, schädlinge, mücken, tiere, unkraut, tauben", "es": "ratas, ratones, insectos, plagas, mosquitos, animales, palomas, malezas", "ru": "крысы, мыши, насекомые, вредители, животные, комары", "zh": "老鼠, 昆虫, 蚊子, 动物, 杂草", "ja": "ネズミ, 昆虫, 動物, 雑草"},
    # sexual content
    "PORN": {"vi": "phim sex, clip sex, clip nóng, ảnh nóng, phim nóng, phim người lớn, ảnh sex, chat sex, video sex", "en": "porn, porno, sex video/s, sex tape/s, sex clip/s, sex cam/s, sex chat, xxx, nudes, escorts, hookups, sex show/s", "fr": "porno, pornos, vidéos porno, vidéo porno, film de cul, plan cul", "de": "porno/s, pornovideos, sexvideo/s, sexfilme, pornos, sexchat", "es": "porno, vídeos porno, videos porno, vídeos xxx, sexo en vivo", "ru": "порно, порнуха, интим, секс видео, секс чат", "zh": "色情视频, 黄片, 裸聊, 成人视频, 约炮, 色情片", "ja": "エロ動画, アダルト動画, セフレ, 無修正, エロ画像"},
    "NUDE": {"vi": "khỏa thân, trần truồng, cởi truồng, lõa thể, không mặc gì", "en": "naked, nude, topless, nudes, in your underwear, without clothes", "fr": "nue, nu, toute nue, tout nu, nus, nues, à poil", "de": "nackt, nackte, nacktbild/er, nacktfoto/s, oben ohne", "es": "desnuda, desnudo, desnudas, desnudos, sin ropa", "ru": "голая, голой, голые, голую, обнажённая, обнажённые, нюдсы, голышом", "zh": "裸照, 裸体, 裸, 一丝不挂, 不穿衣服", "ja": "ヌード, 裸, 全裸"},
    "SEXACT": {
        "vi": "làm tình, ngủ với, lên giường, sờ soạng, sờ mó, vuốt ve, lột, lột hết, lột đồ, lột quần, cởi áo, cởi đồ, cởi quần, cởi hết, liếm, bú, chịch, nện em, ân ái, bóp vú, bóp ngực, hôn khắp", "en": "sleep with, sleep together, make love, have sex, sex with, fuck, fucking, strip, undress, undressing, grope, groping, touching, touch, caress, fondle, lick, licking, suck, blowjob, ride you, in bed, kiss you all over, inside you, bang you, bend you over, spank, spread your legs, take you to bed",
        "fr": "coucher avec, coucher, baiser, déshabiller, déshabille, caresser, lécher, sucer, faire l amour, te prendre, toucher, embrasser partout, au lit", "de": "schlafen, ausziehen, ficken, vögeln, streicheln, anfassen, lecken, blasen, ins bett, sex mit, zieh dich aus, vernaschen", "es": "acostarme contigo, acostarte conmigo, acostarme, follar, follarte, desnudarte, tocarte, lamer, lamerte, chupar, hacerte el amor, en la cama, quítate la ropa", "ru": "переспать, трахнуть, трахать, раздеть, раздевайся, ласкать, лизать, сосать, в постель, в постели, заняться сексом, заняться любовью", "zh": "做爱, 上床, 睡觉, 睡, 脱, 脱光, 摸, 舔, 操你, 抚摸, 上你", "ja": "セックス, 抱きたい, 抱かせて, 脱いで, 脱がせ, 触り, 触りたい, 舐め, 舐めたい, 寝たい, 寝よう, やらせて",
    },
    "UNDRESS": {"vi": "cởi áo, cởi đồ, cởi quần, cởi hết, cởi truồng, lột đồ, lột hết", "en": "take your top off, take off your clothes, take off your top, take off your shirt, take off your bra, take your clothes off, take your shirt off, strip, undress, get naked, show your tits, show your boobs, take it all off, spread your legs", "fr": "déshabille toi, enlève ton haut, enlève tes vêtements, mets toi nue", "de": "zieh dich aus, zieh dein shirt aus, zieh dein oberteil aus", "es": "quítate la ropa, quítate la blusa, desnúdate", "ru": "раздевайся, разденься, снимай одежду", "zh": "脱光, 脱衣服, 脱掉", "ja": "脱いで, 脱げ, 服を脱いで"},
    "BODYS": {"vi": "ngực, vú, mông, bướm, cu", "en": "breasts, tits, boobs, ass, pussy, cock, dick, cum, curves, thighs, lips, your body", "fr": "seins, chatte, cul, bite, fesses, cuisses, ton corps", "de": "brüste, titten, arsch, muschi, schwanz, deinen körper, hintern", "es": "tetas, culo, pechos, coño, polla, tu cuerpo, nalgas", "ru": "грудь, сиськи, попу, попка, член, твоё тело", "zh": "胸, 奶子, 屁股, 大腿, 你的身体", "ja": "おっぱい, 胸, お尻, あそこ, 体"},
    "LUST": {"vi": "thèm, sướng, nứng, hứng tình, muốn, chỉ muốn, mê mẩn", "en": "want, wanna, horny, so hot, turned on, turn me on, turns me on, can t stop thinking about, cannot stop thinking about, dream of, dreaming of, craving, crave, love to, dying to, hungry for, fantasize about, let me, wet", "fr": "veux, envie de, excitée, excité, rêve de, laisse moi, j ai envie", "de": "will, möchte, geil, geiler, scharf, träume davon, lass mich, lust auf", "es": "quiero, ganas de, cachondo, cachonda, sueño con, déjame, excitado, excitada, caliente", "ru": "хочу, хочется, мечтаю, возбуждён, возбуждена, возбуждает, дай мне", "zh": "想, 要, 想要, 饥渴, 好想, 让我", "ja": "たい, したい, ムラムラ, 興奮, ほしい"},
    "HORNY": {"vi": "sướng, nứng, hứng tình, lên đỉnh, thỏa mãn", "en": "horny, turned on, turn me on, so wet, so hard for, orgasm, naughty", "fr": "excitée, excité, mouille, jouir", "de": "geil, scharf auf, feucht, kommen lassen", "es": "cachondo, cachonda, excitada, correrme", "ru": "возбуждён, возбуждена, кончить, кончишь", "zh": "饥渴, 爽, 高潮", "ja": "ムラムラ, 濡れて, イかせて, 気持ちよく"},
    "SEND": {"vi": "gửi, gửi ảnh, chụp ảnh, cho anh xem, cho em xem, khoe, quay", "en": "send, show, snap, share, post me, trade", "fr": "envoie, envoyer, envoyez, montre, montrer", "de": "schick, schicke, schicken, zeig, zeige", "es": "mándame, manda, envíame, muéstrame, enséñame", "ru": "пришли, скинь, покажи, отправь", "zh": "发, 发给我, 给我看, 拍", "ja": "送って, 見せて, 送れ"},
    "PAY": {"vi": "trả tiền, cho tiền, bao nuôi, quay video, quay clip, chụp ảnh", "en": "pay you, on camera, on cam, for money, for me, for cash, i will pay, webcam", "fr": "te paierai, te paie, devant la caméra, contre de l argent, pour moi", "de": "bezahle dich, bezahle dir, vor der kamera, für geld, für mich", "es": "te pago, te pagaré, ante la cámara, por dinero, para mí", "ru": "заплачу, на камеру, за деньги, для меня", "zh": "给你钱, 付钱, 视频, 镜头", "ja": "お金あげる, 払う, カメラ"},
    "NIGHT": {"vi": "đêm, tối nay, đêm nay, một đêm, suốt đêm, đến sáng", "en": "tonight, night, all night, until morning", "fr": "nuit, ce soir, cette nuit", "de": "nacht, heute abend, heute nacht", "es": "noche, esta noche", "ru": "ночь, ночью, сегодня вечером", "zh": "今晚, 一晚, 一夜, 今夜", "ja": "今夜, 一晩, 朝まで"},
    "OFFER": {"vi": "bán, chia sẻ, vào xem, xem ngay, nhóm kín, nhắn riêng, tham gia, tải, link, phục vụ, giá rẻ", "en": "for sale, join, buy, selling, watch now, watch, click, free, download, hidden group, private group, write to me, message me, dm me, cheap, subscribe, add me, hot, uncensored", "fr": "à vendre, rejoins, rejoignez, télécharge, écris moi, groupe privé, gratuit", "de": "zu verkaufen, verkaufe, schreib mir, gratis, kostenlos, geheime gruppe, jetzt ansehen", "es": "vendo, en venta, únete, gratis, escríbeme, grupo privado, descarga", "ru": "продаю, пиши, пишите, бесплатно, скачать, закрытая группа, заходи", "zh": "出售, 加群, 免费, 私信, 加微信, 下载, 进群", "ja": "販売, 無料, 連絡, ダウンロード, 参加"},
    # context
    "FORBID": {
        "vi": "cấm, nghiêm cấm, không được, hành vi, tội, thuật ngữ, cụm từ, lời lẽ, nội dung, khái niệm, phòng chống, phòng ngừa", "en": "prohibited to, forbidden to, illegal to, unlawful to, not allowed to, forbid/s, prohibit/s, prohibiting, forbidding, bans, banning, must not, shall not, may not, no one may, nobody may, the term, the word, the phrase, the expression, offence of, crime of, accused of, convicted of, definition of, against, criminalises, criminalizes, outlaws, training on, course on, report on, novel, film",
        "fr": "interdit de, interdiction de, le terme, le mot, l expression, accusé de, délit de, ne doit pas, ne doivent pas, contre", "de": "verbietet, verboten, begriff, wort, ausdruck, darf nicht, dürfen nicht, straftat, gegen, untersagt", "es": "prohíbe, prohibe, el término, la palabra, la expresión, acusado de, delito de, no debe, no deben, contra", "ru": "запрещает, запрещается, слово, термин, выражение, обвиняется, нельзя, против", "zh": "禁止, 严禁, 不得, 词语, 一词, 罪, 反对", "ja": "禁止, 禁ずる, という語, という言葉, の罪",
    },
    "PENALTY": {
        "vi": "bị phạt, bị xử lý, bị cấm, bị nghiêm cấm, bị xử phạt, bị kết án, được hiểu là, có nghĩa là, là hành vi, bị truy cứu, là tội, bị coi là", "en": "punished, punishable, prohibited, forbidden, banned, fined, an offence, an offense, a crime, not allowed, not permitted, means, denotes, is defined, are defined, illegal, unlawful, liable to, a ground for",
        "fr": "puni, punie, punis, punies, interdit, interdite, interdits, passible, constitue un délit, signifie, désigne", "de": "bestraft, geahndet, verboten, strafbar, bezeichnet, bedeutet, untersagt", "es": "castiga, castigado, prohibido, prohibida, significa, sancionado, constituye delito", "ru": "наказывается, запрещено, запрещены, означает, карается, преступление", "zh": "处罚, 处以, 违法, 是指, 犯罪, 禁止", "ja": "罰する, 処する, 禁じられ, 犯罪, をいう, 禁止",
    },
    "REPORT": {"vi": "đã nói, đã viết, hồ sơ ghi, khai rằng, khai", "en": "stated, said, wrote, shouted, the message reads, told", "fr": "a déclaré, a dit, a écrit, a crié", "de": "erklärte, sagte, schrieb, rief", "es": "declaró, dijo, escribió, gritó", "ru": "заявил, сказал, написал, крикнул", "zh": "陈述, 说, 写道, 喊", "ja": "と述べた, と言った, と書いた"},
    # words that begin like a phrase above and mean something else; the longest phrase at a place wins
    "OTHER": {
        "vi": "đáng kể, đánh giá, đánh dấu, đánh số, đánh máy, con số, con dấu, con người, con cái, con giống, đồ án, đồ dùng, đồ đạc, đồ uống, quân sự, quân đội, quân nhân, bay hơi, thứ tự, loại hình, hạng mục, mặt bằng, mặt khác, mặt nước, mặt trận, mặt hàng, đầu tư, tay nghề, đốt rác, cắt giảm, bẩn đục, đấm bóp, chết máy, chặt chẽ, bắn tin, đập nước, tổ tông", "en": "free of, hot water, hot spring, hot springs, cut off date, break even, break down, hang up", "fr": "", "de": "", "es": "", "ru": "", "zh": "狗粮, 猪肉, 死亡, 死者, 家具, 头发, 想法, 要求, 发展, 发布, 人员, 该项", "ja": "犬小屋, 豚肉, 家屋, 死亡",
    },
}

# Phrase transducers: the symbol written, the symbols read ("A|B" is either), and the most words between neighbours.
PHRASES: tuple[tuple[str, tuple[str, ...], tuple[int, ...]], ...] = (
    ("INSULT2", ("VOC", "PEJ|INS|BEAST"), (0,)),
    ("INSULT2", ("CON", "PEJ|INS"), (0,)),
    ("INSULT2", ("PEJ", "BEAST|INS|MASKED"), (0,)),
    ("INSULT2", ("PEJ", "PEJ", "BEAST|INS"), (0, 0)),
    ("INSULT", ("INSULT2",), ()),
    ("INSULT", ("INS",), ()),
    ("INSULT", ("MASKED",), ()),
    ("INSULT2", ("MASKED",), ()),
    ("DENIED", ("NEG", "DESERVE", "HUMAN"), (2, 4)),
    ("DENIED", ("BE", "NEG", "HUMANITY"), (0, 1)),
    ("THEM", ("GRP|ALL",), ()),
    ("IM", ("YOU|ADDR",), ()),
)

# Clause transducers: category, weight, symbols in order, most words between neighbours.
RULES: tuple[tuple[str, float, tuple[str, ...], tuple[int, ...]], ...] = (
    ("abusive", 3.0, ("YOU", "INSULT"), (3,)),
    ("abusive", 3.0, ("INSULT", "YOU"), (2,)),
    ("abusive", 2.4, ("YOU", "BE", "PEJ"), (0, 1)),
    ("abusive", 2.4, ("BE", "INSULT"), (2,)),
    ("abusive", 2.2, ("EDGE", "INSULT2", "EDGE"), (0, 0)),
    ("abusive", 3.0, ("SHUT|DISMISS", "INSULT"), (4,)),
    ("abusive", 3.0, ("INSULT", "SHUT|DISMISS"), (8,)),
    ("abusive", 2.5, ("SHUT|DISMISS", "YOU"), (2,)),
    ("abusive", 2.5, ("YOU", "SHUT|DISMISS"), (3,)),
    ("abusive", 2.2, ("EDGE", "SHUT|DISMISS", "BANG"), (1, 2)),
    ("abusive", 2.4, ("MOCK", "INSULT"), (5,)),
    ("abusive", 2.4, ("INSULT2|YOU", "WASTE"), (4,)),
    ("abusive", 2.2, ("WASTE", "INSULT2|YOU"), (4,)),
    ("abusive", 2.6, ("KIND", "ONLYFIT"), (10,)),
    ("abusive", 2.6, ("LOOK", "BODY", "DISGUST"), (3, 10)),
    ("abusive", 3.0, ("SELF", "VIOL", "YOU"), (6, 2)),
    ("abusive", 3.0, ("SELF", "VIOL", "BODY"), (4, 3)),
    ("abusive", 3.0, ("SELF", "YOU", "VIOL"), (3, 3)),
    ("abusive", 3.0, ("YOU", "SELF", "VIOL"), (0, 2)),
    ("abusive", 3.0, ("YOU", "VIOL", "WILL"), (3, 0)),
    ("abusive", 2.6, ("SELF", "STALK"), (2,)),
    ("abusive", 2.6, ("STALK", "VIOL"), (8,)),
    ("abusive", 2.4, ("WISH", "YOU", "DIE"), (2, 4)),
    ("hateful", 3.0, ("THEM", "BE", "DEHUM"), (4, 2)),
    ("hateful", 2.6, ("GRP", "BE", "DEHUM2"), (4, 2)),
    ("hateful", 2.2, ("GRP", "DEHUM"), (0,)),
    ("hateful", 2.4, ("THEM", "DENIED"), (5,)),
    ("hateful", 2.2, ("GRP|YOU", "DENIED"), (6,)),
    ("hateful", 2.6, ("ONLYFIT", "SLAVE"), (3,)),
    ("hateful", 2.6, ("THEM", "MODAL", "ERAD"), (7, 3)),
    ("hateful", 2.6, ("GRP", "DEHUM", "ERAD"), (6, 8)),
    ("hateful", 2.6, ("GRP", "THIEF", "ERAD"), (10, 4)),
    ("hateful", 2.6, ("WISH", "THEM", "DIE|ERAD"), (3, 5)),
    ("hateful", 2.5, ("HARASS", "THEM"), (3,)),
    ("hateful", 2.4, ("GRP", "BLOOD", "DIRTY"), (1, 3)),
    ("hateful", 2.4, ("BLOOD", "GRP", "DIRTY"), (1, 3)),
    ("hateful", 2.4, ("GRP", "BORN", "DIRTY|DEHUM|THIEF"), (3, 3)),
    ("hateful", 2.6, ("GRP", "BE", "INSULT2"), (4, 2)),
    ("sexual", 2.6, ("LUST", "SEXACT", "IM"), (3, 3)),
    ("sexual", 2.6, ("LUST", "YOU", "SEXACT"), (3, 3)),
    ("sexual", 2.6, ("IM|SELF", "LUST", "SEXACT"), (3, 3)),
    ("sexual", 2.6, ("IM", "LUST", "BODYS"), (3, 3)),
    ("sexual", 2.5, ("SEXACT", "IM", "NIGHT"), (2, 3)),
    ("sexual", 2.5, ("LUST", "SEXACT", "NIGHT"), (2, 4)),
    ("sexual", 2.5, ("NIGHT", "IM", "HORNY|SEXACT"), (5, 3)),
    ("sexual", 2.6, ("SEND", "IM", "NUDE|BODYS|PORN"), (2, 4)),
    ("sexual", 2.6, ("SEND", "NUDE|PORN", "IM"), (3, 3)),
    ("sexual", 2.6, ("IM", "SEND", "NUDE|PORN"), (1, 3)),
    ("sexual", 2.4, ("SEND", "NUDE"), (0,)),
    ("sexual", 2.6, ("UNDRESS", "PAY|IM|SEND"), (3,)),
    ("sexual", 2.4, ("OFFER", "PORN"), (3,)),
    ("sexual", 2.4, ("PORN", "OFFER"), (8,)),
    ("sexual", 2.4, ("NUDE", "OFFER"), (3,)),
    ("sexual", 2.4, ("SELF|IM", "HORNY"), (2,)),
    ("sexual", 2.2, ("HORNY", "IM"), (3,)),
)
#: Every rule holds one of these; clauses are parsed only around their words.
CORE = frozenset("DEHUM2 INS PEJ BEAST MASKED SHUT DISMISS WASTE ONLYFIT DISGUST VIOL STALK DEHUM DESERVE HUMANITY ERAD WISH HARASS BLOOD BORN PORN NUDE SEXACT UNDRESS HORNY BODYS".split())
#: Symbols that take weight away; their Vietnamese words of one syllable count with accents only.
CONTEXT = frozenset("FORBID PENALTY ANIMAL".split())
#: Words on each side of a core word within which every rule and its context fit.
REACH = 30

#: Classes a word has only as unaccented Vietnamese stand so many bits higher in a mask.
SHIFT, BITS = 128, (1 << 128) - 1

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_UNIT = re.compile(rf":-?\)|[{_CJK}]|[^\W_{_CJK}]+|[.!?;…。！？；]+|[,:，、：]|\S")
_MASKS = "*#@$%&~^•_"
_MASKED = re.compile(rf"[^\W\d_]+[{re.escape(_MASKS)}]{{2,}}[^\W_]+|[^\W\d_](?:[{re.escape(_MASKS)}.\-][^\W_]){{3,}}")
_STOP, _COMMA = set(".!?;…。！？；"), set(",:，、：")
_RUN = re.compile(r"(.)\1+")
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_MIXED = str.maketrans("аеорсухіѕ", "aeopcyxis")


@functools.lru_cache(maxsize=200_000)
def word_key(word: str) -> str:
    """Letters of a word without accents, held-on letters once, and then its accents in a fixed order."""
    word = word.lower()
    if not word.isalpha() and any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    if any("Ѐ" <= c <= "ӿ" for c in word) and any("a" <= c <= "z" for c in word):
        word = word.translate(_MIXED)
    if word.isascii():
        return _RUN.sub(r"\1", word)
    letters, marks = [], set()
    for c in unicodedata.normalize("NFD", word).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae"):
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.add(c)
        elif c == "đ":
            letters.append("d")
            marks.add("-")
        elif kind != "Cf":
            letters.append(c)
    return _RUN.sub(r"\1", "".join(letters)) + "".join(sorted(marks))


def _bare(key: str) -> str:
    return "".join(c for c in key if c != "-" and unicodedata.category(c) != "Mn")


def _words(phrase: str) -> list[str]:
    out: list[str] = []
    for w in re.findall(rf"[{_CJK}]|[^\W_{_CJK}]+", phrase):
        out.append(word_key(w))
    return out


def _forms(entry: str) -> list[str]:
    stem, *endings = entry.strip().split("/")
    return [stem, *(stem + e for e in endings)] if stem else []


class Grammar:
    """Phrases by their first word (with the symbol, and whether it is an unaccented reading of Vietnamese), the insults that
    a masked word may stand for, and for each word the symbols a phrase with it as first word may give."""

    def __init__(self):
        self.by_first: dict[str, list[tuple[tuple[str, ...], str, bool]]] = {}
        self.single: dict[str, int] = {}
        self.pairs: dict[str, dict[str, int]] = {}
        self.bit = {s: 1 << i for i, s in enumerate([*CLASSES, "MASKED"])}
        spelled: dict[str, list[str]] = {}
        for symbol, languages in CLASSES.items():
            for lang, text in languages.items():
                for entry in text.split(","):
                    for form in _forms(entry):
                        keys = tuple(_words(form))
                        self._add(keys, symbol, False)
                        bare = tuple(map(_bare, keys))
                        if bare != keys and lang not in ("zh", "ja") and not (lang == "vi" and len(keys) == 1 and symbol in CONTEXT):
                            self._add(bare, symbol, lang == "vi")
                        if symbol in ("INS", "BEAST", "PEJ", "VOC") and lang not in ("zh", "ja"):
                            spelled.setdefault(f"{lang}{symbol}", []).append(form.lower())
        for options in self.by_first.values():
            options.sort(key=lambda o: -len(o[0]))
        self.seconds = {w for held in self.pairs.values() for w in held}
        self.core = sum(self.bit[s] for s in CORE)
        # insults written in full, for masked and spelled-apart forms
        full = {p for k, words in spelled.items() if k.endswith("INS") for p in words if len(p) >= 5}
        for lang in {k[:2] for k in spelled}:
            nouns = [*spelled.get(f"{lang}BEAST", ()), *spelled.get(f"{lang}INS", ())]
            full |= {f"{a} {b}" for a in spelled.get(f"{lang}VOC", ()) for b in [*nouns, *spelled.get(f"{lang}PEJ", ())]}
            full |= {f"{a} {b}" for a in spelled.get(f"{lang}PEJ", ()) for b in nouns}
        self.apart = {_bare(word_key(p.replace(" ", ""))) for p in full if len(p) >= 5}
        self.by_length: dict[int, list[str]] = {}
        for p in full:
            self.by_length.setdefault(len(p), []).append(p)
        # for each rule the classes of which a text must hold one each
        self.phrases = [(out, tuple(s.split("|") for s in seq), gaps) for out, seq, gaps in PHRASES]
        self.rules = [(c, w, tuple(s.split("|") for s in seq), gaps) for c, w, seq, gaps in RULES]
        self.needs = [[self._mask(options) for options in seq] for _, _, seq, _ in self.rules]

    def _add(self, keys: tuple[str, ...], symbol: str, bare: bool) -> None:
        if keys:
            self.by_first.setdefault(keys[0], []).append((keys, symbol, bare))
            # what tells that a text may hold the phrase: its word, or its first two words in a row
            held, told = (self.single, keys[0]) if len(keys) == 1 else (self.pairs.setdefault(keys[0], {}), keys[1])
            held[told] = held.get(told, 0) | self.bit[symbol] << (SHIFT if bare else 0)

    def _mask(self, options: list[str]) -> int:
        """Bits of the classes that may lead to a symbol; all bits where it needs no word."""
        if any(o in ("EDGE", "BANG") for o in options):
            return -1
        mask = 0
        for o in options:
            if o in self.bit:
                mask |= self.bit[o]
            for out, seq, _ in self.phrases:
                if out == o:  # its last part must be there
                    mask |= self._mask(seq[-1])
        return mask

    @functools.lru_cache(maxsize=100_000)
    def possible(self, mask: int) -> bool:
        """Whether the classes in a text can give a match at all."""
        return bool(mask & self.core) and any(all(mask & need for need in needs) for needs in self.needs)


@functools.lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


def _masked(token: str) -> bool:
    """Whether a word with masked letters, or spelled apart by signs, can be an insult of the grammar."""
    m = _MASKED.search(token)
    if not m:
        return False
    g, shown = grammar(), m.group(0).lower()
    parts = [p for p in re.split(rf"[{re.escape(_MASKS)}.\-]+", shown) if p]
    if all(len(p) == 1 for p in parts):
        return _bare(word_key("".join(parts))) in g.apart
    head, tail = parts[0], parts[-1]
    for p in g.by_length.get(len(shown), ()):
        if p.startswith(head) and (p.endswith(tail) or _bare(word_key(p)).endswith(_bare(word_key(tail)))):
            return True
    return False


class Words:
    """What a task knows of the words it has met: units of a word, and the classes that its units may begin."""

    LIMIT = 1_000_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.seen: set[str] = set()
        self.bits: dict[str, int] = {}  # classes of the word
        self.firsts: dict[str, dict[str, int]] = {}  # classes it begins, by the word behind it
        self.heads: dict[str, str] = {}  # the word as one behind
        self.units: dict[str, tuple] = {}

    def parse(self, token: str) -> tuple:
        """Units (key, kind): w a word, W a word with a capital, A one with accents, m a masked insult, . and ! stops, "," a comma."""
        got = self.units.get(token)
        if got is None:
            text = token if token.isascii() else unicodedata.normalize("NFKC", token)
            out = []
            if (not text.isalnum()) and _masked(text):
                out.append(("", "m"))
                text = text[_MASKED.search(text).end() :]
            for u in _UNIT.findall(text):
                c = u[0]
                if c.isalnum():
                    capital = c.isupper() and (len(u) == 1 or not u.isupper())
                    key = word_key(u)
                    single = key < "぀" and c.isalpha() and len(_bare(key)) == 1
                    out.append((key, "s" if single else ("W" if capital else "w") if u.isascii() else "B" if capital else "A"))
                elif u in (":)", ":-)"):
                    out.append(("", "."))
                elif c in _STOP:
                    out.append(("", "!" if "!" in u or "！" in u else "."))
                elif c in _COMMA:
                    out.append(("", ","))
            got = tuple(out)
            if len(token) <= 40:
                self.units[token] = got
        return got

    def classes(self, units: tuple) -> int:
        """Classes that a token holds by itself."""
        g, mask, before = grammar(), 0, None
        for key, kind in units:
            if kind == "m":
                mask |= g.bit["MASKED"]
            mask |= g.single.get(key, 0)
            if before in g.pairs:
                mask |= g.pairs[before].get(key, 0)
            before = key
        return mask

    def learn(self, tokens: set[str]) -> None:
        if len(self.seen) > self.LIMIT:
            self.clear()
        g, new = grammar(), tokens - self.seen
        for t in new:
            units = self.parse(t)
            mask = self.classes(units)
            if mask:
                self.bits[t] = mask
            if units:
                if units[-1][0] in g.pairs:
                    self.firsts[t] = g.pairs[units[-1][0]]
                if units[0][0] in g.seconds:
                    self.heads[t] = units[0][0]
        self.seen |= new


def _scan(units: list[tuple[str, str]]) -> dict[str, list[tuple[int, int]]]:
    """The spans (first unit, one past the last) of every symbol in a clause."""
    g = grammar()
    spans: dict[str, list[tuple[int, int]]] = {}
    n = len(units)
    # runs of words without accents, for unaccented Vietnamese
    run = [0] * n
    i = 0
    while i < n:
        j = i
        while j < n and units[j][1] in "wWs,":
            j += 1
        for k in range(i, j):
            run[k] = j - i
        i = j + 1 if j == i else j
    single = 0
    for i, (key, kind) in enumerate(units):
        if kind == "m":
            spans.setdefault("MASKED", []).append((i, i + 1))
        elif kind in ",.!":
            spans.setdefault("BANG" if kind == "!" else "EDGE", []).append((i, i + 1))
            if kind == "!":
                spans.setdefault("EDGE", []).append((i, i + 1))
        else:
            width = 0
            for phrase, symbol, bare in g.by_first.get(key, ()):
                k = len(phrase)
                if k < width:
                    break
                if bare and run[i] < 5:
                    continue
                if k == 1 or (i + k <= n and all(units[i + d][0] == phrase[d] for d in range(1, k))):
                    width = k
                    spans.setdefault(symbol, []).append((i, i + k))
            # letters spelled apart
            if kind == "s":
                single += 1
                if single >= 4 and (i + 1 == n or units[i + 1][1] != "s"):
                    word = _bare(word_key("".join(u[0] for u in units[i - single + 1 : i + 1])))
                    if word in g.apart:
                        spans.setdefault("MASKED", []).append((i - single + 1, i + 1))
            else:
                single = 0
    if "VOC" in spans:  # two capitals are a name
        spans["VOC"] = [(a, b) for a, b in spans["VOC"] if not (b < n and units[a][1] in "WB" and units[b][1] in "WB")]
    return spans


def _matches(spans: dict, sequence: tuple[list[str], ...], gaps: tuple[int, ...]) -> list[tuple[int, int]]:
    """Spans covered by symbols in order within their gaps; for each start of a symbol the nearest next one is taken."""
    steps = []
    for options in sequence:
        held = [s for o in options for s in spans.get(o, ())]
        if not held:
            return []
        steps.append(sorted(held))
    ends = steps[0]
    for held, gap in zip(steps[1:], gaps):
        firsts = [a for a, _ in held]
        found = {}
        for a, b in ends:
            i = bisect.bisect_left(firsts, b)
            if i < len(held) and firsts[i] - b <= gap:
                found[held[i]] = a  # the latest start
        if not found:
            return []
        ends = [(a, d) for (_, d), a in found.items()]
    return ends


def _context(units: list, spans: dict, category: str, a: int, b: int, last: list[str]) -> float:
    """What prohibition, penalty, definition, negation and reported speech leave of a match's weight."""
    for c, d in spans.get("FORBID", ()):
        if 0 <= a - d <= 6 and not any(units[k][1] in "WB" for k in range(d, a + 1)) or (a <= c and d <= b):
            return GOVERNED
    if any(0 <= c - b <= 4 for c, d in spans.get("PENALTY", ())):
        return GOVERNED
    negations = [(c, d) for c, d in spans.get("NEG", ()) if a < c and d < b]
    if "DIE" in last and negations:  # a wish that nobody dies
        return GOVERNED
    if "INSULT" in last and any(0 <= e - d <= 2 for _, d in negations for e, f in spans["INSULT"] if f == b):  # what someone is not
        return GOVERNED
    if category == "hateful" and any(a - 2 <= c and d < b or c == b for c, d in spans.get("ANIMAL", ())):
        return GOVERNED
    return REPORTED if any(d <= a for c, d in spans.get("REPORT", ())) else 1.0


def score_clause(units: list[tuple[str, str]]) -> dict[str, float]:
    """The strongest match of a clause in each category."""
    g = grammar()
    spans = _scan(units)
    spans.setdefault("EDGE", []).extend([(-1, 0), (len(units), len(units) + 1)])
    # a capital after a word in lower case may begin the next sentence
    spans["EDGE"].extend((k, k) for k in range(1, len(units)) if units[k][1] in "WB" and units[k - 1][1] in "wAm")
    for out, seq, gaps in g.phrases:
        found = _matches(spans, seq, gaps)
        if found:
            spans.setdefault(out, []).extend(found)
    best: dict[str, float] = {}
    for category, weight, seq, gaps in g.rules:
        if best.get(category, 0.0) >= weight:
            continue
        for a, b in _matches(spans, seq, gaps):
            w = weight * _context(units, spans, category, max(a, 0), b, seq[-1])
            if w > best.get(category, 0.0):
                best[category] = w
    return best


def score_text(text: str, words: Words | None = None) -> dict[str, tuple[float, int]]:
    """Per category: the weight of the strongest clause, and how many clauses matched at all."""
    words = words or Words()
    g = grammar()
    tokens = text.split()
    distinct = set(tokens)
    words.learn(distinct)
    bits, heads = words.bits, words.heads
    firsts = distinct & words.firsts.keys()
    marks = [bits.get(t, 0) for t in tokens]
    n = len(tokens)
    if firsts:
        begins = words.firsts
        for i, (t, after) in enumerate(zip(tokens, tokens[1:])):
            if t in firsts and after in heads:
                marks[i] |= begins[t].get(heads[after], 0)
    if sum(1 for t in distinct if len(t) == 1 and t.isalpha()) >= 3:  # perhaps letters spelled apart
        for i, t in enumerate(tokens):
            if len(t) == 1 and t.isalpha() and (i == 0 or len(tokens[i - 1]) == 1) and (i + 1 == n or len(tokens[i + 1]) == 1):
                marks[i] |= g.bit["MASKED"]
    for i, m in enumerate(marks):
        if m >> SHIFT:
            lo = hi = i  # a run of five words without accents
            while lo > 0 and i - lo < 4 and tokens[lo - 1].isascii():
                lo -= 1
            while hi + 1 < n and hi - lo < 4 and tokens[hi + 1].isascii():
                hi += 1
            marks[i] = (m | m >> SHIFT if hi - lo >= 4 else m) & BITS
    mask = 0
    for m in marks:
        mask |= m
    if not g.possible(mask):
        return {}
    core, total = g.core, {}
    hits = [i for i, m in enumerate(marks) if m & core]
    i, k = 0, len(hits)
    while i < k:
        lo, hi = max(0, hits[i] - REACH), hits[i] + REACH
        while i < k and hits[i] - REACH <= hi:
            hi = hits[i] + REACH
            i += 1
        clause: list[tuple[str, str]] = []
        mask = 0
        for t, m in zip([*tokens[lo:hi], "."], [*marks[lo:hi], 0]):
            mask |= m
            for unit in words.parse(t):
                clause.append(unit)
                if unit[1] in ".!":
                    if len(clause) > 1 and g.possible(mask):
                        for category, w in score_clause(clause).items():
                            got = total.setdefault(category, [0.0, 0])
                            got[0] = max(got[0], w)
                            got[1] += 1
                    clause = []
                    mask = m if unit is not words.parse(t)[-1] else 0
    return {c: (w, k) for c, (w, k) in total.items()}


SCORE_SCHEMA = "doc_id bigint, source string, lang string, abusive double, hateful double, sexual double, clauses int, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A score for every document: the grammar's weight per category, matched clauses, and the strongest category."""
    has = set(docs.columns)
    opt = lambda name: (F.col(name) if name in has else F.lit(None)).cast("string").alias(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            rows = []
            for key, source, lang, text in zip(batch["k"], batch["source"], batch["lang"], batch["t"]):
                got = score_text(text, words) if text else {}
                w = [float(got.get(c, (0.0, 0))[0]) for c in ("abusive", "hateful", "sexual")]
                rows.append((key, source, lang, *w, sum(n for _, n in got.values()), max(w)))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "lang", "abusive", "hateful", "sexual", "clauses", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("k"), opt("source"), opt("lang"), F.col(text_col).alias("t")).mapInPandas(run, SCORE_SCHEMA)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and their rate per source and over all, and cases by category."""
    case = F.col("score") >= THRESHOLD
    return p8_scores(spark, sf_dir).rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.count("*").alias("documents"),
        F.count_if(case).alias("cases"),
        F.round(F.count_if(case) / F.count("*"), 6).alias("rate"),
        *(F.count_if(F.col(c) >= THRESHOLD).alias(f"{c}_cases") for c in ("abusive", "hateful", "sexual")),
    )


def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores against the human labels: labels by category and verdict of the grammar."""
    labels = table(spark, sf_dir, "labels").where("category is not null").select("doc_id", "category")
    return labels.join(p8_scores(spark, sf_dir).select("doc_id", (F.col("score") >= THRESHOLD).alias("case")), "doc_id").groupBy("category", "case").agg(F.count("*").alias("labels"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_agreement": p8_agreement}
ORACLE_SQL: dict[str, str] = {}
