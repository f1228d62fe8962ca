"""Sentence boundaries across languages and scripts (problem 4).

Candidate boundaries are generated from marks, line breaks, joined clause numbers and, in running Thai text,
blanks. Every candidate is decided by one maximum-entropy model on its neighbouring tokens (the words themselves,
case, length, digits, script, and how words like the one before the mark behave in the whole corpus), on quotation
and on line layout. No rule answers in its place: what is certain by layout is only how the model is taught.

The model is trained on reliable boundaries (ends of paragraphs, lines before a numbered clause, marks of scripts
that have no abbreviations) and reliable non-boundaries (a mark before a lower-case word, the number of a clause,
plain blanks), and on hard negatives: words that the corpus shows with a point nearly always and never at the end of
a paragraph, before a capital; ordinals before a capital; marks before the closing quotation within a sentence.
`p4_model` fits it without one chunk in HOLDOUT and reports its accuracy on those, and the shares of yes and no.

Counts of words with a point, at the end of a line and before lower case cover all chunks (partial sums in tasks, then
one aggregate); only words that are seen with a point in 95 of 100 cases and make up at least RARE of all words are
gathered, so their number is bounded by 1 / RARE whatever the size. The model is fitted on a sample of about TRAIN_CHUNKS
chunks (the documented bound), taken by one job; it is applied to every chunk in a map over the table. Defined
results: null and blank texts give no sentences; a text without any mark is one sentence per line; repeated keys are
split independently; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

#: Chunks whose candidates the model is fitted on; width of the hashed features; least share of a word with statistics.
TRAIN_CHUNKS, WIDTH, RARE = 2_000, 1 << 16, 2e-7
#: One in so many sampled chunks is held out of the fit.
HOLDOUT = 5
#: One plain blank in so many teaches the model as a line break in mid-sentence, about as often as there are such breaks.
PLAIN = 40

#: The project's two marker lines around an overlap (fixed values).
OVERLAP_OPEN, OVERLAP_CLOSE = "[...overlap...]", "[...end overlap...]"

#: Words before a number that belongs to them, and words of a numbered heading (fixed values, by language).
REFERENCE_WORDS = frozenset(
    "điều khoản điểm chương mục số tr p q phần mẫu article articles art al no section chapter cf approx artikel abs nr s vgl § artículo párr núm pág статья статье статьи ст п г до пункт пункте статьёй มาตรา धारा المادة للمادة والمادة មាត្រា".split()
)
#: Words that go on after an ellipsis in scripts without case.
CONTINUES = frozenset("且但而并並和或及")
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
_HEADING = re.compile(
    r"(?:điều|chương|mục|phần|article|chapter|section|title|artikel|abschnitt|kapitel|artículo|capítulo|sección|chapitre|titre|статья|глава|раздел|มาตรา|หมวด|धारा|अध्याय|المادة|الفصل|មាត្រា|ជំពូក)\s+(?:\d+|[ivxlcdm]+)\b[.:]?|第\s*[\d一二三四五六七八九十百]+\s*[条章节節款項]",
    re.I,
)
#: First letters of headings, to pass over other lines at once.
_HEADING_FIRSTS = frozenset("đĐcCmMpPaAsStTkKсСгГрРมหधअاម第ជ")
_MARKER = re.compile(r"(\d+)\.(?=\s)|([a-zđ])\)(?=\s)|[-–•*]\s")
_CLOSE = "\"'”’»«“」』）)\\]"
_TERMINAL = re.compile(rf"([.!?…؟]+|[。！？។៕।]+)(?:[{_CLOSE}]|\s(?=[»”]))*")
_QUOTES = re.compile(r"[“”«»„「」『』\"]|\n[ \t]*(?:\n|\d+\.\s|[a-zđ]\)\s)")
_CLOSES = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", '"': '"'}
_WORD = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*\.?|\d+(?:[.,]\d+)*|\S")
_LAST = re.compile(r"[^\s“”«»„「」『』\"()（）\[\]，。、：；]+$|\S$")
_UNSPACED = re.compile(r"[\u0e00-\u0e7f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff]")
_ZEROS = str.maketrans("123456789", "000000000")
_THAI = re.compile(r"[฀-๿]")
_CASELESS = re.compile(r"[؀-ۿऀ-ॿ฀-๿ក-៿぀-ヿ㐀-鿿]")
_JOINED = re.compile(r"(\d+)\.\s+(?=\S)|([a-zđ])\)\s+")
_INLINE = re.compile(r"\s(?:(\d+)\.|([a-zđ])\))\s+(?=\S)")
_NUMBER_FIRST = re.compile(r"(?:^|[.!?…。！？;:।៕។”»\"“]\s+)\d+$")
_HEADING_FIRST = re.compile(rf"(?:^|[.!?…。！？।៕។”»\"]\s+)(?:{_HEADING.pattern.split('|第')[0]})$", re.I)
_REFERRING = frozenset("khoản điểm abs al".split())
_CELLS = re.compile(r"[^\n]*(?:\|[^\n]*\||\t[^\n]*\t)")
_CODES = re.compile(r"[!-~]*\d[!-~]*[,;/][!-~]*$")
_THAI_NUMBER = re.compile(r"\d+\.|[a-z]\)|.*มาตรา")
_ENDS = frozenset(".!?…؟。！？។៕।" + _CLOSE.replace("\\", ""))
_THAI_BLANK = re.compile(r"(?<=\S)[  ]+(?=\S)")
_PLAIN_BLANK = re.compile(r"(?<=[^\W\d_])\s+(?=[^\W_])")
_FULL_STOPS = "。！？।៕។"


def _shape(token: str) -> str:
    """Kind of a token by its first character: U upper, l lower, d digit, a script without case, q other, _ nothing."""
    c = token[:1]
    if not c:
        return "_"
    if c.isupper():
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "d"
    return "a" if _CASELESS.match(c) else "q"


def _is_row(line: str) -> bool:
    return bool(("|" in line or "\t" in line) and _CELLS.match(line) or " " not in line and _CODES.match(line))


def _refers(line: str) -> bool:
    """Whether a line ends with a number that belongs to a word before it."""
    held = line.rsplit(None, 2)
    return len(held) > 1 and held[-1].rstrip(",").isdigit() and held[-2].rstrip(".").lower() in _REFERRING


class Token:
    """What the features need of a word: its bare form, shape, class and hashed features (as p, before a mark, or n, after it)."""

    __slots__ = ("word", "bare", "shape", "kind", "p", "n")

    def __init__(self, word: str, abbreviations: dict[str, int], before: bool):
        self.word, self.bare, self.shape = word, word.rstrip(".").lower(), _shape(word)
        stat, bare = abbreviations.get(self.bare, 0), self.bare
        if before:
            self.kind = (self.shape, min(len(bare), 4), stat, bare in REFERENCE_WORDS, "." in word.rstrip("."), bool(_CASELESS.search(word)))
            self.p = [f"p={bare}", f"ps={self.shape}", f"pl={min(len(bare), 8)}", f"pk={stat}", f"pr={bare in REFERENCE_WORDS}", f"pd={self.kind[4]}"]
            self.n = []
        else:
            self.kind = (self.shape, bare in MONTHS, word[:1] in ",;:)", word[:1] in CONTINUES)
            self.p, self.n = [], [f"n={word[:24].lower()}", f"ns={self.shape}", f"nl={min(len(word), 6)}"]


class Lexicon:
    """Tokens by the raw text beside a candidate, looked up once for each distinct one."""

    LIMIT = 300_000

    def __init__(self, abbreviations: dict[str, int]):
        self.abbreviations = abbreviations
        self._tokens: dict[tuple[str, bool], Token] = {}
        self._before: dict[str, Token] = {}
        self._after: dict[str, Token] = {}

    def before(self, raw: str) -> Token:
        """The last token of a piece of text without blanks."""
        got = self._before.get(raw)
        if got is None:
            if len(self._before) > self.LIMIT:
                self._before.clear()
                self._tokens.clear()
            word = raw
            if not word.isalnum():
                m = _LAST.search(word)
                word = m.group(0) if m else ""
                if "'" in word or "’" in word:
                    word = re.split(r"['’](?=.)", word)[-1]
            word = word.translate(_ZEROS)
            got = self._before[raw] = self._tokens.get((word, True)) or self._tokens.setdefault((word, True), Token(word, self.abbreviations, True))
        return got

    def after(self, raw: str) -> Token:
        """The first token of a piece of text without blanks."""
        got = self._after.get(raw)
        if got is None:
            if len(self._after) > self.LIMIT:
                self._after.clear()
            m = _WORD.match(raw)
            word = m.group(0)[:24].translate(_ZEROS) if m else ""
            got = self._after[raw] = self._tokens.get((word, False)) or self._tokens.setdefault((word, False), Token(word, self.abbreviations, False))
        return got


def _piece_before(text: str, lo: int, end: int) -> str:
    """What stands before a place up to the blank; a few letters in scripts without blanks."""
    if end > lo and text[end - 1] >= "\u0e00" and _UNSPACED.match(text[end - 1]):
        return text[max(lo, end - 6) : end].split()[-1]
    held = text[max(lo, text.rfind(" ", lo, end)) : end].split()
    return held[-1] if held else ""


def _piece_after(text: str, at: int, end: int) -> str:
    """What stands at a place up to the blank; two letters in scripts without blanks."""
    if at < end and text[at] >= "\u0e00" and _UNSPACED.match(text[at]):
        return text[at : at + 2]
    stop = text.find(" ", at, end)
    held = text[at : min(at + 24, stop if stop > 0 else end)].split()
    return held[0] if held else ""


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of each quotation, of any length; an empty line or a numbered clause ends one that is never closed."""
    out: list[tuple[int, int]] = []
    opened = closes = None
    for m in _QUOTES.finditer(text):
        c = m.group(0)
        if c[0] == "\n":
            opened = None
        elif opened is not None:
            if c in closes:
                out.append((opened, m.end()))
                opened = None
        elif c in _CLOSES:
            opened, closes = m.start(), _CLOSES[c]
    return out


def candidates(text: str, lexicon: Lexicon, training: bool = False) -> Iterator[tuple[int, tuple, Token, Token, int | None]]:
    """(offset, context, token before, token after, label) of every candidate of a text in order.

    The context is layout and marks; the label is the answer where it is reliable, else None. `training` adds, at
    offset -1, ends of paragraphs as marks, plain blanks within lines, and known words with a point before a capital.
    """
    spans = quotations(text) if not text.isascii() or '"' in text else []
    opens = [a for a, _ in spans]
    before_, after_ = lexicon.before, lexicon.after
    nothing = before_("")
    previous = None  # the line before: start, end, text, row, heading, token, whether a mark ends it
    number = 0  # the last clause number
    at_line = 0
    lines = text.split("\n")
    widest = max(map(len, lines))
    for raw in lines:
        offset, at_line = at_line, at_line + len(raw) + 1
        line = raw.strip()
        if not line:
            continue
        start = offset + (len(raw) - len(raw.lstrip()) if raw[0].isspace() else 0)
        end = start + len(line)
        if line == OVERLAP_OPEN or line == OVERLAP_CLOSE:
            previous = None
            continue
        marker = _MARKER.match(line)
        heading = _HEADING.match(line) if line[0] in _HEADING_FIRSTS else None
        row = _is_row(line)
        body = start + (marker.end() if marker else heading.end() if heading else 0)
        while body < end and text[body].isspace():
            body += 1
        nxt = after_(_piece_after(text, body, end))
        first = after_(_piece_after(text, start, end)) if body > start else nxt
        thai = not line.isascii() and len(_THAI.findall(line)) * 3 > len(line)
        shape = _shape(line)
        kind = ("n" if marker.group(1) else "c" if marker.group(2) else "b") if marker else "h" if heading else "-"
        if previous is None:
            yield start, ("L", "first"), nothing, nxt, 1
        else:
            p_start, p_end, p_line, p_row, p_heading, prev, ended = previous
            gap = text.count("\n", p_end, start) > 1
            refers = prev.bare in REFERENCE_WORDS or (p_line[-1].isdigit() or p_line[-1] == ",") and _refers(p_line)
            i = bisect.bisect_left(opens, start) - 1
            inside = i >= 0 and start < spans[i][1]
            caseless = nxt.shape == "a" and shape != "l"
            if inside:
                label = 0
            elif gap or row or p_row or thai or caseless:
                label = 1
            elif kind != "-" and refers and not ended:
                label = 0
            elif marker or p_heading and shape != "l" and not ended:
                label = 1
            elif shape == "l":
                label = 0
            else:
                label = 1 if ended and not prev.kind[2] and shape == "U" else None
            fits = p_end - p_start + len(first.word) < widest  # so the line was not broken for its width
            context = ("L", inside, gap, row or p_row, thai, caseless, kind, refers, p_heading, shape, ended, fits)
            yield start, context, prev, nxt, label
            if training and gap and not inside and not row and not p_row and shape == "U" and kind == "-":  # as if no empty line stood there
                yield -1, ("L", inside, False, False, thai, caseless, kind, refers, p_heading, shape, ended, fits), prev, nxt, 1
            if training and ended and not row and not inside and (gap or marker):  # a reliable end by a mark, for the marks within lines
                a = text.rfind(" ", p_start, p_end)
                m = _TERMINAL.search(text, max(p_start, p_end - 4), p_end)
                word = before_(_piece_before(text, p_start, m.start() + 1 if m.group(1)[0] == "." else m.start()))
                yield -1, _mark_context(m, True, None, False, "-", False, word, nxt), word, nxt, 1 if a >= 0 else None
        if marker and marker.group(1):
            number = int(marker.group(1)[-9:])
        ended = False
        if line[-1] in _ENDS:
            last = _TERMINAL.search(line[-4:])
            ended = last is not None and last.end() == len(line[-4:])
        previous = (start, end, line, row, bool(heading), before_(_piece_before(text, start, end)), ended)
        if row:
            continue
        # marks within the line
        head = body if (marker or heading) else start
        for m in _TERMINAL.finditer(text, head, end):
            mark_end = m.end()
            if mark_end >= end:
                continue
            c = text[mark_end]
            if c.isdigit() and text[mark_end - 1] == ".":
                continue
            at = mark_end
            while at < end and text[at].isspace():
                at += 1
            if at >= end:
                continue
            i = bisect.bisect_left(opens, at) - 1
            if i >= 0 and at < spans[i][1]:
                continue
            blank = at > mark_end
            mark = m.group(1)[0]
            if not blank:
                if mark == "." and mark_end - m.start() == 1 and (not text[at].isupper() or not text[m.start() - 1].islower() or text[m.start() - 2 : m.start() - 1] in (".", " ", "")):
                    continue
                if mark in "!?…" and text[at] in ",;:":
                    continue
            prev = before_(_piece_before(text, start, m.start() + 1 if mark == "." else m.start()))
            after = after_(_piece_after(text, at, end))
            i = bisect.bisect_left(opens, mark_end) - 1
            quoted = spans[i] if i >= 0 and spans[i][1] == mark_end else None
            colon = quoted is not None and text[max(0, quoted[0] - 3) : quoted[0]].rstrip()[-1:] in (":", "：")
            joined = "-"
            if text[at].isdigit() or text[at + 1 : at + 2] == ")":
                j = _JOINED.match(text, at, end)
                joined = ("-" if not j else "s" if j.group(1) and int(j.group(1)[-9:]) == number + 1 else "n" if j.group(1) else "c")
            own = text[m.start() - 1] if m.start() else ""
            number_point = (own.isdigit() or own.isupper()) and _joined_number(text, m, start)
            stop = mark in _FULL_STOPS and m.group(0)[-1] == m.group(1)[-1]
            if joined != "-" and prev.bare not in REFERENCE_WORDS:
                label = 1
                if joined != "c":
                    number = int(j.group(1)[-9:])
            elif number_point:
                label = 0
            elif stop:
                label = 1
            elif after.shape == "l" or after.kind[2] or mark == "…" and after.kind[3]:
                label = 0
            elif colon and after.shape == "U":
                label = 1
            elif after.shape == "a" and quoted:
                label = int(colon)
            elif after.shape == "d" or after.kind[1] and prev.bare.isdigit():
                label = 0
            elif prev.kind[2] == 1:  # always with a point and never the last word
                label = 0
            elif after.shape == "a" and prev.kind[5] and not prev.kind[2]:
                label = 1
            else:
                label = None
            yield at, _mark_context(m, blank, quoted, colon, joined, number_point, prev, after), prev, after, label
            if training and label == 0 and prev.kind[2] == 1 and after.shape == "l":  # the same word before a capital
                capital = after_(after.word.capitalize())
                yield -1, _mark_context(m, blank, quoted, colon, joined, number_point, prev, capital), prev, capital, 0
        # clause numbers and letters joined to the line before without a mark
        for m in _INLINE.finditer(line):
            left = line[: m.start()].rstrip()
            at = start + m.start() + 1
            i = bisect.bisect_left(opens, at) - 1
            if not left or i >= 0 and at < spans[i][1]:
                continue
            tail = left[-1]
            prev, after = before_(_piece_before(line, 0, len(left))), after_(_piece_after(line, m.end(), len(line)))
            follows = bool(m.group(1)) and int(m.group(1)[-9:]) == number + 1
            if m.group(2):
                label = int(tail in ";:")
            else:
                label = int(follows and tail.isalnum() and prev.bare not in REFERENCE_WORDS and after.shape in "Ua" and not after.kind[1])
            if m.group(2) and not label or m.group(1) and not tail.isalnum():
                continue
            yield at, ("N", bool(m.group(1)), follows, tail if tail in ";:" else "w", prev.bare in REFERENCE_WORDS, after.shape, after.kind[1]), prev, after, label
            if label and m.group(1):
                number = int(m.group(1)[-9:])
        if thai and not heading:
            for m in _THAI_BLANK.finditer(line):
                at = start + m.end()
                i = bisect.bisect_left(opens, at) - 1
                if i >= 0 and at < spans[i][1]:
                    continue
                left = _piece_before(line, 0, m.start())
                item = bool(_THAI_NUMBER.fullmatch(left)) or left.isdigit() and _piece_before(line, 0, m.start() - len(left) - 1).endswith("มาตรา") or len(left) == m.start() and left.strip("()").isdigit()
                yield at, ("S", item), before_(left), after_(_piece_after(line, m.end(), len(line))), int(not item)
        elif training and not thai:
            for m in list(_PLAIN_BLANK.finditer(line))[len(line) % PLAIN :: PLAIN]:
                prev, after = before_(_piece_before(line, 0, m.start())), after_(_piece_after(line, m.end(), len(line)))
                yield -1, ("L", False, False, False, False, False, "-", prev.bare in REFERENCE_WORDS, False, after.shape, False, False), prev, after, 0


def _mark_context(m: re.Match, blank: bool, quoted: tuple | None, colon: bool, joined: str, number_point: bool, prev: Token, after: Token) -> tuple:
    mark = m.group(1)
    return ("T", mark[0], m.end() > m.end(1), mark[0] in _FULL_STOPS and m.end() == m.end(1), blank, quoted is not None, colon, joined, number_point)


def _joined_number(text: str, m: re.Match, start: int) -> bool:
    """Whether this point closes a clause number or a heading's number that stands at the start of a sentence."""
    left = text[max(start, m.start() - 30) : m.start()]
    return bool(_NUMBER_FIRST.search(left) or _HEADING_FIRST.search(left))


@functools.lru_cache(maxsize=500_000)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def _context_features(context: tuple) -> list[str]:
    return [f"c={context}", *(f"c{i}={context[0]}{v}" for i, v in enumerate(context[1:]))]


def _pair_features(kind: str, mark: str, plain: bool, prev: tuple, after: tuple) -> list[str]:
    return [f"x={kind}{mark}{plain}{prev}{after}", f"y={kind}{mark}{prev[0]}{prev[1]}{after[0]}", f"z={kind}{prev[2]}{prev[3]}{after[0]}", f"v={kind}{mark}{plain}{after}", f"k={kind}"]


def _plain(context: tuple) -> bool:
    """Whether a mark stands without quotation, joined number and number before it."""
    return context[0] == "T" and not context[5] and context[7] == "-" and not context[8]


def features(context: tuple, prev: Token, after: Token) -> list[int]:
    """Hashed features of a candidate; those of words are told apart by the kind of candidate."""
    kind = context[0]
    held = [*_context_features(context), *(kind + f for f in prev.p), *(kind + f for f in after.n), *after.n, *_pair_features(kind, str(context[1]), _plain(context), prev.kind, after.kind)]
    return [_bucket(f) for f in held]


class Model:
    """Scores candidates; the weights of a context, a word on either side and a pair of classes are summed once each."""

    LIMIT = 300_000

    def __init__(self, weights: np.ndarray, abbreviations: dict[str, int]):
        self.w = weights
        self.lexicon = Lexicon(abbreviations)
        self.contexts: dict = {}
        self.pairs: dict = {}
        self.befores: dict = {}
        self.afters: dict = {}

    def _sum(self, held: list[str]) -> float:
        return float(sum(self.w[_bucket(f)] for f in held))

    def score(self, context: tuple, prev: Token, after: Token) -> float:
        kind = context[0]
        c = self.contexts.get(context)
        if c is None:
            c = self.contexts[context] = self._sum(_context_features(context))
        x = self.pairs.get((context, prev.kind, after.kind))
        if x is None:
            x = self.pairs[context, prev.kind, after.kind] = self._sum(_pair_features(kind, str(context[1]), _plain(context), prev.kind, after.kind))
        p = self.befores.get((kind, prev.word))
        if p is None:
            if len(self.befores) > self.LIMIT:
                self.befores.clear()
            p = self.befores[kind, prev.word] = self._sum([kind + f for f in prev.p])
        n = self.afters.get((kind, after.word))
        if n is None:
            if len(self.afters) > self.LIMIT:
                self.afters.clear()
            n = self.afters[kind, after.word] = self._sum([*(kind + f for f in after.n), *after.n])
        return c + x + p + n

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence of a text, in order; the marker lines belong to none."""
        score = self.score
        edges = sorted({at for at, context, prev, after, _ in candidates(text, self.lexicon) if score(context, prev, after) > 0})
        markers = [] if OVERLAP_OPEN not in text and OVERLAP_CLOSE not in text else [m.start() for m in _OVERLAP.finditer(text)]
        out = []
        for a, b in zip(edges, [*edges[1:], len(text)]):
            if markers:
                i = bisect.bisect_left(markers, a)
                b = min(b, markers[i]) if i < len(markers) else b
            end = a + len(text[a:b].rstrip())
            if end > a:
                out.append((a, end))
        return out


_OVERLAP = re.compile(rf"^[ \t]*(?:{re.escape(OVERLAP_OPEN)}|{re.escape(OVERLAP_CLOSE)})[ \t]*$", re.M)


def fit(rows: list[tuple[int, list[int], int]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-7) -> np.ndarray:
    """Maximum-entropy weights (binary, so logistic) by adaptive gradient steps on hashed features; rows are (label, features, count)."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w[:WIDTH]
    width = max(len(f) for _, f, _ in rows)
    x = np.full((len(rows), width), WIDTH, np.int32)
    for i, (_, f, _) in enumerate(rows):
        x[i, : len(f)] = f
    y = np.array([label for label, _, _ in rows], float)
    times = np.sqrt(np.array([n for _, _, n in rows], float))
    g2 = np.full(WIDTH + 1, 1e-8)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 512)):
            score = w[x[part]].sum(1)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[part]) * times[part]
            grad = np.bincount(x[part].ravel(), np.repeat(error, width), WIDTH + 1) / len(part)
            held = np.flatnonzero(grad)
            g = grad[held] + decay * w[held]
            g2[held] += g * g
            w[held] -= rate * g / np.sqrt(g2[held])
            w[WIDTH] = 0
    return w[:WIDTH]


def find_abbreviations(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Words that carry a point nearly wherever they stand: 1 if they are never the last of a sentence, 2 if they may be.

    Counted over all chunks. A word is kept if at least 95 % of three or more occurrences have the point; it is never the
    last where lines do not end with it (at most 2 % of its occurrences) and either lower case or a number follows it often
    or it is short or has a point within and stands so often that this is no chance; it may be the last where lower case follows it sometimes.
    """
    word = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u0900-\u0903\u093a-\u094f])*(?:\.[^\W\d_](?:[^\W\d_]|[\u0900-\u0903\u093a-\u094f])*)*")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, low, last = Counter(), Counter(), Counter()

        def rows() -> pd.DataFrame:
            found: dict[str, list[int]] = {}
            for token, n in seen.items():
                if len(token) > 40 and "." not in token:  # a run of a script without blanks
                    continue
                lower = token.lower()
                parts = [lower] if lower.isalpha() else word.findall(lower)
                for i, w in enumerate(parts):
                    got = found.setdefault(w, [0, 0, 0, 0])
                    got[0] += n
                    if i + 1 == len(parts) and lower.endswith(f"{w}."):
                        got[1] += n
                        got[2] += low.get(token, 0)
                        got[3] += last.get(token, 0)
            for c in (seen, low, last):
                c.clear()
            return pd.DataFrame([(w, *v) for w, v in found.items()], columns=["word", "n", "dots", "lower", "ends"])

        for batch in batches:
            for text in batch["t"]:
                tokens = text.split()
                seen.update(tokens)
                low.update([t for t, u in zip(tokens, tokens[1:]) if t[-1] == "." and (u[0].islower() or u[0].isdigit())])
                last.update([held[-1] for line in text.split("\n") if line.rstrip()[-1:] == "." and (held := line.rsplit(None, 1))])
            if len(seen) > 500_000:
                yield rows()
        yield rows()

    counted = cut(
        df.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull()).mapInPandas(count, "word string, n bigint, dots bigint, lower bigint, ends bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("dots").alias("dots"), F.sum("lower").alias("lower"), F.sum("ends").alias("ends"))
    )
    least = max(3.0, RARE * (counted.agg(F.sum("n")).first()[0] or 0))
    short = F.length("word") <= 5
    never = (F.col("ends") <= 0.02 * F.col("n")) & ((F.col("n") >= 20) & (short | F.col("word").contains(".")) | (F.col("lower") >= 0.2 * F.col("n")))
    kept = counted.where((F.col("n") >= least) & (F.col("dots") >= 0.95 * F.col("n"))).select("word", F.when(never, 1).when(F.col("lower") >= 0.05 * F.col("n"), 2).otherwise(0).alias("stat")).where("stat > 0")
    return {r["word"]: r["stat"] for r in kept.collect()}


def train(df: DataFrame, abbreviations: dict[str, int], id_col: str = "chunk_key", text_col: str = "text", train_chunks: int = TRAIN_CHUNKS, hold_out: bool = False) -> np.ndarray:
    """The model, fitted on the reliable candidates of a bounded sample of chunks, without the held-out ones if so asked.

    Equal candidates are counted in the tasks, so that the rows that reach the driver are the distinct ones.
    """
    keyed = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    within = int(1_000_000 * min(1.0, train_chunks / max(1, keyed.count())))
    sample = keyed.where(F.pmod(F.xxhash64("k", F.lit(41)), F.lit(1_000_000)) < within)
    if hold_out:
        sample = sample.where(F.pmod(F.xxhash64("k", F.lit(43)), F.lit(HOLDOUT)) != 0)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(abbreviations)
        for batch in batches:
            rows: Counter = Counter()
            for t in batch["t"]:
                for _, context, prev, after, label in candidates(t, lexicon, True):
                    if label is not None:
                        rows[label, tuple(features(context, prev, after))] += 1
            yield pd.DataFrame([(y, list(f), n) for (y, f), n in rows.items()], columns=["label", "f", "n"])

    return fit([(r["label"], r["f"], r["n"]) for r in sample.select("t").mapInPandas(gather, "label int, f array<int>, n int").collect()])


SENTENCE_SCHEMA = "chunk_key bigint, sentence_no int, start_char int, end_char int, sentence string"


def sentences(df: DataFrame, id_col: str = "chunk_key", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Every sentence of every chunk, in order, with its place in the text; places only, without `with_text`."""
    abbreviations = find_abbreviations(df, text_col)
    weights = train(df, abbreviations, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast((weights, abbreviations))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                rows += [(key, i, a, b, text[a:b] if with_text else None) for i, (a, b) in enumerate(model.split(text), 1)]
            yield pd.DataFrame(rows, columns=["chunk_key", "sentence_no", "start_char", "end_char", "sentence"])

    return df.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, SENTENCE_SCHEMA)


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "chunks"), with_text=False).select("chunk_key", "start_char")


def p4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their mean and longest length, by the language recorded for the chunk."""
    chunks = table(spark, sf_dir, "chunks")
    found = sentences(chunks).join(chunks.select("chunk_key", "lang"), "chunk_key")
    return found.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg(F.length("sentence")), 1).alias("mean_chars"), F.max(F.length("sentence")).alias("longest_chars"))


def p4_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model decides, by kind of candidate (L line, T mark, N joined number, S Thai blank) and reliable answer (null
    where there is none): candidates of all chunks, how many it accepts, and how many of the reliable answers it gives."""
    chunks = table(spark, sf_dir, "chunks")
    abbreviations = find_abbreviations(chunks)
    weights = train(chunks, abbreviations, hold_out=True)
    sent = spark.sparkContext.broadcast((weights, abbreviations))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for batch in batches:
            seen: Counter = Counter()
            for text, held in zip(batch["t"], batch["held"]):
                for _, context, prev, after, label in candidates(text, model.lexicon):
                    seen[context[0], label, bool(held), model.score(context, prev, after) > 0] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "label", "held", "yes", "n"])

    part = chunks.where("text is not null").select(F.col("text").alias("t"), (F.pmod(F.xxhash64("chunk_key", F.lit(43)), F.lit(HOLDOUT)) == 0).alias("held"))
    found = part.mapInPandas(run, "kind string, label int, held boolean, yes boolean, n bigint")
    right = F.when(F.col("label") == F.col("yes").cast("int"), F.col("n")).otherwise(0)
    return found.groupBy("kind", "label").agg(
        F.sum("n").alias("candidates"), F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("held_out"), F.sum(F.when(F.col("held"), right).otherwise(0)).alias("held_out_right"),
    )


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences, "p4_lengths": p4_lengths, "p4_model": p4_model}
ORACLE_SQL: dict[str, str] = {}
