"""Garbled text from a wrong character encoding (problem 5).

A wrong decoding is a substitution cipher: each letter of the original became one displayed symbol, a character or a
short run of them. A source may hold several ciphers (keys). For each source and key the letters behind the symbols
are learned by expectation-maximization against the bigrams of a language: a symbol's posterior is its prior times the
bigrams with the letters on both sides, where a neighbour that is a symbol itself counts by its own posterior. Code
pages only give priors: a run that, put back into bytes of one page, is a letter in another. The free key has none, any
letter of the language is as likely; it is learned once per language and the likeliest is kept. What EM is sure of
becomes a table per source and key, and values are restored by `str.translate` with these tables (runs of several
characters are first made one private character each), as often as the text was garbled. Pages of two bytes per
character (gbk, big5, shift_jis) are no substitution of single symbols; they are undone as pages.

Counts cover all values: words, letter bigrams per language, and contexts of symbols are aggregates with partial sums,
and none is left out. EM runs in tasks: a key with at most IN_TASK contexts is learned in one, of a larger key each
round sums the expected counts of all contexts over all tasks; the tables are the same. What reaches the driver are
tables over alphabets: bigrams (ideographs count as one letter), symbols, and per round a number per symbol and letter.
The tables are applied in a map over the records. Defined results: null and empty values are no cases; a value whose
garbled part lost characters is a case without a full original; a symbol that stands in text of its own kind (a rare
letter, a sign) is no case; ties between keys go to the first; other columns are ignored; repeated rows are cases on
their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import MAX_BROADCAST_ROWS, cut, table
from .lookalike import clean, look

#: Pages in which the bytes of UTF-8 may have been displayed, and pairs of one-byte pages (displayed, written).
SHOWN_PAGES = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp1250", "cp1258", "mac_roman", "cp866", "koi8-r", "cp874", "cp1253", "cp1254", "gbk", "big5", "shift_jis")
SWAPS = tuple((a, b) for a in ("latin-1", "cp1252", "cp437", "cp1251", "koi8-r", "cp866", "mac_roman") for b in ("cp1251", "koi8-r", "cp866", "cp1252", "tis-620", "cp1258", "mac_roman", "cp437") if a != b)
#: Rounds of expectation-maximization; least gain in log-probability for a token to count as garbled, by kind of swap.
ROUNDS, UTF8_GAIN, SWAP_GAIN, CIPHER_GAIN = 12, 3.0, 9.0, 9.0
#: Gain at which a single word of a value is enough for a key without a code page.
ALONE_GAIN = 14.0
#: Prior of the letter that a code page gives.
PAGE_PRIOR = 0.98
#: Most contexts of a key that one task learns from; a larger key is learned over all tasks. It changes the plan only.
IN_TASK = 200_000
#: Contexts that are worked out at a time.
BLOCK = 4096
#: Pages of two bytes per character.
WIDE_PAGES, WRITTEN_WIDE = ("gbk", "big5", "shift_jis"), ("gbk", "big5", "shift_jis", "euc_jp")
#: Mean log-probability of a letter from which a word without runs is right as it stands.
CLEAR = -4.0
#: Symbols that a swap of two pages must show in a source.
LEAST_SYMBOLS = 3
#: Occurrences from which a symbol without a page is mapped.
EVIDENCE = 5
#: Posterior below which bigrams refute the letter of a code page.
REFUTED = 0.001
#: Share of a letter in a symbol's posterior from which the symbol is mapped to it.
SURE = 0.6
#: Signs that stand in right text beside letters.
SIGNS = set("“”‘’«»„–—…§°·•№×½¼¾²³±µ€£¥©®™º¡¿ʼ\xa0\u202f、。，；：？！（）「」『』")

_TOKEN = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")
_BLANKS = str.maketrans("\n\t\r", "   ")
_HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af\u3040-\u30ff]")
_LOST = re.compile("\ufffd|[^\\W\\d_]\\?[^\\W\\d_]+\\?[^\\W\\d_]")


def _undo(token: str, page: str) -> bytes | None:
    """The bytes that a token was displayed from in a page; a code point below 256 that the page lacks stands for itself."""
    try:
        return token.encode(page)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in token:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if ord(c) > 0xFF and c != "\ufffd":
                return None
            out += b"\xff" if c == "\ufffd" else bytes([ord(c)])
    return bytes(out)


def _edges(text: str) -> str:
    return " " + "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else "\x01" if ord(c) > 0x7F and c not in SIGNS else " " for c in text.lower()) + " "


#: Letters that tell languages of the Latin script apart: those of Vietnamese.
_VIETNAMESE = re.compile("[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]")
_ONLY_VIETNAMESE = re.compile("[ăđơưảãạằẳẵắặầẩẫấậẻẽẹềểễếệỉĩịỏõọồổỗốộờởỡớợủũụừửữứựỳỷỹỵ]")
GROUPS = ("vi", "latin", "cyrillic", "thai", "other")


def group_of(token: str) -> str:
    """The language group of a word that looks right, by its letters."""
    t = token.lower()
    if _ONLY_VIETNAMESE.search(t):
        return "vi"
    for c in t:
        if c > "\x7f" and c.isalpha():
            return "cyrillic" if "\u0400" <= c <= "\u04ff" else "thai" if "\u0e00" <= c <= "\u0e7f" else "latin" if c < "\u0250" else "other"
    return "latin"


def _fold(c: str) -> str:
    """A letter as bigrams know it: in lower case, ideographs as one, anything that is no letter as a blank."""
    c = c.lower()
    return "漢" if _HAN.match(c) else c if c.isalpha() or unicodedata.category(c[0])[0] == "M" else " "


class Language:
    """Smoothed log-probabilities of letters of text that looks right: bigrams per language group and over all, ideographs as one
    letter with their own frequencies."""

    def __init__(self, pairs: dict[tuple[str, str], int], ideographs: dict[str, int] | None = None):
        self.groups: dict[str, Counter] = {g: Counter() for g in GROUPS}
        self.pairs: Counter = Counter()
        for (g, p), n in pairs.items():
            self.groups[g][p] += n
            self.pairs[p] += n
        self.first: Counter = Counter()
        for p, n in self.pairs.items():
            self.first[p[0]] += n
        self.firsts = {g: Counter() for g in GROUPS}
        for g, held in self.groups.items():
            for p, n in held.items():
                self.firsts[g][p[0]] += n
        self.ideographs = ideographs or {}
        self.han = max(1, sum(self.ideographs.values()))
        total = sum(self.first.values())
        # letters that words of right text hold often enough to be told from stray ones
        self.letters = {c for c, n in self.first.items() if n * 2_000_000 >= total and n >= 3} | {c for c, n in self.ideographs.items() if n >= 3}
        self.size = max(1, len(self.first))
        self.cache: dict[str, float] = {}

    def log(self, a: str, b: str, group: str | None = None) -> float:
        # letters seldom seen are as improbable after themselves as after others
        pairs, first = (self.pairs, self.first) if group is None else (self.groups[group], self.firsts[group])
        n = first.get(a, 0)
        return math.log((pairs.get(a + b, 0) + 0.02) / (n + 0.02 * self.size + 50.0))

    def score(self, text: str) -> float:
        t = _edges(text)
        total, cache, before = 0.0, self.cache, " "
        for c in t[1:]:
            own = 0.0
            if c >= "\u3040" and _HAN.match(c):
                own = math.log((self.ideographs.get(c, 0) + 0.02) / (self.han + 400.0))
                c = "漢"
            pair = before + c
            got = cache.get(pair)
            if got is None:
                got = cache[pair] = self.log(before, c)
            total += got + own
            before = c
        return total

    def plain(self, text: str) -> bool:
        """Whether all characters beyond ASCII are letters of the corpus or usual signs."""
        return all(c <= "\x7f" or c in SIGNS or c.lower() in self.letters or unicodedata.category(c)[0] == "M" for c in text)


@functools.lru_cache(maxsize=1)
def _possible() -> tuple[re.Pattern, frozenset]:
    """A pattern for tokens that may be a display of UTF-8 in some page, and the characters that one-byte swaps display."""
    leads, trails, shown = set(), {chr(b) for b in range(0x80, 0xC0)}, set()
    for page in SHOWN_PAGES:
        if page not in ("gbk", "big5", "shift_jis"):
            for c, b in _bytes_of(page).items():
                (leads if b >= 0xC0 else trails).add(c)
    for page in {a for a, _ in SWAPS}:
        shown |= set(_bytes_of(page))
    either = "".join(sorted(leads)), "".join(sorted(trails))
    return re.compile(f"[{re.escape(either[0])}][{re.escape(either[1])}]|[\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af\uff61-\uff9f\ufffd]"), frozenset(shown)


@functools.lru_cache(maxsize=1)
def _pairs() -> re.Pattern:
    """A first byte of UTF-8 and one that may follow it, displayed in some one-byte page."""
    return re.compile(_possible()[0].pattern.rsplit("|", 1)[0])


@functools.lru_cache(maxsize=None)
def _bytes_of(page: str) -> dict[str, int]:
    """The byte above 127 that each character of a one-byte page stands for."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
    return out


class Key:
    """A cipher: how a word is cut into symbols, and the letter a code page gives each of them (none for the free key)."""

    def __init__(self, name: str, pattern: re.Pattern | None, prior: dict[str, str], gain: float):
        self.name, self.pattern, self.prior, self.gain = name, pattern, prior, gain

    def symbols(self, token: str) -> list[str]:
        """The token in symbols: runs of the key, else characters."""
        if self.pattern is None:
            return list(token)
        out, at = [], 0
        for m in self.pattern.finditer(token):
            out += token[at : m.start()]
            out.append(m.group(0))
            at = m.end()
        return [*out, *token[at:]]

    def applies(self, token: str) -> bool:
        return bool(self.pattern.search(token)) if self.pattern is not None else any(c in self.prior for c in token if c > "\x7f")

    def decode(self, token: str, letters: dict[str, str]) -> tuple[str, int]:
        """The token with the letters behind its symbols, and the number of symbols changed."""
        out, changed = [], 0
        for x in self.symbols(token):
            y = letters.get(x)
            changed += y is not None and y != x
            out.append(x if y is None else y)
        return "".join(out), changed


@functools.lru_cache(maxsize=1)
def keys() -> dict[str, Key]:
    """The keys with a code page as prior: displays of UTF-8 in one-byte pages, and swaps of two one-byte pages."""
    out = {}
    for page in SHOWN_PAGES:
        if page in WIDE_PAGES:
            continue
        held = _bytes_of(page)
        by = {k: "".join(re.escape(c) for c, b in held.items() if lo <= b < hi) for k, lo, hi in (("c", 0x80, 0xC0), ("2", 0xC2, 0xE0), ("3", 0xE0, 0xF0), ("4", 0xF0, 0xF5))}
        pattern = re.compile(f"[{by['2']}][{by['c']}]|[{by['3']}][{by['c']}]{{2}}|[{by['4']}][{by['c']}]{{3}}")
        out[f"utf-8<{page}"] = Key(f"utf-8<{page}", pattern, {}, UTF8_GAIN)
    for shown, written in SWAPS:
        prior = {}
        for c, b in _bytes_of(shown).items():
            try:
                y = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if y.isalpha() or unicodedata.category(y)[0] == "M":
                prior[c] = y
        if prior not in [k.prior for k in out.values()]:
            out[f"{written}<{shown}"] = Key(f"{written}<{shown}", None, prior, SWAP_GAIN)
    return out


@functools.lru_cache(maxsize=100_000)
def page_letter(key: str, symbol: str) -> str | None:
    """The letter that the key's code page gives a symbol."""
    k = keys()[key]
    if k.pattern is None:
        return k.prior.get(symbol)
    held = _bytes_of(key.split("<")[1])
    if len(symbol) < 2 or not all(c in held for c in symbol):
        return None
    try:
        y = bytes(held[c] for c in symbol).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return y if len(y) == 1 else None


def shows_utf8(token: str) -> bool:
    """Whether a whole token is a display of UTF-8 in some page, with more characters restored than lost."""
    if not _possible()[0].search(token):
        return False
    for page in SHOWN_PAGES if _pairs().search(token) else WIDE_PAGES:
        raw = _undo(token, page)
        if raw is not None:
            new = raw.decode("utf-8", "replace")
            wide = sum(c > "\x7f" and c != "\ufffd" for c in new)
            if wide > new.count("\ufffd") and new != token and len(new) < len(token):
                return True
    return False


def wide_decodings(token: str) -> Iterator[tuple[str, str, int, int]]:
    """(way, text, characters restored, characters lost) where pages of two bytes a character are concerned: displays of UTF-8 in
    them, and their bytes displayed in a one-byte page."""
    for page in WIDE_PAGES:
        raw = _undo(token, page)
        if raw is None:
            continue
        new = raw.decode("utf-8", "replace")
        wide = sum(c > "\x7f" and c != "\ufffd" for c in new)
        if wide and new != token and len(new) < len(token):
            yield f"utf-8<{page}", new, wide, new.count("\ufffd")
    if _latin(token) and (raw := _undo(token, "cp1252")) is not None:
        for page in WRITTEN_WIDE:
            try:
                new = raw.decode(page)
            except UnicodeDecodeError:
                continue
            wide = sum(c > "\x7f" for c in new)
            if wide > 1 and all(_HAN.match(c) or c in SIGNS for c in new if c > "\x7f"):
                yield f"{page}<cp1252", new, wide, 0


def readings(token: str, language: Language, tables: dict[str, dict[str, str]] | None = None, only: tuple[str, ...] | None = None) -> Iterator[tuple[float, str, str]]:
    """(gain, key, text) of every better reading of a token: by the learned tables, or by the code pages where there are none yet."""
    symbols = sum(c > "\x7f" and c not in "“”‘’«»„…" for c in token)
    maybe, shown_chars = _possible()
    runs = maybe.search(token) is not None
    pairs = runs and _pairs().search(token) is not None
    swappable = symbols and all(c <= "\x7f" or c in shown_chars for c in token) and (symbols >= 3 or not language.plain(token))
    free = (tables or {}).get("free")
    if not (runs or swappable or free and _latin(token) and any(c in free for c in token)):
        return
    composed = unicodedata.normalize("NFC", token)
    own = language.score(composed)
    if not runs and own >= CLEAR * len(composed):
        return
    # look-alike characters, full-width forms and loose accents are another fault: the best of such readings counts
    folded = unicodedata.normalize("NFC", look(token))
    own = max([own, *(language.score(reading) for reading in {unicodedata.normalize("NFC", clean(token)), folded} - {composed})])
    plain = language.plain(token) or language.plain(folded)
    found = False
    if runs or swappable:
        for way, text, wide, lost in wide_decodings(token):
            if lost <= wide and language.plain(text.replace("\ufffd", "")):
                gain = language.score(text.replace("\ufffd", "")) - own - 2.0 * lost
                if gain >= (UTF8_GAIN if way.startswith("utf-8") else SWAP_GAIN):
                    found = True
                    yield gain, way, text
    for name, key in keys().items():
        if key.pattern is not None and not pairs or key.pattern is None and (found or not swappable or plain and symbols < 3):
            continue
        if tables is not None and name not in tables or not key.applies(token):
            continue
        text, changed = token, 0
        while True:  # a run becomes one letter, so that a word ends
            letters = tables[name] if tables is not None else {x: y for x in set(key.symbols(text)) if (y := page_letter(name, x))}
            new, n = key.decode(text, letters) if tables is None else _translate(key, text, letters)
            if not n:
                break
            text, changed = new, changed + n
            composed = unicodedata.normalize("NFC", text)
            if language.plain(composed.replace("\ufffd", "")):
                gain = language.score(composed.replace("\ufffd", "")) - own
                if gain >= key.gain:
                    found = found or key.pattern is not None
                    yield gain, name, composed if key.pattern is None else text
            if key.pattern is None:
                break
    if free and not found and _latin(token):
        text = token.translate({ord(a): b for a, b in free.items()})
        gain = language.score(text) - own
        if text != token and gain >= CIPHER_GAIN:
            yield gain, "free", text


def _latin(token: str) -> bool:
    """Whether a token shows no more than a page of Western letters and signs does."""
    held = _bytes_of("cp1252")
    return all(c <= "\xff" or c in held for c in token)


def _translate(key: Key, token: str, letters: dict[str, str]) -> tuple[str, int]:
    """A token restored with a learned table: runs become one private character each, and the table is applied by translate()."""
    if key.pattern is None:
        text = token.translate({ord(a): b for a, b in letters.items()})
    else:
        names = list(letters)
        private = {x: chr(0xF0000 + i) for i, x in enumerate(names)}
        text = key.pattern.sub(lambda m: private.get(m.group(0), m.group(0)), token).translate({0xF0000 + i: letters[x] for i, x in enumerate(names)})
    return text, int(text != token)


def restore(token: str, language: Language, tables: dict[str, dict[str, str]]) -> tuple[float, str, str] | None:
    """The best reading of a garbled token with the learned tables; nothing for one that looks right or has no better reading."""
    return max(readings(token, language, tables), key=lambda r: r[0], default=None)


class Cipher:
    """Symbols to letters by expectation-maximization.

    A context is a symbol with its neighbours. E-step: a letter's posterior in a context is the bigrams with both neighbours times
    the chance that the letter is displayed as the symbol; a neighbour that is a symbol counts by its present posterior. M-step:
    that chance, from the expected counts. `prior` is the code page's letter of a symbol, as strong as ten contexts. Letters are
    those of the language beyond ASCII (of one group, if named). Expected counts are sums over contexts, in any order and parts.
    """

    def __init__(self, symbols: Iterable[str], language: Language, prior: dict[str, str], group: str | None = None):
        self.language, self.prior, self.group = language, prior, group
        # an accent that joins the letter before it, and what is no letter, is the page's: bigrams tell nothing of it
        self.fixed = {s: y for s, y in prior.items() if not y[0].isalpha()}
        self.symbols = sorted(set(symbols) - self.fixed.keys())
        first = language.first if group is None else language.firsts[group]
        self.letters = sorted({c for c in first if c > "\x7f" and c.isalpha() and c != "漢" and first[c] >= 3 and c in language.letters} | {_fold(y) for s, y in prior.items() if s not in self.fixed})
        self.place, self.at = {s: i for i, s in enumerate(self.symbols)}, {c: i for i, c in enumerate(self.letters)}
        self.beside: tuple[dict, dict] = ({}, {})
        if not self.symbols or not self.letters:
            return
        self.base = np.full((len(self.symbols), len(self.letters)), 1.0 / len(self.letters))
        for s, i in self.place.items():
            if s in prior:
                self.base[i] *= 1 - PAGE_PRIOR
                self.base[i, self.at[_fold(prior[s])]] += PAGE_PRIOR
        self.between = np.exp([[language.log(x, y, group) for y in self.letters] for x in self.letters])
        self.base *= 10.0 if prior else 0.1
        self.counts = self.base

    def __getstate__(self) -> dict:
        """What a task needs for a round; it has the language already."""
        return {k: v for k, v in self.__dict__.items() if k not in ("language", "base")}

    def _beside(self, side: int, name: str) -> np.ndarray:
        """The chance of each letter beside a neighbour on the left (0) or right (1) that is no symbol; a fixed symbol tells nothing."""
        got = self.beside[side].get(name)
        if got is None:
            log = self.language.log
            got = self.beside[side][name] = np.ones(len(self.letters)) if name in self.fixed else np.exp([log(x, name, self.group) if side else log(name, x, self.group) for x in self.letters])
        return got

    def rows(self, contexts: Iterable[tuple[str, str, str, float]]) -> tuple:
        """Contexts (left, symbol, right, number) as arrays in the order of symbols: symbols, numbers, and per side the places in a
        table of neighbours, the table, and its rows that are symbols."""
        held = sorted((self.place[s], a, b, float(n)) for a, s, b, n in contexts if s in self.place)
        sides = []
        for side in (0, 1):
            names = sorted({r[1 + side] for r in held})
            index = {x: i for i, x in enumerate(names)}
            known = np.ones((len(names), len(self.letters)))
            for x, i in index.items():
                if x not in self.place:
                    known[i] = self._beside(side, x)
            ours = np.array([(i, self.place[x]) for x, i in index.items() if x in self.place], dtype=int).reshape(-1, 2)
            sides.append((np.array([index[r[1 + side]] for r in held], dtype=int), known, ours))
        return np.array([r[0] for r in held], dtype=int), np.array([r[3] for r in held]), *sides

    def expect(self, rows: tuple, sums: np.ndarray) -> float:
        """E-step: adds the expected counts of contexts to `sums`; their log-likelihood."""
        si, n, (ai, left, ours_left), (bi, right, ours_right) = rows
        posterior = lambda k: self.counts[k] / self.counts[k].sum(1, keepdims=True)
        left[ours_left[:, 0]] = posterior(ours_left[:, 1]) @ self.between
        right[ours_right[:, 0]] = posterior(ours_right[:, 1]) @ self.between.T
        left = left / self.counts.sum(0)  # counts over a letter's sum: the chance that it is displayed as the symbol
        likelihood = 0.0
        for lo in range(0, len(si), BLOCK):
            s, w = si[lo : lo + BLOCK], n[lo : lo + BLOCK]
            part = self.counts[s] * left[ai[lo : lo + BLOCK]] * right[bi[lo : lo + BLOCK]]
            total = np.maximum(part.sum(1), 1e-300)
            likelihood += float((w * np.log(total)).sum())
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sums[s[starts]] += np.add.reduceat(part * (w / total)[:, None], starts)
        return likelihood

    def maximize(self, sums: np.ndarray) -> None:
        self.counts = self.base + sums

    def table(self, seen: dict[str, int]) -> dict[str, str]:
        """The letters that are sure, given how often each symbol was seen."""
        share = self.counts / self.counts.sum(1, keepdims=True)
        best = share.argmax(1)
        out = dict(self.fixed)
        for s, i in self.place.items():
            if s in self.prior:  # with its case, or the very ideograph
                if share[i, self.at[_fold(self.prior[s])]] >= REFUTED:
                    out[s] = self.prior[s]
            elif share[i, best[i]] >= SURE and seen[s] >= EVIDENCE:
                out[s] = self.letters[best[i]]
        return out


def learn_key(contexts: dict[tuple[str, str, str], float], language: Language, prior: dict[str, str], group: str | None = None) -> tuple[dict[str, str], float]:
    """Symbols to letters by expectation-maximization, and the mean log-likelihood of a context."""
    cipher = Cipher({s for _, s, _ in contexts}, language, prior, group)
    if not cipher.symbols or not cipher.letters:
        return cipher.fixed, -1e9
    rows = cipher.rows((a, s, b, n) for (a, s, b), n in contexts.items())
    likelihood = 0.0
    for _ in range(ROUNDS):
        sums = np.zeros_like(cipher.counts)
        likelihood = cipher.expect(rows, sums)
        cipher.maximize(sums)
    seen: Counter = Counter()
    for (_, s, _), n in contexts.items():
        seen[s] += n
    return cipher.table(seen), likelihood / max(1.0, float(rows[1].sum()))


def _ways(name: str, symbols: Iterable[str], language: Language) -> list[tuple[dict[str, str], str | None]]:
    """(prior, group) of the ways in which a key is learned; the likeliest is kept."""
    if name == "free":
        return [({}, g) for g in GROUPS[:-1] if len(language.groups[g]) > 50]
    return [({s: y for s in symbols if (y := page_letter(name, s))}, None)]


def _learn_over_tasks(contexts: DataFrame, name: str, seen: dict[str, int], sent: Broadcast) -> dict[str, str]:
    """The table of a key with any number of contexts (a, s, b, n): the E-step runs in all tasks, a round after the other. A symbol's
    contexts are in one task, so that its expected counts reach the driver once."""
    contexts = cut(contexts.select("a", "s", "b", "n").repartition("s"))
    learned = []
    for prior, group in _ways(name, seen, sent.value):
        cipher = Cipher(seen, sent.value, prior, group)
        if not cipher.symbols or not cipher.letters:
            learned.append((cipher.fixed, -1e9))
            continue
        likelihood = 0.0
        for _ in range(ROUNDS):
            state = contexts.sparkSession.sparkContext.broadcast(cipher)

            def expect(batches: Iterator[pd.DataFrame], state: Broadcast = state) -> Iterator[pd.DataFrame]:
                cipher = state.value
                cipher.language = sent.value
                sums, met, likelihood = np.zeros_like(cipher.counts), set(), 0.0
                for batch in batches:
                    rows = cipher.rows(zip(batch["a"], batch["s"], batch["b"], batch["n"]))
                    likelihood += cipher.expect(rows, sums)
                    met.update(rows[0].tolist())
                places = np.array(sorted(met), dtype=np.int64)
                for lo in range(0, len(places), BLOCK):
                    part = places[lo : lo + BLOCK]
                    yield pd.DataFrame({"places": [part.tobytes()], "sums": [sums[part].tobytes()], "likelihood": [likelihood if lo == 0 else 0.0]})

            sums, likelihood = np.zeros_like(cipher.counts), 0.0
            for r in contexts.mapInPandas(expect, "places binary, sums binary, likelihood double").collect():
                sums[np.frombuffer(r["places"], np.int64)] += np.frombuffer(r["sums"]).reshape(-1, sums.shape[1])
                likelihood += r["likelihood"]
            cipher.maximize(sums)
            state.destroy()
        learned.append((cipher.table(seen), likelihood / max(1.0, float(sum(seen[s] for s in cipher.symbols)))))
    return max(learned, key=lambda x: x[1], default=({}, 0.0))[0]


def _tokens(values: DataFrame) -> DataFrame:
    """Distinct words with a character beyond ASCII, per source, with their counts over all values."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pd.DataFrame:
            held = [(s, t, n) for s, c in seen.items() for t, n in c.items() if not t.isascii()]
            seen.clear()
            return pd.DataFrame(held, columns=["source", "token", "n"])

        for batch in batches:
            for source, value in zip(batch["source"], batch["value"]):
                if not value.isascii():
                    seen[source].update(value.translate(_BLANKS).split(" ") if "\t" in value or "\r" in value else value.replace("\n", " ").split(" "))
            if sum(map(len, seen.values())) > 500_000:
                yield rows()
        yield rows()

    return values.where("value is not null").select("source", "value").mapInPandas(count, "source string, token string, n bigint").groupBy("source", "token").agg(F.sum("n").alias("n"))


def learn_language(tokens: DataFrame) -> Language:
    """Bigrams of the words that no code page explains and that hold letters and usual signs only, per language group."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs: Counter = Counter()
            for token, n in zip(batch["token"], batch["n"]):
                if "\ufffd" in token or any("\x80" <= c < "\xa0" for c in token):
                    continue
                if shows_utf8(token):
                    continue
                t = _edges(unicodedata.normalize("NFC", token))
                if "\x01" not in t:
                    group = group_of(t)
                    if _HAN.search(t):
                        for c in t:
                            if _HAN.match(c):
                                pairs["han", c] += int(n)
                        t = _HAN.sub("漢", t)
                    for i in range(len(t) - 1):
                        pairs[group, t[i : i + 2]] += int(n)
            yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["g", "pair", "n"])

    rows = tokens.mapInPandas(count, "g string, pair string, n bigint").groupBy("g", "pair").agg(F.sum("n").alias("n")).where("n >= 3")
    held = rows.toArrow().to_pydict()
    held = list(zip(held["g"], held["pair"], held["n"]))
    return Language({(g, p): n for g, p, n in held if g != "han"}, {p: n for g, p, n in held if g == "han"})


def learn_tables(tokens: DataFrame, language: Language) -> dict[str, dict[str, dict[str, str]]]:
    """For each source and key the table of symbols and letters that EM is sure of, from the contexts of all words."""
    sent = tokens.sparkSession.sparkContext.broadcast(language)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = sent.value
        for batch in batches:
            rows: Counter = Counter()
            for source, token, n in zip(batch["source"], batch["token"], batch["n"]):
                best = max(readings(token, lang), key=lambda r: r[0], default=None)
                if best is not None and best[1] in keys():
                    key, text = keys()[best[1]], token
                    while True:  # a word garbled more than once shows other symbols each time
                        t = [" ", *key.symbols(text), " "]
                        letters = {x: y for x in t if (y := page_letter(key.name, x))}
                        if not letters:
                            break
                        for i in range(1, len(t) - 1):
                            if t[i] in letters:
                                rows[source, key.name, *(x if x in letters else _fold(x) for x in t[i - 1 : i + 2])] += int(n)
                        text = key.decode(text, letters)[0]
                        if key.pattern is None:
                            break
                # words that no page explains, or one that proves to be no key of the source
                if best is None or best[1] in keys() and keys()[best[1]].pattern is None:
                    odd = [c for c in token if "\x80" <= c <= "\xff" and (c.lower() not in lang.letters or c in "¸¶·¹¨»¾¼½©®ª«¬\xadµ")]
                    if odd and _latin(token) and any(c.isalpha() and c <= "\x7f" for c in token):
                        t = " " + token + " "
                        for i in range(1, len(t) - 1):
                            if t[i] > "\x7f":
                                rows[source, "free" if best is None else f"free|{best[1]}", *(x if x > "\x7f" else _fold(x) for x in t[i - 1 : i + 2])] += int(n)
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["source", "key", "a", "s", "b", "n"])

    rows = cut(tokens.mapInPandas(gather, "source string, key string, a string, s string, b string, n bigint").groupBy("source", "key", "a", "s", "b").agg(F.sum("n").alias("n")))
    met: dict[tuple[str, str], dict[str, tuple[int, int]]] = defaultdict(dict)
    for r in rows.groupBy("source", "key", "s").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).collect():
        met[r["source"], r["key"]][r["s"]] = r["contexts"], r["n"]
    parts: dict[tuple[str, str], list[str]] = defaultdict(list)  # what is learned as one
    for source, name in sorted(met):
        told = name.split("|")[1] if "|" in name else name
        # a swap that shows few of its symbols is chance; its words belong to the free key
        chance = told in keys() and keys()[told].pattern is None and len(met.get((source, told), ())) < LEAST_SYMBOLS
        if "|" not in name and not chance:
            parts[source, name].append(name)
        elif "|" in name and chance:
            parts[source, "free"].append(name)
    out: dict[str, dict[str, dict[str, str]]] = defaultdict(dict)
    near = []
    for (source, name), held in sorted(parts.items()):
        if sum(c for part in held for c, _ in met[source, part].values()) <= IN_TASK:
            near += [(source, part, name) for part in held]
            continue
        seen: Counter = Counter()
        for part in held:
            for s, (_, n) in met[source, part].items():
                seen[s] += n
        if letters := _learn_over_tasks(rows.where((F.col("source") == source) & F.col("key").isin(held)), name, seen, sent):
            out[source][name] = letters

    def learn(key: tuple, contexts: pd.DataFrame) -> pd.DataFrame:
        source, name = key
        held: Counter = Counter()
        for a, s, b, n in zip(contexts["a"], contexts["s"], contexts["b"], contexts["n"]):
            held[a, s, b] += int(n)
        learned = [learn_key(held, sent.value, prior, group) for prior, group in _ways(name, {s for _, s, _ in held}, sent.value)]
        letters, _ = max(learned, key=lambda x: x[1], default=({}, 0.0))
        return pd.DataFrame([(source, name, s, y) for s, y in letters.items()], columns=["source", "key", "s", "letter"])

    if near:
        plan = tokens.sparkSession.createDataFrame(near, "source string, key string, name string")
        held = rows.join(F.broadcast(plan) if len(near) <= MAX_BROADCAST_ROWS else plan, ["source", "key"])
        for r in held.groupBy("source", "name").applyInPandas(learn, "source string, key string, s string, letter string").collect():
            out[r["source"]].setdefault(r["key"], {})[r["s"]] = r["letter"]
    return dict(out)


def find_garbled(records: DataFrame, laws: DataFrame | None = None, id_col: str = "record_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(record_id, field_name, way, words, lost, restored) of every garbled value; `restored` is null where characters are lost."""
    held = records.select(F.col(id_col).cast("bigint").alias("k"), *([F.lower("law_id").alias("law")] if laws is not None else []), *[F.col(f).cast("string").alias(f) for f in fields])
    if laws is not None:
        known = laws.select(F.lower("law_id").alias("law"), "source").dropDuplicates(["law"])
        known = F.broadcast(known) if laws.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else known
        held = held.join(known, "law", "left")
    else:
        held = held.withColumn("source", F.lit(None).cast("string"))
    values = held.select("k", F.coalesce("source", F.lit("unknown")).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("e")).select("k", "source", "e.field_name", "e.value")
    tokens = cut(_tokens(values))
    language = learn_language(tokens)
    sent = records.sparkSession.sparkContext.broadcast((language, learn_tables(tokens, language)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language, tables = sent.value
        seen: dict[str, set[str]] = defaultdict(set)
        bad: dict[str, dict[str, tuple[float, str, str]]] = defaultdict(dict)
        for batch in batches:
            rows = []
            for key, source, field, value in zip(batch["k"], batch["source"], batch["field_name"], batch["value"]):
                if value.isascii() and "?" not in value:
                    continue
                words = set(value.translate(_BLANKS).split(" ") if "\t" in value or "\r" in value else value.replace("\n", " ").split(" "))
                new = words - seen[source]
                if new:
                    if len(seen[source]) > 500_000:
                        seen[source], bad[source] = set(), {}
                        new = words
                    for t in new:
                        if not t.isascii() and (got := restore(t, language, tables.get(source, {}))) is not None:
                            bad[source][t] = got
                    seen[source] |= new
                hits = words & bad[source].keys()
                lost = len(_LOST.findall(value)) if "\ufffd" in value or "?" in value else 0
                if not hits and not lost:
                    continue
                ways: Counter = Counter()
                # a key without a code page needs several words of a value, or one that is beyond doubt
                if hits and not (len(hits) == 1 and bad[source][(one := next(iter(hits)))][1] == "free" and bad[source][one][0] < ALONE_GAIN and len(words) > 1):

                    def fix(m: re.Match) -> str:
                        got = bad[source].get(m.group(0))
                        if got is None:
                            return m.group(0)
                        ways[got[1]] += 1
                        return got[2]

                    text = _TOKEN.sub(fix, value)
                    lost += max(0, text.count("\ufffd") - value.count("\ufffd"))
                else:
                    text = value
                if ways or lost:
                    way = max(ways, key=lambda w: (ways[w], w)) if ways else "lost"
                    rows.append((key, field, way, sum(ways.values()), lost, None if lost else text))
            yield pd.DataFrame(rows, columns=["record_id", "field_name", "way", "words", "lost", "restored"])

    return values.where(F.col("value").isNotNull()).mapInPandas(run, "record_id bigint, field_name string, way string, words int, lost int, restored string")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "records"), table(spark, sf_dir, "laws"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("record_id", "field_name")


def p5_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values by field and way of garbling, and how many could be restored whole."""
    return p5_restored(spark, sf_dir).groupBy("field_name", "way").agg(F.count("*").alias("garbled"), F.count("restored").alias("restored_whole"))


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored, "p5_ways": p5_ways}
ORACLE_SQL: dict[str, str] = {}
