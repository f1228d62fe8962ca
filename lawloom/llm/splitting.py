"""Splitting oversized items at natural boundaries (problem 3).

Balanced targets: the least number of pieces is computed, equal-length targets are placed, each target
snaps to the strongest boundary near it, and a piece is added whenever a piece would exceed the limit.

Every row is split on its own, so the work is a map over the table without a shuffle; a text costs time in
proportion to its length. Defined results: a null text gives no piece; an empty text gives one empty piece;
a text within the limit gives itself as one piece; repeated keys are split independently; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

#: The project's limits, in tokens, and its estimate of characters per token.
MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 1200, 100, 3.5

#: Boundaries from strong to weak; each pattern ends where the next piece may begin.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t]*\n+",  # paragraph
        r"\n+",  # line
        r"(?<!\d)[.!?…។៕।]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*\s*",  # sentence
        r"[;:；：；]\s*(?=\S)|,\s+|[，、]\s*",  # clause
        r"\s+",  # word
    )
)
#: How far from its target, as a share of a piece, a boundary of each strength may lie.
REACH = (0.30, 0.25, 0.20, 0.15, 0.10)

PIECE_SCHEMA = "chunk_key bigint, piece_no int, n_pieces int, start_char int, end_char int, overlap_chars int, cut_kind int, piece string"


def max_chars(tokens: int, ratio: float = CHARS_PER_TOKEN) -> int:
    """The most characters whose estimate (characters / ratio, fraction dropped) stays within so many tokens."""
    return math.ceil((tokens + 1) * ratio) - 1


def _joins(text: str, at: int) -> bool:
    """Whether a cut at this place would tear a mark, a joiner or a surrogate sequence from its base."""
    if not 0 < at < len(text):
        return False
    return unicodedata.category(text[at])[0] == "M" or text[at] in "‍️" or text[at - 1] == "‍"


def _snap(text: str, target: int, low: int, high: int, size: float) -> tuple[int, int]:
    """The place in [low, high] with the strongest boundary near the target (its rank, 5 for none), nearest first."""
    for rank, (pattern, reach) in enumerate(zip(BOUNDARIES, REACH)):
        lo, hi = max(low, int(target - reach * size)), min(high, int(target + reach * size))
        if lo > hi:
            continue
        best = min((m.end() for m in pattern.finditer(text, max(0, lo - 8), min(len(text), hi + 8)) if lo <= m.end() <= hi), key=lambda e: (abs(e - target), e), default=None)
        if best is not None:
            return best, rank
    at = min(max(target, low), high)
    while at > low and _joins(text, at):
        at -= 1
    return at, len(BOUNDARIES)


def _overlap_start(text: str, cut: int, least: int, most: int) -> int:
    """Where the overlap before a cut begins: at a word's first letter if one lies within the allowed lengths."""
    places = range(cut - least, max(0, cut - most) - 1, -1)
    for at in places:
        if at == 0 or (text[at - 1].isspace() and not text[at].isspace()):
            return at
    return next((at for at in places if not _joins(text, at)), cut - least)


def _place(text: str, pieces: int, limit: int, shared: int) -> list[tuple[int, int]] | None:
    """Cuts (place, rank) for so many pieces, or nothing where a piece could not keep the limit."""
    n, room, at = len(text), limit - shared, 0
    length = (n + (pieces - 1) * shared) / pieces
    cuts = []
    for k in range(1, pieces):
        target = round(k * length - (k - 1) * shared)
        low = max(at + shared, n - (pieces - k) * room)
        high = at + room if cuts else limit
        if low > high:
            return None
        at, rank = _snap(text, target, low, high, length)
        if at < low:
            return None
        cuts.append((at, rank))
    return cuts if n - at <= room else None


def split_text(text: str, limit: int, overlap: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, rank of the boundary at the end) of each piece; the end of the text has rank -1.

    The least number of pieces is tried first; one or two more are added while a limit fails or a cut finds
    no boundary, and more only while a limit fails.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0, -1)]
    least = 1 + math.ceil((n - limit) / (limit - overlap[1]))
    cuts = None
    for pieces in range(least, 4 * least + 4):
        placed = _place(text, pieces, limit, overlap[1])
        if placed is not None:
            natural = all(rank < len(BOUNDARIES) for _, rank in placed)
            cuts = placed if natural or cuts is None else cuts
            if natural or pieces >= least + 2:
                break
    if cuts is None:  # no place for a cut anywhere, as in one cluster of marks: cut at the limit
        cuts = [(at, len(BOUNDARIES)) for at in range(limit, n, limit - overlap[1])]
    out, begin, shared = [], 0, 0
    for at, rank in [*cuts, (n, -1)]:
        out.append((begin, at, shared, rank))
        if at < n:
            begin = _overlap_start(text, at, *overlap)
            shared = at - begin
    return out


def split_oversized(df: DataFrame, id_col: str = "chunk_key", text_col: str = "text", max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """Every text in pieces of at most `max_tokens`, neighbours sharing `overlap_tokens`.

    `start_char` and `end_char` are offsets in the stored text; `cut_kind` is the strength of the boundary at
    the end of the piece (0 paragraph, 1 line, 2 sentence, 3 clause, 4 word, 5 none, -1 end of text).
    """
    limit = max_chars(max_tokens, ratio)
    overlap = (math.ceil(overlap_tokens * ratio), max_chars(overlap_tokens, ratio))
    if overlap[1] * 2 >= limit:
        raise ValueError("the overlap must be less than half of the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                parts = split_text(text, limit, overlap)
                rows += [(key, i, len(parts), a, b, o, r, text[a:b]) for i, (a, b, o, r) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["chunk_key", "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "cut_kind", "piece"])

    keyed = df.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    return keyed.mapInPandas(run, PIECE_SCHEMA)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the operator had to cut: those with a second piece."""
    return p3_pieces(spark, sf_dir).where("piece_no = 2").select("chunk_key")


def p3_cut_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cuts fall: pieces, longest piece and overlap by kind of boundary."""
    return (
        p3_pieces(spark, sf_dir)
        .groupBy("cut_kind")
        .agg(
            F.count("*").alias("pieces"),
            F.max(F.expr("cast(floor(length(piece) / 3.5D) as int)")).alias("max_tokens"),
            F.min(F.when(F.col("piece_no") > 1, F.expr("cast(floor(overlap_chars / 3.5D) as int)"))).alias("min_overlap_tokens"),
            F.max(F.when(F.col("piece_no") > 1, F.expr("cast(floor(overlap_chars / 3.5D) as int)"))).alias("max_overlap_tokens"),
        )
    )


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cut_quality": p3_cut_quality}
ORACLE_SQL = {"p3_found": "SELECT chunk_key FROM chunks WHERE floor(length(text) / 3.5) > 1200"}
