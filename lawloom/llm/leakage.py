"""Evaluation texts leaking into training text (problem 7).

Both sides are cut into windows of fifteen words. Two windows whose five-word shingles are 0.8 alike have an inner run of
thirteen words nearly in common, so what is fingerprinted are these: the SimHash of an inner window's shingles, weighted as
in the comparison. The items' fingerprints are indexed by blocks of bits; any two within RADIUS bits agree in one block,
so the blocks find every pair within it. Around each such pair the windows of fifteen words are verified by the exact
weighted similarity of their shingles.

Before fingerprints are taken, an exact bound passes over text that can hold no leak: what a window shares with any item
weighs no more than those of its shingles that items hold at all, and windows for which that is too little are left
out; none that reaches the similarity is.

The evaluation table goes to the tasks in sets of a fixed number of windows, so what a task holds is bounded
whatever the table's size; the corpus is only mapped over, never shuffled, and hot sources or groups of copies
cost what their rows cost. Defined results: null and empty texts hold no windows; a text of fewer words than a
window holds none; repeated rows give a row for each pair of distinct keys; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

#: Words of a window; the least weighted similarity; words of a shingle that is compared.
WINDOW, SIMILARITY, SHINGLE = 15, 0.8, 5
#: Words by which a fingerprinted window is shorter; bits by which fingerprints may differ.
INNER, RADIUS = 2, 3
#: Evaluation windows held by a task at once; a larger evaluation table is worked through in several sets.
SET_WINDOWS = 400_000
#: Windows of a document that are fingerprinted at once.
STRIDE = 40_000
#: Bits of the table that tells most shingles without a match.
TABLE_BITS = 22

WORD = re.compile(r"[^\W_]+")

LEAK_SCHEMA = "doc_id bigint, item_id bigint, windows int, similarity double, longest_run int"


def words_of(text: str) -> list[str]:
    """The words of a text: unbroken runs of letters or digits, composed and in lower case."""
    return WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n]
    for k in range(1, size):
        out = _mix(out, hashes[k : k + n])
    return out


def _box(values: np.ndarray, span: int) -> np.ndarray:
    """Sums of each so many successive values."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[span:] - total[:-span]


def simhash(shingles: np.ndarray, weights: np.ndarray, span: int) -> np.ndarray:
    """Weighted SimHash of each so many successive shingles: a bit is set where shingles of more than half the weight have it."""
    n = len(shingles) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(shingles) + 1, 64))
    np.cumsum(np.where(bits, weights[:, None], -weights[:, None]), axis=0, out=sums[1:])
    return np.packbits(sums[span:] - sums[:-span] > 1e-9, axis=1).view(np.uint64).ravel()


class _Blocks:
    """Fingerprints of the inner windows of a set of items, by each block of their bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.parts = prints, radius, []
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:]):
            mask = np.uint64((1 << int(hi - lo)) - 1)
            key = (prints >> np.uint64(lo)) & mask
            order = np.argsort(key, kind="stable")
            self.parts.append((np.uint64(lo), mask, order, key[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in `prints`, in the set) of all pairs within the radius, each once."""
        left, right = [], []
        for lo, mask, order, keys in self.parts:
            key = (prints >> lo) & mask
            first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            count = last - first
            a = np.repeat(np.arange(len(prints)), count)
            b = order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            close = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
            left.append(a[close])
            right.append(b[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]


class _Index:
    """The items of a set: the weights of their shingles, by hash, and the fingerprints of their inner windows."""

    def __init__(self, shingles: list[np.ndarray], weights: list[np.ndarray], span: int, radius: int = RADIUS):
        flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        self.keys, first = np.unique(flat, return_index=True)
        self.weight = np.concatenate(weights)[first] if shingles else np.zeros(0)
        self.span, self.inner = span, max(1, span - INNER)
        prints = [simhash(s, w, self.inner) for s, w in zip(shingles, weights)]
        self.item = np.repeat(np.arange(len(prints)), [len(x) for x in prints])
        self.place = np.concatenate([np.arange(len(x)) for x in prints]) if prints else np.zeros(0, int)
        self.windows = [len(s) - span + 1 for s in shingles]
        self.blocks = _Blocks(np.concatenate(prints) if prints else flat, radius)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def pairs(self, hashes: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int]]:
        """Pairs of windows (place in the document, item, place in it) around near fingerprints, each once."""
        span, inner = self.span, self.inner
        at = np.flatnonzero(self.table[(hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        if not len(at) or len(hashes) < span:
            return
        key = np.searchsorted(self.keys, hashes[at])
        known = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[at]
        at, key = at[known], key[known]
        weight, held = np.ones(len(hashes)), np.zeros(len(hashes))
        weight[at] = held[at] = self.weight[key]
        likely = np.flatnonzero(_box(held, span) >= (similarity - 1e-6) * _box(weight, span))
        if not len(likely):
            return
        # the inner windows of likely ones, in runs
        starts = np.unique((likely[:, None] + np.arange(span - inner + 1)).ravel())
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            lo, hi = run[0], run[-1] + inner
            for step in range(lo, hi - inner + 1, STRIDE):
                end = min(hi, step + STRIDE + inner - 1)
                a, b = self.blocks.near(simhash(hashes[step:end], weight[step:end], inner))
                seen: set[tuple[int, int, int]] = set()
                for i, n, j in zip((a + step).tolist(), self.item[b].tolist(), self.place[b].tolist()):
                    for x in range(max(0, i - INNER), min(i, len(hashes) - span) + 1):
                        for y in range(max(0, j - INNER), min(j, self.windows[n] - 1) + 1):
                            seen.add((x, n, y))
                yield from sorted(seen)


def _shingles(words: list[str], size: int) -> Counter:
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def weighted_similarity(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted Jaccard similarity of two bags of shingles; a shingle without a weight counts 1."""
    both = sum(weight.get(s, 1.0) * min(n, b[s]) for s, n in a.items() if s in b)
    every = sum(weight.get(s, 1.0) * n for s, n in a.items()) + sum(weight.get(s, 1.0) * n for s, n in b.items()) - both
    return both / every if every else 0.0


def _run(a: list[str], i: int, b: list[str], j: int, window: int) -> tuple[int, int]:
    """Length of the longest run of equal words through two windows at the same offset, and the end in `a` of the last."""
    longest, end, d = 0, i, 0
    while d < window:
        if a[i + d] != b[j + d]:
            d += 1
            continue
        lo = hi = d
        while i + lo > 0 and j + lo > 0 and a[i + lo - 1] == b[j + lo - 1]:
            lo -= 1
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        longest, end, d = max(longest, hi - lo), i + hi, hi
    return longest, end


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per document and item with a verified pair of windows.

    `windows` is the number of such pairs, `similarity` the best of them and `longest_run` the most successive
    words the two have in common through a pair (at least the window's size where a window is held exactly).
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    held = items.select(F.col(item_id).cast("bigint").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    sizes = held.select("k", F.regexp_count("t", F.lit(r"[\p{L}\p{N}\p{M}]+")).alias("n"))
    # items of one set, by a running total over blocks of keys; a set holds about SET_WINDOWS windows
    n_windows = sizes.agg(F.sum("n")).first()[0] or 0
    n_sets = max(1, -(-int(n_windows) // SET_WINDOWS))
    weights = cut(_item_weights(held, shingle))
    out = None
    for k in range(n_sets):
        part = held.where(F.pmod(F.xxhash64("k"), F.lit(n_sets)) == k)
        found = _search(keyed, part, weights, window, similarity, shingle)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], LEAK_SCHEMA)


def _item_weights(held: DataFrame, shingle: int) -> DataFrame:
    """Inverse item frequency of each shingle that several items share, so that boilerplate counts little."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(int(xxhash.xxh3_64_intdigest(" ".join(s)) >> 1),) for t in batch["t"] for s in set(_shingles(words_of(t), shingle))]
            yield pd.DataFrame(rows, columns=["s"])

    return held.mapInPandas(count, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s", (1.0 / F.col("n")).alias("w"))


def _search(docs: DataFrame, part: DataFrame, weights: DataFrame, window: int, similarity: float, shingle: int) -> DataFrame:
    items = [(int(r["k"]), words_of(r["t"])) for r in part.orderBy("k").collect()]  # one set: bounded by SET_WINDOWS
    items = [(k, w) for k, w in items if len(w) >= window]
    hashed = _Hashes()
    shingles = [shingle_hashes(np.array([hashed[x] for x in w], np.uint64), shingle) for _, w in items]
    own = {int(xxhash.xxh3_64_intdigest(" ".join(s)) >> 1): s for _, w in items for s in _shingles(w, shingle)}
    # of the shared shingles of the whole table only those of this set
    named = docs.sparkSession.createDataFrame([(s,) for s in own], "s bigint")
    weight = {own[r["s"]]: r["w"] for r in weights.join(named, "s", "left_semi").collect()} if items else {}
    own_weights = [np.array([weight.get(tuple(w[i : i + shingle]), 1.0) for i in range(len(w) - shingle + 1)]) for _, w in items]
    sent = docs.sparkSession.sparkContext.broadcast((items, shingles, own_weights, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, shingles, own_weights, weight = sent.value
        index, hashed = _Index(shingles, own_weights, window - shingle + 1), _Hashes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                words = words_of(text)
                if len(words) < window or not items:
                    continue
                hashes = np.array([hashed[w] for w in words], np.uint64)
                best: dict[int, list] = {}
                done: set[tuple[int, int, int]] = set()
                ends: dict[tuple[int, int], int] = {}
                for i, n, at in index.pairs(shingle_hashes(hashes, shingle), similarity):
                    if (i, n, at) in done:
                        continue
                    done.add((i, n, at))
                    theirs = items[n][1]
                    x, y = words[i : i + window], theirs[at : at + window]
                    s = 1.0 if x == y else weighted_similarity(_shingles(x, shingle), _shingles(y, shingle), weight)
                    if s >= similarity:
                        got = best.setdefault(n, [0, 0.0, 0])
                        got[0] += 1
                        got[1] = max(got[1], s)
                        # a pair inside the run last measured at this offset has no other
                        if i + window > ends.get((n, at - i), 0):
                            longest, ends[n, at - i] = _run(words, i, theirs, at, window)
                            got[2] = max(got[2], longest)
                rows += [(key, items[n][0], *got) for n, got in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "windows", "similarity", "longest_run"])

    return docs.mapInPandas(run, LEAK_SCHEMA)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with windows of similarity 0.8 or more, exact or not."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 15 successive words of an item: the verified pairs with such a run."""
    return p7_leaks(spark, sf_dir).where(F.col("longest_run") >= WINDOW).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked: documents with an exact passage, with any passage, and the longest run, per item."""
    return (
        p7_leaks(spark, sf_dir)
        .groupBy("item_id")
        .agg(
            F.countDistinct(F.when(F.col("longest_run") >= WINDOW, F.col("doc_id"))).alias("exact_documents"),
            F.countDistinct("doc_id").alias("documents"),
            F.max("longest_run").alias("longest_run"),
        )
    )


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items}
ORACLE_SQL: dict[str, str] = {}
