"""Filling fixed-capacity containers with documents (problem 6).

Sizes are tokens of a public tokenizer. Documents are spread over shards by a hash of their key; a shard is
packed from its histogram of sizes, which has at most as many rows as the capacity, whatever the number of
documents. A shard is first shrunk by dominance: a small set of documents that provably belongs together in
some best packing (one that fills a container exactly, or one than which nothing better can join its largest
document) is fixed for good, and the remainder is packed best-fit in decreasing size. The plan of a shard names,
for each size, which containers take how many; documents find their place by their rank among those of
their size, counted in two steps so that a size shared by a third of all rows is no single task.

Only a document larger than the capacity is split: into full containers and a rest that is packed like any
other document. Defined results: a null or empty text has size 0 and is put, with the other empty ones, into
containers of its shard without using space; repeated keys are packed as separate documents and share their
rows' numbers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .tokens import DEFAULT_VOCAB, count_tokens, vocab_path

#: Tokens a container holds; documents per shard on average.
CAPACITY, SHARD_DOCS = 4096, 50_000
#: Groups that the documents of one size in one shard are counted in.
RANK_GROUPS = 16

PLAN_SCHEMA = "shard int, size int, first_rank bigint, last_rank bigint, container bigint, per_container int"


class _Stock:
    """Sizes that are left, with their counts, and the largest size at or below a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        top = max(counts, default=0)
        self.below = list(range(top + 1))  # union-find: the largest size still in stock at or below
        for s in range(top + 1):
            if not self.counts.get(s):
                self.below[s] = s - 1

    def floor(self, s: int) -> int:
        """The largest size in stock that is at most s; 0 or less if there is none."""
        s = min(s, len(self.below) - 1)
        root = s
        while root > 0 and self.below[root] != root:
            root = self.below[root]
        while s > root:
            self.below[s], s = root, self.below[s]
        return root

    def take(self, s: int, n: int) -> None:
        self.counts[s] -= n
        if not self.counts[s]:
            self.below[s] = s - 1


def _least_two(stock: _Stock, ascending: list[int], at: int) -> tuple[int, int]:
    """The sum of the two smallest documents in stock (a large number if there are not two), and where to look on."""
    while at < len(ascending) and not stock.counts.get(ascending[at]):
        at += 1
    first = second = 0
    for s in ascending[at:]:
        n = stock.counts.get(s, 0)
        if not n:
            continue
        if not first:
            first = s
            if n > 1:
                return 2 * s, at
        else:
            second = s
            break
    return (first + second if second else 1 << 60), at


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of sizes that some best packing holds, with how often, and the sizes that are left.

    For the largest size j in stock: alone, if nothing fits beside it; with the size that fills the container
    exactly, if there is one; with the largest size that fits, if no two others fit beside j. A pair of this
    kind dominates every other set that holds j, so fixing it loses no container. Larger sets are left.
    """
    stock = _Stock(counts)
    fixed: list[tuple[tuple[int, ...], int]] = []
    ascending = sorted(counts)
    at = 0
    for j in sorted(counts, reverse=True):
        while (n := stock.counts.get(j, 0)) > 0:
            room = capacity - j
            stock.take(j, 1)  # the one that is placed does not count among what may join it
            mate = stock.floor(room) if room > 0 else 0
            two, at = _least_two(stock, ascending, at)
            available = stock.counts.get(mate, 0) if mate > 0 else 0
            if mate <= 0 or not available:
                times = n
                stock.take(j, n - 1) if n > 1 else None
                fixed.append(((j,), times))
            elif mate == room or two > room:
                # the same set again, as long as both sizes last and the reason still holds
                times = min(n, available) if mate != j else 1 + (available - 1) // 2
                stock.take(mate, times if mate != j else 1 + 2 * (times - 1))
                if mate != j and times > 1:
                    stock.take(j, times - 1)
                fixed.append(((j, mate), times))
            else:
                stock.counts[j] += 1
                stock.below[j] = j
                break
    return fixed, {s: n for s, n in stock.counts.items() if n}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing size on a histogram: containers alike in content are kept as one entry with a count.

    A size goes into the fullest containers that still hold it; every step splits at most one entry, so the
    number of entries stays in proportion to the number of distinct sizes.
    """
    import bisect

    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([content, n])

    done: list[tuple[tuple[int, ...], int]] = []
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                fit = capacity // s
                whole, rest = divmod(left, fit)
                if whole:
                    put(capacity - s * fit, (s,) * fit, whole)
                if rest:
                    put(capacity - s * rest, (s,) * rest, 1)
                break
            room = rooms[at]
            entry = open_by_room[room][-1]
            # as many of this size into each as fit, if there are enough of them
            fit = min(room // s, left)
            n = min(entry[1], left // fit)
            content = entry[0] + (s,) * fit
            entry[1] -= n
            if not entry[1]:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            if room - s * fit:
                put(room - s * fit, content, n)
            else:
                done.append((content, n))
            left -= n * fit
    return done + [(tuple(c), n) for entries in open_by_room.values() for c, n in entries]


def plan_shard(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank, first container, documents of this size per container) rows of a shard."""
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    fixed, rest = reduce_by_dominance(counts, capacity)
    used = dict.fromkeys(counts, 0)
    rows, container = [], 0
    for content, times in [*fixed, *best_fit(rest, capacity)]:
        for s in dict.fromkeys(content):
            each = content.count(s)
            rows.append((s, used[s], used[s] + each * times - 1, container, each))
            used[s] += each * times
        container += times
    return rows


def document_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, folder: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row under a public tokenizer; 0 for null texts."""
    path = vocab_path(vocab, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["k"], "tokens": [count_tokens(t, path) or 0 for t in batch["t"]]})

    return df.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id bigint, tokens bigint")


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, tokens, part_no, part_tokens, shard, container) for every document and part of a document."""
    sizes = cut(sizes)
    shards = max(1, -(-sizes.count() // shard_docs))
    parts = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    full = F.expr(f"cast(tokens div {capacity} as bigint)")
    # a document over the capacity fills containers of its own; what is left of it is packed with the others
    whole = (
        parts.where(F.col("tokens") > capacity)
        .withColumn("part_no", F.explode(F.sequence(F.lit(1).cast("bigint"), full)))
        .select("doc_id", "tokens", "part_no", F.lit(capacity).cast("bigint").alias("part_tokens"), "shard", F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("part_no").cast("string")).alias("container"))
    )
    big = F.col("tokens") > capacity
    rest = (
        parts.withColumn("size", F.when(big, F.col("tokens") % capacity).otherwise(F.col("tokens")).cast("int"))
        .withColumn("part_no", F.when(big, full + 1).otherwise(F.lit(1)).cast("bigint"))
        .where(~big | (F.col("size") > 0))
    )
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(RANK_GROUPS)).cast("int"))
    counts = cut(rest.groupBy("shard", "size", "grp").count())

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        plan = plan_shard({int(s): int(n) for s, n in zip(rows["size"], rows["count"])}, capacity)
        return pd.DataFrame([(key[0], *row) for row in plan], columns=["shard", "size", "first_rank", "last_rank", "container", "per_container"])

    plan = counts.where("size > 0").groupBy("shard", "size").agg(F.sum("count").alias("count")).groupBy("shard").applyInPandas(run, PLAN_SCHEMA)
    before = counts.withColumn("offset", F.sum("count").over(Window.partitionBy("shard", "size").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "size", "grp", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = (
        rest.withColumn("within", F.row_number().over(Window.partitionBy("shard", "size", "grp").orderBy("doc_id", "part_no")) - 1)
        .join(before.hint("merge"), ["shard", "size", "grp"])
        .withColumn("rank", F.col("within") + F.col("offset"))
    )
    span = plan.withColumnRenamed("container", "first_container")
    # the plan's steps of a size, by rank: bounded by the distinct sizes of a shard; a document takes the last step at or before its rank
    starts = span.groupBy("shard", "size").agg(F.sort_array(F.collect_list(F.struct("first_rank", "first_container", "per_container"))).alias("steps"))
    placed = (
        ranked.where("size > 0")
        .join(starts.hint("merge"), ["shard", "size"])
        .withColumn("step", F.element_at(F.filter("steps", lambda s: s["first_rank"] <= F.col("rank")), -1))
        .select("doc_id", "tokens", "part_no", F.col("size").cast("bigint").alias("part_tokens"), "shard", F.concat_ws("-", F.col("shard").cast("string"), F.expr("cast(step.first_container + (rank - step.first_rank) div step.per_container as string)")).alias("container"))
    )
    empty = ranked.where("size = 0").select("doc_id", "tokens", "part_no", F.lit(0).cast("bigint").alias("part_tokens"), "shard", F.concat_ws("-", F.lit("empty"), F.col("shard").cast("string")).alias("container"))
    return placed.unionByName(whole).unionByName(empty)


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, and of every part of a document over the capacity."""
    return pack(document_sizes(table(spark, sf_dir, "documents")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, their fill, and the least number any packing needs."""
    used = p6_assignment(spark, sf_dir).groupBy("container").agg(F.sum("part_tokens").alias("filled"))
    return used.where("filled > 0").agg(
        F.count("*").alias("containers"),
        F.sum("filled").alias("tokens"),
        F.ceil(F.sum("filled") / F.lit(CAPACITY)).alias("least_containers"),
        F.max("filled").alias("fullest"),
        F.round(F.sum("filled") / (F.count("*") * F.lit(CAPACITY)), 4).alias("share_used"),
    )


QUERIES = {"p6_assignment": p6_assignment, "p6_fill": p6_fill}
ORACLE_SQL: dict[str, str] = {}
