"""Filling containers of fixed capacity with items of varying length.

Which lengths share a container depends on the histogram of lengths only, and
that has at most ``capacity`` entries however many items there are.  So the
driver plans patterns (a multiset of lengths, and how many containers use it)
by best-two-fit over the histogram, and the items then find their slots by
their rank among the items of their length, which is computed in shards.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.tokens import VOCABULARY, token_count
from threadmill.session import cut_lineage

CAPACITY = 2048

#: About as many items share a shard when ranks are counted.
SHARD_ITEMS = 500_000
#: Ranks of items of one length are below two to this power.
_RANK_BITS = 48


def _floor_index(counts: np.ndarray) -> np.ndarray:
    """For every length the largest available length that does not exceed it, else 0."""
    at = np.where(counts > 0, np.arange(len(counts)), 0)
    return np.maximum.accumulate(at)


def _best_two(counts: np.ndarray, floor: np.ndarray, room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum within ``room``, (0, 0) if none."""
    larger = np.flatnonzero(counts[: room + 1])
    larger = larger[larger > 0]
    if not len(larger):
        return 0, 0
    smaller = floor[np.minimum(room - larger, larger)]
    # the same length twice needs two items of it
    twice = (smaller == larger) & (counts[larger] < 2)
    smaller = np.where(twice, floor[np.maximum(larger - 1, 0)], smaller)
    total = np.where(smaller > 0, larger + smaller, 0)
    best = int(np.argmax(total))
    return (int(larger[best]), int(smaller[best])) if total[best] else (0, 0)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over a histogram of lengths in 1..capacity.

    A container is filled greedily with the longest items that fit.  Then its
    smallest item is taken out if two unpacked items fill the wider gap more
    tightly.  The pattern found is repeated as often as the histogram allows,
    so every round uses up at least one length.  Returns (containers, lengths).
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[tuple[int, dict[int, int]]] = []
    while counts.any():
        floor = _floor_index(counts)
        left, used, room = counts.copy(), [], capacity
        while room:
            length = int(floor[room])
            if not length:
                break
            used.append(length)
            left[length] -= 1
            room -= length
            if not left[length]:
                floor = _floor_index(left)
        if room and len(used) > 1:
            smallest = used[-1]
            larger, smaller = _best_two(left, _floor_index(left), room + smallest)
            if larger + smaller > smallest:
                used[-1:] = [larger, smaller]
        pattern = Counter(used)
        times = min(int(counts[length] // n) for length, n in pattern.items())
        for length, n in pattern.items():
            counts[length] -= n * times
        patterns.append((times, dict(pattern)))
    return patterns


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``key, piece_no, container_no, start, size`` for every item.

    Items longer than ``capacity`` are cut into full pieces and a rest; the
    rest is packed like any other item.  Items of size zero or null take no
    room: they get no container (null) and one piece of size 0.  Rows that
    repeat a key are items of their own.
    """
    known = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_whole"))
    pieces = known.select(key, "_whole", F.explode(F.expr(f"sequence(0, greatest(cast(ceil(_whole / {capacity}) as int) - 1, 0))")).alias("piece_no")).select(
        key, "piece_no", (F.col("piece_no") * capacity).cast("bigint").alias("start"), F.least(F.col("_whole") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("size")
    )
    pieces = cut_lineage(pieces)
    shards = max(1, -(-pieces.count() // shard_items))
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    per_shard = sharded.where("size > 0").groupBy("size", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity x shards rows; summed up it has at most ``capacity`` rows
    histogram = {r["size"]: r["n"] for r in per_shard.groupBy("size").agg(F.sum("_n").alias("n")).collect()}

    slots, base, taken = [], 0, Counter()
    for times, pattern in plan_patterns(histogram, capacity):
        for length, n in pattern.items():
            slots.append((length, taken[length], n, base))
            taken[length] += times * n
        base += times
    # which rank of a length begins which stretch of containers; a rank finds its stretch by halving
    plan = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
    starts = (plan[:, 0] << _RANK_BITS) + plan[:, 1]

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, (sizes.to_numpy(np.int64) << _RANK_BITS) + ranks.to_numpy(np.int64), side="right") - 1
        return pd.Series(plan[at, 3] + (ranks.to_numpy(np.int64) - plan[at, 1]) // plan[at, 2])

    before = F.coalesce(F.sum("_n").over(Window.partitionBy("size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_shard.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy("size", "_shard").orderBy(key, "piece_no")) - 1
    ranked = sharded.where("size > 0").withColumn("_rank", rank).join(offsets, ["size", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    packed = ranked.select(key, "piece_no", container("size", "_rank").alias("container_no"), "start", "size")
    roomless = pieces.where("size = 0").select(key, "piece_no", F.lit(None).cast("bigint").alias("container_no"), "start", "size")
    return packed.unionByName(roomless)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Training inputs: which pieces of which documents share a container."""
    counted = documents.select("doc_id", token_count("text", vocabulary).alias("n_tokens"))
    return pack(counted, "doc_id", "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers that could hold them, and the share of room left over."""
    held = packed.where("size > 0")
    return held.agg(
        F.count_distinct("container_no").alias("containers"),
        F.sum("size").alias("tokens"),
        F.ceil(F.sum("size") / capacity).alias("least_containers"),
        (1 - F.sum("size") / (F.count_distinct("container_no") * capacity)).alias("unused_share"),
    )


def packing_faults(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: how many documents are placed, and what must be none: containers over their capacity, documents split though they fit, pieces out of place; and whether at most one container in a hundred is more than the tokens need."""
    held = packed.where("size > 0")
    over = held.groupBy("container_no").agg(F.sum("size").alias("n")).where(F.col("n") > capacity).agg(F.count(F.lit(1)).alias("over_full"))
    whole = held.groupBy("doc_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("size")).alias("end"))
    told = whole.agg(
        F.count(F.lit(1)).alias("placed"),
        F.count_if((F.col("n") <= capacity) & (F.col("pieces") > 1)).alias("split_needlessly"),
        F.count_if(F.col("n") != F.col("end")).alias("torn"),
    )
    rows = documents.agg(F.count(F.lit(1)).alias("given")).crossJoin(packed.where("piece_no = 0").agg(F.count(F.lit(1)).alias("listed")))
    fill = fill_report(packed, capacity).select((F.col("containers") <= F.ceil(F.col("least_containers") * 1.01)).alias("tight"))
    return told.crossJoin(over).crossJoin(fill).crossJoin(rows.select((F.col("given") - F.col("listed")).alias("lost")))
