"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by a hash of their text and never split.  The
smallest feasible shard capacity is found by binary search with a greedy check,
and shards are cut there.

The driver never sees the groups.  It starts from sums over 2**14 ranges of the
order, searches capacities over those sums, and asks again, in ranges 256 times
finer, only for the ranges in which a cut could fall at any capacity still
possible: a few hundred a round, however many groups there are.  When no such
range holds two groups, the capacity and all cuts are exact.

Defined results: null text counts as empty (one group with empty texts) and has
size 8; null ids and repeated rows are rows of their own; an empty table gives
no rows; a group larger than the mean fills a shard alone and the others share
the rest evenly; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm.ranges import before
from skyquilt.session import cut, table

SHARDS = 24
FIRST_BITS, MORE_BITS = 14, 8


@dataclass
class Pieces:
    """Ranges of the order: prefix of the key and its bits, bytes, groups, largest group."""

    prefix: np.ndarray
    bits: np.ndarray
    total: np.ndarray
    groups: np.ndarray

    def low(self) -> np.ndarray:
        """Smallest key of each range, as a signed 64-bit integer."""
        return self.prefix << (64 - self.bits)

    def ordered(self) -> Pieces:
        o = np.argsort(self.low())
        return Pieces(self.prefix[o], self.bits[o], self.total[o], self.groups[o])


def greedy(ends: np.ndarray, capacity: int, shards: int, at: int = 0) -> list[int] | None:
    """Piece boundaries at which shards end from boundary ``at`` on, or None if they don't suffice."""
    cuts = []
    while at < len(ends) - 1:
        to = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        if to == at or len(cuts) == shards:
            return None
        cuts.append(at := to)
    return cuts


def smallest_capacity(ends: np.ndarray, shards: int) -> int:
    """Binary search over capacities for ordered sizes with running totals ``ends`` (from 0)."""
    low, high = max(int(np.diff(ends).max(initial=0)), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within ``capacity`` that leave even rests: where greedy filling would leave
    later shards empty, each takes about the mean of what is left instead."""
    at, cuts = 0, []
    for left in range(shards, 0, -1):
        if at == len(ends) - 1:
            cuts.append(at)
            continue
        full = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        mean = ends[at] + (ends[-1] - ends[at]) / left
        near = int(np.searchsorted(ends, mean))
        if near > at + 1 and mean - ends[near - 1] < ends[near] - mean:
            near -= 1
        to = min(full, max(near, at + 1))
        if to < full and greedy(ends, capacity, left - 1, to) is None:
            to = full
        cuts.append(at := to)
    return cuts


def _ask(keyed: DataFrame, key: str, size: str, bits: int, within: tuple[int, list[int]] | None) -> Pieces:
    rows = keyed if within is None else keyed.where(F.shiftright(key, 64 - within[0]).isin(within[1]))
    groups = rows.groupBy(key).agg(F.sum(size).alias("__bytes"))
    got = groups.groupBy(F.shiftright(key, 64 - bits).alias("__prefix")).agg(F.sum("__bytes").alias("__bytes"), F.count(F.lit(1)).alias("__groups")).collect()
    a = np.array([tuple(r) for r in got], np.int64).reshape(-1, 3)
    return Pieces(a[:, 0], np.full(len(a), bits), a[:, 1], a[:, 2])


def cut_keys(keyed: DataFrame, shards: int = SHARDS, key: str = "key", size: str = "size") -> list[int]:
    """Smallest keys of shards 1, 2, ...; a shard without groups has none."""
    p = _ask(keyed, key, size, FIRST_BITS, None).ordered()
    if not len(p.total):
        return []
    while True:
        ends = np.concatenate([[0], np.cumsum(p.total)])
        high = smallest_capacity(ends, shards)
        low = max(-(-int(ends[-1]) // shards), int(p.total[p.groups == 1].max(initial=0)))
        lowest, highest, may = 0, 0, np.zeros(len(p.total), bool)
        for _ in range(shards - 1):  # bounds of the next cut over all capacities from low to high
            lowest = max(lowest, int(ends[np.searchsorted(ends, lowest + low, "right") - 1]))
            highest = min(int(ends[-1]), highest + high)
            may |= (ends[:-1] < highest) & (ends[1:] > lowest)
        may &= p.groups > 1
        if not may.any():
            break
        parts = [Pieces(p.prefix[~may], p.bits[~may], p.total[~may], p.groups[~may])]
        for bits in np.unique(p.bits[may]):
            parts.append(_ask(keyed, key, size, min(64, int(bits) + MORE_BITS), (int(bits), p.prefix[may & (p.bits == bits)].tolist())))
        p = Pieces(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("prefix", "bits", "total", "groups"))).ordered()
    lows = p.low()
    return [int(lows[i]) for i in balanced(ends, high, shards)[:-1] if i < len(lows)]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = cut(rows)
    cuts = cut_keys(rows, shards)
    number: Column = F.lit(0)
    for low in cuts:
        number = number + (F.col("key") >= F.lit(low)).cast("int")
    spread = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key").cast("string")))
    rows = rows.withColumn("shard", number).withColumn("__spread", spread)
    rows = before(rows, "shard", "__spread", F.lit(1), "slot")
    return rows.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
