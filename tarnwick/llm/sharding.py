"""Minimax contiguous partition of atomic groups into shards, with DataFrame operations only.

Equal texts form one group; the groups lie in the order of their 64-bit text hash. The smallest
shard capacity for which the groups, taken in order, fit into the shards is found by binary
search, with a greedy check per probe; a group beyond it gets a shard of its own. The groups themselves never reach the driver: it sees a
histogram of hash ranges, gets from it a lower and an upper bound of the answer, and asks for a
finer histogram of just those ranges in which a cut may lie, until the bounds meet.
"""

from __future__ import annotations

from bisect import bisect_right
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, ranked_within

_FIRST_BITS, _NEXT_BITS, _MOST_CUT, _TOP = 14, 6, 4096, 1 << 64


def _unsigned(h: Column) -> Column:
    """A 64-bit hash as a whole number from 0 to 2**64 - 1 in order."""
    return (h.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("decimal(20,0)")


def _greedy(segments: list[tuple], prefix: list[int], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Cut positions (indices of segments that begin a shard) or None if ``shards`` don't do.

    A segment is (low, high, size, groups) and ``prefix`` has the sizes before each. If ``fluid``,
    a segment of several groups may be cut anywhere. A single group beyond the capacity has a
    shard of its own, so that one large group doesn't set the size of all other shards.
    """
    cuts, x = [], 0
    while x + capacity < prefix[-1]:
        y = x + capacity
        k = bisect_right(prefix, y) - 1
        if not (fluid and segments[k][3] > 1):
            y = prefix[k]
            if y <= x:
                if segments[k][3] > 1:
                    return None
                k += 1
                y = prefix[k]
                if k == len(segments):
                    break
        cuts.append(k)
        x = y
        if len(cuts) >= shards:
            return None
    return cuts


def _smallest(segments: list[tuple], prefix: list[int], low: int, high: int, shards: int, fluid: bool) -> int:
    while low < high:
        mid = (low + high) // 2
        if _greedy(segments, prefix, mid, shards, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Cut points in the unsigned order of column ``pos`` and the smallest capacity that does.

    What is minimised is the largest sum over the shards of two or more groups: a single group
    beyond the capacity has a shard of its own and does not count.

    ``groups`` has h long, pos decimal(20,0) (h in unsigned order) and size long, one row per atomic group. Each histogram has
    at most 2**14 ranges at first, and then 64 for each of the 4096 largest ranges in which a cut
    may still lie, until the bounds meet.
    """

    def cell(width: int) -> Column:
        if width == 1:
            return F.col("pos")
        return F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), width.bit_length() - 1)

    def histogram(width: int, inside: list[int] | None = None, wider: int = 0) -> list[tuple]:
        """Ranges of ``width``, of all groups or of those in the given ranges of ``wider``."""
        some = groups if inside is None else groups.where(cell(wider).isin(inside))
        rows = some.groupBy(cell(width).alias("c")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((int(r["c"]) * width, (int(r["c"]) + 1) * width, int(r["s"]), int(r["n"])) for r in rows)

    width = _TOP >> _FIRST_BITS
    segments = histogram(width)
    total = sum(s[2] for s in segments)
    while segments:
        prefix = [0, *accumulate(s[2] for s in segments)]
        low = _smallest(segments, prefix, 1, max(1, total), shards, True)
        high = _smallest(segments, prefix, low, max(1, total), shards, False)
        first, last = _greedy(segments, prefix, low, shards, True), _greedy(segments, prefix, high, shards, False)
        if low == high and _greedy(segments, prefix, low, shards, False) is not None:
            return [segments[k][0] for k in _greedy(segments, prefix, low, shards, False)], low
        spans = set()
        last_fluid = _greedy(segments, prefix, high, shards, True)
        for j in range(shards - 1):
            a = first[j] if j < len(first) else len(segments) - 1
            b = max(x[j] if j < len(x) else len(segments) - 1 for x in (last, last_fluid, first))
            spans.update(range(max(0, min(a, b) - 1), min(len(segments), max(a, b) + 1)))
        spans.update(k for k, s in enumerate(segments) if s[2] > low)
        cut = [k for k in sorted(spans) if segments[k][3] > 1]
        if not cut:
            cut = [k for k, s in enumerate(segments) if s[3] > 1]
        cut = sorted(cut, key=lambda k: -segments[k][2])[:_MOST_CUT]
        by_width: dict[int, list[int]] = {}
        for k in cut:
            a, b = segments[k][:2]
            by_width.setdefault(b - a, []).append(a // (b - a))
        fine = [x for w, inside in by_width.items() for x in histogram(max(1, w >> _NEXT_BITS), inside, w)]
        gone = set(cut)
        segments = sorted([s for k, s in enumerate(segments) if k not in gone] + fine)
    return [], 0


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus ``overhead``. Equal texts stay
    together (two texts of one 64-bit hash as well); rows with a null text are groups of their
    own by id. Returns doc_id, size, text_crc32 (null text: that of no bytes), law ``bytes``,
    shard, slot (gapless from 0 in each shard) and grown_shard (null under this law). An empty
    table gives an empty table; fewer groups than shards leave shards empty.
    """
    text, doc = F.col(text_col), F.col(id_col)
    slim = docs.select(
        doc.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.xxhash64(F.lit("null text"), doc)).otherwise(F.xxhash64(text)).alias("h"),
    )
    slim = materialize(slim, "sizes")
    groups = slim.groupBy("h").agg(F.sum("size").alias("size")).withColumn("pos", _unsigned(F.col("h")))
    cuts, _ = minimax_cuts(materialize(groups, "groups"), shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("h") >= F.lit(c - (1 << 63))).cast("int")
    placed = slim.withColumn("shard", number.cast("int"))
    slotted = ranked_within(placed, ["shard"], [F.col("doc_id"), F.col("h")], [F.col("doc_id"), F.col("h")], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
