"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are built from whole texts. Distinct fingerprints are dealt into buckets that any
pair within the radius must share, and each bucket is compared in vertical form: for 64
fingerprints at a time, plane k holds their bits k, and carry-save counters add one bit of all 64
distances per step. A block of 64 is given up as soon as all of its distances exceed the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import TMP, discard, each, materialize, shuffle_partitions
from tarnwick.llm.graph import connected_components

SEED = 42
_CHUNK = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_bytes(text: bytes, width: int = 3) -> int:
    """SimHash of one UTF-8 text: ASCII lower case, white-space words, word shingles, XXH64."""
    ws = text.lower().split()
    if not ws:
        return 0
    if len(ws) < width:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    digest, n = xxhash.xxh64_intdigest, len(ws) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        part = ws[lo : min(n, lo + _CHUNK) + width - 1]
        shingles = zip(*[part[k:] for k in range(width)], strict=False)
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint long) for every row; a null or wordless text has fingerprint zero."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = [fingerprint_bytes(t or b"", width) for t in each(texts.cast(pa.binary()))]
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fingerprint"))


def _planes(values: np.ndarray) -> np.ndarray:
    """Turn (blocks, 64) fingerprints into (blocks, 64) bit planes."""
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save count exceeds the radius, compared bit by bit from the top."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def sliced_pairs(values: np.ndarray, bucket: np.ndarray, radius: int, step: int = 1 << 18):
    """Yield index arrays (i, j), i < j, of values of the same bucket within ``radius`` bits.

    ``bucket`` must be sorted. Each value meets the blocks of 64 of its own bucket from its own
    block on; the work goes in slices of ``step`` (value, block) meetings.
    """
    if not len(values):
        return
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    blocks = -(-sizes // 64)
    first_block = np.r_[0, np.cumsum(blocks)[:-1]]
    which = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(values)) - starts[which]
    own = first_block[which] + within // 64
    lanes = np.zeros((int(blocks.sum()), 64), dtype="<u8")
    lanes[own, within % 64] = values
    index = np.full(lanes.shape, -1, dtype=np.int64)
    index[own, within % 64] = np.arange(len(values))
    filled = np.packbits(index >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    planes = _planes(lanes)
    meets = first_block[which] + blocks[which] - own
    ends = np.cumsum(meets)
    depth = (radius + 1).bit_length()
    at = 0
    while at < ends[-1]:
        many = np.arange(at, min(int(ends[-1]), at + step))
        at += len(many)
        who = np.searchsorted(ends, many, side="right")
        block = own[who] + many - (ends[who] - meets[who])
        counters = [np.zeros(len(many), dtype="<u8") for _ in range(depth)]
        spilt = ~filled[block]
        for bit in range(64):
            carry = planes[block, bit] ^ (np.uint64(0) - (values[who] >> np.uint64(bit) & np.uint64(1)))
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            spilt |= carry
            if bit % 8 == 7:
                spilt |= _over(counters, radius)
                alive = spilt != _ONES
                if not alive.all():
                    who, block, spilt = who[alive], block[alive], spilt[alive]
                    counters = [c[alive] for c in counters]
                if not len(who):
                    break
        if len(who):
            near = np.unpackbits((~spilt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(near)
            i, j = who[row], index[block[row], lane]
            yield i[i < j], j[i < j]


def _forest(n: int, pairs) -> np.ndarray:
    """Least index reachable from each of ``n`` indices over all pairs, slice by slice."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            split = a != b
            i, j, a, b = i[split], j[split], a[split], b[split]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _bucketed(values: DataFrame, keep: list[str], bits: int, segments: int, radius: int, shift: int) -> DataFrame:
    """Rows once for each choice of ``segments - radius`` whole segments, with that choice as key.

    Two values that differ in at most ``radius`` bits agree in some choice. ``shift`` picks the
    bits of ``rest`` that are cut into segments of ``bits`` bits.
    """
    choices = []
    for c, chosen in enumerate(combinations(range(segments), segments - radius)):
        mask = sum(((1 << bits) - 1) << (s * bits) for s in chosen)
        key = F.col("rest").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
        left = [s for s in range(segments) if s not in chosen]
        rest = F.lit(0).cast("long")
        for place, s in enumerate(left):
            low = F.shiftrightunsigned(F.col("rest"), s * bits).bitwiseAND(F.lit((1 << bits) - 1))
            rest = rest.bitwiseOR(F.shiftleft(low, place * bits))
        choices.append(F.struct(F.lit(c).alias("c"), key.alias("k"), rest.alias("rest")))
    each = values.select(*keep, F.explode(F.array(*choices)).alias("e"))
    bucket = F.xxhash64("bucket", "e.c", "e.k") if "bucket" in values.columns else F.xxhash64("e.c", "e.k")
    kept = [c for c in keep if c != "bucket"]
    return each.select(*kept, bucket.alias("bucket"), F.col("e.rest").alias("rest"))


def links(distinct: DataFrame, radius: int = 2, bucket_rows: int = 4096, group_rows: int = 50_000) -> DataFrame:
    """A spanning set (a, b) of the links between distinct fingerprints within ``radius`` bits.

    Buckets of over ``bucket_rows`` fingerprints are cut again by the bits that they do not
    share, in the same way, so that none is dropped and none stays whole in one task unless its
    fingerprints agree in 48 of 64 bits, of which there can be 65,536. A 64-bit bucket name may
    stand for two buckets by chance; that only adds comparisons. Of each group of buckets only
    the forest of its links is returned.
    """
    spark = distinct.sparkSession
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    base = distinct.select("fingerprint", F.col("fingerprint").alias("rest"))
    level = _bucketed(base, ["fingerprint"], 16, 4, 2, 0)
    counts = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = materialize(level.join(counts, "bucket"), "buckets")
    small = level.where(F.col("n") <= bucket_rows).select("bucket", "fingerprint")
    hot = level.where(F.col("n") > bucket_rows).select("fingerprint", "bucket", "rest")
    cut = _bucketed(hot, ["fingerprint", "bucket"], 8, 4, 2, 0)
    alive = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    cut = cut.join(alive, "bucket").select("bucket", "fingerprint")
    before, level = level, materialize(small.unionByName(cut), "buckets2")
    discard(before)
    groups = max(4 * shuffle_partitions(spark), level.count() // group_rows + 1)

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        value = table.column("fingerprint").to_numpy()
        order = np.lexsort((value, bucket))
        bucket, value = bucket[order], value[order].view(np.uint64)
        names, of = np.unique(value, return_inverse=True)
        root = _forest(len(names), ((of[i], of[j]) for i, j in sliced_pairs(value, bucket, radius)))
        moved = root != np.arange(len(names))
        signed = names.view(np.int64)
        return pa.table({"a": signed[moved], "b": signed[root[moved]]})

    return level.groupBy(F.pmod(F.col("bucket"), F.lit(groups)).alias("g")).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs``.

    Equal fingerprints are one node, so thousands of copies cost one comparison. component_id is
    the smallest doc_id reachable over links of at most ``radius`` differing bits. Null and
    wordless texts have fingerprint zero and are linked like any other; repeated rows stay
    repeated; an empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fingerprint"), radius))
    placed = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left")
    placed = placed.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(lowest, "root").select(F.col("fingerprint").alias(TMP + "f"), "component_id")
    return prints.join(classes, prints["fingerprint"] == classes[TMP + "f"]).drop(TMP + "f").select(
        "doc_id", "fingerprint", "component_id"
    )
