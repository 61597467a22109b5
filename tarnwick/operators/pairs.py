"""All pairs of points within groups, block by block: no pair is ever a row of a plan.

The points of a group are packed into blocks, two binary columns each; a task takes two blocks at a
time and keeps sums, or counts per bin. Every two blocks are met once, and dealt out evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import ensure_checkpoints

BLOCK, BINS = 2048, 4096
STATS = ("mean", "median", "max", "std", "pairs")


def packed(df: DataFrame, group: str, key: str, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """(g, size, reach, blocks, b, xs, ys): the points of each group in blocks of about ``block``, coordinates as bytes.

    No two points of a group are farther apart than ``reach``, the diagonal of their rectangle.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("g is not null and x is not null and y is not null")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("reach"))
    dealt = rows.join(sizes, "g").withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int")).withColumn("b", F.pmod(F.xxhash64("k", "x", "y"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        one = {c: t.column(c).slice(0, 1) for c in ("g", "size", "reach", "blocks", "b")}
        return pa.table(one | {f"{c}s": pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for c in ("x", "y")})

    return dealt.select("g", "size", "reach", "blocks", "b", "x", "y").groupBy("g", "b").applyInArrow(pack, f"g {kind}, size long, reach double, blocks int, b int, xs binary, ys binary")


def distances(xs: bytes, ys: bytes, oxs: bytes, oys: bytes, same: bool, rows: int = 32) -> Iterator[np.ndarray]:
    """The distances of all pairs of two blocks, each pair once where both are the same, in pieces that fit in a core's cache."""
    x, y, ox, oy = (np.frombuffer(b) for b in (xs, ys, oxs, oys))
    for lo in range(0, len(x), rows):
        a, b, from_ = x[lo : lo + rows, None], y[lo : lo + rows, None], lo if same else 0
        d, e = a - ox[None, from_:], b - oy[None, from_:]
        np.multiply(d, d, out=d)
        np.multiply(e, e, out=e)
        np.sqrt(np.add(d, e, out=d), out=d)
        if same:
            yield d[:, : len(a)][np.triu_indices(len(a), 1)]
            d = d[:, len(a) :]
        yield d.ravel()


def _met(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a group, and each with itself, once, dealt evenly to tasks of a fixed number."""
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Block b meets itself and the half of the ring of blocks that follows it.
    n, step = F.col("blocks"), F.col("step")
    ring = blocks.select("g", "b", "blocks", "reach", F.explode(F.expr("sequence(0, blocks div 2)")).alias("step")).where((step * 2 < n) | (F.col("b") * 2 < n))
    ring = ring.select("g", "b", F.pmod(F.col("b") + step, n).alias("ob"), "reach").repartition(tasks, "g", "b", "ob")
    at = {k: blocks.select("g", F.col("b").alias(f"{k}b"), F.col("xs").alias(f"{k}xs"), F.col("ys").alias(f"{k}ys")) for k in ("", "o")}
    both = ring.join(at[""], ["g", "b"]).join(at["o"], ["g", "ob"]).select("g", "b", "ob", "reach", "xs", "ys", "oxs", "oys")
    return both.repartition(tasks, F.xxhash64("g", "b", "ob"))


def _over_pairs(met: DataFrame, start: Callable, add: Callable, rows: Callable, schema: str, *more: str, most: int = 256) -> DataFrame:
    """What a task makes of all its pairs of blocks of a group: ``start(row)``, then ``add(state, distances)``, then ``rows(state)``.

    A task sends a group's state on at its end, or when it holds ``most`` of them.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches):
        held: dict = {}

        def sent(kind: pa.DataType):
            for g, state in held.items():
                found = rows(state)
                if len(found[0]):
                    yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(found[0]), kind), **dict(zip(names[1:], map(pa.array, found), strict=True))})
            held.clear()

        for batch in batches:
            kind = batch.column("g").type
            for i in range(batch.num_rows):  # a row is a pair of blocks
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                state = held.get(row["g"])
                if state is None:
                    if len(held) >= most:
                        yield from sent(kind)
                    state = held[row["g"]] = start(row)
                for d in distances(row["xs"], row["ys"], row["oxs"], row["oys"], row["b"] == row["ob"]):
                    add(state, d)
        if held:
            yield from sent(kind)

    return met.select("g", "b", "ob", "reach", "xs", "ys", "oxs", "oys", *more).mapInArrow(go, schema)


@dataclass
class _Sums:
    """Sums of one group's distances and their counts in ``BINS`` ranges up to ``top``, a power of two, so that the ranges' ends are exact."""

    top: float
    s: float = 0.0
    q: float = 0.0
    m: float = 0.0
    n: int = 0
    bins: np.ndarray = field(default_factory=lambda: np.zeros(BINS, dtype=np.int64))

    def add(self, d: np.ndarray, counted: bool) -> None:
        if len(d):
            self.s, self.q, self.m, self.n = self.s + float(d.sum()), self.q + float(d @ d), max(self.m, float(d.max())), self.n + len(d)
            if counted:
                self.bins += np.bincount(np.minimum(d * (BINS / self.top), BINS - 1).astype(np.int64), minlength=BINS)


@dataclass
class _Part:
    """The distances of one group from ``lo`` to ``hi`` by range: number, least and greatest."""

    lo: float
    hi: float
    values: list[np.ndarray] = field(default_factory=list)
    waiting: int = 0
    bins: dict[int, tuple[int, float, float]] = field(default_factory=dict)

    def add(self, d: np.ndarray) -> None:
        d = d[(d >= self.lo) & (d <= self.hi)]
        if len(d):
            self.values.append(d)
            self.waiting += len(d)
            if self.waiting > 1 << 20:
                self.count()

    def count(self) -> None:
        if not self.values:
            return
        d = np.sort(np.concatenate(self.values))
        self.values, self.waiting = [], 0
        at = np.minimum(((d - self.lo) / (self.hi - self.lo) * BINS).astype(np.int64), BINS - 1) if self.hi > self.lo else np.zeros(len(d), np.int64)
        for b, first, n in zip(*(v.tolist() for v in np.unique(at, return_index=True, return_counts=True)), strict=True):
            old = self.bins.get(b, (0, np.inf, -np.inf))
            self.bins[b] = (old[0] + n, min(old[1], float(d[first])), max(old[2], float(d[first + n - 1])))

    def rows(self) -> list[list]:
        self.count()
        return [list(self.bins), *([v[i] for v in self.bins.values()] for i in range(3))]


def pair_stats(df: DataFrame, group: str, key: str, x: str = "x", y: str = "y", median: bool = True, block: int = BLOCK) -> DataFrame:
    """Mean, median, greatest and population deviation of the distances within each group, and their number.

    Groups of one block are done at once. For others one pass over the pairs sums and counts them
    per range; the median comes from passes over the range that holds it, which narrows until its
    ends meet: two more for most tables. A task keeps the sums of its groups, so what it sends does
    not grow with the pairs. Groups of one point have no row. Rows without a group, x or y take no part.
    """
    ensure_checkpoints(df.sparkSession)
    kind = df.schema[group].dataType.simpleString()
    blocks = packed(df, group, key, x, y, block).checkpoint()

    def alone(batches):
        for batch in batches:
            out = []
            for xs, ys in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                d = np.concatenate([np.zeros(0), *distances(xs, ys, xs, ys, True)])
                out.append((d.mean(), np.median(d), d.max(), d.std(), len(d)) if len(d) else (None,) * 5)
            yield pa.RecordBatch.from_arrays([batch.column("g"), *(pa.array([r[i] for r in out], pa.int64() if i == 4 else pa.float64()) for i in range(5))], ["g", *STATS])

    schema = f"g {kind}, mean double, median double, max double, std double, pairs long"
    small = blocks.where("blocks = 1").select("g", "xs", "ys").mapInArrow(alone, schema).where("pairs is not null")
    large = blocks.where("blocks > 1")
    if large.limit(1).count() == 0:
        return small.withColumnRenamed("g", group)

    met = _met(large)
    # A power of two above all distances of the group.
    start = lambda row: _Sums(math.ldexp(1.0, math.frexp(row["reach"] * 1.001)[1]))
    sums = _over_pairs(met, start, lambda t, d: t.add(d, median), lambda t: ([t.s], [t.q], [t.m], [t.n], [t.top], [t.bins.tolist() if median else []]), f"g {kind}, s double, q double, m double, n long, top double, bins array<long>").checkpoint()
    whole = sums.groupBy("g").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("max"), F.sum("n").alias("pairs"))
    mean = F.col("s") / F.col("pairs")
    whole = whole.select("g", mean.alias("mean"), "max", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("pairs") - mean * mean)).alias("std"), "pairs").checkpoint()
    if median:
        whole = whole.join(_medians(met, sums, whole, kind), "g")
    else:
        whole = whole.withColumn("median", F.lit(None).cast("double"))
    return small.unionByName(whole.select("g", *STATS)).withColumnRenamed("g", group)


def _medians(met: DataFrame, sums: DataFrame, whole: DataFrame, kind: str) -> DataFrame:
    """(g, median) of groups of several blocks: the counts of ``sums`` name a first range, which narrows."""
    first, second = F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2)
    bins = sums.select("g", "top", F.posexplode("bins").alias("bin", "n")).groupBy("g", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # The one range, or the two with nothing between them, in which the two middle distances lie.
    hold = bins.where("n > 0").withColumn("before", upto - F.col("n")).join(whole.select("g", first.alias("r1"), second.alias("r2")), "g").where("before <= r2 and before + n > r1")
    edge = lambda b: b * F.col("top") / F.lit(float(BINS))
    ranges = hold.groupBy("g", "r1", "r2").agg(F.min(edge(F.col("bin"))).alias("lo"), F.max(edge(F.col("bin") + 1)).alias("hi"), F.min("before").alias("before"))
    ranges = ranges.select("g", "lo", "hi", (F.col("r1") - F.col("before")).alias("r1"), (F.col("r2") - F.col("before")).alias("r2")).checkpoint()
    done = None

    while True:
        bins = _over_pairs(met.join(ranges.select("g", "lo", "hi"), "g"), lambda row: _Part(row["lo"], row["hi"]), lambda t, d: t.add(d), lambda t: t.rows(), f"g {kind}, bin long, n long, low double, high double", "lo", "hi")
        per = bins.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # At most BINS rows a group, in an array: the ranks are looked up in its running sums.
        table = per.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("t")).join(ranges.select("g", "r1", "r2"), "g")
        start = F.named_struct(F.lit("before"), F.lit(0).cast("long"), F.lit("out"), F.array().cast("array<struct<upto:bigint,n:bigint,low:double,high:double>>"))
        step = lambda a, e: F.named_struct(F.lit("before"), a["before"] + e["n"], F.lit("out"), F.concat(a["out"], F.array(F.named_struct(F.lit("upto"), a["before"] + e["n"], F.lit("n"), e["n"], F.lit("low"), e["low"], F.lit("high"), e["high"]))))
        bin_of = lambda r: F.get(F.filter("u", lambda e: e["upto"] > F.col(r)), F.lit(0))
        found = table.withColumn("u", F.aggregate("t", start, step, lambda a: a["out"])).select("g", "r1", "r2", bin_of("r1").alias("b1"), bin_of("r2").alias("b2")).checkpoint()
        apart = F.col("b1.upto") != F.col("b2.upto")
        closed = apart | (F.col("b1.low") == F.col("b1.high"))
        value = F.when(apart, (F.col("b1.high") + F.col("b2.low")) / 2).otherwise(F.col("b1.low"))
        ready = found.where(closed).select("g", value.alias("median"))
        done = ready if done is None else done.unionByName(ready)
        before = F.col("b1.upto") - F.col("b1.n")
        ranges = found.where(~closed).select("g", F.col("b1.low").alias("lo"), F.col("b1.high").alias("hi"), (F.col("r1") - before).alias("r1"), (F.col("r2") - before).alias("r2"))
        if ranges.limit(1).count() == 0:
            return done
