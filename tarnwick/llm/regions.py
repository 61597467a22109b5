"""Integer vectors dealt into regions, with one stored index per part of a region.

A tree of halvings, fitted on a bounded sample, deals every vector to a region of neighbours. A
region's vectors are indexed part by part, each index built once and stored as one row. Queries
meet the region they fall into first; what they find there bounds what other regions must offer,
and a query goes on only to regions whose range of inner products can offer it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import TMP, materialize

#: Sums of products below this are exact in single and in double precision.
SINGLE, DOUBLE = 2.0**24, 2.0**53
#: Below and above every score; either can be negated.
LEAST, MOST = -(2**63 - 1), 2**63 - 1


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double, as integers.

    Components saturate at the square root of 2^63 / length, so that an inner product fits in 64 bits.
    """
    most = F.least(F.floor(F.sqrt(F.lit(2.0**63 - 2.0**11) / F.greatest(F.size(vector), F.lit(1)))), F.lit(2**31 - 1)).cast("double")
    return F.transform(vector, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale))).cast("int"))


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def tight(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product of integer matrices, exact, as 64-bit integers.

    It runs in floating point where every partial sum is exact there, else in integers.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < DOUBLE:
        kind = np.float32 if most < SINGLE else np.float64
        return np.matmul(a.astype(kind), b.astype(kind)).astype(np.int64)
    return np.matmul(a.astype(np.int64), b.astype(np.int64))


def first_rows(score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Along the last axis, places of the first ``k`` by score, highest first, ties to the smaller name."""
    return np.lexsort((name, -score), axis=-1)[..., :k]


def halve(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A direction along which the points spread, its median and the points up to that; None for equal points."""
    mean = x.mean(axis=0)
    some = x if len(x) <= 1024 else x[rng.choice(len(x), 1024, replace=False)]
    off = some - mean
    w = off[np.argmax((off * off).sum(axis=1))]
    for _ in range(4):
        w = off.T @ (off @ w)
        size = np.sqrt(w @ w)
        if not size:
            break
        w = w / size
    along = x @ w
    cut = float(np.median(along))
    if (along <= cut).all():  # many points on the median
        if not (along < cut).any():
            return None
        cut = float(along[along < cut].max())
    return w, cut, along <= cut


class Halvings:
    """A tree that halves a sample again and again; its leaves are regions."""

    def __init__(self, x: np.ndarray, leaf: int, depth: int, seed: int = 5):
        rng, self.nodes = np.random.default_rng(seed), [None]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, some, level = todo.pop()
            cut = halve(x[some], rng) if len(some) > leaf and level < depth else None
            if cut is None:
                continue
            low = cut[2]
            self.nodes[at] = (*cut[:2], len(self.nodes))
            todo += [(len(self.nodes), some[low], level + 1), (len(self.nodes) + 1, some[~low], level + 1)]
            self.nodes += [None, None]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The region of each point."""
        x = x.astype(np.float64)
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, some = todo.pop()
            if self.nodes[at] is None:
                out[some] = at
            elif len(some):
                w, cut, child = self.nodes[at]
                low = x[some] @ w <= cut
                todo += [(child, some[low]), (child + 1, some[~low])]
        return out


def neighbours_together(x: np.ndarray, leaf: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which halves of halves are neighbours, and where its leaves begin."""
    rng, x = np.random.default_rng(seed), x.astype(np.float64)
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        cut = halve(x[order[lo:hi]], rng) if hi - lo > leaf else None
        if cut is None:  # few rows, or copies of one point: blocks of at most ``leaf``
            starts += range(lo, hi, leaf)
            continue
        idx, low = order[lo:hi], cut[2]
        mid = lo + int(low.sum())
        order[lo:hi] = np.r_[idx[low], idx[~low]]
        todo += [(lo, mid), (mid, hi)]
    return order, np.array(sorted(starts), dtype=np.int64)


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """One row for equal rows but for their ids: the smallest id and, as ``ids``, the ``ids`` smallest.

    ``rows`` has vec_id, v and label; it is read twice, so pass a written table. A group of copies
    is cut to its smallest ids in 64 cells first.
    """
    key = ["same", "same2"]
    rows = rows.withColumn("same", F.xxhash64("v", "label")).withColumn("same2", F.xxhash64(F.lit(1), F.col("label"), F.col("v")))
    salt = F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(64))
    order = Window.partitionBy(*key, TMP + "salt").orderBy("vec_id")
    few = rows.select("vec_id", *key, salt.alias(TMP + "salt")).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= ids)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("r") <= ids)
    few = few.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return rows.join(few, ["vec_id", *key]).dropDuplicates(["vec_id", *key]).drop(*key)


class Regions:
    """Stored indexes over distinct vectors, region by region.

    The tree of regions is fitted on at most ``sample_rows`` rows in the order of a hash and has
    at most a leaf for eight of them, so tables of one row a region may be broadcast. A region of
    more than four times ``region_rows`` is dealt over several parts by a hash; ``build(x, ids,
    labels)`` makes the index of one part, and ``lo``/``hi`` bound the components in a region.
    """

    def __init__(self, rows: DataFrame, width: int, build: Callable, region_rows: int, sample_rows: int, keep_ids: int):
        self.width, few = width, distinct_vectors(rows, keep_ids)
        n = rows.count()
        sample = rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample_rows).orderBy("vec_id").select("v").toArrow()
        depth = max(0, (-(-n // region_rows) - 1).bit_length())
        self.tree = tree = Halvings(matrix(sample.column("v"), width).astype(np.float64), 8, depth)

        @F.arrow_udf("int")
        def region(v: pa.Array) -> pa.Array:
            return pa.array(tree.home(matrix(v, width)), pa.int32())

        self.region = region
        placed = materialize(few.withColumn("s", region("v")), "placed")
        self.parts = placed.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * region_rows)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int")

        def index(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            x = matrix(group.column("v"), width)
            made = pickle.dumps(build(x, group.column("ids").to_pylist(), group.column("label").to_numpy()))
            lo, hi = x.min(axis=0).tolist(), x.max(axis=0).tolist()
            return pa.table({"s": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "lo": pa.array([lo], pa.list_(pa.int32())), "hi": pa.array([hi], pa.list_(pa.int32())), "made": pa.array([made], pa.binary())})

        dealt = placed.join(F.broadcast(self.parts), "s").withColumn("part", part).select("s", "part", "v", "ids", "label")
        self.made = materialize(dealt.groupBy("s", "part").applyInArrow(index, "s int, part int, lo array<int>, hi array<int>, made binary"), "indexes")
        ends = self.made.select("s", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("s", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
        ends = ends.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("ends")).select("s", "ends.lo", "ends.hi").toArrow()
        if not width:  # vectors without components
            ends = pa.table({"s": pa.array([0], pa.int32()), "lo": pa.array([[]], pa.list_(pa.int32())), "hi": pa.array([[]], pa.list_(pa.int32()))})
        self.names = ends.column("s").to_numpy()
        self.lo, self.hi = (matrix(ends.column(c), width) for c in ("lo", "hi"))

    def route(self, asked: DataFrame, low: Column, high: Column) -> DataFrame:
        """A row of ``asked`` for every region beyond its own whose inner products can lie in [low, high]."""
        cols = [c for c in asked.columns if c != "s"]
        narrowed = asked.withColumns({TMP + "low": low.cast("long"), TMP + "high": high.cast("long")})
        names, lo, hi, width = self.names, self.lo.T, self.hi.T, self.width
        far = np.maximum(np.abs(lo), np.abs(hi)).astype(np.float64)

        def go(batches):
            for batch in batches:
                q, home = matrix(batch.column("v"), width).astype(np.float64), batch.column("s").to_numpy()
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                most, least = up @ hi + down @ lo, up @ lo + down @ hi
                slack = 1e-9 * (np.abs(q) @ far)
                most, least = most + slack, least - slack
                reached = (most >= batch.column(TMP + "low").to_numpy()[:, None]) & (least <= batch.column(TMP + "high").to_numpy()[:, None]) & (names[None, :] != home[:, None])
                for j in np.flatnonzero(reached.any(axis=0)):
                    out = batch.take(pa.array(np.flatnonzero(reached[:, j])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), names[j]), pa.int32()), *(out.column(c) for c in cols)], ["s", *cols])

        types = dict(asked.dtypes)
        return narrowed.mapInArrow(go, ", ".join(["s int", *(f"`{c}` {types[c]}" for c in cols)]))

    def search(self, asked: DataFrame, query_rows: int, meet: Callable, schema: str, spread: str) -> DataFrame:
        """``meet(index, queries)`` of every index with the queries of its region, in blocks of about ``query_rows``."""
        loads = asked.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64(spread, F.lit("block")), F.col("blocks")).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(F.broadcast(loads), "s").join(F.broadcast(self.parts), "s").select(*asked.columns, each("parts").alias("part"), block.alias("b"))
        made = self.made.join(F.broadcast(loads), "s").select("s", "part", each("blocks").alias("b"), "made")

        def both(queries: pa.Table, index: pa.Table) -> pa.Table:
            if not (queries.num_rows and index.num_rows):
                return no_rows(schema)
            return meet(pickle.loads(index.column("made")[0].as_py()), queries)

        return q.groupBy("s", "part", "b").cogroup(made.groupBy("s", "part", "b")).applyInArrow(both, schema)


def no_rows(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(","))})


def expand(row: np.ndarray, who: np.ndarray, score: np.ndarray, ids: list[list[int]], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the first ``k`` ids per query row, own ids left out, ties to the smaller id."""
    copies = np.array([len(ids[w]) for w in who.tolist()], dtype=np.int64)
    name = np.array([i for w in who.tolist() for i in ids[w]], dtype=np.int64)
    row, score = np.repeat(row, copies), np.repeat(score, copies)
    other = own[row] != name
    row, score, name = row[other], score[other], name[other]
    order = np.lexsort((name, -score, row))
    opens = np.r_[True, np.diff(row[order]) != 0][: len(order)]
    at = np.arange(len(order))
    kept = order[at - np.maximum.accumulate(np.where(opens, at, 0)) < k] if len(order) else order
    return row[kept], name[kept], score[kept]
