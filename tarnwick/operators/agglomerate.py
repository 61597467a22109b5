"""Agglomerative clustering of points in the plane, beyond what one task can hold.

Ward linkage (Euclidean) needs size and centroid of a cluster, complete linkage (L1) its box in
the coordinates x + y and x - y: both fit in a row, and distances come from two rows. Neither
linkage brings a merged cluster nearer to others than its parts were, so two clusters that are
each other's nearest may merge at once, whatever happens elsewhere. In every round the clusters are
dealt to rectangles of neighbours, and a task merges such pairs as long as their distance is
below any that a cluster outside the rectangle can have. Rounds go on with fewer clusters in
larger rectangles; the last few thousand meet in one. All merges are kept with their heights, and
the tree is cut at its highest ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import ensure_checkpoints

STATE = "id long, n double, s1 double, s2 double, s3 double, s4 double, height double"
_ALL = (-np.inf, np.inf, -np.inf, np.inf)


class Rectangles:
    """Halvings of the plane at the medians of a sample; a leaf is (low x, high x, low y, high y)."""

    def __init__(self, centres: np.ndarray, leaf: float):
        self.nodes: list = [None]
        self.leaves = {0: _ALL}
        todo = [(0, centres, _ALL)]
        while todo:
            at, some, box = todo.pop()
            spread = np.ptp(some, axis=0) if len(some) else np.zeros(2)
            axis = int(np.argmax(spread))
            if len(some) <= leaf or not spread[axis]:
                continue
            along = np.sort(some[:, axis])
            cut = along[len(along) // 2]
            if cut == along[0]:
                cut = along[np.searchsorted(along, cut, side="right")]
            low = some[:, axis] < cut
            self.nodes[at] = (axis, cut, len(self.nodes))
            del self.leaves[at]
            for i, part in enumerate((low, ~low)):
                edge = list(box)
                edge[2 * axis + (1 - i)] = cut
                child = len(self.nodes)
                self.nodes.append(None)
                self.leaves[child] = tuple(edge)
                todo.append((child, some[part], tuple(edge)))

    def home(self, centres: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(centres), dtype=np.int64), [(0, np.arange(len(centres)))]
        while todo:
            at, some = todo.pop()
            if self.nodes[at] is None:
                out[some] = at
            elif len(some):
                axis, cut, child = self.nodes[at]
                low = centres[some, axis] < cut
                todo += [(child, some[low]), (child + 1, some[~low])]
        return out


def _centres(s: np.ndarray, linkage: str) -> np.ndarray:
    return s[:, :2] if linkage == "ward" else np.c_[(s[:, 0] + s[:, 1]) / 2, (s[:, 2] + s[:, 3]) / 2]


def merge_certain(ids: np.ndarray, n: np.ndarray, s: np.ndarray, height: np.ndarray, box: tuple, linkage: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Merge, in place, pairs that are each other's nearest and nearer than anything outside ``box``.

    Chains of nearest neighbours find the pairs. Returns which rows are left and the merges
    (id that goes, id that stays, height) in order; the smaller id stays, heights never fall.
    """
    ward, m = linkage == "ward", len(ids)
    alive, stuck, chain, merges, start = np.ones(m, dtype=bool), np.zeros(m, dtype=bool), [], [], 0
    rows = np.arange(m)  # of those alive, compacted now and then

    def away(i: int) -> np.ndarray:
        t = s[rows]
        if ward:
            d = n[rows] * n[i] / (n[rows] + n[i]) * ((t[:, 0] - s[i, 0]) ** 2 + (t[:, 1] - s[i, 1]) ** 2)
        else:
            d = np.maximum(np.maximum(t[:, 1] - s[i, 0], s[i, 1] - t[:, 0]), np.maximum(t[:, 3] - s[i, 2], s[i, 3] - t[:, 2]))
        d[(rows == i) | ~alive[rows]] = np.inf
        return d

    def outside(i: int) -> float:
        if ward:
            edge = min(s[i, 0] - box[0], box[1] - s[i, 0], s[i, 1] - box[2], box[3] - s[i, 1])
            return n[i] / (n[i] + 1) * max(edge, 0.0) ** 2
        u, v = (s[i, 0] + s[i, 1]) / 2, (s[i, 2] + s[i, 3]) / 2
        half_u, half_v = (s[i, 1] - s[i, 0]) / 2, (s[i, 3] - s[i, 2]) / 2
        return min(u - box[0] + half_u, box[1] - u + half_u, v - box[2] + half_v, box[3] - v + half_v)

    while True:
        if not chain:
            while start < m and (stuck[start] or not alive[start]):
                start += 1
            if start == m:
                return alive, merges
            chain.append(start)
        if 2 * alive[rows].sum() < len(rows):
            rows = rows[alive[rows]]
        i = chain[-1]
        d = away(i)
        place = int(np.argmin(d))
        j, least = int(rows[place]), d[place]
        if len(chain) > 1 and d[np.searchsorted(rows, chain[-2])] == least:
            j = chain[-2]
        if not np.isfinite(least) or least > outside(i) or stuck[j]:
            stuck[i] = True
            chain.pop()
        elif len(chain) > 1 and j == chain[-2]:
            keep, gone = (i, j) if ids[i] < ids[j] else (j, i)
            high = max(least, height[i], height[j])
            merges.append((int(ids[gone]), int(ids[keep]), float(high)))
            if ward:
                s[keep, :2] = (n[i] * s[i, :2] + n[j] * s[j, :2]) / (n[i] + n[j])
            else:
                s[keep] = [min(s[i, 0], s[j, 0]), max(s[i, 1], s[j, 1]), min(s[i, 2], s[j, 2]), max(s[i, 3], s[j, 3])]
            n[keep] += n[gone]
            height[keep], alive[gone] = high, False
            chain = chain[:-2]
            start = min(start, keep)
        else:
            chain.append(j)


def merges_of(spots: DataFrame, linkage: str, block: int, last: int, sample: int) -> DataFrame | None:
    """(round, block, seq, gone, stays, height): every merge of the tree over ``spots`` (STATE); None for one spot or none."""
    kept, clusters, turn = [], spots, 0
    out = "block long, merge boolean, seq long, other long, " + STATE
    names = [x.split()[0] for x in out.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in out.split(", ")])
    m = clusters.count()
    while m > 1:
        if m <= last:
            cuts = Rectangles(np.zeros((0, 2)), 1)
        else:
            few = clusters.select("id", "s1", "s2", "s3", "s4").orderBy(F.xxhash64("id", F.lit(turn))).limit(sample).toArrow()
            cuts = Rectangles(_centres(np.c_[tuple(few.column(c).to_numpy() for c in ("s1", "s2", "s3", "s4"))], linkage), max(2.0, block * few.num_rows / m))

        @F.arrow_udf("long")
        def home(s1: pa.Array, s2: pa.Array, s3: pa.Array, s4: pa.Array) -> pa.Array:
            return pa.array(cuts.home(_centres(np.c_[tuple(c.to_numpy() for c in (s1, s2, s3, s4))], linkage)))

        def run(group: pa.Table) -> pa.Table:
            at = int(group.column("block")[0].as_py())
            group = group.sort_by("id")
            ids, n, height = (group.column(c).to_numpy().copy() for c in ("id", "n", "height"))
            s = np.c_[tuple(group.column(c).to_numpy() for c in ("s1", "s2", "s3", "s4"))].copy()
            alive, merges = merge_certain(ids, n, s, height, cuts.leaves[at], linkage)
            left, done = int(alive.sum()), len(merges)
            gone, stays, high = (np.array(x) for x in zip(*merges, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            none = np.zeros(done)
            columns = (np.full(left + done, at), np.arange(left + done) >= left, np.r_[np.zeros(left, np.int64), np.arange(done)], np.r_[ids[alive], gone], np.r_[ids[alive], stays],
                       np.r_[n[alive], none], *(np.r_[s[alive, c], none] for c in range(4)), np.r_[height[alive], high])
            return pa.table(dict(zip(names, columns, strict=True))).cast(schema)

        dealt = clusters.withColumn("block", home("s1", "s2", "s3", "s4")).select("block", *[x.split()[0] for x in STATE.split(", ")])
        found = dealt.groupBy("block").applyInArrow(run, out).checkpoint()
        kept.append(found.where("merge").select(F.lit(turn).alias("round"), "block", "seq", F.col("other").alias("gone"), F.col("id").alias("stays"), "height"))
        clusters = found.where("not merge").select(*[x.split()[0] for x in STATE.split(", ")])
        before, m, turn = m, clusters.count(), turn + 1
        if m > 0.8 * before:  # borders hold too many apart
            block *= 2
            last = max(last, block)
    merges = None
    for part in kept:
        merges = part if merges is None else merges.unionByName(part)
    return merges


def agglomerate(df: DataFrame, key: str, k: int, linkage: str = "ward", x: str = "x", y: str = "y", block: int = 2048, last: int = 8192, sample: int = 50_000) -> DataFrame:
    """(key, raw): the ``k`` clusters of the merge tree by ward (Euclidean) or complete (L1) linkage.

    raw counts from 0 in the order of the clusters' least keys. Rows without a key, x or y take no
    part; equal points start as one cluster, so fewer distinct points than ``k`` give as many
    clusters as there are. Equal distances may be merged in any order. A task holds about ``block``
    clusters, at the end ``last``; rectangles are cut on at most ``sample`` of them.
    """
    if linkage not in ("ward", "complete"):
        raise ValueError(f"unknown linkage {linkage!r}")
    spark = df.sparkSession
    ensure_checkpoints(spark)
    points = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("key is not null and px is not null and py is not null and not isnan(px) and not isnan(py)")
    spots = points.groupBy("px", "py").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    u, v, none = F.col("px") + F.col("py"), F.col("px") - F.col("py"), F.lit(0.0)
    state = (F.col("px"), F.col("py"), none, none) if linkage == "ward" else (u, u, v, v)
    merges = merges_of(spots.select("id", "n", *(c.alias(f"s{i + 1}") for i, c in enumerate(state)), none.alias("height")), linkage, block, last, sample)
    labels = spots.select("px", "py", "id", F.col("id").alias("label"))
    if merges is not None:
        kind, order = "round int, block long, seq long, gone long, root long", ["height", "round", "seq", "block"]
        top = merges.orderBy(*(F.col(c).desc() for c in order)).limit(max(0, k - 1)).select(*order)
        # The k - 1 highest merges are undone; a merge below them never needs one of them.
        least = top.orderBy(*order).limit(1).collect()
        valid = merges
        if least:
            cut = least[0]
            later = F.lit(True)
            for c in reversed(order):
                later = (F.col(c) > cut[c]) | ((F.col(c) == cut[c]) & later)
            valid = merges.where(~later)

        def replay(group: pa.Table) -> pa.Table:
            group = group.sort_by("seq")
            up = dict(zip(group.column("gone").to_pylist(), group.column("stays").to_pylist(), strict=True))
            for gone in reversed(group.column("gone").to_pylist()):  # later merges first, so one step is enough
                up[gone] = up.get(up[gone], up[gone])
            return group.drop_columns(["stays", "height"]).append_column("root", pa.array([up[g] for g in group.column("gone").to_pylist()], pa.int64()))

        roots = valid.groupBy("round", "block").applyInArrow(replay, kind).checkpoint()
        turns = roots.agg(F.max("round")).first()[0]
        for turn in range(0 if turns is None else turns + 1):
            moved = roots.where(F.col("round") == turn).select(F.col("gone").alias("label"), "root")
            labels = labels.join(moved, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    found = points.join(labels.select("px", "py", "label"), ["px", "py"]).select("key", "label").checkpoint()
    least = found.groupBy("label").agg(F.min("key").alias("first"))
    raw = least.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("raw"))
    return found.join(raw, "label").select(F.col("key").alias(key), F.col("raw").cast("int").alias("raw"))
