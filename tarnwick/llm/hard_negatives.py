"""Hard negatives by a dual-tree search over anchors and candidates.

A node of a tree holds the box, the ball and the range of labels of its rows. For a pair of nodes
these give an interval that holds the inner products of all their pairs, so one test drops a
whole group of anchors against a whole group of candidates; what is left in pairs of leaves is
scored exactly. Both searches of the miner run this way: an anchor's positives (the highest
scores within its label), then the negatives of each positive (the highest scores of other labels
within the positive's window).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import materialize
from tarnwick.llm.regions import LEAST, MOST, Regions, expand, first_rows, halve, matrix, product, tight, usable, whole


class Tree:
    """Rows in the order of a tree's leaves; per node its rows, box, ball and range of labels.

    A node in which one label holds more than a leaf is split between labels, any other in halves
    along the direction in which its rows spread.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int, seed: int = 11):
        rng, wide = np.random.default_rng(seed), x.astype(np.float64)
        order, self.nodes = np.arange(len(x)), [[0, len(x), -1]]
        todo = [0]
        while todo:
            at = todo.pop()
            lo, hi, _ = self.nodes[at]
            idx = order[lo:hi]
            if hi - lo <= leaf:
                continue
            names, counts = np.unique(labels[idx], return_counts=True)
            if len(names) > 1 and counts.max() > leaf:
                before = np.cumsum(counts)[:-1]
                low = labels[idx] <= names[np.argmin(np.abs(before - (hi - lo) / 2))]
            else:
                cut = halve(wide[idx], rng)
                low = np.arange(hi - lo) < (hi - lo) // 2 if cut is None else cut[2]
            mid = lo + int(low.sum())
            order[lo:hi] = np.r_[idx[low], idx[~low]]
            self.nodes[at][2] = len(self.nodes)
            todo += [len(self.nodes), len(self.nodes) + 1]
            self.nodes += [[lo, mid, -1], [mid, hi, -1]]
        self.order, self.x, self.labels = order, tight(x[order]), labels[order]
        wide = wide[order]
        n, d = len(self.nodes), x.shape[1]
        self.lo, self.hi, self.centre, self.radius = np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d)), np.zeros(n)
        self.first, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, (lo, hi, _) in enumerate(self.nodes):
            rows = wide[lo:hi]
            self.lo[at], self.hi[at] = rows.min(axis=0), rows.max(axis=0)
            self.centre[at] = rows.mean(axis=0)
            self.radius[at] = np.sqrt(((rows - self.centre[at]) ** 2).sum(axis=1).max())
            self.first[at], self.last[at] = self.labels[lo:hi].min(), self.labels[lo:hi].max()
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def intervals(self, at: int, other: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of the rows of a node with those of other nodes, widened by rounding."""
        a, b = self.lo[at], self.hi[at]
        corners = np.stack([a * other.lo[nodes], a * other.hi[nodes], b * other.lo[nodes], b * other.hi[nodes]])
        middle = other.centre[nodes] @ self.centre[at]
        reach = self.radius[at] * other.norm[nodes] + other.radius[nodes] * (self.norm[at] + self.radius[at])
        slack = 1e-9 * np.abs(corners).max(axis=0).sum(axis=1)
        low = np.maximum(corners.min(axis=0).sum(axis=1), middle - reach) - slack
        return low, np.minimum(corners.max(axis=0).sum(axis=1), middle + reach) + slack


class Candidates(Tree):
    """The stored tree of one part of a region."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], labels: np.ndarray, leaf: int = 128):
        super().__init__(x, labels, leaf)
        self.ids = [ids[i] for i in self.order.tolist()]
        self.name = np.array([i[0] for i in self.ids], dtype=np.int64)

    def search(self, anchors: Tree, k: int, low: np.ndarray, high: np.ndarray, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The first ``k`` rows of each window of each anchor, among rows of its label or of others.

        ``low`` and ``high`` are windows (anchor, window) in the order of ``anchors``; a window
        with low above high is none. Returns row numbers and scores (anchor, window, k), row -1
        where there is none, each window's k-th score or low end, and the pairs of leaves scored.
        """
        floor = low.astype(np.int64).copy()
        row, score = np.full((*low.shape, k), -1), np.full((*low.shape, k), LEAST)
        none, pairs = np.iinfo(np.int64).max, 0
        open_low = np.where(low <= high, floor, MOST)  # what a window still asks for
        top = np.where(low <= high, high, LEAST)

        def apart(a: int, c: int) -> bool:
            if same_label:
                return anchors.first[a] > self.last[c] or anchors.last[a] < self.first[c]
            return anchors.first[a] == anchors.last[a] == self.first[c] == self.last[c]

        start = anchors.intervals(0, self, [0])
        todo = [(0, 0, start[0][0], start[1][0])]
        while todo:
            a, c, least, most = todo.pop()
            alo, ahi, achild = anchors.nodes[a]
            if apart(a, c) or most < open_low[alo:ahi].min() or least > top[alo:ahi].max():
                continue
            clo, chi, cchild = self.nodes[c]
            if achild < 0 and cchild < 0:
                pairs += 1
                self._score(anchors, slice(alo, ahi), slice(clo, chi), same_label, k, top, row, score, floor, open_low, none)
            elif cchild < 0 or (achild >= 0 and ahi - alo > chi - clo):
                lows, highs = self.intervals(c, anchors, [achild, achild + 1])
                todo += [(achild + i, c, lows[i], highs[i]) for i in (0, 1)]
            else:
                lows, highs = anchors.intervals(a, self, [cchild, cchild + 1])
                todo += [(a, cchild + int(i), lows[i], highs[i]) for i in np.argsort(highs)]
        return row, score, floor, pairs

    def _score(self, anchors, some, rows, same_label, k, top, row, score, floor, open_low, none) -> None:
        got = product(anchors.x[some], self.x[rows].T)
        fits = anchors.labels[some, None] == self.labels[None, rows]
        if not same_label:
            fits = ~fits
        for w in range(top.shape[1]):
            counts = fits & (got >= open_low[some, w, None]) & (got <= top[some, w, None])
            better = np.flatnonzero(counts.any(axis=1))
            if not len(better):
                continue
            at = better + some.start
            s = np.concatenate([score[at, w], np.where(counts[better], got[better], LEAST)], axis=1)
            r = np.concatenate([row[at, w], np.where(counts[better], np.arange(rows.start, rows.stop), -1)], axis=1)
            best = first_rows(s, np.where(r < 0, none, self.name[r]), k)
            score[at, w], row[at, w] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
            full = at[row[at, w, -1] >= 0]
            floor[full, w] = np.maximum(floor[full, w], score[full, w, -1])
            open_low[full, w] = floor[full, w]


def _anchor_tree(queries: pa.Table, width: int, leaf: int) -> tuple[Tree, pa.Table]:
    tree = Tree(matrix(queries.column("v"), width), queries.column("label").to_numpy(), leaf)
    return tree, queries.take(pa.array(tree.order))


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, scale: int = 256,
                   relabel: tuple[int, int] | None = (7, 10), region_rows: int = 8192, query_rows: int = 4096, leaf: int = 32, sample_rows: int = 20_000,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Negatives that score nearly as high as a positive, for every row whose id is divisible by ``every``.

    A row's score is its inner product with the anchor over components floor(scale * x); the
    higher comes first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of its label. For each of them the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score are returned, with their rank.
    ``relabel`` (m, n) turns the label of rows whose id m divides into (label + 1) % n first.

    Rows without an id or a label, with a null vector or with a null or non-finite component take
    no part; an empty table gives an empty one; other columns are not read; vectors of different
    lengths raise. Components beyond the root of 2^63 over the length saturate there. A row
    repeated as it is counts once; rows of one id are nothing to each other, and two rows of one
    id that differ are two candidates and two anchors. Equal rows stand in a tree once, with the
    smallest ids that have them: no others can be among the first. A positive score of zero asks
    for scores of zero, a negative one for none.

    The tree of regions is fitted on at most ``sample_rows`` rows. One task sees one stored tree
    of at most about four times ``region_rows`` rows and about ``query_rows`` anchors.
    """
    spark, v, label = table.sparkSession, F.col(vector_col), F.col(label_col).cast("long")
    if relabel:
        label = F.when(F.col(id_col) % relabel[0] == 0, (label + 1) % relabel[1]).otherwise(label)
    rows = table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(v))
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("vec_id"), whole(v, scale).alias("v"), label.alias("label")), "whole")
    size = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if size["lo"] is None:
        return spark.createDataFrame([], out)
    if size["lo"] != size["hi"]:
        raise ValueError("all vectors must have the same length")
    width = size["lo"]
    regions = Regions(rows, width, Candidates, region_rows, sample_rows, max(positives, negatives) + 1)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct()
    key = ["anchor_id", "label", "same"]
    asked = materialize(asked.select(regions.region("v").alias("s"), *key[:2], F.xxhash64("v").alias("same"), "v"), "anchors")

    near = "anchor_id long, label long, same long, vec_id long, score long, floor long"

    def meet_same(index: Candidates, queries: pa.Table) -> pa.Table:
        tree, queries = _anchor_tree(queries, width, leaf)
        own, floors = queries.column("anchor_id").to_numpy(), queries.column("floor").to_numpy()
        row, score, floor, _ = index.search(tree, positives + 1, floors[:, None], np.full((len(own), 1), MOST), True)
        a, w, j = np.nonzero(row >= 0)
        a, name, score = expand(a, row[a, w, j], score[a, w, j], index.ids, own, positives)
        return pa.table({**{c: queries.column(c).to_numpy()[a] for c in key}, "vec_id": name, "score": score, "floor": floor[a, 0]})

    ask = asked.withColumn("floor", F.lit(LEAST))
    first = materialize(regions.search(ask, query_rows, meet_same, near, "anchor_id"), "first")
    known = first.groupBy(*key).agg(F.max("floor").alias("floor"))
    further = asked.join(known, key, "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))).select("s", *key, "v", "floor")
    routed = materialize(regions.route(further, F.col("floor"), F.lit(MOST)), "routed")
    both = first.unionByName(regions.search(routed, query_rows, meet_same, near, "anchor_id"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id"))
    best = both.withColumn("r", rank).where(F.col("r") <= positives)
    windows = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", F.col("vec_id").alias("id"), "score"))).alias("p"))
    # Windows in whole numbers: low * p <= 100 * score <= high * p, rounded inwards.
    share = lambda p, part: F.floor(p.cast("decimal(20,0)") * part / F.lit(100).cast("decimal(20,0)")).cast("long")
    lows = F.transform(F.col("p.score"), lambda p: -share(-p, low))
    highs = F.transform(F.col("p.score"), lambda p: share(p, high))
    mined = asked.join(windows, key).select("s", *key, "v", F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores"), lows.alias("lows"), highs.alias("highs"))
    mined = materialize(mined, "mined")

    far = "anchor_id long, label long, same long, w int, positive_id long, positive_score long, negative_id long, negative_score long, floor long"

    def meet_other(index: Candidates, queries: pa.Table) -> pa.Table:
        tree, queries = _anchor_tree(queries, width, leaf)
        own = queries.column("anchor_id").to_numpy()
        there = queries.column("lows").combine_chunks().value_lengths().to_numpy()
        grid = np.arange(positives)[None, :] < there[:, None]

        def laid(column: str, none: int) -> np.ndarray:
            out = np.full(grid.shape, none, dtype=np.int64)
            out[grid] = queries.column(column).combine_chunks().flatten().to_numpy()
            return out

        lows, highs = laid("lows", MOST), laid("highs", LEAST)
        ids, scores = laid("positive_ids", 0), laid("positive_scores", 0)
        row, score, floor, _ = index.search(tree, negatives + 1, lows, highs, False)
        a, w, j = np.nonzero(row >= 0)
        pair, name, score = expand(a * positives + w, row[a, w, j], score[a, w, j], index.ids, np.repeat(own, positives), negatives)
        a, w = pair // positives, pair % positives
        return pa.table({**{c: queries.column(c).to_numpy()[a] for c in key}, "w": (w + 1).astype(np.int32), "positive_id": ids[a, w], "positive_score": scores[a, w],
                         "negative_id": name, "negative_score": score, "floor": floor[a, w]})

    first = materialize(regions.search(mined, query_rows, meet_other, far, "anchor_id"), "first_negatives")
    # What a window still asks for: its k-th score so far, its low end where there are fewer.
    floors = first.groupBy(*key, "w").agg(F.max("floor").alias("floor")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))
    narrowed = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i + 1), x)))
    further = mined.join(floors, key, "left").select("s", *key, "v", "positive_ids", "positive_scores", narrowed.alias("lows"), "highs")
    asks = F.filter(F.arrays_zip("lows", "highs"), lambda x: x["lows"] <= x["highs"])
    least, most = F.array_min(F.transform(asks, lambda x: x["lows"])), F.array_max(F.transform(asks, lambda x: x["highs"]))
    routed = materialize(regions.route(further, F.coalesce(least, F.lit(MOST)), F.coalesce(most, F.lit(LEAST))), "routed_negatives")
    both = first.unionByName(regions.search(routed, query_rows, meet_other, far, "anchor_id"))
    rank = F.row_number().over(Window.partitionBy(*key, "w").orderBy(F.col("negative_score").desc(), "negative_id"))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives_sql(positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, scale: int = 256) -> str:
    """The same rows for DuckDB, by comparing each anchor with all rows."""
    return f"""
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor({scale} * x::double) for x in embedding] as q from embeddings
           where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
p as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
g as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from p where same),
n as (select g.anchor_id, g.vec_id as positive_id, g.score as positive_score, p.vec_id as negative_id, p.score as negative_score,
             cast(row_number() over (partition by g.anchor_id, g.vec_id order by p.score desc, p.vec_id) as integer) as rank
      from g join p on p.anchor_id = g.anchor_id and not p.same and {low} * g.score <= 100 * p.score and 100 * p.score <= {high} * g.score where g.r <= {positives})
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {negatives}"""
