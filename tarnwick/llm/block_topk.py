"""Exact top-k by block-at-a-time pruning over integer vectors.

Components are the terms. The rows of a region stand in an order that keeps neighbours together
and are cut into blocks; a block keeps the least and the greatest value of every term, and its
rows as a forward index. A query sums, term by term, the most that a block can add to its score,
meets the blocks from the highest sum downwards, scores the rows of each in its forward index and
ends at the first block whose sum falls below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import materialize
from tarnwick.llm.regions import LEAST, MOST, Regions, expand, first_rows, matrix, neighbours_together, product, tight, usable, whole


class Blocks:
    """Forward indexes of blocks of neighbouring rows, with the range of every term."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], rows: int = 64):
        order, starts = neighbours_together(x, rows)
        x = tight(x[order])
        self.ids = [ids[i] for i in order.tolist()]
        ends = np.r_[starts[1:], len(x)]
        self.lo, self.hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        # A short block repeats its last row; the place -1 marks the repeats.
        place = starts[:, None] + np.arange(int((ends - starts).max()))
        self.place = np.where(place < ends[:, None], place, -1)
        self.x = x

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of the first ``k`` rows per query that reach its ``floor``; each
        query's k-th score or floor; and the number of blocks met."""
        first = np.array([i[0] for i in self.ids], dtype=np.int64)
        parts, met, bounds = [], 0, floor.astype(np.int64).copy()
        for lo in range(0, len(q), step):
            some = q[lo : lo + step]
            kth = bounds[lo : lo + step]
            sums = product(np.maximum(some, 0), self.hi.T) + product(np.minimum(some, 0), self.lo.T)
            order = np.argsort(-sums, axis=1, kind="stable")
            score, row = np.full((len(some), k), LEAST), np.full((len(some), k), -1)
            active = np.arange(len(some))
            for turn in range(sums.shape[1]):
                block = order[active, turn]
                going = sums[active, block] >= kth[active]
                active, block = active[going], block[going]
                if not len(active):
                    break
                met += len(active)
                place = self.place[block]
                got = product(self.x[place], some[active][:, :, None])[:, :, 0]
                counts = (place >= 0) & (got >= kth[active, None])
                better = counts.any(axis=1)
                if better.any():
                    at = active[better]
                    s = np.concatenate([score[at], np.where(counts[better], got[better], LEAST)], axis=1)
                    r = np.concatenate([row[at], np.where(counts[better], place[better], -1)], axis=1)
                    best = first_rows(s, np.where(r < 0, np.iinfo(np.int64).max, first[r]), k)
                    score[at], row[at] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
                    full = row[at, -1] >= 0
                    kth[at[full]] = np.maximum(kth[at[full]], score[at[full], -1])
            own, col = np.nonzero(row >= 0)
            parts.append((own + lo, row[own, col], score[own, col]))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return *found, bounds, met


def exact_top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, region_rows: int = 8192, query_rows: int = 4096, block_rows: int = 64,
                sample_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every row whose id is divisible by ``every``.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id and score, ties to
    the smaller id; fewer rows than ``k`` where there are fewer candidates. Results are exact.

    Rows without an id, with a null vector or with a null or non-finite component take no part;
    an empty table gives an empty one; other columns are not read; vectors of different lengths
    raise. Components beyond the root of 2^63 over the length saturate there. A row repeated as it
    is counts once; rows of one id are candidates only of other ids, and two vectors of one id are
    two candidates and two queries, each with its own ranks. Equal vectors stand in an index once,
    with the ``k + 1`` smallest ids that have them: no other can be among anyone's first ``k``.

    The tree of regions is fitted on at most ``sample_rows`` rows. One task sees one stored index
    of at most about four times ``region_rows`` rows and about ``query_rows`` queries.
    """
    spark, v = table.sparkSession, F.col(vector_col)
    rows = table.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), whole(v, scale).alias("v"), F.lit(0).alias("label"))
    rows = materialize(rows, "whole")
    size = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if size["lo"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size["lo"] != size["hi"]:
        raise ValueError("all vectors must have the same length")
    width = size["lo"]
    regions = Regions(rows, width, lambda x, ids, _: Blocks(x, ids, block_rows), region_rows, sample_rows, k + 1)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = asked.select(regions.region("v").alias("s"), "query_id", F.xxhash64("v").alias("same"), F.lit(LEAST).alias("floor"), "v")
    asked = materialize(asked, "asked")
    found = "query_id long, same long, vec_id long, score long, floor long"

    def meet(index: Blocks, queries: pa.Table) -> pa.Table:
        own, same = queries.column("query_id").to_numpy(), queries.column("same").to_numpy()
        row, who, score, kth, _ = index.search(matrix(queries.column("v"), width), k + 1, queries.column("floor").to_numpy())
        row, name, score = expand(row, who, score, index.ids, own, k)
        return pa.table({"query_id": own[row], "same": same[row], "vec_id": name, "score": score, "floor": kth[row]})

    first = materialize(regions.search(asked, query_rows, meet, found, "query_id"), "first")
    known = first.groupBy("query_id", "same").agg(F.max("floor").alias("floor"))
    further = asked.drop("floor").join(known, ["query_id", "same"], "left").select("s", "query_id", "same", F.coalesce("floor", F.lit(LEAST)).alias("floor"), "v")
    routed = materialize(regions.route(further, F.col("floor"), F.lit(MOST)), "routed")
    both = first.unionByName(regions.search(routed, query_rows, meet, found, "query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.col("score").desc(), "vec_id"))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """The same rows for DuckDB, by comparing each query with all rows."""
    return f"""
with v as (select distinct vec_id, [floor({scale} * x::double) for x in embedding] as q from embeddings
           where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
p as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= {k}"""
