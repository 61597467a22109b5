"""Nearest neighbours by inner product with vantage-point trees per shard.

Inner products become distances by one more coordinate that brings every vector to the length of
the longest; the nearest by distance is then the largest by inner product. A coarse vantage-point
tree, fitted on a bounded sample, deals every row to a shard, so that a shard is a region. Each
shard's own tree is built once and stored. A query searches the shard it falls into; the k-th
distance found there then says, by the triangle inequality at the coarse tree's vantage points,
which other shards can hold anything nearer, and only those are searched. Both tests take the
k-th distance ``relax`` times: factor one is exact, ties included.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import TMP, materialize

#: Relative error that distances by matrix products may have; every bound is widened by it.
MARGIN = 1e-9


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the coordinates."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def ranked(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each row by score, ties to the smaller name; sorted."""
    order = np.lexsort((name, -score, row))
    opens = np.r_[True, np.diff(row[order]) != 0][: len(order)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(opens, at, 0)) < k] if len(order) else order


class Lift:
    """Vectors as points of equal length: distances order points as inner products order vectors.

    Vectors are divided by the largest component ``scale`` first, so that squares stay finite;
    ``longest`` is the greatest squared length after that.
    """

    def __init__(self, scale: float, longest: float):
        self.scale, self.longest = scale or 1.0, longest or 1.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.c_[x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))]

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.c_[q * np.sqrt(self.longest / (q * q).sum(axis=1))[:, None], np.zeros(len(q))]


class VantageTree:
    """A vantage-point tree over points, as arrays: ``order`` holds the rows leaf by leaf.

    A node is (vantage row or -1, radius, first child, from, to); the children of an inner node
    are neighbours in the table, inner side first.
    """

    def __init__(self, points: np.ndarray, leaf: int = 256, depth: int | None = None, seed: int = 3):
        rng, n = np.random.default_rng(seed), len(points)
        self.order = np.arange(n)
        self.nodes: list[list] = [[-1, 0.0, -1, 0, n]]
        todo = [(0, 0)]
        while todo:
            at, level = todo.pop()
            lo, hi = self.nodes[at][3:]
            idx = self.order[lo:hi]
            if hi - lo <= leaf or level == depth:
                continue
            vantage = int(idx[rng.integers(len(idx))])
            d = np.sqrt(((points[idx] - points[vantage]) ** 2).sum(axis=1))
            radius = float(np.median(d))
            inner = d <= radius
            if inner.all():
                continue
            cut = lo + int(inner.sum())
            self.order[lo:hi] = np.r_[idx[inner], idx[~inner]]
            self.nodes[at][:3] = [vantage, radius, len(self.nodes)]
            self.nodes += [[-1, 0.0, -1, lo, cut], [-1, 0.0, -1, cut, hi]]
            todo += [(self.nodes[at][2], level + 1), (self.nodes[at][2] + 1, level + 1)]
        inner_nodes = [n[0] for n in self.nodes if n[0] >= 0]
        self.vantage = points[inner_nodes]
        self.slot = {row: i for i, row in enumerate(inner_nodes)}

    def leaves(self) -> list[int]:
        return [at for at, n in enumerate(self.nodes) if n[0] < 0]

    def _gap(self, at: int, points: np.ndarray) -> np.ndarray:
        """Signed distance from the sphere of a node: not positive inside."""
        row, radius = self.nodes[at][:2]
        return np.sqrt(((points - self.vantage[self.slot[row]]) ** 2).sum(axis=1)) - radius

    def reach(self, points: np.ndarray, bound: np.ndarray) -> dict[int, np.ndarray]:
        """For every leaf, the points that come within their ``bound`` of its region."""
        out, todo = {}, [(0, np.arange(len(points)))]
        while todo:
            at, some = todo.pop()
            if self.nodes[at][0] < 0:
                out[at] = some
            elif len(some):
                gap = self._gap(at, points[some])
                child = self.nodes[at][2]
                todo += [(child, some[gap <= bound[some]]), (child + 1, some[-gap <= bound[some]])]
        return out

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose region holds each point; spheres belong to their inside."""
        out, todo = np.zeros(len(points), dtype=np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, some = todo.pop()
            if self.nodes[at][0] < 0:
                out[some] = at
            elif len(some):
                inside = self._gap(at, points[some]) <= 0
                child = self.nodes[at][2]
                todo += [(child, some[inside]), (child + 1, some[~inside])]
        return out


class Shard:
    """Vectors with their names, least first, and a tree over the lifted points."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, lift: Lift, leaf: int = 256):
        points = lift.rows(vectors)
        self.tree, self.lift = VantageTree(points, leaf), lift
        self.order = self.tree.order
        self.x, self.names, self.points = vectors[self.order], names[self.order], points[self.order]
        del self.tree.order

    def __getstate__(self):
        return self.__dict__ | {"points": None, "order": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.points = self.lift.rows(self.x)

    def search(self, q: np.ndarray, k: int, relax: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of the ``k`` best per query, and each query's k-th distance.

        Best by (score, smaller name) among the vectors met. ``start`` bounds the k-th distance
        from elsewhere. A leaf or a vantage point is met unless relax times the bound excludes it.
        """
        points, tree = self.lift.queries(q), self.tree
        margin = MARGIN * self.lift.longest
        limit = np.full(len(q), np.inf) if start is None else start.copy()
        norms = (self.points**2).sum(axis=1)
        row, who, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        near = np.full((len(q), k), np.inf)

        def meet(active: np.ndarray, lo: int, hi: int) -> None:
            nonlocal row, who, score
            d = np.maximum(self.lift.longest + norms[lo:hi] - 2 * points[active] @ self.points[lo:hi].T, 0)
            # The k least of old and new distances bound what can still count; ties stay in.
            both = np.concatenate([near[active], d], axis=1)
            both = np.partition(both, k - 1, axis=1)[:, :k]
            near[active] = both
            limit[active] = np.minimum(limit[active], np.sqrt(both.max(axis=1)))
            r, c = np.nonzero(d <= limit[active, None] ** 2 + margin)
            if not len(r):
                return
            r, c = active[r], c + lo
            mine = np.zeros(len(q), dtype=bool)
            mine[active] = True
            old = mine[row]
            rows, whos = np.r_[row[old], r], np.r_[who[old], c]
            scores = np.r_[score[old], exact_scores(q[r], self.x[c])]
            kept = ranked(rows, scores, self.names[whos], k)
            row, who, score = np.r_[row[~old], rows[kept]], np.r_[who[~old], whos[kept]], np.r_[score[~old], scores[kept]]

        todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            at, some, gap = todo.pop()
            some = some[gap <= relax * limit[some] + np.sqrt(margin)]
            if not len(some):
                continue
            _, _, child, lo, hi = tree.nodes[at]
            if child < 0:
                meet(some, lo, hi)
                continue
            far = tree._gap(at, points[some])
            inside = far <= 0
            # The side a query lies in is searched first (last on the stack).
            todo += [(child, some[~inside], far[~inside]), (child + 1, some[inside], -far[inside])]
            todo += [(child, some[inside], np.zeros(int(inside.sum()))), (child + 1, some[~inside], np.zeros(int((~inside).sum())))]
        return row, who, score, limit


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a finite, non-zero vector, as doubles."""
    v = F.col(vector_col)
    rows = table.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(table: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 8192, query_rows: int = 4096, relax: float = 0.8,
            sample_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by inner product of every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score, ties to the smaller id; fewer rows than
    ``k`` where there are fewer candidates. Null, zero and non-finite vectors take no part, nor
    do rows without an id; vectors of different lengths raise; an empty table gives an empty one.
    Equal vectors stand in a tree once, with the ``k + 1`` smallest ids that have them: no others
    can be among anyone's nearest. All still ask as queries. Rows are candidates only of other
    ids. A row repeated as it is counts once; two vectors of one id are two candidates, and two
    queries, each with its own ranks.

    The coarse tree is fitted on at most ``sample_rows`` rows, in the order of a hash, with leaves
    for shards of about ``shard_rows`` rows or for eight of the sample; a shard of more than four
    times the rows is dealt over several by a hash. One task sees one stored tree and about
    ``query_rows`` queries, so memory does not grow with the table.
    """
    spark = table.sparkSession
    rows = materialize(_usable(table, id_col, vector_col).withColumn("same", F.xxhash64("v")).withColumn("same2", F.xxhash64(F.lit(1), F.col("v"))), "vectors")
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not top["n"]:
        return spark.createDataFrame([], empty)
    if top["lo"] != top["hi"]:
        raise ValueError("all vectors must have the same length")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(top["scale"])) * (x / F.lit(top["scale"])))
    lift = Lift(top["scale"], rows.agg(F.max(squares)).first()[0])

    salt = F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(64))
    order = Window.partitionBy("same", "same2", TMP + "salt").orderBy("vec_id")
    ids = rows.select("vec_id", "same", "same2", salt.alias(TMP + "salt")).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("same", "same2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    needed = ids.groupBy("same", "same2").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    candidates = rows.join(needed, ["vec_id", "same", "same2"]).dropDuplicates(["vec_id", "same", "same2"])

    sample = rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample_rows).orderBy("vec_id").select("v").toArrow()
    points = lift.rows(_matrix(sample.column("v")))
    shards = -(-top["n"] // shard_rows)
    coarse = VantageTree(points, leaf=8, depth=max(0, (shards - 1).bit_length()))
    del coarse.order

    @F.arrow_udf("int")
    def region(v: pa.Array) -> pa.Array:
        return pa.array(coarse.home(lift.rows(_matrix(v))), pa.int32())

    placed = materialize(candidates.withColumn("s", region("v")), "placed")
    parts = placed.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * shard_rows)).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "s").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        many = group.column("ids").combine_chunks()
        shard = Shard(_matrix(group.column("v")), group.column("vec_id").to_numpy(), lift)
        ids = [many[int(i)].as_py() for i in shard.order]
        row = [group.column("s")[0].as_py(), group.column("part")[0].as_py(), pickle.dumps((shard, ids))]
        return pa.table({c: pa.array([x], t) for c, x, t in zip(("s", "part", "tree"), row, (pa.int32(), pa.int32(), pa.binary()), strict=True)})

    trees = materialize(placed.select("s", "part", "vec_id", "v", "ids").groupBy("s", "part").applyInArrow(build, "s int, part int, tree binary"), "trees")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "same", "same2"]).withColumnRenamed("vec_id", "query_id")

    @F.arrow_udf("int")
    def query_region(v: pa.Array) -> pa.Array:
        return pa.array(coarse.home(lift.queries(_matrix(v))), pa.int32())

    asked = materialize(asked.withColumn("s", query_region("v")).withColumn("bound", F.lit(float("inf"))), "asked")
    found = "query_id long, same long, same2 long, vec_id long, score double, bound double"

    def search(routed: DataFrame) -> DataFrame:
        """Meet every routed query (s, query_id, same, same2, v, bound) with the trees of its shard."""
        loads = routed.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.col("blocks")).cast("int")
        each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        q = routed.join(F.broadcast(loads), "s").join(F.broadcast(parts), "s").select("s", each_part, block.alias("b"), "query_id", "same", "same2", "v", "bound", F.lit(None).cast("binary").alias("tree"))
        t = trees.join(F.broadcast(loads), "s").select("s", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), *[F.lit(None).cast(x.dataType).alias(x.name) for x in q.schema[3:8]], "tree")

        def meet(group: pa.Table) -> pa.Table:
            blob = group.column("tree")
            is_tree = blob.is_valid().to_numpy()
            asks = group.filter(pa.array(~is_tree))
            none = pa.table({f.name: pa.array([], f.type) for f in FOUND})
            if not is_tree.any() or not len(asks):
                return none
            shard, ids = pickle.loads(blob.filter(pa.array(is_tree))[0].as_py())
            v, q_ids = _matrix(asks.column("v")), asks.column("query_id").to_numpy()
            row, who, score, limit = shard.search(v, min(k + 1, len(ids)), relax, asks.column("bound").to_numpy())
            copies = np.array([len(ids[w]) for w in who.tolist()], dtype=np.int64)
            names = np.array([i for w in who.tolist() for i in ids[w]], dtype=np.int64)
            row, score = np.repeat(row, copies), np.repeat(score, copies)
            other = np.flatnonzero(q_ids[row] != names)
            best = other[ranked(row[other], score[other], names[other], k)]
            at = row[best]
            bound = np.where(len(ids) > k, limit[at], np.inf)
            values = (q_ids[at], asks.column("same").to_numpy()[at], asks.column("same2").to_numpy()[at], names[best], score[best], bound)
            return pa.table({f.name: pa.array(x, f.type) for f, x in zip(FOUND, values, strict=True)})

        return q.unionByName(t).groupBy("s", "part", "b").applyInArrow(meet, found)

    key = ["query_id", "same", "same2"]
    first = materialize(search(asked), "first")
    known = first.groupBy(*key).agg(F.min("bound").alias("known"))
    bounded = asked.select(*key, "v", "s").join(known, key, "left").withColumn("bound", F.coalesce("known", F.lit(float("inf"))))

    def route(batches):
        for batch in batches:
            v, home, bound = _matrix(batch.column("v")), batch.column("s").to_numpy(), batch.column("bound").to_numpy()
            slack = relax * bound + np.sqrt(MARGIN * lift.longest)
            for leaf, some in coarse.reach(lift.queries(v), slack).items():
                some = some[home[some] != leaf]
                if len(some):
                    out = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), leaf), pa.int32()), *(out.column(c) for c in (*key, "v", "bound"))], ["s", *key, "v", "bound"])

    routed = bounded.select(*key, "v", "s", "bound").mapInArrow(route, "s int, query_id long, same long, same2 long, v array<double>, bound double")
    routed = materialize(routed, "routed").join(F.broadcast(parts.select("s")), "s", "left_semi")
    both = first.unionByName(search(routed))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


FOUND = pa.schema([("query_id", pa.int64()), ("same", pa.int64()), ("same2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("bound", pa.float64())])
