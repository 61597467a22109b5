"""Distances to the nearest members of a group in the plane, without rows for pairs.

A group's distinct points are dealt to cells of a grid over its own extent; a cell with too many
gets a grid over its own extent again, until cells are small, however the points crowd. A cell is
searched by itself first. A point whose k-th distance does not reach out of its cell is done; the
others are sent to those cells that their k-th distance reaches, and to no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import ensure_checkpoints


def cells(spots: DataFrame, group: str, most: int = 2048, x: str = "x", y: str = "y") -> DataFrame:
    """``spots`` with a column cell: numbers of grids within grids, of about ``most`` points at most.

    Points must be distinct within a group, else equal ones can't be parted and stay together.
    """
    rows = spots.withColumn("cell", F.lit("")).withColumn("__open", F.lit(True))
    while True:
        extent = rows.where("__open").groupBy(group, "cell").agg(F.count(F.lit(1)).alias("__n"), *(f(c).alias(f"__{name}{c}") for c in (x, y) for name, f in (("lo", F.min), ("hi", F.max))))
        crowded = extent.where((F.col("__n") > most) & ((F.col(f"__lo{x}") < F.col(f"__hi{x}")) | (F.col(f"__lo{y}") < F.col(f"__hi{y}")))).checkpoint()
        if crowded.limit(1).count() == 0:
            return rows.drop("__open")
        side = F.least(F.ceil(F.sqrt(2.0 * F.col("__n") / most)), F.lit(32))

        def step(c: str, side=side):
            share = (F.col(c) - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}"))
            return F.when(F.col(f"__lo{c}") < F.col(f"__hi{c}"), F.least(F.floor(share * side), side - 1)).otherwise(0)

        c = crowded.withColumnsRenamed({group: "__g", "cell": "__c"})
        rows = rows.join(c, (F.col(group) == F.col("__g")) & (F.col("cell") == F.col("__c")) & F.col("__open"), "left")
        finer = F.concat_ws("/", "cell", F.concat_ws(",", step(x), step(y)))
        rows = rows.withColumn("__open", F.col("__c").isNotNull()).withColumn("cell", F.when(F.col("__open"), finer).otherwise(F.col("cell")))
        rows = rows.drop("__g", "__c", "__n", *(f"__{e}{c}" for c in (x, y) for e in ("lo", "hi"))).checkpoint()


def reached(local: DataFrame) -> DataFrame:
    """(g, cell, ocell, olx, ohx, oly, ohy): the other cells whose box comes nearer to a cell's than its points' greatest ``kth``.

    Boxes are met from the coarsest grid down, and only below boxes that are near enough, so a
    cell meets as many as one grid has (at most 1,024) a level and not all of its group.
    """
    c, box = F.col, ("lx", "hx", "ly", "hy")
    boxes = local.groupBy("g", "cell").agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.max("kth").alias("reach")).checkpoint()
    parts = F.split("cell", "/")
    upto = boxes.select("g", *box, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("node"), "cell")
    nodes = upto.groupBy("g", "node").agg(F.min("lx").alias("olx"), F.max("hx").alias("ohx"), F.min("ly").alias("oly"), F.max("hy").alias("ohy"), F.max(c("cell") == c("node")).alias("leaf"))
    nodes = nodes.withColumn("parent", F.when(c("node") != "", F.regexp_replace("node", "/[^/]*$", ""))).checkpoint()
    frontier = boxes.join(nodes.where("node = ''").drop("parent"), "g")
    found = None
    for _ in range(1 + (boxes.agg(F.max(F.size(parts))).first()[0] or 1)):
        wide = lambda lo, hi: F.greatest(F.lit(0.0), c(f"o{lo}") - c(hi), c(lo) - c(f"o{hi}"))
        near = frontier.where(F.hypot(wide("lx", "hx"), wide("ly", "hy")) < c("reach")).checkpoint()
        here = near.where(c("leaf") & (c("node") != c("cell"))).select("g", "cell", c("node").alias("ocell"), "olx", "ohx", "oly", "ohy")
        found = here if found is None else found.unionByName(here)
        inner = near.where(~c("leaf")).select("g", "cell", *box, "reach", c("node").alias("parent"))
        frontier = inner.join(nodes, ["g", "parent"]).drop("parent")
    return found


def k_least(own: np.ndarray, there: np.ndarray, times: np.ndarray, k: int, same: bool, block: int = 512) -> np.ndarray:
    """The ``k`` least distances (inf where there are fewer) of points to others that stand ``times`` times.

    With ``same`` both are the same points, each of which is no neighbour of itself.
    """
    out = np.empty((len(own), k))
    for lo in range(0, len(own), block):
        q = own[lo : lo + block]
        d = np.hypot(q[:, 0, None] - there[None, :, 0], q[:, 1, None] - there[None, :, 1])
        few = min(k, d.shape[1]) if (times >= 1).all() else d.shape[1]
        counts = times[None, :] - (np.arange(lo, lo + len(q))[:, None] == np.arange(len(there))[None, :] if same else 0)
        d = np.where(counts > 0, d, np.inf)
        near = np.argpartition(d, min(few, d.shape[1]) - 1, axis=1)[:, :few] if few < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(q), 1))
        nd, nc = np.take_along_axis(d, near, 1), np.minimum(np.take_along_axis(np.broadcast_to(counts, d.shape), near, 1), k)
        order = np.argsort(nd, axis=1, kind="stable")
        nd, nc = np.take_along_axis(nd, order, 1), np.maximum(np.take_along_axis(nc, order, 1), 0)
        upto = np.cumsum(nc, axis=1)
        for j in range(k):  # the j-th neighbour is the first point up to which there are more than j
            at = (upto <= j).sum(axis=1)
            full = np.minimum(at, nd.shape[1] - 1)
            out[lo : lo + len(q), j] = np.where(at < nd.shape[1], np.take_along_axis(nd, full[:, None], 1)[:, 0], np.inf)
    return out


def nearest_distances(df: DataFrame, group: str, k: int = 3, x: str = "x", y: str = "y", most: int = 2048, asks: int = 8192) -> DataFrame:
    """(group, x, y, times, near): the distinct points of each group with the ``k`` least distances to other members.

    ``near`` is shorter where a group has fewer others; a point that stands ``times`` times is its
    own neighbour times - 1 times. Rows without a group, x or y take no part. One task sees one
    cell of about ``most`` points and ``asks`` points of other cells that reach it.
    """
    ensure_checkpoints(df.sparkSession)
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("g is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = rows.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("times"))
    dealt = cells(spots, "g", most).select("g", "cell", "x", "y", "times").checkpoint()

    def within(t: pa.Table) -> pa.Table:
        p = np.c_[t.column("x").to_numpy(), t.column("y").to_numpy()]
        found = k_least(p, p, t.column("times").to_numpy(), k, True)
        return t.append_column("near", pa.array(found.tolist(), pa.list_(pa.float64())))

    local = dealt.groupBy("g", "cell").applyInArrow(within, f"g {kind}, cell string, x double, y double, times long, near array<double>").withColumn("kth", F.element_at("near", -1)).checkpoint()
    gap = lambda lo, hi, olo, ohi: F.greatest(F.lit(0.0), olo - hi, lo - ohi)
    c = F.col
    links = reached(local)
    away = F.hypot(gap(c("x"), c("x"), c("olx"), c("ohx")), gap(c("y"), c("y"), c("oly"), c("ohy")))
    sent = local.select("g", "cell", "x", "y", "kth").join(links, ["g", "cell"]).where(away < c("kth")).select("g", F.col("ocell").alias("cell"), "x", "y").checkpoint()
    loads = sent.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(asks)).cast("int").alias("blocks"))
    asked = sent.join(loads, ["g", "cell"]).withColumn("b", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int")).select("g", "cell", "b", "x", "y")
    held = dealt.join(loads, ["g", "cell"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "cell", "b", "x", "y", "times")

    def beyond(q: pa.Table, there: pa.Table) -> pa.Table:
        points = lambda t: np.c_[t.column("x").to_numpy(), t.column("y").to_numpy()]
        found = k_least(points(q), points(there), there.column("times").to_numpy(), k, False)
        return pa.table({"g": q.column("g"), "x": q.column("x"), "y": q.column("y"), "near": pa.array(found.tolist(), pa.list_(pa.float64()))})

    more = asked.groupBy("g", "cell", "b").cogroup(held.groupBy("g", "cell", "b")).applyInArrow(beyond, f"g {kind}, x double, y double, near array<double>")
    both = local.select("g", "x", "y", "times", "near").unionByName(more.withColumn("times", F.lit(None).cast("long")))
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    out = both.groupBy("g", "x", "y").agg(F.max("times").alias("times"), near.alias("near"))
    return out.select(F.col("g").alias(group), "x", "y", "times", F.filter("near", lambda d: d < float("inf")).alias("near"))
