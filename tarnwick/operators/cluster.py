"""Clustering of points in two dimensions and deterministic renumbering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.semantics import clip_upper, digitize
from tarnwick.operators.agglomerate import agglomerate


def scale_points(df: DataFrame, cap: float = 1.3, divisor: float = 10.0) -> DataFrame:
    """Complete rows with DR capped and DL divided."""
    return df.na.drop(subset=["DR", "DL"]).withColumn("x", clip_upper(F.col("DR"), cap)).withColumn("y", F.col("DL") / divisor)


def normalize_points(df: DataFrame, dr_max: float = 1.0, dl_max: float = 10.0) -> DataFrame:
    """DR and DL as shares of fixed bounds, not clipped: x and y are missing where they are."""
    return df.withColumn("x", F.col("DR") / dr_max).withColumn("y", F.col("DL") / dl_max)


def grid_cells(df: DataFrame, x_cuts: list[float], y_cuts: list[float], x: str = "DR", y: str = "DL") -> DataFrame:
    cell = digitize(F.col(x), x_cuts) * (len(y_cuts) + 1) + digitize(F.col(y), y_cuts)
    return df.withColumn("raw", cell)


def renumber(df: DataFrame, raw: str = "raw", out: str = "cluster", groups: int | None = None, wt: int | None = None, ascending: bool = False) -> DataFrame:
    """Ids by mean DR (then mean DL, then raw id); the last rank gets ``wt``, the others 1.. without it.

    Rows without a raw label stay without an id. ``groups`` raises if another number is found.
    """
    means = df.where(F.col(raw).isNotNull()).groupBy(raw).agg(F.avg("DR").alias("__dr"), F.avg("DL").alias("__dl"))
    if groups is not None and (found := means.count()) != groups:
        raise ValueError(f"{found} groups instead of {groups}")
    order = [F.col("__dr").asc() if ascending else F.col("__dr").desc(), F.col("__dl").asc(), F.col(raw).asc()]
    rank = F.row_number().over(Window.orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    last = F.lit(wt) if wt is not None else n
    number = F.when(F.col("__r") == F.col("__n"), last).otherwise(F.col("__r") + F.when(F.col("__r") >= last, 1).otherwise(0))
    ids = means.withColumn("__r", rank).withColumn("__n", n).select(raw, number.cast("int").alias(out))
    return df.join(F.broadcast(ids) if groups is not None else ids, raw, "left")


def centroids(df: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n"))


def ch_db(df: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from the centroids."""
    c = centroids(df, by, x, y)
    d = df.join(c, by).withColumn("d2", F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))
    per = d.groupBy(by, "cx", "cy", "n").agg(F.sum("d2").alias("ss"), F.avg(F.sqrt("d2")).alias("s"))
    whole = Window.partitionBy()
    mx, my = (F.sum(F.col(a) * F.col("n")).over(whole) / F.sum("n").over(whole) for a in ("cx", "cy"))
    spread = per.withColumn("b", F.col("n") * (F.pow(F.col("cx") - mx, 2) + F.pow(F.col("cy") - my, 2)))
    k, total = F.count(F.lit(1)), F.sum("n")
    ch = spread.agg(F.try_divide(F.sum("b") * (total - k), F.sum("ss") * (k - 1)).alias("calinski_harabasz"))
    o = per.select(F.col(by).alias("o"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("s").alias("os"))
    r = F.try_divide(F.col("s") + F.col("os"), F.sqrt(F.pow(F.col("cx") - F.col("ox"), 2) + F.pow(F.col("cy") - F.col("oy"), 2)))
    worst = per.join(o, F.col(by) != F.col("o")).groupBy(by).agg(F.max(r).alias("r"))
    return ch.join(worst.agg(F.avg("r").alias("davies_bouldin")), how="cross")


def silhouette(df: DataFrame, key: str, by: str, x: str = "x", y: str = "y", block: int = 2048) -> DataFrame:
    """Mean silhouette of Euclidean distances (quadratic in the rows, as its definition is).

    Equal points of a label stand once with their number. Points are packed into blocks of about
    ``block``, coordinates as bytes; a task takes two blocks at a time, each two once, and gives a
    sum per point and label of the other block for both, so distances are never rows of a plan. The
    pairs of blocks are dealt out evenly. Keys are unique; a point alone in its label has 0.
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, by)}
    points = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("l"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("w"))
    n_blocks = max(1, -(-points.count() // block))
    dealt = points.select("k", "l", "x", "y", "w", F.pmod(F.xxhash64("k"), F.lit(n_blocks)).cast("int").alias("b"))

    def pack(t: pa.Table) -> pa.Table:
        lists = {c + "s": pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("k", "l")}
        return pa.table({"b": t.column("b").slice(0, 1)} | lists | {f"{c}s": pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for c in ("x", "y", "w")})

    packed = dealt.groupBy("b").applyInArrow(pack, f"b int, ks array<{kinds[key]}>, ls array<{kinds[by]}>, xs binary, ys binary, ws binary")
    other = packed.toDF("o", "oks", "ols", "oxs", "oys", "ows")
    n_pairs = n_blocks * (n_blocks + 1) // 2
    tasks = min(n_pairs, max(4 * spark.sparkContext.defaultParallelism, n_pairs // 64))
    met = spark.range(n_blocks).select(F.col("id").cast("int").alias("b")).select("b", F.explode(F.sequence(F.col("b"), F.lit(n_blocks - 1))).alias("o")).repartition(tasks)
    pairs = met.join(packed, "b").join(other, "o")

    def per_label(d: np.ndarray, keys: pa.Array, labels: pa.Array, mine: np.ndarray, others: pa.Array, w: np.ndarray) -> pa.RecordBatch:
        codes = others.dictionary_encode()
        at = codes.indices.to_numpy()
        n = np.bincount(at, w).astype(np.int64)
        if len(n) <= 64:
            shares = np.zeros((len(at), len(n)))
            shares[np.arange(len(at)), at] = w
            sums = d @ shares
        else:
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(d[:, order] * w[order], np.r_[0, np.cumsum(np.bincount(at))[:-1]], axis=1)
        rows, cols = pa.array(np.repeat(np.arange(len(keys)), len(n))), pa.array(np.tile(np.arange(len(n)), len(keys)))
        return pa.RecordBatch.from_arrays([keys.take(rows), labels.take(rows), pa.array(np.repeat(mine, len(n))), codes.dictionary.take(cols), pa.array(sums.ravel()), pa.array(np.tile(n, len(keys)))], ["k", "l", "w", "ol", "s", "n"])

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a pair of blocks
                c = {name: batch.column(name)[i] for name in batch.schema.names}
                px, py, qx, qy = (np.frombuffer(c[name].as_py()) for name in ("xs", "ys", "oxs", "oys"))
                pw, qw = (np.frombuffer(c[name].as_py(), dtype=np.int64) for name in ("ws", "ows"))
                dx, dy = px[:, None] - qx[None], py[:, None] - qy[None]
                np.multiply(dx, dx, out=dx)
                np.multiply(dy, dy, out=dy)
                d = np.sqrt(np.add(dx, dy, out=dx), out=dx)
                yield per_label(d, c["ks"].values, c["ls"].values, pw, c["ols"].values, qw)
                if c["b"].as_py() != c["o"].as_py():
                    yield per_label(d.T, c["oks"].values, c["ols"].values, qw, c["ls"].values, pw)

    found = pairs.mapInArrow(sums, f"k {kinds[key]}, l {kinds[by]}, w long, ol {kinds[by]}, s double, n long").groupBy("k", "l", "w", "ol").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("l") == F.col("ol")
    ab = found.groupBy("k", "w").agg(F.min(F.when(own, F.try_divide("s", F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return ab.agg((F.sum(s * F.col("w")) / F.sum(F.when(s.isNotNull(), F.col("w")))).alias("silhouette"))


def kmeans(df: DataFrame, k: int, x: str = "x", y: str = "y", seed: int = 42, tries: int = 10) -> DataFrame:
    """Labels of the best of ``tries`` seeded runs."""
    rows = VectorAssembler(inputCols=[x, y], outputCol="__v").transform(df)
    held = rows.select("__v").persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="raw").fit(held) for i in range(tries)]
    finally:
        held.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost).transform(rows).drop("__v")


def gmm(df: DataFrame, k: int, x: str = "x", y: str = "y", seed: int = 42) -> DataFrame:
    rows = VectorAssembler(inputCols=[x, y], outputCol="__v").transform(df)
    return GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="raw").fit(rows).transform(rows).drop("__v", "probability")


def merge_tree(points: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Labels of agglomerative clustering cut at ``k`` groups: ward (L2) or complete (L1)."""
    n = len(points)
    diff = points[:, None, :] - points[None, :, :]
    d = (diff**2).sum(axis=2) if linkage == "ward" else np.abs(diff).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > max(1, k):
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        if linkage == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        else:
            new = np.maximum(d[i], d[j])
        new[[i, j]] = np.inf
        new[~np.isfinite(d[i]) & ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def hierarchical(df: DataFrame, key: str, k: int, linkage: str = "ward", x: str = "x", y: str = "y") -> DataFrame:
    """(key, raw) of ``k`` clusters of one merge tree over all rows: ward (L2) or complete (L1)."""
    return agglomerate(df, key, k, linkage, x, y)


def auto_merge(df: DataFrame, raw: str, k: int) -> DataFrame:
    """Merge raw clusters to ``k`` groups by a ward tree over their centroids (at most a few dozen)."""
    rows = centroids(df, raw).orderBy(raw).limit(1001).collect()
    if not k <= len(rows) <= 1000:
        raise ValueError(f"{len(rows)} raw clusters can't become {k} groups")
    labels = merge_tree(np.array([[r.cx, r.cy] for r in rows]), k, "ward")
    table = df.sparkSession.createDataFrame([(r[raw], int(g)) for r, g in zip(rows, labels, strict=True)], f"{raw} {df.schema[raw].dataType.simpleString()}, merged int")
    return df.join(F.broadcast(table), raw, "left")


def finalize_auto_merge(df: DataFrame, raw: str, k: int = 9, wt: int = 9, x: str = "x", y: str = "y") -> DataFrame:
    """Raw clusters merged to ``k`` by their centroids in (x, y), then numbered by mean DR with ``wt`` the last: column cluster.

    Rows without a raw label keep none; fewer raw clusters than ``k`` raise. The raw label stays.
    """
    labelled = df.where(F.col(raw).isNotNull())
    merged = auto_merge(labelled.withColumnsRenamed({x: "x", y: "y"}) if (x, y) != ("x", "y") else labelled, raw, k)
    numbers = renumber(merged, "merged", groups=k, wt=wt).select(raw, "cluster").distinct()
    return df.join(numbers, raw, "left")


def k_sweep(df: DataFrame, key: str, ks: range, tries: int = 10) -> DataFrame:
    """inertia, silhouette, Calinski-Harabasz and Davies-Bouldin for every k."""
    parts = []
    for k in ks:
        labels = kmeans(df, k, tries=tries)
        c = centroids(labels, "raw")
        inertia = labels.join(c, "raw").agg(F.sum(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)).alias("inertia"))
        parts.append(inertia.join(silhouette(labels, key, "raw"), how="cross").join(ch_db(labels, "raw"), how="cross").select(F.lit(k).alias("k"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manual_merge(df: DataFrame, groups: dict[int, int], raw: str = "raw", wt: int | None = None) -> DataFrame:
    """Merge raw clusters by a given map and renumber; a raw id without a group, or a group without rows, raises."""
    found = {r[0] for r in df.where(F.col(raw).isNotNull()).select(raw).distinct().limit(len(groups) + 1).collect()}
    if found != set(groups):
        raise ValueError(f"raw clusters {sorted(found)} but groups for {sorted(groups)}")
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return renumber(df.withColumn("merged", F.try_element_at(table, F.col(raw))), "merged", groups=len(set(groups.values())), wt=wt)


def score_labels(df: DataFrame, key: str, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """silhouette, Calinski-Harabasz, Davies-Bouldin and the number of labels as one row."""
    n = df.agg(F.countDistinct(by).alias("n_labels"))
    return silhouette(df, key, by, x, y).join(ch_db(df, by, x, y), how="cross").join(n, how="cross")


def compare_variants(variants: dict[str, DataFrame], key: str, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """The scores of several labellings, one row each."""
    rows = [score_labels(df, key, by, x, y).select(F.lit(name).alias("variant"), "*") for name, df in variants.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
