"""Coherence of groups of points: distances, geometric medians, permutation tests, attribution."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.nearest import nearest_distances
from tarnwick.operators.pair_sums import prefix_sums
from tarnwick.operators.pairs import pair_stats
from tarnwick.operators.relational import numbered


def size_window(df: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """Rows of groups with ``low`` to ``high`` members."""
    ok = df.groupBy(group).agg(F.count(F.lit(1)).alias("term_size")).where(F.col("term_size").between(low, high))
    return df.join(ok, group)


def pairwise(df: DataFrame, group: str, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Mean, median, max and spread of the distances within each group.

    A group's pairs are its size squared, so groups are meant to be cut by ``size_window`` first;
    larger ones are met block by block.
    """
    return pair_stats(df, group, key, x, y)


def knn_mean(df: DataFrame, group: str, key: str, k: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """Mean distance to the k nearest members (all others, if fewer); 0 for a lone member."""
    near = nearest_distances(df, group, k, x, y)
    total = F.aggregate("near", F.lit(0.0), lambda a, d: a + d)
    found = near.groupBy(group).agg(F.try_divide(F.sum(F.col("times") * total), F.sum(F.col("times") * F.size("near"))).alias("knn"))
    return df.select(group).distinct().join(found, group, "left").na.fill({"knn": 0.0})


def weiszfeld(p: np.ndarray, eps: float = 1e-5, most: int = 1000) -> np.ndarray:
    """Geometric median from the medians of the axes on."""
    at = np.median(p, axis=0)
    for _ in range(most):
        w = 1 / np.maximum(np.sqrt(((p - at) ** 2).sum(axis=1)), eps)
        new = (p * w[:, None]).sum(axis=0) / w.sum()
        if np.sqrt(((new - at) ** 2).sum()) < eps:
            return new
        at = new
    return at


def geometric_median(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Geometric median of each group, with mean, median and maximal distance to it."""
    kind = df.schema[group].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([x, y])[[x, y]].to_numpy(dtype=float)
        c = weiszfeld(p)
        d = np.sqrt(((p - c) ** 2).sum(axis=1))
        return pd.DataFrame({group: [key[0]], "centroid_x": c[0], "centroid_y": c[1], "mean_distance": d.mean(), "median_distance": np.median(d), "max_distance": d.max(), "covered": len(p)})

    return df.select(group, x, y).groupBy(group).applyInPandas(run, f"{group} {kind}, centroid_x double, centroid_y double, mean_distance double, median_distance double, max_distance double, covered long")


def mean_pairwise(p: np.ndarray, block: int = 256) -> float:
    """Mean distance of all pairs; 0 for fewer than two points."""
    return float(prefix_means(p, np.array([len(p)]), block)[0]) if len(p) > 1 else 0.0


def prefix_means(p: np.ndarray, sizes: np.ndarray, block: int = 256) -> np.ndarray:
    """Mean distance of all pairs among the first n rows, for every n in ``sizes``, ascending."""
    return prefix_sums(p, sizes, block) / (sizes * (sizes - 1) / 2)


def random_prefixes(background: DataFrame, key: str, sizes: list[int], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], names: tuple[str, ...], x: str, y: str, times: int, seed: int, most: int) -> DataFrame:
    """(n, draw, *names): ``measure(points, sizes)`` of ``times`` random orders of the background.

    One order serves all sizes: a random set of n rows is its first n. A draw takes as many rows as
    the largest size has, by index, from its own seed, so draws are alike however they are dealt
    to tasks. A background of up to ``most`` rows goes to every task, two doubles a row; of a
    larger one the drawn rows come by a join. Sizes under 2 or above the background have no draws.
    """
    spark = background.sparkSession
    names_schema = ", ".join(["n long", "draw long", *(f"{c} double" for c in names)])
    rows = background.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    total = rows.count()
    fit = np.array(sorted(n for n in sizes if 1 < n <= total), dtype=np.int64)
    if not len(fit):
        return spark.createDataFrame([], names_schema)
    largest = int(fit[-1])

    def picked(draw: int) -> np.ndarray:
        return np.random.default_rng([seed, draw]).choice(total, largest, replace=False)

    def laid(draw: int, points: np.ndarray) -> pa.Table:
        found = measure(points, fit).reshape(len(fit), len(names))
        return pa.table({"n": fit, "draw": np.full(len(fit), draw), **{c: found[:, i] for i, c in enumerate(names)}})

    draws = spark.range(times).withColumnRenamed("id", "draw").repartition(min(times, 4 * spark.sparkContext.defaultParallelism))
    if total <= most:
        cloud = rows.orderBy("key", "x", "y").select("x", "y").toArrow()
        cloud = spark.sparkContext.broadcast(np.c_[cloud.column("x").to_numpy(), cloud.column("y").to_numpy()])

        def from_all(batches):
            for batch in batches:
                for draw in batch.column("draw").to_pylist():
                    yield from laid(draw, cloud.value[picked(draw)]).to_batches()

        return draws.mapInArrow(from_all, names_schema)

    placed = numbered(rows, [F.col("key"), F.col("x"), F.col("y")], "i").select("i", "x", "y")

    def indexes(batches):
        for batch in batches:
            for draw in batch.column("draw").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(largest, draw)), pa.array(np.arange(largest)), pa.array(picked(draw))], ["draw", "place", "i"])

    def from_joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        return laid(t.column("draw")[0].as_py(), np.c_[t.column("x").to_numpy(), t.column("y").to_numpy()])

    return draws.mapInArrow(indexes, "draw long, place long, i long").join(placed, "i").groupBy("draw").applyInArrow(from_joined, names_schema)


def permutation_test(df: DataFrame, background: DataFrame, group: str, key: str, x: str = "x", y: str = "y", times: int = 1000, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """z and p of each group's mean pairwise distance against random sets of its size.

    Every draw is one random order of the background that serves all sizes (``random_prefixes``),
    and its sums of pairs come from a grid (``pair_sums``): its work is less than the square of the
    largest group and its memory that group. z uses the population deviation; a lone member or a flat null gives (0, 1).
    """
    sized = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = [r.n for r in sized.select("n").distinct().collect()]
    drawn = random_prefixes(background, key, sizes, prefix_means, ("value",), x, y, times, seed, most)
    nulls = drawn.groupBy("n").agg(F.sort_array(F.collect_list("value")).alias("draws"))
    observed = pair_stats(df, group, key, x, y, median=False).select(group, F.col("mean").alias("observed"))
    out = sized.join(observed, group, "left").join(nulls, "n", "left")
    mean = F.expr("aggregate(draws, 0D, (a, d) -> a + d) / size(draws)")
    std = F.expr("sqrt(aggregate(draws, 0D, (a, d) -> a + (d - m) * (d - m)) / size(draws))")
    out = out.withColumn("m", F.when(F.size("draws") > 0, mean)).withColumn("s", F.when(F.size("draws") > 0, std))
    flat = F.col("m").isNull() | (F.col("s") < 1e-12) | F.col("observed").isNull()
    share = F.expr("size(filter(draws, d -> d <= observed)) / size(draws)")
    return out.select(group, "n", "observed", F.when(flat, 0.0).otherwise(F.try_divide(F.col("observed") - F.col("m"), F.col("s"))).alias("z"), F.when(flat, 1.0).otherwise(share).alias("p"))


def two_gaussians(p: np.ndarray, seed: int = 42, tries: int = 5, rounds: int = 100) -> np.ndarray:
    """Labels of the best of some runs of a two-component full-covariance mixture."""
    rng, best, found = np.random.default_rng(seed), -np.inf, np.zeros(len(p), dtype=int)
    for _ in range(tries):
        mean = p[rng.choice(len(p), 2, replace=False)]
        cov = np.stack([np.cov(p.T, bias=True) + 1e-6 * np.eye(2)] * 2)
        share = np.array([0.5, 0.5])
        for _ in range(rounds):
            d = p[:, None, :] - mean[None]
            log = np.log(share) - 0.5 * np.einsum("nki,kij,nkj->nk", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov))
            top = log.max(axis=1, keepdims=True)
            r = np.exp(log - top)
            like = float((np.log(r.sum(axis=1)) + top[:, 0]).sum())
            r /= r.sum(axis=1, keepdims=True)
            n = r.sum(axis=0) + 1e-9
            share, mean = n / n.sum(), (r.T @ p) / n[:, None]
            d = p[:, None, :] - mean[None]
            cov = np.einsum("nk,nki,nkj->kij", r, d, d) / n[:, None, None] + 1e-6 * np.eye(2)
        if like > best:
            best, found = like, r.argmax(axis=1)
    return found


def major_minor(df: DataFrame, group: str, key: str, x: str = "x", y: str = "y", least: int = 6, separation: float = 0.5) -> DataFrame:
    """core or outer for the members of groups that fall into two components; else a reason."""
    kind, key_kind = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        p, out = pdf[[x, y]].to_numpy(dtype=float), "too few members"
        part, score = np.array(["all"] * len(p), dtype=object), np.nan
        if len(p) >= least:
            label = two_gaussians(p)
            out = "one component"
            if 0 < label.sum() < len(p):
                d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
                own, other = (np.array([d[i, m[i]].sum() / max(1, m[i].sum() - same) for i in range(len(p))]) for same, m in ((1, label[:, None] == label[None]), (0, label[:, None] != label[None])))
                score = float(np.mean((other - own) / np.maximum(np.maximum(own, other), 1e-12)))
                out = "split" if score >= separation else "not separated"
            if out == "split":
                spread = [p[label == k].std(axis=0).sum() for k in (0, 1)]
                part = np.where(label == int(np.argmin(spread)), "core", "outer").astype(object)
        return pd.DataFrame({group: name[0], key: pdf[key], "part": part, "reason": out, "score": score})

    return df.select(group, key, x, y).groupBy(group).applyInPandas(run, f"{group} {kind}, {key} {key_kind}, part string, reason string, score double")


def attribution(df: DataFrame) -> DataFrame:
    """Why a group is loose, from its ``reason`` of major_minor and its shared_fraction.

    A split comes first, then half or more shared members, then too few members, else the group
    itself; a missing fraction shares nothing.
    """
    from tarnwick.functions.semantics import label

    return df.withColumn("cause", label([(F.col("reason") == "split", "major_minor_split"), (F.col("shared_fraction") >= 0.5, "shared_subunits"), (F.col("reason") == "too few members", "data_limited")], "intrinsic_heterogeneity"))


def permutation_by_kind(df: DataFrame, backgrounds: dict[str, DataFrame], kind: str, group: str, key: str, x: str = "x", y: str = "y", times: int = 1000) -> DataFrame:
    """``permutation_test`` for the groups of each kind against the background of that kind."""
    parts = [permutation_test(df.where(F.col(kind) == name), background, group, key, x, y, times).withColumn(kind, F.lit(name)) for name, background in backgrounds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Measures of dispersion that can be set against random sets. Fixed values.
DISPERSIONS = ("mean_distance_to_centroid", "median_distance_to_centroid", "mean_pairwise_distance", "median_pairwise_distance", "max_pairwise_distance", "mean_knn_distance")


def dispersions(p: np.ndarray, k: int = 3) -> np.ndarray:
    """The six measures of one set of points, of two or more rows, in the order of ``DISPERSIONS``."""
    return prefix_dispersions(p, np.array([len(p)]), k)[0]


def prefix_dispersions(p: np.ndarray, sizes: np.ndarray, k: int = 3) -> np.ndarray:
    """The six measures of the first n rows for every n in ``sizes``, ascending.

    Distances are laid out once; the least ones of each row and the sorted distances of all pairs
    are kept from one size to the next and only what the new rows bring is merged in.
    """
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    out, pairs, before = np.empty((len(sizes), 6)), np.zeros(0), 0
    near = np.full((len(p), k), np.inf)
    for row, n in enumerate(sizes.tolist()):
        fresh = d[before:n, :n]
        new = np.sort(fresh[np.arange(n)[None, :] < np.arange(before, n)[:, None]])
        pairs = np.insert(pairs, np.searchsorted(pairs, new), new)
        # Rows from before meet the new ones, new rows meet all.
        if before:
            near[:before] = np.sort(np.concatenate([near[:before], d[:before, before:n]], axis=1), axis=1)[:, :k]
        own = fresh.copy()
        own[np.arange(n - before), np.arange(before, n)] = np.inf
        least = np.sort(own, axis=1)[:, :k]
        near[before:n, : least.shape[1]] = least
        away = np.sqrt(((p[:n] - weiszfeld(p[:n])) ** 2).sum(axis=1))
        out[row] = away.mean(), np.median(away), pairs.mean(), np.median(pairs), pairs[-1], near[:n, : min(k, n - 1)].mean()
        before = n
    return out


def dispersion_scores(df: DataFrame, background: DataFrame, group: str, key: str, x: str = "x", y: str = "y", times: int = 1000, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """Each of the six measures of each group with z and p against random sets of its size: one row a group.

    One random order of the background serves all measures and all sizes (``random_prefixes``).
    Cut groups by ``size_window`` first, as the measures lay out a group's size squared. z uses the
    population deviation; lone members and flat nulls give z 0 and p 1.
    """
    kind = df.schema[group].dataType.simpleString()
    names = ", ".join(f"{m} double" for m in DISPERSIONS)

    def observed(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([x, y])[[x, y]].to_numpy(dtype=float)
        return pd.DataFrame([(name[0], len(p), *(dispersions(p) if len(p) > 1 else np.zeros(6)))], columns=[group, "n", *DISPERSIONS])

    found = df.select(group, x, y).groupBy(group).applyInPandas(observed, f"{group} {kind}, n long, {names}")
    sizes = [r.n for r in df.groupBy(group).count().select(F.col("count").alias("n")).distinct().collect()]
    draws = random_prefixes(background, key, sizes, prefix_dispersions, DISPERSIONS, x, y, times, seed, most)
    against = draws.groupBy("n").agg(*[F.sort_array(F.collect_list(m)).alias(f"{m}_draws") for m in DISPERSIONS])
    out = found.join(against, "n", "left")
    columns = []

    def score(m: str) -> list[Column]:
        d, observed, mean = F.col(f"{m}_draws"), F.col(m), F.col(f"{m}_mean")
        std = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(d))
        flat = mean.isNull() | F.coalesce(std < 1e-12, F.lit(True))
        share = F.size(F.filter(d, lambda v: v <= observed)) / F.size(d)
        return [F.when(flat, 0.0).otherwise((observed - mean) / std).alias(f"{m}_zscore"), F.when(flat, 1.0).otherwise(share).alias(f"{m}_pvalue")]

    for m in DISPERSIONS:
        d = F.col(f"{m}_draws")
        out = out.withColumn(f"{m}_mean", F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d)))
        columns += score(m)
    return out.select(group, "n", *DISPERSIONS, *columns)


def flip_contrast(members: DataFrame, centroids: DataFrame, by: list[str], outcome: str = "outcome", x: str = "x", y: str = "y", margin: float = 0.05, least: int = 2) -> DataFrame:
    """Whether genes whose call flips lie farther from their group's centroid than the others.

    ``centroids`` has ``by``, centroid_x and centroid_y; a group without one has no distances. With
    under ``least`` distances on a side the difference is missing and the signal says so; a missing
    outcome is no flip.
    """
    away = F.sqrt(F.pow(F.col(x) - F.col("centroid_x"), 2) + F.pow(F.col(y) - F.col("centroid_y"), 2))
    flip = F.coalesce(F.col(outcome).startswith("flip_"), F.lit(False))
    rows = members.join(centroids, by, "left").select(*by, F.when(flip, away).alias("a"), F.when(~flip, away).alias("b"))
    g = rows.groupBy(*by).agg(F.avg("a").alias("flip_mean_distance"), F.avg("b").alias("nonflip_mean_distance"), F.count("a").alias("na"), F.count("b").alias("nb"))
    delta = F.when((F.col("na") >= least) & (F.col("nb") >= least), F.col("flip_mean_distance") - F.col("nonflip_mean_distance"))
    signal = F.when(delta.isNull(), "insufficient_data").when(delta > margin, "flip_peripheral").when(delta < -margin, "flip_central").otherwise("no_difference")
    return g.select(*by, "flip_mean_distance", "nonflip_mean_distance", delta.alias("distance_delta"), signal.alias("enrichment_signal"))
