"""Statistics: correlation, regression, rank ratios, curves, densities and enrichment tests."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def betainc_half(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``betainc(a, 0.5, x)`` of many a and x at once."""
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    swap = x > (a + 1) / (a + 2.5)
    p, q, y = np.where(swap, 0.5, a), np.where(swap, a, 0.5), np.clip(np.where(swap, 1 - x, x), 1e-300, 1.0)
    logs = (lgamma(p + q) - lgamma(p) - lgamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-np.minimum(y, 1 - 1e-16))
    c, d = np.ones(len(y)), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(d == 0, 1e-300, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    found = np.exp(logs) / p * h
    found = np.where(swap, 1 - found, found)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, found))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a Pearson r from n pairs, a batch at a time; missing under three pairs."""
    r, n = r.to_numpy(dtype=float), n.to_numpy(dtype=float)
    ok = ~np.isnan(r) & (n >= 3)
    out = np.full(len(r), np.nan)
    if ok.any():
        out[ok] = betainc_half((n[ok] - 2) / 2, np.maximum(0.0, 1 - r[ok] ** 2))
    out[ok & (n == 3) & (np.abs(r) < 1e-12)] = 1.0
    return pd.Series(out).where(pd.Series(ok), None)


def correlation(x: Column, y: Column) -> Column:
    """Pearson r of complete pairs; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def pairwise_correlation(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """(x, y, r, p, n) of every unordered pair, from one aggregation."""
    pairs = list(combinations(columns, 2))
    parts = []
    for i, (a, b) in enumerate(pairs):
        parts += [correlation(F.col(a), F.col(b)).alias(f"r{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}")]
    each = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    rows = df.agg(*parts).select(F.inline(F.array(*each))).where(F.col("n") >= least)
    return rows.select("x", "y", "r", correlation_p("r", "n").alias("p"), "n")


def usable_columns(df: DataFrame, columns: list[str], least: int = 3) -> list[str]:
    """Columns that exist and have at least ``least`` values."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    return [c for c in there if counts[c] >= least]


def ols(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r, r2, stderr and n of finite pairs."""
    ok = df.where((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    sums = ok.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), correlation(F.col(x), F.col(y)).alias("r"),
                                       F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.count(F.lit(1)).alias("n"))
    r2 = F.col("r") * F.col("r")
    stderr = F.sqrt(F.greatest(F.lit(0.0), (1 - r2) * F.try_divide(F.try_divide(F.col("syy"), F.col("sxx")), F.col("n") - 2)))
    return sums.select(*(by or []), "slope", "intercept", "r", r2.alias("r2"), stderr.alias("stderr"), "n")


def ols_without(df: DataFrame, sample: str, reference: str, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``ols`` of all samples but the reference one; a missing sample name stays in."""
    return ols(df.where(~F.col(sample).eqNullSafe(F.lit(reference))), x, y, by)


def loglog(df: DataFrame, x: str, y: str) -> DataFrame:
    """Fit of log10 y on log10 x over positive finite pairs: r, r2, slope, intercept, rmse, n."""
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0) & (F.col(x) < float("inf")) & (F.col(y) < float("inf"))).select(F.log10(x).alias("a"), F.log10(y).alias("b"))
    s = ok.agg(correlation(F.col("a"), F.col("b")).alias("r"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.regr_syy("b", "a").alias("syy"), F.count(F.lit(1)).alias("n"))
    return s.select("r", (F.col("r") * F.col("r")).alias("r2"), "slope", "intercept", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r") * F.col("r")) * F.try_divide(F.col("syy"), F.col("n")))).alias("rmse"), "n")


def rank_ratio(df: DataFrame, key: list[str], reads: str, ratios: list[float]) -> DataFrame:
    """Dilution by average rank, and reads relative to the shifted maximum, with log2.

    The average rank of ties is cut to a whole number; the least read is shifted to zero.
    """
    w = Window.partitionBy(*key)
    rank = F.rank().over(w.orderBy(reads)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, reads)) - 1) / 2.0
    ratio = F.try_element_at(F.array(*[F.lit(float(r)) for r in ratios]), rank.cast("int"))
    shifted = F.col(reads) - F.min(reads).over(w)
    from tarnwick.functions.semantics import log2_or_inf

    out = df.withColumn("ratio", ratio).withColumn("shifted", shifted)
    relative = F.try_divide(F.col("shifted").cast("double"), F.max("shifted").over(w))
    out = out.withColumn("relative", relative)
    return out.withColumn("log2_ratio", log2_or_inf(F.col("ratio"))).withColumn("log2_relative", log2_or_inf(F.col("relative")))


def gompertz(t: Column, a: Column, rate: Column, lag: Column) -> Column:
    """a * exp(-exp(rate * e / a * (lag - t) + 1)), the exponent within 700; zero for a = 0."""
    x = rate * math.e * F.try_divide(lag - t, a) + 1
    x = F.when(x > 700, 700.0).when(x < -700, -700.0).otherwise(x)
    return F.when(a == 0, F.lit(0.0)).otherwise(a * F.exp(-F.exp(x)))


def inflection_segment(a: Column, rate: Column, lag: Column) -> tuple[Column, Column]:
    """Start and end of the steep part."""
    end = F.coalesce(lag + F.try_divide(a, rate), F.lit(1.0))
    return F.when(lag < 0, F.lit(0.0)).otherwise(lag), F.when(end < 1, F.lit(1.0)).otherwise(end)


def kde_grid(points: DataFrame, x: str, y: str, size: int = 60) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a grid over the points' range: (gx, gy, density).

    Every part of the points sums its own grid of ``size`` squared places, so no more than that
    is shuffled from a part.
    """
    pts = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"), F.count(F.lit(1)).alias("n")).first()
    schema = "i int, j int, gx double, gy double, density double"
    if s["n"] < 3 or s["xx"] * s["yy"] - s["xy"] ** 2 <= 0:
        return points.sparkSession.createDataFrame([], schema)
    h2 = s["n"] ** (-2 / 6)
    xx, yy, xy = s["xx"] * h2, s["yy"] * h2, s["xy"] * h2
    det = xx * yy - xy * xy
    gx, gy = (F.lit(s[a + "0"]) + F.col(k) * ((s[a + "1"] - s[a + "0"]) / (size - 1)) for a, k in (("x", "i"), ("y", "j")))
    xs = s["x0"] + np.arange(size) * ((s["x1"] - s["x0"]) / (size - 1))
    ys = s["y0"] + np.arange(size) * ((s["y1"] - s["y0"]) / (size - 1))

    def summed(batches):
        """One grid per part of the points, whatever their number."""
        total = np.zeros((size, size))
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                dx, dy = (g[None, :] - pdf[a].to_numpy()[lo : lo + 256, None] for g, a in ((xs, "x"), (ys, "y")))
                q = dx[:, :, None] ** 2 * yy - 2 * dx[:, :, None] * dy[:, None, :] * xy + dy[:, None, :] ** 2 * xx
                total += np.exp(-q / det / 2).sum(axis=0)
        i, j = np.divmod(np.arange(size * size), size)
        yield pd.DataFrame({"i": i, "j": j, "part": total.ravel()})

    total = F.sum("part") / (2 * math.pi * math.sqrt(det) * s["n"])
    return pts.select("x", "y").mapInPandas(summed, "i int, j int, part double").groupBy("i", "j").agg(total.alias("density")).select("i", "j", gx.alias("gx"), gy.alias("gy"), "density")


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers, by a table below 32 and Stirling's series from there on."""
    small = np.array([math.lgamma(k + 1) for k in range(32)])
    x = np.maximum(n, 32) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 32, small[np.minimum(n, 31)], series)


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(k: pd.Series, n: pd.Series, big_k: pd.Series, big_n: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of k hits in n drawn, K hits in N.

    The distribution is laid out once per (n, K, N), over the counts that it allows.
    """
    rows = pd.DataFrame({"k": k, "n": n, "K": big_k, "N": big_n}).astype("int64").reset_index(drop=True)
    out = np.empty(len(rows))
    for (b, c, d), part in rows.groupby(["n", "K", "N"], sort=False):
        i = np.arange(max(0, b + c - d), min(b, c) + 1)
        logs = log_factorial(np.array([c, d - c, d, b, d - b]))
        pmf = np.exp(logs[0] + logs[1] - logs[2] + logs[3] + logs[4] - log_factorial(i) - log_factorial(c - i) - log_factorial(b - i) - log_factorial(d - c - b + i))
        ordered = np.sort(pmf)
        below = np.concatenate([[0.0], np.cumsum(ordered)])
        at = pmf[part["k"].to_numpy() - i[0]]
        out[part.index] = np.minimum(1.0, below[np.searchsorted(ordered, at * (1 + 1e-7), side="right")])
    return pd.Series(out)


def benjamini_hochberg(df: DataFrame, run: list[str], p: str, tie: list[str], out: str = "p_fdr", weight: str | None = None) -> DataFrame:
    """Step-up false discovery rate within each run; a row may stand for ``weight`` tests of one p."""
    each = F.col(weight) if weight else F.lit(1)
    rn = F.sum(each).over(Window.partitionBy(*run).orderBy(p, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = F.sum(each).over(Window.partitionBy(*run))
    ranked = df.withColumn("__rn", rn).withColumn("__q", F.col(p) * m / F.col("__rn"))
    least = F.min("__q").over(Window.partitionBy(*run).orderBy(F.desc("__rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(out, F.least(F.lit(1.0), least)).drop("__rn", "__q")


def regression_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """r2, rmse, mae, pearson r and p on the original scale."""
    e = F.col(truth) - F.col(pred)
    s = df.agg((1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), correlation(F.col(truth), F.col(pred)).alias("r"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("p", correlation_p("r", "n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
