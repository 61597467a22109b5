"""Levels of counts that merge: distinct members and quantiles without reading rows again.

A level holds, for each of its finest keys, exact sums and sketches as binary columns: KLL for
quantiles, HyperLogLog for distinct members, theta for distinct members of unions, overlaps and
differences. Coarser levels merge the finer ones, so drilling up, down or across reads sketches
alone, whose size does not depend on the rows below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: quantiles off by at most about 0.4 % of the rows, distinct counts by about 1.6 % (95 of 100).
KLL_K, LG_K = 800, 14


def level(df: DataFrame, by: list[str], values: list[str] = (), members: list[str] = ()) -> DataFrame:
    """One row per key: rows, and per value its number, sum, least, greatest and quantile sketch, per member column two sketches.

    Missing values and members are left out; a key without any has null sketches.
    """
    out = [F.count(F.lit(1)).alias("rows")]
    for v in values:
        c = F.col(v).cast("double")
        out += [F.count(c).alias(f"n_{v}"), F.sum(c).alias(f"sum_{v}"), F.min(c).alias(f"min_{v}"), F.max(c).alias(f"max_{v}"), F.kll_sketch_agg_double(c, F.lit(KLL_K)).alias(f"kll_{v}")]
    for m in members:
        c = F.col(m).cast("string")
        out += [F.hll_sketch_agg(c, F.lit(LG_K)).alias(f"hll_{m}"), F.theta_sketch_agg(c, F.lit(LG_K)).alias(f"theta_{m}")]
    return df.groupBy(*by).agg(*out)


def _columns(levels: DataFrame, prefix: str) -> list[str]:
    return [c.removeprefix(prefix) for c in levels.columns if c.startswith(prefix)]


def rolled_up(levels: DataFrame, by: list[str]) -> DataFrame:
    """The same level with fewer keys, from its rows alone; no keys give one row."""
    out = [F.sum("rows").alias("rows")]
    for v in _columns(levels, "kll_"):
        out += [F.sum(f"n_{v}").alias(f"n_{v}"), F.sum(f"sum_{v}").alias(f"sum_{v}"), F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}"), F.kll_merge_agg_double(f"kll_{v}").alias(f"kll_{v}")]
    for m in _columns(levels, "hll_"):
        out += [F.hll_union_agg(f"hll_{m}").alias(f"hll_{m}"), F.theta_union_agg(f"theta_{m}", F.lit(LG_K)).alias(f"theta_{m}")]
    return levels.groupBy(*by).agg(*out)


def quantile(v: str, share: float) -> Column:
    """An estimate whose rank is near ``share``; the ends are exact."""
    inner = F.kll_sketch_get_quantile_double(f"kll_{v}", F.lit(share))
    return F.when(F.col(f"n_{v}") == 0, None).when(F.lit(share) <= 0, F.col(f"min_{v}")).when(F.lit(share) >= 1, F.col(f"max_{v}")).otherwise(inner)


def figures(levels: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows, means (exact), quantiles and distinct members of every key of a level."""
    out = [F.col("rows")]
    for v in _columns(levels, "kll_"):
        out += [F.try_divide(f"sum_{v}", f"n_{v}").alias(f"mean_{v}"), *[quantile(v, s).alias(f"q{round(100 * s):02d}_{v}") for s in shares]]
    out += [F.hll_sketch_estimate(f"hll_{m}").alias(f"distinct_{m}") for m in _columns(levels, "hll_")]
    return levels.select(*keys, *out)


def overlaps(levels: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b, both, either, only_a): estimated members that two keys of a level share, a < b; pairs that share none stay out.

    A level has a row per key, so this is quadratic in the keys and not in the rows.
    """
    t = levels.select(F.col(key).alias("a"), F.col(f"theta_{member}").alias("x"))
    other = t.withColumnsRenamed({"a": "b", "x": "y"})
    both, either = F.theta_sketch_estimate(F.theta_intersection("x", "y")), F.theta_sketch_estimate(F.theta_union("x", "y", F.lit(LG_K)))
    only = F.theta_sketch_estimate(F.theta_difference("x", "y"))
    return t.join(other, F.col("a") < F.col("b")).select("a", "b", both.alias("both"), either.alias("either"), only.alias("only_a")).where("both > 0")
