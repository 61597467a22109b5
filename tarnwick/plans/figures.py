"""Tables behind figures that show single rows or bins: histograms, points with jitter, ordered ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import relational, stats

#: Edges of the histograms (first, step, number of edges) and the filters of their rows. Fixed values.
EDGES = {"DR": (-0.2, 0.05, 34), "DL": (0.0, 0.5, 30)}
ROWS = {"All genes": None, "Essential": "E", "Non-essential": "V"}
JITTER_SEED = 42


def edge_list(first: float, step: float, edges: int) -> list[float]:
    return [first + i * step for i in range(edges)]


def bin_of(value: Column, edges: list[float]) -> Column:
    """The bin between two edges, from 0; the last holds its upper edge; values outside have none."""
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))
    return F.when(value == edges[-1], len(edges) - 2).when((below >= 1) & (below < len(edges)), below - 1)


def dr_dl_histograms(genes: DataFrame, essentiality: str = "DeletionLibrary_essentiality") -> DataFrame:
    """(rows, feature, bin, low, high, n): DR and DL of all genes with a call, of essential and of other ones.

    "All genes" are those with any call, so one that was not determined counts there only. Bins
    without values have n 0.
    """
    spark = genes.sparkSession
    call = F.col(essentiality)
    kinds = F.array(*[F.when(call.isNotNull() if value is None else call == value, F.lit(name)) for name, value in ROWS.items()])
    features = [F.struct(F.lit(f).alias("feature"), bin_of(F.col(f).cast("double"), edge_list(*e)).alias("bin")) for f, e in EDGES.items()]
    rows = genes.select(F.array_compact(kinds).alias("k"), F.explode(F.array(*features)).alias("f")).select(F.explode("k").alias("rows"), "f.*")
    counts = rows.where("bin is not null").groupBy("rows", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = [(r, f, i, low, high) for r in ROWS for f, e in EDGES.items() for i, (low, high) in enumerate(zip(edge_list(*e), edge_list(*e)[1:], strict=False))]
    bins = spark.createDataFrame(frame, "rows string, feature string, bin int, low double, high double")
    return bins.join(counts, ["rows", "feature", "bin"], "left").na.fill({"n": 0})


def jitter(key: list[str], width: float, seed: int = JITTER_SEED) -> Column:
    """An offset in [-width, width) that depends on a row's key only, so a figure can be drawn again."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) * 2 - 1) * width


def category_points(df: DataFrame, key: list[str], category: str, value: str, order: list[str], width: float = 0.15) -> DataFrame:
    """A point for each row with a category and a value: place of the category, size of it, x with jitter.

    Categories of ``order`` come first, in that order, all others behind them by name; none is left out.
    """
    rows = df.where(F.col(category).isNotNull())
    sizes = rows.groupBy(category).agg(F.count(value).alias("n"))
    at = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(category))
    # The categories as one sorted array: their number is that of labels, not of rows.
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct(F.when(at > 0, at).otherwise(len(order) + 1).alias("p"), category, "n"))).alias("c"))
    places = listed.select(F.posexplode("c").alias("place", "c")).select("place", f"c.{category}", "c.n")
    points = rows.where(F.col(value).isNotNull()).join(places, category)
    return points.select(*key, category, "place", "n", (F.col("place") + jitter(key, width)).alias("x"), F.col(value).alias("y"))


def ordered_ids(df: DataFrame, key: str, value: str, keep: Column, ascending: bool = False) -> DataFrame:
    """(place, key): the different keys of the kept rows in the order of their first appearance by ``value``, missing last."""
    best = F.min if ascending else F.max
    rows = df.where(keep).groupBy(key).agg(best(value).alias("__v"))
    order = F.asc_nulls_last("__v") if ascending else F.desc_nulls_last("__v")
    return relational.numbered(rows, [order, F.col(key)], "place").select("place", key)


def trna_summary(nuclear: DataFrame, key: str = "Systematic_ID", copies: str = "copies", value: str = "DR") -> tuple[DataFrame, DataFrame]:
    """Genes by copy number, and a point with jitter for every fitted gene."""
    counts = nuclear.where(F.col(copies).isNotNull()).groupBy(F.col(copies).cast("int").alias("copy_number")).agg(F.count(F.lit(1)).alias("genes"))
    fitted = nuclear.where(F.col(copies).isNotNull() & F.col(value).isNotNull())
    return counts, fitted.select(key, F.col(copies).cast("int").alias("copy_number"), (F.col(copies) + jitter([key], 0.2)).alias("x"), F.col(value).alias("y"))


def replicate_points(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Replicates side by side, whether the log-log fit takes them, and that fit with the ends of its line."""
    both = first.select(*keys, F.col(value).cast("double").alias("r1")).join(second.select(*keys, F.col(value).cast("double").alias("r2")), keys)
    points = both.withColumn("in_fit", F.coalesce((F.col("r1") > 0) & (F.col("r2") > 0), F.lit(False)))
    fit = stats.loglog(both, "r1", "r2")
    ends = points.where("in_fit").agg(F.min("r1").alias("from"), F.max("r1").alias("to"))
    return points, fit.join(ends, how="cross")
