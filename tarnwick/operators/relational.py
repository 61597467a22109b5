"""Relational operators: keys, joins, deduplication, counts and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import ensure_checkpoints

from tarnwick.functions.strings import any_keyword

LEGACY = {"um": "DR", "lam": "DL"}


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def keep_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def normalize_metrics(df: DataFrame, legacy: dict[str, str] = LEGACY) -> DataFrame:
    """Old metric names become the new ones unless those are there already."""
    return df.withColumnsRenamed({old: new for old, new in legacy.items() if old in df.columns and new not in df.columns})


def dedupe_priority(df: DataFrame, key: list[str], passes: Column, order: list[Column]) -> DataFrame:
    """One row per key: the first that passes, else the first at all."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce(passes, F.lit(False)).desc(), *order))
    return df.withColumn("__n", first).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return dedupe_priority(df, key, F.lit(True), order)


def reindex_left(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The table's rows for exactly these keys; nulls where it has none."""
    return keys.select(*on).join(table, on, "left")


def merge_outer(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of all tables on shared keys."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables)


def override(df: DataFrame, other: DataFrame, on: list[str], column: str, value: str) -> DataFrame:
    """The other table's value wherever it has the key, even if that value is null."""
    marked = other.select(*on, F.col(value).alias("__v"), F.lit(True).alias("__hit"))
    return df.join(marked, on, "left").withColumn(column, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(column))).drop("__v", "__hit")


def zero_fill_when(df: DataFrame, cond: Column, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(cond, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def resolve_ids(df: DataFrame, column: str, meta: DataFrame, out: str = "resolved") -> DataFrame:
    """Current id for what may be an id, a name or a synonym of ``meta`` (id, name, synonyms).

    The first level that knows the value decides: an ambiguous name or synonym gives null, an
    unknown value stays as it is, a missing one stays missing.
    """
    ids = meta.select(F.col("id").alias("k")).distinct().withColumn("is_id", F.lit(True))
    names = meta.where("name is not null").groupBy(F.col("name").alias("k")).agg(F.countDistinct("id").alias("name_n"), F.min("id").alias("name_id"))
    synonyms = meta.select("id", F.explode(F.split("synonyms", ",")).alias("k")).select("id", F.trim("k").alias("k")).where("k <> ''")
    synonyms = synonyms.groupBy("k").agg(F.countDistinct("id").alias("syn_n"), F.min("id").alias("syn_id"))
    out_df = df
    for side in (ids, names, synonyms):
        out_df = out_df.join(side, out_df[column] == side["k"], "left").drop("k")
    value = (
        F.when(F.col("is_id"), F.col(column)).when(F.col("name_n") == 1, F.col("name_id")).when(F.col("name_n") > 1, F.lit(None))
        .when(F.col("syn_n") == 1, F.col("syn_id")).when(F.col("syn_n") > 1, F.lit(None)).otherwise(F.col(column))
    )
    return out_df.withColumn(out, value).drop("is_id", "name_n", "name_id", "syn_n", "syn_id")


def coverage(df: DataFrame, by: list[str], in_gene: Column, covered: Column) -> DataFrame:
    """total, in_gene, rest and covered per group; a row without annotation counts as the rest."""
    hit = F.count_if(F.coalesce(in_gene, F.lit(False)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), hit.alias("in_gene"), (F.count(F.lit(1)) - hit).alias("rest"), F.count_if(F.coalesce(covered, F.lit(False))).alias("covered"))


def long_stats(parts: dict[str, DataFrame]) -> DataFrame:
    """(metric, category, total, covered, not_covered) of frames with category, total, covered."""
    each = [df.select(F.lit(m).alias("metric"), F.col("category").cast("string").alias("category"), "total", "covered", (F.col("total") - F.col("covered")).alias("not_covered")) for m, df in parts.items()]
    return reduce(DataFrame.unionByName, each)


def match_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """match and mismatch over rows where both are known."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(F.count_if(known & (F.col(a) == F.col(b))).alias("match"), F.count_if(known & (F.col(a) != F.col(b))).alias("mismatch"))


def mode_per(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Most frequent value per key, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return keep_first(counts, key, [F.desc("n"), F.asc(value)])


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def top_distinct(df: DataFrame, term: str, score: str, n: int) -> DataFrame:
    """The ``n`` terms of least best score, ties by term."""
    return df.groupBy(term).agg(F.min(score).alias(score)).orderBy(score, term).limit(n)


def ragged_matrix(df: DataFrame, column: str, value: str, columns: list) -> DataFrame:
    """A column per group with its sorted values one below the other."""
    placed = df.withColumn("row", F.row_number().over(Window.partitionBy(column).orderBy(value)))
    return placed.groupBy("row").pivot(column, columns).agg(F.first(value))


def shared_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Members of a group that other groups have as well, and those groups."""
    other = df.select(F.col(group).alias("other"), F.col(member).alias("m")).distinct()
    pairs = df.select(group, member).distinct().join(other, (F.col(member) == F.col("m")) & (F.col(group) != F.col("other")))
    return pairs.groupBy(group).agg(F.countDistinct(member).alias("shared"), F.sort_array(F.collect_set("other")).alias("others"))


def shared_fraction(df: DataFrame, group: str, member: str) -> DataFrame:
    """The share of each group's different members that another group has as well."""
    own = df.select(group, member).distinct()
    groups = own.groupBy(member).agg((F.count(F.lit(1)) > 1).alias("shared"))
    return own.join(groups, member).groupBy(group).agg(F.avg(F.col("shared").cast("double")).alias("shared_fraction"))


def histogram(df: DataFrame, value: Column, low: float, step: float, bins: int) -> DataFrame:
    from tarnwick.functions.semantics import bucket_floor

    return df.select(bucket_floor(value, low, step, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, key: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*key).agg(q.alias("q"), F.avg(value).alias("mean"), F.count(value).alias("n")).select(
        *key, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "mean", "n")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows with their place from 0 in a total order, in ranges of it: no task holds all.

    Rows are dealt to ranges and written; each range numbers its own rows behind the rows of the
    ranges before it, of which there is one count each.
    """
    ensure_checkpoints(df.sparkSession)
    held = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    base = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    base = base.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return held.withColumn("__r", own).join(F.broadcast(base), "__p").withColumn(out, F.col("__r") - 1 + F.col("__b")).drop("__p", "__r", "__b")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` itself, or an error if a key occurs twice."""
    if twice := df.groupBy(*key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"repeated key {tuple(twice[0])[:-1]}")
    return df


def keyword_groups(df: DataFrame, text: str, groups: list[tuple[str, list[str], list[str]]], out: str = "module") -> DataFrame:
    """One row per row and group (name, include, exclude) whose words its text has and has not, whatever the case."""
    low = F.lower(text)
    hits = [F.when(any_keyword(low, [w.lower() for w in yes]) & ~(any_keyword(low, [w.lower() for w in no]) if no else F.lit(False)), F.lit(name)) for name, yes, no in groups]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*hits))))


def bucketed(df: DataFrame, column: str, order: list[str], missing: str = "Not verified") -> DataFrame:
    """Rows in ordered buckets of a label: missing ones first, labels outside the order vanish."""
    name = F.coalesce(F.col(column), F.lit(missing))
    place = F.array_position(F.array(*[F.lit(x) for x in [missing, *order]]), name)
    return df.withColumn("bucket", name).withColumn("bucket_no", place.cast("int")).where("bucket_no > 0")


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, std, cv and n of the replicates in each group."""
    mean, std = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*by).agg(mean.alias("mean"), std.alias("std"), F.try_divide(std, mean).alias("cv"), F.count(F.lit(1)).alias("n"))


def copies(df: DataFrame, by: list[str], out: str = "copies") -> DataFrame:
    """How many rows share all of ``by``; null where one of them is missing."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    return df.withColumn(out, F.when(known, F.count(F.lit(1)).over(Window.partitionBy(*by))))


def crosstab(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Counts of each row label by the levels of another label, 0 where there are none."""
    return df.groupBy(row).pivot(column, levels).count().na.fill(0)


def pivot_mean(df: DataFrame, row: str, column: str, levels: list, value: str) -> DataFrame:
    """Means of each row label by the levels of another label, 0 where there are none."""
    return df.groupBy(row).pivot(column, levels).agg(F.avg(value)).na.fill(0.0)


def group_summary(df: DataFrame, by: list[str], conditions: dict[str, Column], distinct: dict[str, str], listed: dict[str, str]) -> DataFrame:
    """Rows, rows that each condition holds for, different values, and sorted lists of different values, per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()],
        *[F.countDistinct(c).alias(name) for name, c in distinct.items()], *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(name) for name, c in listed.items()])


def lookup_last(df: DataFrame, table: DataFrame, key: list[str], value: str, order: list[Column]) -> DataFrame:
    """The table's value for each row's key, of a repeated key the last in the given order; null where it has none."""
    last = table.groupBy(*key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))
    return df.join(last, key, "left")


def fitness_table(features: DataFrame, clusters: DataFrame, guides: DataFrame, densities: list[str], top: float = 200.0) -> DataFrame:
    """All protein features with the fitness of both screens as um_DIT_HAP and um_gRNA, densities capped.

    Both tables are keyed by ``Systematic ID``; the first has the metric DR (or um), the second um
    (or DR), and a table with neither raises.
    """
    from tarnwick.functions.semantics import clip_upper

    out = features
    for table, names, name in ((clusters, ("DR", "um"), "um_DIT_HAP"), (guides, ("um", "DR"), "um_gRNA")):
        metric = next((c for c in names if c in table.columns), None)
        if metric is None:
            raise KeyError(f"no fitness column among {names}")
        out = out.join(table.select(F.col("Systematic ID").alias("gene_systematic_id"), F.col(metric).alias(name)), "gene_systematic_id", "left")
    return out.withColumns({c: clip_upper(F.col(c), top) for c in densities if c in out.columns})
