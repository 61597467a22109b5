"""Writers of tables, lists and association files."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.relational import ragged_matrix


#: Key of a column's metadata under which its logical form stands.
LOGICAL = "logical"


def unique_names(names: list[str]) -> list[str]:
    """The second and later equal names get ``__dupN``."""
    seen, out = Counter(), []
    for n in names:
        out.append(f"{n}__dup{seen[n]}" if seen[n] else n)
        seen[n] += 1
    return out


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] | None = None, mode: str = "error", index: list[str] | None = None, series: bool = False, named: bool = True) -> None:
    """Write a table whose logical form comes back with ``readers.read_parquet``.

    Equal names are kept apart, and every column carries in its metadata its own name, its place
    and its role: an ``index`` column or a value. A ``series`` has one value column, whose name is
    only a stand-in unless it is ``named``. Parquet keeps the metadata with the schema, so a lost
    or added file loses nothing; columns of ``partition_by`` lie in folder names and have none.
    """
    index = index or []
    if unknown := [c for c in index if c not in df.columns]:
        raise ValueError(f"no index columns {unknown}")
    if series and len(df.columns) - len(index) != 1:
        raise ValueError(f"a series has one column beside its index, not {len(df.columns) - len(index)}")
    names = unique_names(df.columns)
    fields = []
    for place, (name, logical) in enumerate(zip(names, df.columns, strict=True)):
        role = "index" if name in index else "series" if series else "value"
        fields.append(F.col(name).alias(name, metadata={LOGICAL: {"name": logical, "place": place, "role": role, "named": named}}))
    df.toDF(*names).select(*fields).write.mode(mode).parquet(path, compression=compression, partitionBy=partition_by)


def write_text_table(df: DataFrame, path: str, sep: str = "\t", digits: int | None = None, mode: str = "error") -> None:
    """CSV or TSV; floats with a fixed number of digits if asked for."""
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode(mode).csv(path, sep=sep, header=True)


def write_sheets(df: DataFrame, path: str, sheet: str, mode: str = "error") -> None:
    """One folder per sheet, the names cut to 31 characters; for more rows than a workbook holds (``workbook.write_workbook``)."""
    df.withColumn(sheet, F.substring(sheet, 1, 31)).write.mode(mode).partitionBy(sheet).parquet(path)


def write_lists(df: DataFrame, path: str, group: str, value: str, mode: str = "error") -> None:
    df.select(group, F.col(value).cast("string").alias(value)).write.mode(mode).partitionBy(group).text(path)


def write_matrix(df: DataFrame, path: str, group: str, value: str, groups: list, mode: str = "error") -> None:
    write_text_table(ragged_matrix(df, group, value, groups).orderBy("row").drop("row"), path, mode=mode)


def write_gaf(df: DataFrame, path: str, date: str, mode: str = "error") -> None:
    """An association file: version and date lines, then rows in one part."""
    head = df.sparkSession.createDataFrame([(0, "!gaf-version: 2.2"), (1, f"!date-generated: {date}")], "o int, value string")
    body = df.select(F.lit(2).alias("o"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("o").select("value").write.mode(mode).text(path)


def write_sentinel(spark: SparkSession, path: str, done: str, counts: dict[str, int]) -> None:
    """A small text file that says that a step is done, with one line of name and number each; written over an older one.

    It is written beside its place first and moved there, so a reader sees the whole of it or none.
    """
    text = "\n".join([f"{done} complete", *(f"{k}\t{v}" for k, v in counts.items())]) + "\n"
    jvm = spark._jvm.org.apache.hadoop.fs
    at, part = jvm.Path(path), jvm.Path(f"{path}.part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"can't move {part} to {path}")
