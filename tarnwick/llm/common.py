"""Helpers that the training-data operators share.

Tables between steps are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``, so that a lost executor never loses a finished step and a later step
never recomputes an earlier one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
SPACE = "[ \\x09-\\x0D]"
#: Bytes that a task buffers of a table before it writes them; texts are large.
ROW_GROUP = 32 << 20
#: A prefix that keeps working columns apart from whatever columns a table brings.
TMP = "__tw_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local masters."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwick-"))
    return sc.getCheckpointDir().rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back.

    All tables of one application lie in a folder of its own, which goes when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tarnwick/{spark.sparkContext.applicationId}"
    fs, at = _hadoop(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/tarnwick/{spark.sparkContext.applicationId}/" in folder:
            fs, at = _hadoop(spark, folder)
            fs.delete(at, True)


def each(values, slice_rows: int = 256):
    """The Python values of an Arrow array, a few at a time, so that a batch of texts is never held twice."""
    for lo in range(0, len(values), slice_rows):
        yield from values.slice(lo, slice_rows).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: a word starts at each non-space that follows a space or the start."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return F.size(F.split(padded, SPACE + "+(?=[^ \\x09-\\x0D])")).cast("long") - 1


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``."""
    return F.crc32(doc_id.cast("string")) % n


def ranked_within(df: DataFrame, key: list[str], order: list[Column], salt_on: list[Column], out: str,
                  per_key: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without ever gathering a key in one task.

    A key's rows are dealt into cells by a hash, as many cells as its share of all rows asks for
    (about four per shuffle partition over all keys). Cell counts give each cell its first number
    and a window within the cell does the rest. The cell table has at most ``4 * partitions``
    rows plus one per key; it is joined by its keys, and Spark may split that join where it is
    skewed. ``df`` is read twice, so pass a written table.
    """
    spark = df.sparkSession
    cells = 4 * shuffle_partitions(spark)
    n, total, salt, first = (TMP + x for x in ("n", "total", "salt", "first"))
    rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    all_rows = max(1, df.count()) if per_key is None else per_key
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * cells / F.lit(float(all_rows)))).cast("long")
    keyed = join_on(df, rows.select(*key, parts.alias(total)), key)
    keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(*salt_on), F.col(total))).drop(total)
    firsts = keyed.groupBy(*key, salt).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*key, salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(*key, salt).orderBy(*order))
    numbered = keyed.withColumn(out, within.cast("long") - 1)
    numbered = join_on(numbered, firsts, [*key, salt])
    return numbered.withColumn(out, F.col(out) + F.col(first)).drop(salt, first)


def join_on(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where null equals null; the right side's keys go away."""
    renamed = right.select(*[F.col(k).alias(f"{TMP}r_{k}") if k in key else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(renamed[f"{TMP}r_{k}"]) for k in key]
    return left.join(renamed, on, how).drop(*[f"{TMP}r_{k}" for k in key])
