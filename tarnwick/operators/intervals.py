"""Positions among intervals of a line: what lies to the left, to the right and around.

Events of both are put in one order per chromosome, in cells of ``width`` positions: a window
within a cell carries the last end, the next start and the longest open interval; what a cell needs
from the cells before or behind it comes from one row a cell. So a chromosome is never one task,
and neither positions nor intervals are joined with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import ensure_checkpoints


def flanked(points: DataFrame, intervals: DataFrame, carried: list[str], chrom: str = "Chr", at: str = "Coordinate", start: str = "Start", end: str = "End", width: int = 100_000) -> DataFrame:
    """``points`` with left_*, right_* and inner_* of the interval that ends last before, starts first behind, and reaches farthest around each.

    * are start, end and the ``carried`` columns. A position on an end is inside. Of equal ends
    (or starts, or farthest ends of what holds the position) the least start (end, start), then
    the least of the carried columns counts. A side without an interval is null. Intervals with a
    missing or turned end take no part; points without a place keep nulls.
    """
    ensure_checkpoints(points.sparkSession)
    keep = [start, end, *carried]
    # The least of ties first: starts and carried columns count downwards where the greatest is taken.
    iv = intervals.where(F.col(start) <= F.col(end)).select(F.col(chrom).alias("c"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.struct(*[F.col(x) for x in keep]).alias("iv"))
    rank = F.row_number().over(Window.partitionBy("c", "s", "e").orderBy(*[F.col(f"iv.{x}") for x in carried]))
    iv = iv.withColumn("r", rank).where("r = 1").drop("r")
    kind = iv.schema["iv"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    tag = F.lit(None).cast("long")
    ends = iv.select("c", F.col("e").alias("p"), F.lit(2).alias("o"), F.struct("e", (-F.col("s")).alias("t"), "iv").alias("left"), F.lit(None).cast(f"struct<s:bigint,t:bigint,iv:{kind}>").alias("right"), F.lit(None).cast(f"struct<e:bigint,t:bigint,iv:{kind}>").alias("inner"), tag.alias("eid"))
    starts = iv.select("c", F.col("s").alias("p"), F.lit(0).alias("o"), F.lit(None).cast(f"struct<e:bigint,t:bigint,iv:{kind}>").alias("left"), F.struct("s", F.col("e").alias("t"), "iv").alias("right"), F.struct("e", (-F.col("s")).alias("t"), "iv").alias("inner"), tag.alias("eid"))
    numbered = points.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    asked = numbered.where(F.col(chrom).isNotNull() & F.col(at).isNotNull()).select(F.col(chrom).alias("c"), F.col(at).cast("long").alias("p"), F.lit(1).alias("o"), *[F.lit(None).cast(ends.schema[x].dataType).alias(x) for x in ("left", "right", "inner")], F.col("__id").alias("eid"))
    events = ends.unionByName(starts).unionByName(asked).withColumn("cell", F.floor(F.col("p") / width))

    cells = events.groupBy("c", "cell").agg(F.max("left").alias("l"), F.min("right").alias("r"), F.max("inner").alias("i"))
    before = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("c").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("c", "cell", F.max("l").over(before).alias("l"), F.min("r").over(behind).alias("r"), F.max("i").over(before).alias("i"))

    # Ends at p come behind the points at p and starts before them: both hold p.
    back = Window.partitionBy("c", "cell").orderBy("p", "o", "eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What follows is met from behind: a frame that starts anew at each row would cost the square.
    ahead = Window.partitionBy("c", "cell").orderBy(F.desc("p"), F.desc("o"), F.desc("eid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.select("*", F.max("left").over(back).alias("wl"), F.min("right").over(ahead).alias("wr"), F.max("inner").over(back).alias("wi")).where("eid is not null").select("c", "cell", "p", "eid", "wl", "wr", "wi")
    found = found.join(cells, ["c", "cell"])
    left, right, inner = F.greatest("wl", "l"), F.least("wr", "r"), F.greatest("wi", "i")
    got = found.select("eid", left.alias("left"), right.alias("right"), F.when(inner["e"] >= F.col("p"), inner).alias("inner"))
    out = numbered.join(got, F.col("__id") == F.col("eid"), "left")
    return out.select(*points.columns, *[F.col(f"{side}.iv.{x}").alias(f"{side}_{x}") for side in ("left", "right", "inner") for x in keep])


def regions(points: DataFrame, genes: DataFrame, chrom: str = "Chr", at: str = "Coordinate", width: int = 100_000) -> DataFrame:
    """Insertions with the columns that ``stages.parental_gene`` reads, from coordinates of genes (Chr, Start, End, Name, Systematic_ID, Strand).

    In a gene: its Name, Systematic_ID and Strand_Interval, distances to its ends and Type "Gene".
    Between genes: left and right neighbour parted by a bar, an end of the chromosome empty, with
    the distances to the neighbours' near ends, missing at the end of a chromosome, and Type
    "Intergenic region".
    """
    rows = flanked(points, genes, ["Name", "Systematic_ID", "Strand"], chrom, at, width=width)
    inside = F.col("inner_Start").isNotNull()

    def named(x: str):
        both = F.concat_ws("|", F.coalesce(F.col(f"left_{x}"), F.lit("")), F.coalesce(F.col(f"right_{x}"), F.lit("")))
        return F.when(inside, F.col(f"inner_{x}")).otherwise(both)

    place = F.col(at)
    return rows.select(
        *points.columns, F.when(inside, "Gene").otherwise("Intergenic region").alias("Type"), named("Name").alias("Name"), named("Systematic_ID").alias("Systematic_ID"), named("Strand").alias("Strand_Interval"),
        F.when(inside, place - F.col("inner_Start")).otherwise(place - F.col("left_End")).alias("Distance_to_region_start"),
        F.when(inside, F.col("inner_End") - place).otherwise(F.col("right_Start") - place).alias("Distance_to_region_end"))
