"""Mixing sources to target weights along a curriculum that changes over the training run.

Each source has a weight schedule over training time from 0 to 1. Its integral, scaled to the
source's target, is the source's cumulative demand of words; a document's place in its source's
cumulative supply is sent through the inverse of that demand to give the training position, and
the documents are range-sorted by position.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import TMP, join_on, materialize, shuffle_partitions, word_count

#: Weights of the sources by code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Schedules by the same order: (time, relative weight) knots, linear in between.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

ORDER, CELL, PARTS, START, SUM, NO = (TMP + x for x in ("order", "cell", "parts", "start", "sum", "no"))
KEY = (ORDER, "doc_id", "size")


def integrated(schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces (t0, t1, w0, w1, share before) of a schedule, its whole integral scaled to one."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(schedule))
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in pairwise(schedule):
        pieces.append((t0, t1, w0 / whole, w1 / whole, before))
        before += (t1 - t0) * (w0 + w1) / 2 / whole
    return pieces


def inverse_demand(share: Column, schedule) -> Column:
    """The time at which a schedule has asked for ``share`` (0 to 1) of its words."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, before in reversed(integrated(schedule)):
        part = (t1 - t0) * (w0 + w1) / 2
        y = F.greatest(share - before, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = t0 + y / w0 if w0 else F.lit(t1)
        else:
            t = t0 + (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0))) - w0) / slope
        out = F.when(share < before + part, t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, rows, source_size, weight_no, target) from rows of (source, size).

    ``share`` of all words goes out by weight; a source takes at most ``most`` times its own size
    and the excess goes to the others by weight until none is above. That end state is found at
    once: with the sources sorted by limit per weight, those below the common level are full.
    Works on one row per source; null is a source and comes last.
    """
    table = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("weight_no", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("weight_no") + 1)
    table = table.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = share * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    table = table.withColumn("level", level)
    settled = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(settled, F.lit(float("inf"))) * F.col("w"))
    return table.select("source", "rows", "source_size", "weight_no", target.cast("double").alias("target"))


def _small(table: DataFrame, label: str, most: int = 100_000) -> DataFrame:
    """A written table that is broadcast to joins if it has at most ``most`` rows."""
    table = materialize(table, label)
    return F.broadcast(table) if table.count() <= most else table


class _Plan:
    """Where each row of (doc_id, source, size) stands in its source, from a written table of them.

    A source's rows come in the order of a hash of their id, dealt into cells of that order, about
    four a shuffle partition over all sources; the sums of the cells give each cell its start, and
    a window inside the cell the rest, so no source is gathered in one task.
    """

    def __init__(self, slim: DataFrame, share: float, most: float, weights, schedules):
        if len(schedules) != len(weights):
            raise ValueError("each weight needs a schedule")
        targets = materialize(source_targets(slim, share, most, weights), "targets")
        cells = 4 * shuffle_partitions(slim.sparkSession)
        total = targets.agg(F.sum("rows")).first()[0] or 1
        parts = F.greatest(F.lit(1), F.ceil(F.col("rows") * cells / F.lit(float(total)))).cast("long")
        self.schedules, self.passes, self.most = schedules, range(1, math.ceil(most) + 1), most
        self.sources = _small(targets.select("source", "source_size", "target", F.col("weight_no").alias(NO), parts.alias(PARTS)), "sources")
        sums = self._in_cells(slim).groupBy("source", CELL).agg(F.sum("size").alias("sum"))
        before = Window.partitionBy("source").orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        self.starts = _small(sums.select("source", CELL, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(START), F.col("sum").alias(SUM)), "cells")

    def _in_cells(self, rows: DataFrame) -> DataFrame:
        hashed = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("mix")), 32)
        return join_on(rows, self.sources, ["source"]).withColumn(ORDER, hashed).withColumn(CELL, F.shiftrightunsigned(F.col(ORDER) * F.col(PARTS), 32))

    def exact(self, rows: DataFrame) -> DataFrame:
        """Rows with source_size, target and, as START, the words of their source before them."""
        before = Window.partitionBy("source", CELL).orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
        rows = self._in_cells(rows).withColumn(TMP + "in", F.coalesce(F.sum("size").over(before), F.lit(0)))
        return join_on(rows, self.starts, ["source", CELL]).withColumn(START, F.col(START) + F.col(TMP + "in")).drop(TMP + "in")

    def interpolated(self, rows: DataFrame) -> DataFrame:
        """The same without a window: START is exact at a cell's beginning and goes with the hash inside it."""
        inside = (F.col(ORDER) * F.col(PARTS)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
        return join_on(self._in_cells(rows), self.starts, ["source", CELL]).withColumn(START, F.col(START) + F.floor(inside * F.col(SUM)))

    def taken(self, number, start: Column) -> Column:
        """Words that pass ``number`` takes of a row that ``start`` words of its source stand before."""
        size = F.least(F.col("size"), F.floor((self.most - number + 1) * F.col("size")).cast("long"))
        left = F.round(F.col("target")).cast("long") - (number - 1) * F.col("source_size") - start
        return F.greatest(F.lit(0), F.least(size, left)).cast("long")

    def position(self, number, start: Column) -> Column:
        """The time at which the schedule has asked for all that stands before."""
        share = ((number - 1) * F.col("source_size") + start) / F.when(F.col("target") > 0, F.col("target"))
        out = F.lit(None).cast("double")
        for k, schedule in enumerate(self.schedules):
            out = F.when(F.col(NO) == k, inverse_demand(share, schedule)).otherwise(out)
        return out


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *more)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every row of ``docs``, in training order.

    Returns doc_id, size (words; null text: 0), source, source_size, target, taken (words taken,
    repeats counted, at most ``most`` times the size), position (0 to 1; where the first pass over
    the document stands in training; null if nothing is taken) and position_2, ... for the further
    passes, range-sorted by position. Within a source documents come in the order of a hash of
    their id, pass after pass, until the target is met; the last one may be taken in part, so
    that every source meets its target to within a word, and what a source gives up to any time
    is its integrated schedule to within a document. Null sources form one source. The same
    table gives the same mix on every run; repeated rows each count, ties in the hash go by id and
    size; an empty table gives an empty table.
    """
    slim = materialize(_slim(docs, id_col, text_col, source_col), "words")
    plan = _Plan(slim, share, most, weights, schedules)
    rows = plan.exact(slim)
    for e in plan.passes:
        rows = rows.withColumn(f"taken_{e}", plan.taken(e, F.col(START))).withColumn(f"position_{e}", F.when(F.col(f"taken_{e}") > 0, plan.position(e, F.col(START))))
    taken = sum((F.col(f"taken_{e}") for e in plan.passes), F.lit(0).cast("long"))
    out = rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.col("position_1").alias("position"), *[f"position_{e}" for e in plan.passes if e > 1])
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in training order, all columns kept.

    A document comes once for each pass over it. Texts stay whole: a pass of which less than half is
    taken is left out, one of which half or more is comes whole, so a source misses its target by
    at most half a document. A document without words, which no mix can take, comes once and last.
    Rows without an id count like others; rows of one id and size are taken together; an empty
    table gives an empty table.

    The last row that each pass takes is found on (id, source, size) alone; a row comes if it does
    not stand behind it. So texts are shuffled once, each pass to its stretch of training time,
    and sorted there. Positions are exact where a cell begins and interpolated inside.
    """
    slim = materialize(_slim(docs, id_col, text_col, source_col), "words")
    plan, parts, key = _Plan(slim, share, most, weights, schedules), shuffle_partitions(docs.sparkSession), F.struct(*KEY)
    exact = plan.exact(slim)
    last = [F.max(F.when((plan.taken(e, F.col(START)) > 0) & (2 * plan.taken(e, F.col(START)) >= F.col("size")), key)).alias(f"{TMP}last_{e}") for e in plan.passes]
    ends = _small(exact.groupBy("source").agg(*last), "ends")
    rows = plan.interpolated(_slim(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias(TMP + "row")))
    rows = join_on(rows, ends, ["source"])
    comes = F.filter(F.array(*[F.when(key <= F.col(f"{TMP}last_{e}"), plan.position(e, F.col(START))) for e in plan.passes]), lambda x: x.isNotNull())
    at = F.explode(F.when(F.col("size") == 0, F.array(F.lit(2.0))).otherwise(comes))
    rows = rows.select(TMP + "row", at.alias("at"), F.xxhash64("doc_id").alias("tie"))
    rows = rows.withColumn("stretch", F.least(F.lit(parts - 1), F.floor(F.col("at") * parts)).cast("int")).repartitionById(parts, F.col("stretch"))
    return rows.sortWithinPartitions("at", "tie").select(TMP + "row.*")
