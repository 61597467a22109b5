"""Scalar rules for missing values, ratios, clipping, logs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null only: every NaN of a float column becomes null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def inf_to_null(c: Column) -> Column:
    return F.when(F.abs(c) < INF, c)


def differs(a: Column, b: Column) -> Column:
    """Unequal, where a missing side counts as another value."""
    return ~a.eqNullSafe(b)


def ratio(a: Column, b: Column) -> Column:
    """Quotient that keeps the infinities of a zero divisor; 0/0 is null."""
    signed = F.when(a > 0, INF).when(a < 0, -INF)
    return F.when(b == 0, signed).otherwise(F.try_divide(a.cast("double"), b))


def clip_upper(c: Column, top: float) -> Column:
    """Cap at ``top``; missing stays missing."""
    return F.when(c > top, F.lit(top)).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def log2_or_inf(c: Column) -> Column:
    """log2 with minus infinity at zero and null below."""
    return F.when(c == 0, F.lit(-INF)).when(c > 0, F.log2(c))


def neg_log10(p: Column, floor: float = 1e-50) -> Column:
    """-log10 of a probability that is no smaller than ``floor``."""
    return -F.log10(F.when(p < floor, F.lit(floor)).otherwise(p))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def lookup(c: Column, mapping: dict, keep: bool = False) -> Column:
    """Value of ``mapping``; what it lacks becomes null, or stays if ``keep``."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, c)
    return F.coalesce(found, c) if keep else found


def label(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first case that holds; a null case does not hold."""
    out = F.lit(otherwise)
    for cond, name in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def flags(cases: list[tuple[Column, str]]) -> Column:
    """The labels of all cases that hold, as an array."""
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in cases]))


def prefixed(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def insertion_fraction(start: Column, stop: Column) -> Column:
    """Place between start and stop codon, 0 to 1; null where they coincide."""
    return clamp(F.try_divide(start.cast("double"), start + stop), 0.0, 1.0)


def digitize(c: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value: a value at a cut belongs to the upper bin."""
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(c >= cut, 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def bucket_floor(c: Column, low: float, step: float, bins: int) -> Column:
    """Histogram bin; the last one includes its upper edge, values outside are null."""
    k = F.floor((c - low) / step).cast("int")
    return F.when(c == low + step * bins, bins - 1).when((k >= 0) & (k < bins), k)


def mean_present(a: Column, b: Column) -> Column:
    """Mean of two values, the one that is there if the other is missing."""
    return F.coalesce((a + b) / 2, a, b)
