"""String rules of the screening tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(c: Column, sep: str, place: int) -> Column:
    """The ``place``-th field (from 1, or from the end if negative), null if there is none."""
    return F.try_element_at(F.split(c, sep), F.lit(place))


def before_last(c: Column, sep: str = "_") -> Column:
    """Everything before the last separator; the whole string without one."""
    return F.regexp_replace(c, f"{sep}[^{sep}]*$", "")


def first_sorted(c: Column, sep: str) -> Column:
    return F.array_min(F.split(c, sep))


def token_count(c: Column, sep: str) -> Column:
    """Number of fields; missing counts as none."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.split(c, sep)))


def match_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(F.regexp_like(c, F.lit(pattern)), found)


def dotted_id_case(c: Column) -> Column:
    """Upper-case first part, lower-case second; further parts are dropped."""
    parts = F.split(c, "\\.")
    return F.concat_ws(".", F.upper(F.get(parts, 0)), F.lower(F.get(parts, 1)))


def any_keyword(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w))


#: Words of a role's description by the kind of role, in the order in which kinds are asked. Fixed values.
ROLE_WORDS = (
    ("shared", ("shared with", "shared ", "TAF module", "HSA-module", "heterohexamer")),
    ("peripheral", ("peripheral", "non-essential", "regulator", "TBP-interaction")),
    ("core", ("essential", "core", "scaffold", "structural", "catalytic", "specific")),
)


def first_kind(c: Column, kinds: tuple[tuple[str, tuple[str, ...]], ...] = ROLE_WORDS, otherwise: str = "unclear") -> Column:
    """The first kind any of whose words a text has, whatever the case; a missing text has none and is ``otherwise``."""
    out = None
    for name, words in kinds:
        hit = F.coalesce(any_keyword(c, list(words)), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def cache_key(*parts: Column) -> Column:
    """First 16 digits of the SHA-1 of the parts joined by two pipes; order matters."""
    return F.substring(F.sha1(F.concat_ws("||", *parts)), 1, 16)


def iso_to_compact(c: Column) -> Column:
    return F.regexp_replace(c, "-", "")


def sorted_join(c: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(c), sep)
