"""Nucleotide and peptide measures."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: The standard genetic code, codons in TCAG order. Fixed values.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), CODE, strict=True)}
#: Kyte-Doolittle hydropathy. Fixed values.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
#: Monoisotopic masses of residues, and of water. Fixed values.
MASS = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER = 18.01056
#: Normalised flexibility of residues, and the weights within a window of nine. Fixed values.
FLEXIBILITY = {
    "A": 0.984, "C": 0.906, "D": 1.068, "E": 1.094, "F": 0.915, "G": 1.031, "H": 0.950, "I": 0.927, "K": 1.102, "L": 0.935,
    "M": 0.952, "N": 1.048, "P": 1.049, "Q": 1.037, "R": 1.008, "S": 1.046, "T": 0.997, "V": 0.931, "W": 0.904, "Y": 0.929,
}
WINDOW = (0.25, 0.4375, 0.625, 0.8125, 0.0, 1.8125, 0.625, 0.4375, 0.25)
#: Dissociation constants of side chains and of end residues that differ from 7.5 and 3.55. Fixed values.
PKA = {"+": {"K": 10.0, "R": 12.0, "H": 5.98}, "-": {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}}
PKA_FIRST = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PKA_LAST = {"D": 4.55, "E": 4.75}


def count_of(c: Column, letters: str) -> Column:
    """Occurrences of any of the letters."""
    return F.length(c) - F.length(F.translate(c, letters, ""))


def gc_fraction(c: Column) -> Column:
    return F.try_divide(count_of(c, "GCgc").cast("double"), F.length(c))


def gc_counts(c: Column) -> tuple[Column, Column]:
    """Letters that are G or C, and letters that are known to be or not to be; unknown ones are in neither."""
    # Letter by letter, as a translation looks each letter up as a string of its own.
    def without(x: Column, letters: str) -> Column:
        for a in letters:
            x = F.replace(x, F.lit(a), F.lit(""))
        return x

    others = without(c, "GCSgcs")
    return F.length(c) - F.length(others), F.length(c) - F.length(without(others, "ATUWatuw"))


def gc_known(c: Column) -> Column:
    """Share of G and C among the letters of which it is known; 0 without any."""
    gc, known = gc_counts(c)
    return F.coalesce(F.try_divide(gc.cast("double"), known), F.lit(0.0))


def every_third(c: Column, first: int = 3) -> Column:
    """Letters first, first+3, ... as a string."""
    return F.coalesce(F.regexp_replace(F.substring(c, first, 2**31 - 1), "(?s)(.).{0,2}", "$1"), F.lit(""))


def gc3(c: Column) -> Column:
    return gc_fraction(every_third(c))


def codons(c: Column) -> Column:
    """Whole codons in order; a trailing part is dropped."""
    # A match walks the text once, a substring per codon would walk it from its start each time.
    found = F.regexp_extract_all(c, F.lit("(?s).{3}"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def other_strand(c: Column) -> Column:
    """The reverse complement, with the letters that stand for several bases."""
    return F.reverse(F.translate(c, "ACGTRYKMBDHVacgtrykmbdhv", "TGCAYRMKVHDBtgcayrmkvhdb"))


def translated(c: Column) -> Column:
    """Peptide up to the first stop; an unknown codon gives X, one whose readings all are stops is a stop."""
    table = F.create_map(*[F.lit(x) for pair in (CODONS | {"TAR": "*", "TRA": "*"}).items() for x in pair])
    letters = F.transform(codons(F.upper(c)), lambda k: F.coalesce(F.try_element_at(table, k), F.lit("X")))
    return F.substring_index(F.array_join(letters, ""), "*", 1)


def anticodon_counts(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key with a column for each of the 64 anticodons."""
    each = df.select(key, F.explode(codons(F.upper(F.col(seq)))).alias("codon"))
    each = each.select(key, reverse_complement(F.col("codon")).alias("anticodon"))
    return each.groupBy(key).pivot("anticodon", sorted(CODONS)).count().na.fill(0)


def clean_peptide(c: Column) -> Column:
    """Up to the first stop sign."""
    return F.substring_index(c, "*", 1)


def monoisotopic_mass(c: Column) -> Column:
    """Mass of a peptide; other letters weigh nothing."""
    return sum((count_of(c, a) * m for a, m in MASS.items()), F.lit(WATER))


def aliphatic_index(c: Column) -> Column:
    """A + 2.9 V + 3.9 (I + L) in percent of the length, a hundredfold, to three digits."""
    n = F.length(c)
    weighed = count_of(c, "A") + 2.9 * count_of(c, "V") + 3.9 * count_of(c, "IL")
    return F.bround(F.try_divide(weighed * 10000.0, n), 3)


def peptide_measures(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Length, composition, aromaticity, hydropathy, extinction and structure shares."""
    p = clean_peptide(F.upper(F.col(seq)))
    base = df.select(key, p.alias("p"))
    n = F.length("p")
    c = {a: count_of(F.col("p"), a) for a in AMINO}
    share = {a: F.try_divide(c[a].cast("double"), n) for a in AMINO}
    gravy = sum((c[a] * HYDROPATHY[a] for a in AMINO), F.lit(0.0))
    reduced = c["W"] * 5500 + c["Y"] * 1490
    return base.select(
        key, n.alias("length"), *[c[a].cast("long").alias(f"count_{a}") for a in AMINO], *[share[a].alias(f"percent_{a}") for a in AMINO],
        (share["F"] + share["W"] + share["Y"]).alias("aromaticity"), F.try_divide(gravy, n).alias("gravy"),
        reduced.cast("long").alias("extinction_reduced"), (reduced + F.floor(c["C"] / 2) * 125).cast("long").alias("extinction_cystines"),
        sum((share[a] for a in "EMALK"), F.lit(0.0)).alias("helix"), sum((share[a] for a in "NPGSD"), F.lit(0.0)).alias("turn"),
        sum((share[a] for a in "VIYFWLT"), F.lit(0.0)).alias("sheet"), aliphatic_index(F.col("p")).alias("aliphatic_index"),
    )


def effective_codons(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Effective number of codons by amino-acid degeneracy class (Wright 1990), at most 61.

    The whole codons of all sequences of a key are counted together, each in its own frame. A class
    without data takes the mean of its neighbours, classes of one count two.
    """
    table = df.sparkSession.createDataFrame([(k, a, sum(x == a for x in CODONS.values())) for k, a in CODONS.items() if a != "*"], "codon string, aa string, degree int")
    each = df.select(key, F.explode(codons(F.upper(F.col(seq)))).alias("codon")).join(F.broadcast(table), "codon")
    n = each.groupBy(key, "aa", "degree", "codon").count()
    by_aa = n.groupBy(key, "aa", "degree").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("s"))
    f = F.when(F.col("n") > 1, (F.col("s") / F.col("n") - 1) / (F.col("n") - 1))
    mean = by_aa.where("degree > 1").withColumn("f", f).where("f > 0").groupBy(key).pivot("degree", [2, 3, 4, 6]).avg("f")
    f2, f4, f6 = F.col("2"), F.col("4"), F.col("6")
    f3 = F.coalesce(F.col("3"), (f2 + f4) / 2)
    return mean.select(key, F.least(F.lit(61.0), 2 + F.try_divide(F.lit(9.0), f2) + F.try_divide(F.lit(1.0), f3) + F.try_divide(F.lit(5.0), f4) + F.try_divide(F.lit(3.0), f6)).alias("effective_codons"))


#: Base letters as they are numbered; all others are the last.
_BASES = "TCAGR"
_NUMBERS = np.full(256, len(_BASES), dtype=np.int64)
for _i, _b in enumerate(_BASES):
    _NUMBERS[[ord(_b), ord(_b.lower())]] = _i
#: Codons that are stops, and the place of all others in the genetic code, by the numbers of their letters.
_TRIPLES = ["".join(x) for x in product(_BASES + "?", repeat=3)]
_STOPS = np.array([CODONS.get(x) == "*" or x in ("TAR", "TRA") for x in _TRIPLES])
_PLACES = np.array([list(CODONS).index(x) if CODONS.get(x, "*") != "*" else len(CODONS) for x in _TRIPLES])
#: Bytes that are G or C, and those that are known to be or not to be.
_GC, _KNOWN = (np.isin(np.arange(256), [ord(x) for x in letters]).astype(np.int64) for letters in ("GCSgcs", "GCSgcsATUWatuw"))
#: Codons (rows) of each amino acid, by degree.
_DEGREES = {d: np.array([[x == a for a in AMINO if CODE.count(a) == d] for x in CODONS.values()], dtype=np.float64) for d in (2, 3, 4, 6)}


def _codon_measures(sequences: pa.Array) -> pa.Array:
    data = sequences.cast(pa.large_binary())
    if np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8).max(initial=0) > 127:
        data = pa.array([None if x is None else x.encode("ascii", "replace") for x in sequences.to_pylist()], pa.large_binary())
    rows, there = len(data), data.is_valid().to_numpy(zero_copy_only=False)
    ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + rows + 1]
    letters = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)
    n = np.where(there, np.diff(ends), 0) // 3
    row = np.repeat(np.arange(rows), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = ends[:-1][row] + 3 * within
    side = len(_BASES) + 1
    third = _NUMBERS[letters[at + 2]]
    codon = (_NUMBERS[letters[at]] * side + _NUMBERS[letters[at + 1]]) * side + third

    def share(gc: np.ndarray, known: np.ndarray) -> pa.Array:
        return pa.array(np.divide(gc, known, out=np.zeros(rows), where=known > 0), mask=~there)

    counted = [np.diff(np.r_[0, np.cumsum(of[letters])][ends]) for of in (_GC, _KNOWN)]
    thirds = [np.bincount(row, weights=x, minlength=rows) for x in ((third == 1) | (third == 3), third < 4)]

    peptide, stops = n.copy(), np.flatnonzero(_STOPS[codon])
    np.minimum.at(peptide, row[stops], within[stops])

    width = len(CODONS) + 1
    counts = np.bincount(row * width + _PLACES[codon], minlength=rows * width).reshape(rows, width)[:, :-1].astype(np.float64)
    mean = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for d, members in _DEGREES.items():
            of, squares = counts @ members, (counts * counts) @ members
            f = (squares / of - 1) / (of - 1)
            good = (of > 1) & (f > 0)
            mean[d] = np.where(good, f, 0.0).sum(axis=1) / good.sum(axis=1)
        some = ~np.isnan(np.stack(list(mean.values()))).all(axis=0)
        f3 = np.where(np.isnan(mean[3]), (mean[2] + mean[4]) / 2, mean[3])
        effective = np.fmin(61.0, 2 + 9.0 / mean[2] + 1.0 / f3 + 5.0 / mean[4] + 3.0 / mean[6])
    return pa.StructArray.from_arrays([share(*counted), share(*thirds), pa.array(peptide.astype(np.int32), mask=~there), pa.array(effective, mask=~some)], ["gc", "gc3", "peptide_length", "effective_codons"])


def codon_measures(c: Column) -> Column:
    """(gc, gc3, peptide_length, effective_codons) of each sequence by itself.

    They are ``gc_known``, the share of G and C among the letters A, C, G and T that are third of a codon, the length of ``translated``
    and ``effective_codons``. A sequence's codons are counted in its own row, so none of them is a row of a plan. Without
    a class that has data there is no effective number.
    """
    return F.arrow_udf(_codon_measures, "struct<gc: double, gc3: double, peptide_length: int, effective_codons: double>")(c)


def plddt_measures(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, spread, variation and share under 50 of per-residue confidence."""
    x, mean, std = F.col(value), F.avg(value), F.stddev_pop(value)
    return df.groupBy(key).agg(F.bround(mean, 3).alias("mean"), F.bround(std, 3).alias("std"), F.bround(F.try_divide(std, mean), 3).alias("cv"),
                               F.bround(F.count_if(x < 50) / F.count(x), 3).alias("disorder"))


def _letter_values(c: Column, values: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.transform(F.filter(F.split(c, ""), lambda a: a != ""), lambda a: F.coalesce(F.try_element_at(table, a), F.lit(0.0)))


def flexibility(c: Column) -> Column:
    """Mean weighted flexibility of the windows of nine residues; null for nine residues or fewer.

    The last window is left out and the sixth residue has the middle's full weight besides its own,
    as the method's common implementation does it; the fifth has none.
    """
    def summed(v: Column) -> Column:
        n = F.size(v) - len(WINDOW)
        parts = [w * F.aggregate(F.slice(v, k + 1, n), F.lit(0.0), lambda a, x: a + x) for k, w in enumerate(WINDOW) if w]
        return F.when(n > 0, sum(parts[1:], parts[0]) / (5.25 * n))

    return F.get(F.transform(F.array(_letter_values(clean_peptide(F.upper(c)), FLEXIBILITY)), summed), F.lit(0))


def instability(c: Column, weights: dict[str, float], otherwise: float = 1.0) -> Column:
    """Ten times the mean dipeptide weight per residue; ``weights`` maps pairs of letters, others weigh ``otherwise``.

    The published table of 400 weights is a parameter and not part of the library.
    """
    p = clean_peptide(F.upper(c))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    places = F.when(F.length(p) > 1, F.sequence(F.lit(1), F.length(p) - 1)).otherwise(F.array().cast("array<int>"))
    weight = lambda i: F.lit(otherwise) if table is None else F.coalesce(F.try_element_at(table, F.substr(p, i, F.lit(2))), F.lit(otherwise))
    return F.try_divide(10.0 * F.aggregate(F.transform(places, weight), F.lit(0.0), lambda a, x: a + x), F.length(p))


#: Letters that carry a charge inside a peptide, with their constants.
_CHARGED = (*PKA["+"].items(), *PKA["-"].items())


def _charges(p: Column) -> Column:
    """What the charge of a clean peptide depends on: its ends' constants and the numbers of its charged letters."""
    first, last = (F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for t in (PKA_FIRST, PKA_LAST))
    start = F.coalesce(F.try_element_at(first, F.substring(p, 1, 1)), F.lit(7.5))
    end = F.coalesce(F.try_element_at(last, F.substring(p, -1, 1)), F.lit(3.55))
    return F.struct(start.alias("start"), end.alias("end"), F.length(p).alias("n"), *[count_of(p, a).alias("n" + a) for a, _ in _CHARGED])


def _net_charge(s: Column, ph: Column) -> Column:
    up = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
    down = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
    plus = sum((s["n" + a] * up(k) for a, k in PKA["+"].items()), up(s["start"]))
    minus = sum((s["n" + a] * down(k) for a, k in PKA["-"].items()), down(s["end"]))
    return F.when(s["n"] > 0, plus - minus)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def charge_at(c: Column, ph: Column) -> Column:
    """Net charge of a peptide at a pH, by the dissociation constants in PKA."""
    charges = lambda p: _with(_charges(p), lambda s: _net_charge(s, ph))
    return _with(clean_peptide(F.upper(c)), charges)


def isoelectric_point(c: Column, steps: int = 24) -> Column:
    """The pH from 0 to 14 at which the net charge vanishes, by bisection.

    Letters are counted once; a step halves the width above the lower bound.
    """
    def found(s: Column) -> Column:
        start = F.named_struct(F.lit("low"), F.lit(0.0), F.lit("width"), F.lit(14.0))

        def half(a: Column, _: Column) -> Column:
            width = a["width"] / 2
            return F.named_struct(F.lit("low"), F.when(_net_charge(s, a["low"] + width) > 0, a["low"] + width).otherwise(a["low"]), F.lit("width"), width)

        return F.when(s["n"] > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda a: a["low"] + a["width"] / 2))

    return _with(clean_peptide(F.upper(c)), lambda p: _with(_charges(p), found))
