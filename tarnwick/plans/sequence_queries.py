"""Queries of the sequence operators over whole document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import sequence as Q
from tarnwick.plans.registry import Tables, query, six


@query("select doc_id, round((length(text) - length(translate(text, 'GCgc', ''))) / nullif(length(text), 0)::double, 6) as gc, length(text) as n from documents")
def gc_fraction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", six(Q.gc_fraction(F.col("text"))).alias("gc"), F.length("text").cast("long").alias("n"))


@query("select doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) = text as palindrome, left(reverse(translate(text, 'ACGTacgt', 'TGCAtgca')), 20) as start from documents")
def reverse_complement(t: Tables) -> DataFrame:
    r = Q.reverse_complement(F.col("text"))
    return t.documents.select("doc_id", (r == F.col("text")).alias("palindrome"), F.substring(r, 1, 20).alias("start"))


#: Part names with their letters replaced by bases, as coding sequences.
_DNA = "translate(upper(replace(p_name, ' ', '')), 'BDEFHIJKLMNOPQRSUVWXYZ0123456789#', 'ACGTACGTACGTACGTACGTACGTACGTACGTA')"


def dna():
    return F.translate(F.upper(F.regexp_replace("p_name", " ", "")), "BDEFHIJKLMNOPQRSUVWXYZ0123456789#", "ACGTACGTACGTACGTACGTACGTACGTACGTA")


@query(f"with s as (select p_partkey, {_DNA} as s from part), c as (select p_partkey, s, unnest(range(0, cast(floor(length(s) / 3) as bigint))) as k from s) select substr(s, (k * 3 + 1)::int, 3) as codon, count(*) as n from c group by 1")
def codon_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(Q.codons(dna())).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


@query(f"with s as (select p_partkey, {_DNA} as s from part), c as (select p_partkey, array_to_string(list_transform(range(3, length(s) + 1, 3), lambda k: substr(s, k::int, 1)), '') as x from s) select p_partkey, round((length(x) - length(translate(x, 'GC', ''))) / nullif(length(x), 0)::double, 6) as gc3 from c")
def gc3(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", six(Q.gc3(dna())).alias("gc3"))


_SPLIT = f"s as (select p_partkey, p_brand, {_DNA} as s from part), c as (select p_partkey, p_brand, s, unnest(range(0, cast(floor(length(s) / 3) as bigint))) as k from s), k as (select p_partkey, p_brand, k, substr(s, (k * 3 + 1)::int, 3) as codon from c)"
_CODE = "map([" + ", ".join(f"'{c}'" for c in Q.CODONS) + "], [" + ", ".join(f"'{a}'" for a in Q.CODONS.values()) + "])"
_PEPTIDE = f"{_SPLIT}, t as (select p_partkey, split_part(string_agg(coalesce({_CODE}[codon], 'X'), '' order by k), '*', 1) as p from k group by 1), q as (select part.p_partkey, coalesce(p, '') as p from part left join t using (p_partkey))"


def _of(letters: str) -> str:
    return f"(length(p) - length(translate(p, '{letters}', '')))"


_MEASURED = ", ".join([
    "p_partkey", "length(p) as length", *[f"{_of(a)} as count_{a}" for a in Q.AMINO], *[f"round({_of(a)} / nullif(length(p), 0)::double, 6) as percent_{a}" for a in Q.AMINO],
    f"round({_of('FWY')} / nullif(length(p), 0)::double, 6) as aromaticity", "round((" + " + ".join(f"{_of(a)} * {h}" for a, h in Q.HYDROPATHY.items()) + ") / nullif(length(p), 0), 6)::double as gravy",
    f"{_of('W')} * 5500 + {_of('Y')} * 1490 as extinction_reduced", f"{_of('W')} * 5500 + {_of('Y')} * 1490 + {_of('C')} // 2 * 125 as extinction_cystines",
    *[f"round({_of(x)} / nullif(length(p), 0)::double, 6) as {name}" for name, x in (("helix", "EMALK"), ("turn", "NPGSD"), ("sheet", "VIYFWLT"))],
])


@query(f"with {_PEPTIDE} select {_MEASURED} from q")
def translated_peptides(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", Q.translated(dna()).alias("peptide"))
    out = Q.peptide_measures(rows, "p_partkey", "peptide").drop("aliphatic_index")
    return out.select(*[six(c).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) for c, kind in out.dtypes])


@query(f"with {_SPLIT} select p_partkey, " + ", ".join(f"count(*) filter (codon = reverse(translate('{c}', 'ACGT', 'TGCA'))) as \"{c}\"" for c in sorted(Q.CODONS)) + " from k group by 1")
def anticodons(t: Tables) -> DataFrame:
    return Q.anticodon_counts(t.part.select("p_partkey", dna().alias("s")), "p_partkey", "s")


@query(f"with {_SPLIT}, a as (select p_brand, codon, {_CODE}[codon] as aa, count(*) as n from k group by 1, 2, 3), d as (select aa, count(*) as degree from (select unnest(map_values({_CODE})) as aa) group by 1 having aa <> '*'), "
       "b as (select p_brand, aa, degree, sum(n) as n, sum(n * n) as s from a join d using (aa) where degree > 1 group by all), f as (select p_brand, degree, (s / n - 1) / (n - 1) as f from b where n > 1), "
       "m as (select p_brand, avg(f) filter (degree = 2) as f2, avg(f) filter (degree = 3) as f3, avg(f) filter (degree = 4) as f4, avg(f) filter (degree = 6) as f6 from f where f > 0 group by 1) "
       "select p_brand, round(case when f2 + f4 + f6 is not null then least(61, 2 + 9 / f2 + 1 / coalesce(f3, (f2 + f4) / 2) + 5 / f4 + 3 / f6) else 61 end, 6)::double as effective_codons from m")
def effective_codons(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", dna().alias("s"))
    return Q.effective_codons(rows, "p_brand", "s").withColumn("effective_codons", six("effective_codons"))


@query("select c_mktsegment, round(avg(v), 3) as mean, round(stddev_pop(v), 3) as std, round(stddev_pop(v) / avg(v), 3) as cv, round(count(*) filter (v < 50) / count(*)::double, 3) as disorder from (select c_mktsegment, c_custkey % 97 + 1.0::double as v from customer) group by 1")
def plddt(t: Tables) -> DataFrame:
    return Q.plddt_measures(t.customer.select("c_mktsegment", (F.col("c_custkey") % 97 + 1.0).cast("double").alias("v")), "c_mktsegment", "v")
