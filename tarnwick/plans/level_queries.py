"""Queries of the whole feature levels, of slim enrichment and of the sets that models learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import coherence, ml, ontology, relational, search, stats
from tarnwick.plans import features as L
from tarnwick.plans.cluster_queries import points
from tarnwick.plans.registry import Tables, query, six
from tarnwick.plans.sequence_queries import _DNA, dna
from tarnwick.plans.stats_queries import _EDGES, _edges

_CDS = f"""t as (select p_partkey, {_DNA} as s, p_size, floor(p_retailprice)::int as r, case when p_partkey % 2 = 0 then '+' else '-' end as strand, case when p_partkey % 7 = 0 then 'III' else 'I' end as chrom from part),
c as (select *, unnest(range(0, p_size % 3 + 1)) as k from t), d as (select *, r + k * 40 as b, r + k * 40 + 8 as e, substr(s, (k + 1)::int, 9) as q from c),
i as (select *, unnest(range(0, p_size % 3)) as k from t), j as (select *, substr(s, (k + 2)::int, 5) as q from i),
g as (select p_partkey, any_value(s) as s, any_value(strand) as strand, any_value(chrom) as chrom, min(b) as lo, max(e) as hi, count(*) as n, case when any_value(strand) = '+' then string_agg(q, '' order by k) else string_agg(q, '' order by k desc) end as q from d group by 1),
h as (select p_partkey, count(*) as n, string_agg(q, '' order by k) as q, arg_min(q, k) as q1 from j group by 1),
w as (select g.*, case when strand = '+' then lo else hi end as st, case when strand = '+' then hi else lo end as en, (lo + hi) // 2 as mid, coalesce(h.n, 0) as ni, coalesce(h.q, '') as iq, coalesce(h.q1, '') as iq1 from g left join h using (p_partkey))"""


def _gc(c: str) -> str:
    return f"coalesce(round((length({c}) - length(translate({c}, 'GC', ''))) / nullif(length({c}), 0)::double, 3), 0)"


@query(f"""with {_CDS} select p_partkey as "Gene_id", chrom as "Chromosome", st as "Start", en as "End", strand as "Strand", case when chrom = 'I' then least(abs(mid - 100), abs(mid - 3000)) end as "Abs_distance_from_telomere",
case when chrom = 'I' then abs(mid - 1250.5) end::double as "Abs_distance_from_centromere", hi - lo + 1 as "Gene_length", {_gc('s')} as "GC_content_of_gene", n as "CDS_number", {_gc('q')} as "GC_content_of_CDS", round(length(q) / (hi - lo + 1)::double, 3) as "Fraction_of_CDS",
ni > 0 as "Containing_intron", ni as "Intron_number", {_gc('iq')} as "GC_content_of_intron", length(iq) as "Total_intron_length", coalesce(length(iq) / nullif(ni, 0)::double, 0) as "Average_intron_length", length(iq1) as "Length_of_first_intron", {_gc('iq1')} as "GC_contents_of_first_intron" from w""")
def dna_record(t: Tables) -> DataFrame:
    base = t.part.select(F.col("p_partkey").alias("Gene_id"), F.col("p_partkey").alias("mRNA_id"), F.when(F.col("p_partkey") % 7 == 0, "III").otherwise("I").alias("Chromosome"),
                         F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("Strand"), dna().alias("gene_sequence"), "p_size", F.floor("p_retailprice").cast("int").alias("r"))
    k, pieces = F.col("k"), F.col("p_size") % 3
    cds = base.select("*", F.explode(F.sequence(F.lit(0), pieces)).alias("k")).select("mRNA_id", (F.col("r") + k * 40).alias("start"), (F.col("r") + k * 40 + 8).alias("end"), F.substring("gene_sequence", k + 1, F.lit(9)).alias("sequence"))
    introns = base.where(pieces > 0).select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k")).select("mRNA_id", k.alias("start"), (k + 5).alias("end"), F.substring("gene_sequence", k + 2, F.lit(5)).alias("sequence"))
    places = t.spark.createDataFrame([("I", 4000, 100, 3000, 1200, 1301)], "Chromosome string, length int, left int, right int, centromere_start int, centromere_end int")
    primary = t.part.select(F.col("p_partkey").cast("string").alias("Gene_id"), F.lit(3).alias("Primary_peptide_length"))
    text = base.drop("p_size", "r").withColumns({"Gene_id": F.col("Gene_id").cast("string"), "mRNA_id": F.col("mRNA_id").cast("string")})
    out = L.dna_record(text, cds.withColumn("mRNA_id", F.col("mRNA_id").cast("string")), introns.withColumn("mRNA_id", F.col("mRNA_id").cast("string")), places, primary)
    return out.drop("mRNA_id", "Relative_distance_from_telomere", "Relative_distance_from_centromere", "GC3", "ENC", "Peptide_length", "Primary_peptide_length", "Primary_candidate").withColumn("Gene_id", F.col("Gene_id").cast("long"))


@query("""with o as (select p_partkey as g, case when p_size = 1 then 0 else len(string_split(p_name, ' ')) end as a, case when p_size % 2 = 0 then 0 else 1 end as b from part where p_partkey % 3 > 0), p as (select l_partkey as g, count(*) as n from lineitem where l_quantity > 45 and l_linestatus = 'O' group by 1),
r as (select s_suppkey as g, s_acctbal from supplier), x as (select coalesce(o.g, p.g) as g, a, b, n from o full outer join p on o.g = p.g), y as (select coalesce(x.g, r.g) as g, a, b, n, s_acctbal from x full outer join r on x.g = r.g)
select coalesce(g, p_partkey) as "Gene_id", a as japonicus_ortholog_count, b as human_ortholog_count, coalesce(n, 0) as paralog_count, round(s_acctbal, 6) as evolutionary_rate, p_size as phylop from y full outer join (select * from part where p_partkey % 10 = 0) on g = p_partkey where coalesce(g, p_partkey) % 2 = 0""")
def evolutionary_level(t: Tables) -> DataFrame:
    key = F.concat("p_partkey", F.lit("(note)")).alias("Gene_id")
    base = t.part.where("p_partkey % 3 > 0")
    orthologs = {"japonicus": base.select(key, F.when(F.col("p_size") != 1, F.regexp_replace("p_name", " ", "|")).alias("orthologs")), "human": base.select(key, F.when(F.col("p_size") % 2 != 0, "x").alias("orthologs"))}
    paralogs = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("Gene_id"), F.when(F.col("l_linestatus") == "O", "n").alias("name"))
    rates = t.supplier.select(F.col("s_suppkey").cast("string").alias("Gene_id"), F.col("s_acctbal").alias("evolutionary_rate"))
    scores = t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("Gene_id"), F.col("p_size").alias("phylop"))
    ids = t.part.select(F.col("p_partkey").alias("g")).union(t.supplier.select("s_suppkey")).union(t.lineitem.select("l_partkey")).where("g % 2 = 0")
    out = L.evolutionary_level(orthologs, paralogs, rates, scores, ids.select(F.col("g").cast("string").alias("Gene_id")))
    return out.withColumns({"Gene_id": F.col("Gene_id").cast("long"), "evolutionary_rate": six("evolutionary_rate")})


@query("""with d as (select l_partkey as g, count(*) as n from lineitem where l_returnflag = 'A' group by 1), q as (select l_partkey as g, max(l_quantity) filter (l_linestatus = 'O') as a, max(l_quantity) filter (l_linestatus = 'F') as b from lineitem group by 1),
k as (select s_suppkey as g, s_acctbal from supplier where s_suppkey % 3 > 0), p as (select p_partkey as g, length(p_name) as len from part), x as (select coalesce(p.g, q.g) as g, len, a, b from p full outer join (select * from q where a is not null and b is not null) q on p.g = q.g), y as (select coalesce(x.g, k.g) as g, len, a, b, s_acctbal from x full outer join k on x.g = k.g)
select y.g as "Gene_id", len, a as proliferating, b as quiescent, round(s_acctbal, 6) as half_life, coalesce(n, 0) as domains from y left join d on y.g = d.g where y.g % 2 = 0 and y.g > 0""")
def protein_level(t: Tables) -> DataFrame:
    def key(c):
        return F.col(c).cast("string").alias("Gene_id")

    peptides = t.part.select(key("p_partkey"), F.length("p_name").alias("len"))
    copies = t.lineitem.groupBy(key("l_partkey"), F.when(F.col("l_linestatus") == "O", "proliferating").otherwise("quiescent").alias("condition")).agg(F.max("l_quantity").alias("copies"))
    turnover = t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(";", "s_suppkey", F.lit("0"))).alias("ids"), F.col("s_suppkey").cast("string").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, 1.0).alias("rate"), F.col("s_acctbal").alias("half_life"), F.col("s_suppkey").alias("row_no"))
    domains = t.lineitem.select(key("l_partkey"), F.when(F.col("l_returnflag") == "A", "PFAM").otherwise("other").alias("database"))
    ids = t.part.select(F.col("p_partkey").alias("g")).union(t.supplier.select("s_suppkey")).union(t.lineitem.select("l_partkey")).where("g % 2 = 0 and g > 0")
    lives = L.half_lives(turnover).where("Gene_id <> '0'")
    out = L.protein_level(t.part.where("p_partkey < 0").select(key("p_partkey")), peptides, copies, lives, t.part.where("p_partkey < 0").select(key("p_partkey")), domains, ids.select(F.col("g").cast("string").alias("Gene_id")))
    return out.select(F.col("Gene_id").cast("long").alias("Gene_id"), "len", F.col("copies_per_cell_EMM_Proliferating_Cell").alias("proliferating"), F.col("copies_per_cell_EMMN_Quiescent_Cell").alias("quiescent"), six("protein_half_life_minutes").alias("half_life"), F.col("PFAM_domain_count").alias("domains"))


_SLIM = ("R0", "R1", "G1", "ROOT", "N3")
_MAPPED = "('R0', 'R1', 'G1', 'ROOT', 'N3')"


def _members(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("gene"), F.concat(F.lit("N"), "c_nationkey").alias("term"))


def _slim(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in _SLIM], "term string")


@query(f"with recursive {_EDGES} select distinct c_custkey as gene, ancestor as term from customer join c on c.term = 'N' || c_nationkey where ancestor in {_MAPPED}")
def slim_associations(t: Tables) -> DataFrame:
    return ontology.slim_associations(_members(t), ontology.closure(_edges(t)), _slim(t))


def _tested(variant: str, terms: str) -> str:
    """SQL of the terms of one variant with their p and false discovery rate, from log factorials."""
    return f"""{variant}a as (select distinct c_custkey as gene, ancestor as term from customer join c on c.term = 'N' || c_nationkey{terms}), {variant}p as (select term, count(*) as pop_count from {variant}a group by 1), {variant}h as (select grp, term, count(*) as k from {variant}a join s using (gene) group by 1, 2),
{variant}x as (select sn.grp, p.term, coalesce(k, 0) as k, study_n as n, pop_count as m, pop_n as o from sn cross join {variant}p p cross join pn left join {variant}h h on h.grp = sn.grp and h.term = p.term),
{variant}y as (select *, unnest(range(greatest(0, n + m - o), least(n, m) + 1)) as i from {variant}x), {variant}z as (select *, lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(o - m + 1) - lgamma(n - i + 1) - lgamma(o - m - n + i + 1) - lgamma(o + 1) + lgamma(n + 1) + lgamma(o - n + 1) as lp from {variant}y),
{variant}w as (select grp, term, k, n, m, o, max(lp) filter (i = k) as lk, list(lp) as lps from {variant}z group by all), {variant}q as (select *, least(1, list_sum(list_transform(list_filter(lps, lambda v: exp(v) <= exp(lk) * (1 + 1e-7)), lambda v: exp(v)))) as p from {variant}w),
{variant}r as (select *, row_number() over (partition by grp order by p, term) as rn, count(*) over (partition by grp) as t from {variant}q), {variant}f as (select '{variant}' as variant, *, least(1, min(p * t / rn) over (partition by grp order by rn desc rows unbounded preceding)) as q from {variant}r)"""


_TESTED = f"with recursive {_EDGES}, s as (select c_custkey as gene, c_nationkey % 4 as grp from customer where c_nationkey % 4 < 3), pn as (select count(distinct c_custkey) as pop_n from customer), sn as (select grp, count(distinct gene) as study_n from s group by 1), {_tested('full', '')}, {_tested('slim', f' where ancestor in {_MAPPED}')}, found as (select * from fullf union all select * from slimf)"


def _enriched(t: Tables) -> DataFrame:
    closed = ontology.closure(_edges(t))
    study = t.customer.where("c_nationkey % 4 < 3").select((F.col("c_nationkey") % 4).alias("grp"), F.col("c_custkey").alias("gene"))
    spaces = closed.select("term").distinct().withColumn("namespace", F.lit("BP"))
    return ontology.enrich_full_and_slim(study, t.customer.select(F.col("c_custkey").alias("gene")), _members(t), closed, _slim(t), spaces)


@query(f"{_TESTED} select variant, grp, term, k as study_count, m as pop_count, round(p, 6) as p, round(q, 6) as p_fdr from found where q < 0.05 and k / n::double > m / o::double")
def slim_enrichment(t: Tables) -> DataFrame:
    return _enriched(t).select("variant", "grp", "term", "study_count", "pop_count", six("p_uncorrected").alias("p"), six("p_fdr").alias("p_fdr"))


@query(f"{_TESTED}, b as (select distinct c_custkey as gene, ancestor as term from customer join c on c.term = 'N' || c_nationkey), i as (select term, string_agg(gene::varchar, ',' order by gene::varchar) as pop_items from b group by 1) "
       "select variant, grp, term as term_id, case when term like 'N%' then 'name of ' || term end as term, round_even(k / n::double, 2) as gene_ratio, k || '/' || n as ratio_in_study, md5(pop_items) as pop_items, case when term = 'ROOT' then 0 when term like 'N%' then 2 else 1 end as depth from found join i using (term) where q < 0.05 and k / n::double > m / o::double")
def enrichment_report(t: Tables) -> DataFrame:
    closed = ontology.closure(_edges(t))
    info = ontology.term_levels(_edges(t)).withColumns({"name": F.when(F.col("term").startswith("N"), F.concat(F.lit("name of "), "term")), "definition": F.lit(None).cast("string")})
    out = ontology.enrichment_report(_enriched(t), t.customer.select(F.col("c_custkey").alias("gene")), ontology.propagate(_members(t), closed), info)
    return out.select("variant", "grp", "term_id", "term", "gene_ratio", "ratio_in_study", F.md5("pop_items").alias("pop_items"), "depth")


@query("with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1 union all select p_partkey, p_partkey // 6 from part where p_partkey > 6 and p_partkey % 5 = 0), w as (select distinct parent as term, 0 as d from e where parent not in (select child from e) union select child, d + 1 from w join e on e.parent = w.term) select term, min(d) as level, max(d) as depth from w group by 1")
def term_levels(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    edges = t.part.where(p > 1).select(p.alias("child"), F.floor(p / 2).alias("parent")).unionByName(t.part.where((p > 6) & (p % 5 == 0)).select(p.alias("child"), F.floor(p / 6).alias("parent")))
    return ontology.term_levels(edges)


@query("with p as (select part.*, case when p_partkey % 3 = 0 then '+' when p_partkey % 3 = 1 then '-' end as strand, case when p_size > 45 then null when p_size % 2 = 0 then 'a' else 'b' end as kind from part) select p_partkey, coalesce(kind = 'a', false)::int as kind_a, coalesce(kind = 'b', false)::int as kind_b, (kind is null)::int as kind_nan, case strand when '+' then 1 when '-' then 0 end as strand, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6) as \"x.price\", p_size from p")
def transform_map(t: Tables) -> DataFrame:
    p = F.col("p_partkey") % 3
    rows = t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("x.price"), F.when(p == 0, "+").when(p == 1, "-").alias("strand"), F.when(F.col("p_size") > 45, None).when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("kind"))
    kinds = {"p_partkey": "set_index", "kind": "OneHotEncoder", "strand": "binary_encoding", "absent": "StandardScaler", "x.price": "StandardScaler"}
    return ml.transform_map(rows, kinds, ["p_size"], "p_partkey").withColumn("x.price", six("`x.price`"))


@query("with p as (select *, p_size / 50.0 as dr, p_partkey % 10 as c, case when p_partkey % 11 > 0 then p_retailprice end as x from part), f as (select * from p where x is not null) select 'all' as split, count(*) as n, 0.0::double as mean, 1.0::double as std from f union all select 'DR_gt_p35', count(*), 0.0, 1.0 from f where dr > 0.35 union all select 'DR_le_p35', count(*), 0.0, 1.0 from f where dr <= 0.35 "
       "union all select 'nonWT', count(*), round(avg((x - (select avg(x) from f)) / (select stddev_pop(x) from f)), 6), round(stddev_pop(x) / (select stddev_pop(x) from f), 6) from f where c <> 9")
def model_splits(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("DR"), (F.col("p_partkey") % 10).alias("DIT_HAP_cluster"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_retailprice")).alias("x"))
    sets = ml.model_splits(rows, {"p_partkey": "set_index", "x": "StandardScaler"}, ["DR", "DIT_HAP_cluster"], "p_partkey")
    return stats.union_all([df.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"), (six(F.avg("x")) + 0.0).alias("mean"), six(F.stddev_pop("x")).alias("std")) for name, df in sets.items()])


@query("select p_partkey as gene_systematic_id, least(p_retailprice, 200)::double as density, s_size as \"um_DIT_HAP\", s_acctbal as \"um_gRNA\" from part left join (select p_partkey as k, p_size as s_size from part where p_partkey % 2 = 0) on p_partkey = k left join supplier on p_partkey = s_suppkey")
def fitness_table(t: Tables) -> DataFrame:
    proteins = t.part.select(F.col("p_partkey").alias("gene_systematic_id"), F.col("p_retailprice").alias("density"))
    clusters = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("Systematic ID"), F.col("p_size").alias("DR"))
    return relational.fitness_table(proteins, clusters, t.supplier.select(F.col("s_suppkey").alias("Systematic ID"), F.col("s_acctbal").alias("um")), ["density", "absent"])


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(corr(l_extendedprice, l_quantity), 6) as r, count(*) as n from lineitem where case when l_partkey % 4 > 0 then l_linestatus end is distinct from 'O' group by 1")
def regression_without_reference(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("sample", F.when(F.col("l_partkey") % 4 > 0, F.col("l_linestatus")))
    out = stats.ols_without(rows, "sample", "O", "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), six("r").alias("r"), "n")


@query()
def dispersion_scores(t: Tables) -> DataFrame:
    """All six measures of groups of 3 to 300, 200 draws each."""
    rows = coherence.size_window(points(t).withColumn("grp", F.floor(F.col("vec_id") / 25)), "grp", 3, 300)
    return coherence.dispersion_scores(rows, points(t), "grp", "vec_id")


@query()
def model_search(t: Tables) -> DataFrame:
    """Every model of the last rung with its out-of-fold error, and the ensemble chosen from them."""
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_quantity", "l_discount", "l_tax", F.dayofyear("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"))
    return search.model_search(rows, ["l_quantity", "l_discount", "l_tax", "day", "absent"], "price", ["key"]).leaderboard
