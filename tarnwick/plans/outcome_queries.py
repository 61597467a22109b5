"""Queries of the outcome labels, the outlier groups and the attribution of loose groups.

Orders stand in for verified genes; the SQL states each rule by itself, in its own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import semantics as S
from tarnwick.operators import coherence, ontology, relational
from tarnwick.plans import features, outcomes, stages
from tarnwick.plans.registry import Tables, query

_GENES = """select o_orderkey as gene, case when o_orderkey % 3 = 0 then 'SPAC' || o_orderkey when o_orderkey % 50 = 1 then 'mal1' else 'gen' || o_orderkey end as gene_name,
 case when o_custkey % 2 = 0 then 'E' when o_custkey % 7 = 0 then null else 'V' end as ver, case o_orderstatus when 'F' then 'E' when 'O' then ' V ' else 'n.d.' end as lib,
 case when o_orderkey % 11 = 0 then null else 0.75 + (o_custkey % 25) / 100.0 end as r2, 40 + o_custkey % 80 as colonies, (o_custkey % 101) / 100.0 as fraction,
 case when o_orderkey % 13 = 0 then '菌落很小' when o_orderkey % 17 = 0 then 'good' end as comments,
 case o_orderpriority when '1-URGENT' then 'condition-dependent' when '2-HIGH' then 'viable' when '3-MEDIUM' then 'inviable' end as fypo,
 case when o_orderkey % 5 > 0 then (o_custkey % 40) / 100.0 end as area from orders"""
_LABELS = f"""g as ({_GENES}), c as (select *, case when lib = 'n.d.' then 'no_library_ref' when lib = 'E' and ver = 'E' then 'concordant_E' when lib = ' V ' and ver = 'V' then 'concordant_V' when lib = ' V ' and ver = 'E' then 'flip_V2E' else 'flip_E2V' end as concordance,
 concat_ws(';', case when gene_name = 'mal1' then 'noised_gene' end, case when comments like '%小%' then 'borderline_comment' end, case when r2 < 0.8 then 'poor_fit' end, case when colonies < 50 then 'thin_colonies' end, case when fraction < 0.5 then 'low_filter_fraction' end) as reasons from g),
 o as (select *, reasons <> '' as doubt, case when reasons <> '' then 'ambiguous' else concordance end as outcome from c)"""


def _genes(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("gene"), F.when(k % 3 == 0, F.concat(F.lit("SPAC"), k)).when(k % 50 == 1, "mal1").otherwise(F.concat(F.lit("gen"), k)).alias("gene_name"),
        F.when(c % 2 == 0, "E").when(c % 7 != 0, "V").alias("verification_essentiality"), S.lookup(F.col("o_orderstatus"), {"F": "E", "O": " V ", "P": "n.d."}).alias("DeletionLibrary_essentiality"),
        F.when(k % 11 != 0, F.round(0.75 + (c % 25) / 100, 2)).alias("R2"), (40 + c % 80).alias("total_colonies"), ((c % 101) / 100).alias("filtering_fraction"),
        F.when(k % 13 == 0, "菌落很小").when(k % 17 == 0, "good").alias("comments"),
        S.lookup(F.col("o_orderpriority"), {"1-URGENT": "condition-dependent", "2-HIGH": "viable", "3-MEDIUM": "inviable"}).alias("FYPOviability"), F.when(k % 5 > 0, (c % 40) / 100).alias("median_area_day6"))


@query(f"with {_LABELS} select gene, concordance as essentiality_concordance, reasons as qc_flag_reason, comments is not null as has_any_comment, outcome from o")
def outcome_labels(t: Tables) -> DataFrame:
    return outcomes.outcome_table(_genes(t)).select("gene", "essentiality_concordance", "qc_flag_reason", "has_any_comment", "outcome")


@query(f"with {_LABELS} select gene, outcome, case outcome when 'flip_V2E' then 0 when 'concordant_E' then 1 when 'flip_E2V' then 2 else 9 end as priority from o where left(gene_name, 3) in ('SPA', 'SPB') and r2 >= 0.98 and not doubt")
def novel_genes(t: Tables) -> DataFrame:
    return outcomes.novel_genes(outcomes.outcome_table(_genes(t))).select("gene", "outcome", "priority")


@query(f"with {_LABELS}, d as (select *, (r2 < 0.8) is true or colonies < 52 or gene_name = 'mal1' or fraction < 0.88 as bad, coalesce(fypo = 'condition-dependent', false) as cond from o where doubt) "
       "select gene, case when bad then case when cond then 'both' else 'data_quality' end when cond then 'biology_condition_dependent' when reasons = 'borderline_comment' then 'borderline_observation' else 'unattributed' end as failure_cause from d")
def failure_causes(t: Tables) -> DataFrame:
    return outcomes.failure_causes(outcomes.outcome_table(_genes(t))).select("gene", "failure_cause")


@query(f"with {_LABELS}, f as (select *, coalesce(area, 0) > 0.1 as grows from o where concordance in ('flip_V2E', 'flip_E2V')) "
       "select gene, case when fypo = 'condition-dependent' then 'condition_dependent_annotation' when concordance = 'flip_V2E' and fypo = 'viable' then 'unconditional_viable_to_essential' when concordance = 'flip_E2V' and fypo = 'inviable' then 'unconditional_essential_to_viable' else 'other' end as flip_reason, "
       "grows as day6_grows, (concordance = 'flip_E2V') = grows as area_confirms_flip from f")
def flip_reasons(t: Tables) -> DataFrame:
    return outcomes.flips(outcomes.outcome_table(_genes(t))).select("gene", "flip_reason", "day6_grows", "area_confirms_flip")


_OUTLIERS = """select p_partkey, p_size / 50.0 as dr, case p_size % 5 when 0 then 'WT-like' when 1 then 'small colonies' when 2 then 'spores' when 3 then 'germinated' else 'spores, germinated' end as cat,
 case when p_size % 4 = 0 then null when p_size % 4 = 1 then 'E' else 'V' end as e from part"""


@query(f"with g as ({_OUTLIERS}) select 'WT2nonWT' as bucket, count(*) as n from g where cat = 'WT-like' and dr > 0.35 union all select 'scE2E', count(*) from g where cat = 'small colonies' and dr > 0.75 and e = 'E' "
       "union all select 'sc2E', count(*) from g where cat = 'small colonies' and dr > 0.75 and (e is null or e <> 'E') union all select 'E2V', count(*) from g where cat in ('spores', 'germinated', 'microcolonies') and dr < 0.35")
def outlier_buckets(t: Tables) -> DataFrame:
    groups, g = stages.outlier_groups(), _outlier_genes(t)
    return g.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, (cond, _) in groups.items()]).unpivot([], list(groups), "bucket", "n")


def _outlier_genes(t: Tables) -> DataFrame:
    r, kind = F.col("p_size") % 4, F.col("p_size") % 5
    cat = S.label([(kind == 0, "WT-like"), (kind == 1, "small colonies"), (kind == 2, "spores"), (kind == 3, "germinated")], "spores, germinated")
    return t.part.select(F.col("p_partkey").alias("Systematic_ID"), (F.col("p_size") / 50.0).alias("DR"), cat.alias("Category"), F.when(r == 1, "E").when(r > 1, "V").alias("DeletionLibrary_essentiality"))


@query(f"with g as ({_OUTLIERS}), v as (select distinct l_partkey, case l_linenumber when 1 then 'spores' when 2 then 'E' when 3 then 'WT' else 'odd' end as res from lineitem where l_quantity > 48) "
       "select 'E2V' as grp, coalesce(res, 'Not verified') as bucket, count(distinct p_partkey) as genes, round(avg(dr), 6) as mean_dr from g left join v on p_partkey = l_partkey where cat in ('spores', 'germinated', 'microcolonies') and dr < 0.35 and coalesce(res, '') <> 'odd' group by 2")
def verification_buckets(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    verified = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("Systematic_ID"), S.label([(line == 1, "spores"), (line == 2, "E"), (line == 3, "WT")], "odd").alias("result"))
    rows = stages.outlier_review(_outlier_genes(t), verified, "E2V")
    return rows.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("genes"), F.round(F.avg("DR"), 6).alias("mean_dr"))


@query("with m as (select distinct p_brand as g, p_size as k from part), s as (select k from m group by 1 having count(*) > 1) select g as grp, round(count(s.k) / count(*)::double, 6) as shared_fraction from m left join s on m.k = s.k group by 1")
def shared_fraction(t: Tables) -> DataFrame:
    return relational.shared_fraction(t.part, "p_brand", "p_size").select(F.col("p_brand").alias("grp"), F.round("shared_fraction", 6).alias("shared_fraction"))


@query("select p_partkey as k, case when p_size % 5 = 0 then 'major_minor_split' when p_size % 7 > 0 and p_size / 50.0 >= 0.5 then 'shared_subunits' when p_size % 3 = 0 then 'data_limited' else 'intrinsic_heterogeneity' end as cause from part")
def loose_causes(t: Tables) -> DataFrame:
    s = F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("k"), S.label([(s % 5 == 0, "split"), (s % 3 == 0, "too few members")], "one component").alias("reason"), F.when(s % 7 > 0, s / 50.0).alias("shared_fraction"))
    return coherence.attribution(rows).select("k", "cause")


@query("select l_orderkey as k1, l_linenumber as k2, case when l_partkey % 4 = 0 then l_linenumber = 1 else l_quantity = max(l_quantity) over (partition by l_orderkey) end as primary_candidate from lineitem")
def primary_transcripts(t: Tables) -> DataFrame:
    top = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.max("l_quantity").alias("longest"))
    known = F.when(F.col("l_partkey") % 4 == 0, "SPBC119.04").otherwise("SPAC1.01")
    rows = t.lineitem.join(top, F.col("l_orderkey") == F.col("o")).select("l_orderkey", "l_linenumber", known.alias("gene"), F.concat(F.lit("m."), "l_linenumber").alias("mrna"), "l_quantity", "longest")
    flag = features.primary_candidate(F.col("gene"), F.col("mrna"), F.col("l_quantity"), F.col("longest"))
    return rows.select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), flag.alias("primary_candidate"))


_TERMS = "select distinct 'T:' || l_suppkey as term, 'term ' || l_suppkey as name from lineitem where l_suppkey % 3 > 0"


def _terms(t: Tables) -> DataFrame:
    return t.lineitem.where("l_suppkey % 3 > 0").select(F.concat(F.lit("T:"), "l_suppkey").alias("term"), F.concat(F.lit("term "), "l_suppkey").alias("name")).distinct()


@query(f"with n as ({_TERMS}) select 'G' || l_partkey as \"DB_Object_ID\", 'T:' || l_suppkey as \"GO_ID\", coalesce(name, 'No record for T:' || l_suppkey) as \"DB_Object_Name\", strftime(l_shipdate, '%Y%m%d') as \"Date\", 'FYPO' as \"Aspect\", 'taxon:4896' as \"Taxon\", l_orderkey || '/' || l_linenumber as \"Reference\" "
       "from lineitem left join n on term = 'T:' || l_suppkey where l_returnflag <> 'N' and l_linenumber <> 2")
def phenotype_associations(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    condition = F.when(F.col("l_linenumber") != 2, "FYECO:0000001,FYECO:0000005").otherwise("FYECO:0000001")
    phaf = t.lineitem.select(
        F.concat(F.lit("G"), "l_partkey").alias("Gene systematic ID"), F.lit("g").alias("Gene symbol"), F.concat(F.lit("T:"), "l_suppkey").alias("FYPO ID"), S.lookup(flag, {"A": "deletion", "R": "disruption", "N": "other"}).alias("Allele type"),
        condition.alias("Condition"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("Reference"), F.lit("ev").alias("Evidence"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), F.lit("DB").alias("#Database name"), F.lit("").alias("Extension"))
    return ontology.phenotype_gaf(phaf, _terms(t)).select("DB_Object_ID", "GO_ID", "DB_Object_Name", "Date", "Aspect", "Taxon", "Reference")


@query(f"with n as ({_TERMS}) select l_orderkey || '/' || l_linenumber as \"Reference\", coalesce(name, 'No record for T:' || l_suppkey) as \"DB_Object_Name\", case when l_linenumber = 1 then '20250901' else strftime(l_shipdate, '%Y%m%d') end as \"Date\", 'Pombase' as \"DB\", 'PomBase' as \"Assigned_By\" from lineitem left join n on term = 'T:' || l_suppkey")
def disease_associations(t: Tables) -> DataFrame:
    date = F.when(F.col("l_linenumber") != 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = t.lineitem.select(F.lit("G").alias("#gene_systematic_id"), F.lit("g").alias("gene_name"), F.concat(F.lit("T:"), "l_suppkey").alias("mondo_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("reference"), date.alias("date"))
    return ontology.disease_gaf(rows, _terms(t)).select("Reference", "DB_Object_Name", "Date", "DB", "Assigned_By")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order that they come in: ids of rows grow along sorted partitions."""
    return relational.numbered(rows.withColumn("__o", F.monotonically_increasing_id()), [F.col("__o")], "place")


@query(f"with {_LABELS}, n as (select gene, r2, case outcome when 'flip_V2E' then 0 when 'concordant_E' then 1 when 'flip_E2V' then 2 else 9 end as priority from o where left(gene_name, 3) in ('SPA', 'SPB') and r2 >= 0.98 and not doubt) "
       "select gene, row_number() over (order by priority, r2 desc, gene) - 1 as place from n")
def novel_genes_in_order(t: Tables) -> DataFrame:
    return _in_order(outcomes.novel_genes(outcomes.outcome_table(_genes(t)))).select("gene", "place")


@query(f"with g as ({_OUTLIERS}), v as (select distinct l_partkey, case l_linenumber when 1 then 'spores' when 2 then 'E' when 3 then 'WT' else 'odd' end as res from lineitem where l_quantity > 48), "
       "r as (select p_partkey, dr, res, case when res is null then 1 when res = 'spores' then 2 when res = 'E' then 5 else 9 end as no from g left join v on p_partkey = l_partkey where cat in ('spores', 'germinated', 'microcolonies') and dr < 0.35 and coalesce(res, '') <> 'odd') "
       "select p_partkey as gene, coalesce(res, 'Not verified') as bucket, row_number() over (order by no, dr, p_partkey) - 1 as place from r")
def outlier_review_in_order(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    verified = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("Systematic_ID"), S.label([(line == 1, "spores"), (line == 2, "E"), (line == 3, "WT")], "odd").alias("result"))
    rows = _in_order(stages.outlier_review(_outlier_genes(t), verified, "E2V"))
    return rows.select(F.col("Systematic_ID").alias("gene"), "bucket", "place")
