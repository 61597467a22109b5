"""Queries of the feature levels and of the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import sequence as Q
from tarnwick.operators import cluster, ml, ontology, relational
from tarnwick.plans import features as L
from tarnwick.plans.registry import Tables, query, six


@query("select p_partkey as \"Gene_id\", length(p_name) as cds_length, least(p_size, 100 - p_size - 10)::double as to_telomere, abs(p_size + 5 - 40)::double as to_centromere from part")
def dna_level(t: Tables) -> DataFrame:
    genes = t.part.select(F.col("p_partkey").alias("Gene_id"), F.lit("I").alias("chromosome"), F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("end"), F.col("p_name").alias("sequence"))
    chrom = t.spark.createDataFrame([("I", 100, 40)], "chromosome string, length int, centromere int")
    return L.dna_level(genes, chrom).select("Gene_id", F.col("cds_length").cast("long").alias("cds_length"), "to_telomere", "to_centromere")


@query("with r as (select l_orderkey, l_linenumber, [x for x in [case when l_discount > 0.03 then l_discount end, l_tax, l_quantity / 100] if x is not null] as v from lineitem) select l_orderkey, l_linenumber, round(list_avg(v), 6) as mean, round(list_stddev_samp(v), 6) as std from r")
def replicate_columns(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.monotonically_increasing_id().alias("id"), "l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 100).alias("c"))
    rows = rows.withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    out = L.replicates(rows, "key", {"r": ["a", "b", "c"]})
    return out.select("key.*", six("r_mean").alias("mean"), six("r_std").alias("std"))


@query("with p as (select distinct l_suppkey as a, l_partkey as b, case when l_returnflag = 'N' then 'physical' else 'genetic' end as kind from lineitem), d as (select a, count(*) filter (kind = 'physical') as physical, count(*) filter (kind = 'genetic') as genetic from p group by 1), r as (select s_suppkey as a, count(distinct s_nationkey) as terms from supplier where s_suppkey % 2 = 0 group by 1) select coalesce(d.a, r.a) as \"Gene_id\", physical, genetic, terms from d full outer join r on d.a = r.a")
def network_level(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.when(F.col("l_returnflag") == "N", "physical").otherwise("genetic").alias("kind"))
    return L.network_level(pairs, t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("Gene_id"), F.col("s_nationkey").alias("term")))


@query("with m as (select distinct 'order' as kind, cast(o_orderpriority as varchar) as grp, o_custkey as gene from orders union all select 'segment', c_mktsegment, c_custkey from customer), n as (select gene, count(distinct kind || '/' || grp) as groups from m group by 1) select m.*, groups from m join n using (gene)")
def foundation(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("gene")).distinct()
    return L.foundation(a, t.customer.select(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("gene")))


@query("select o_orderstatus, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percent from orders group by 1")
def donut(t: Tables) -> DataFrame:
    return L.donut(t.orders, "o_orderstatus").select("o_orderstatus", "n", six("percent").alias("percent"))


@query("select p_type, round(quantile_cont(p_retailprice, 0.25), 6) as q25, round(quantile_cont(p_retailprice, 0.5), 6) as q50, round(quantile_cont(p_retailprice, 0.75), 6) as q75, count(*) as n, case p_type when 'ECONOMY' then 1 when 'PROMO' then 2 when 'SMALL' then 3 end as place from part where p_type in ('ECONOMY', 'PROMO', 'SMALL') group by 1")
def box_table(t: Tables) -> DataFrame:
    b = L.box_table(t.part, "p_type", "p_retailprice", ["ECONOMY", "PROMO", "SMALL"])
    return b.select("p_type", *[six(c).alias(c) for c in ("q25", "q50", "q75")], "n", F.col("place").cast("int").alias("place"))


@query("with p as (select p_name as term, p_brand as variant, 1.0 / (p_partkey + 1) as p from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3')), b as (select term from p group by 1 order by min(p), 1 limit 15) select term, round(coalesce(max(-log10(p)) filter (variant = 'Brand#1'), 0), 6) as v1, round(coalesce(max(-log10(p)) filter (variant = 'Brand#2'), 0), 6) as v2, round(coalesce(max(-log10(p)) filter (variant = 'Brand#3'), 0), 6) as v3 from p join b using (term) group by 1")
def variant_heatmap(t: Tables) -> DataFrame:
    names = ["Brand#1", "Brand#2", "Brand#3"]
    rows = t.part.where(F.col("p_brand").isin(names)).select(F.col("p_name").alias("term"), F.col("p_brand").alias("variant"), (1.0 / (F.col("p_partkey") + 1)).alias("p"))
    return L.variant_heatmap(rows, names, 15).select("term", *[six(F.col(f"`{n}`")).alias(f"v{i}") for i, n in enumerate(names, 1)])


@query("with r as (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as k from customer) select c_nationkey, c_custkey, round(c_acctbal, 6) as c_acctbal from r where k <= 3")
def largest_per_group(t: Tables) -> DataFrame:
    rows = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    order = F.struct((-F.col("c_acctbal")).alias("v"), "c_custkey")
    return L.extremes(rows, ["c_nationkey"], order, 3).withColumn("c_acctbal", six("c_acctbal"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * 1000, 4) as residual from lineitem")
def residuals(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return L.residuals(rows, "y", "p").select("l_orderkey", "l_linenumber", F.round("residual", 4).alias("residual"))


@query("select distinct upper(n_name) as name, n_regionkey from nation")
def distinct_rows(t: Tables) -> DataFrame:
    return t.nation.select(F.upper("n_name").alias("name"), "n_regionkey").distinct()


@query("select n_nationkey as k from nation intersect select s_nationkey from supplier except select c_nationkey from customer where c_acctbal > 9900")
def set_operations(t: Tables) -> DataFrame:
    n, s, c = t.nation.select(F.col("n_nationkey").alias("k")), t.supplier.select("s_nationkey"), t.customer.where("c_acctbal > 9900").select("c_nationkey")
    return n.intersect(s).subtract(c)


@query("select o_custkey, o_orderkey, max(o_orderdate) over w as last_date, round(sum(o_totalprice) over w, 2) as running from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)")
def ext_running_sum(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.orders.select("o_custkey", "o_orderkey", F.max("o_orderdate").over(w).alias("last_date"), F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("with e as (select user_id, event_id, ts from events where event_type = 'purchase'), v as (select user_id, ts as vt, event_id as vid from events where event_type = 'view'), j as (select e.*, vid, row_number() over (partition by e.event_id order by vt desc nulls last, vid desc) as k from e left join v on e.user_id = v.user_id and vt <= ts) select user_id, event_id, vid from j where k = 1")
def ext_asof_join(t: Tables) -> DataFrame:
    """Latest view before each purchase: one sort of both kinds together, no pairs."""
    from pyspark.sql.window import Window

    rows = t.events.where(F.col("event_type").isin("purchase", "view"))
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("v", F.max(view).over(w))
    return found.where("event_type = 'purchase'").select("user_id", "event_id", F.col("v.event_id").alias("vid"))


#: Upper case of these alone, as engines differ on letters that have no single capital.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WEIGHED = " + ".join(f"(length(x) - length(replace(x, '{a}', ''))) * {m}" for a, m in Q.MASS.items())


@query(f"select doc_id, round({Q.WATER} + {_WEIGHED}, 3) as mass from (select doc_id, translate(text, '{_LETTERS}', upper('{_LETTERS}')) as x from documents)")
def peptide_masses(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(Q.monoisotopic_mass(F.translate("text", _LETTERS, _LETTERS.upper())), 3).alias("mass"))


@query("with l as (select n_regionkey, arg_max(n_name, n_nationkey) as n_name from nation where n_regionkey > 0 group by 1) select s_suppkey, s_nationkey, n_name from supplier left join l on s_nationkey = n_regionkey")
def left_lookup(t: Tables) -> DataFrame:
    names = t.nation.where("n_regionkey > 0").select(F.col("n_regionkey").alias("s_nationkey"), "n_name", "n_nationkey")
    return relational.lookup_last(t.supplier.select("s_suppkey", "s_nationkey"), names, ["s_nationkey"], "n_name", [F.col("n_nationkey")])


@query("with a as (select p_partkey as k, p_size + (p_partkey % 5) / 2 as m, (p_partkey % 5) / sqrt(2) as s from part where p_partkey % 2 = 0), b as (select s_suppkey as k, s_acctbal from supplier where s_suppkey % 2 = 0) select coalesce(a.k, b.k) as \"Gene_id\", round(m, 3) as mean, round(s, 3) as std, round(s_acctbal, 3) as half_life from a full outer join b on a.k = b.k")
def rna_level(t: Tables) -> DataFrame:
    abundance = t.part.select(F.col("p_partkey").alias("Gene_id"), F.col("p_partkey").alias("row_no"), F.col("p_size").alias("r1"), (F.col("p_size") + F.col("p_partkey") % 5).alias("r2"))
    kinetics = t.supplier.select(F.col("s_suppkey").alias("Gene_id"), F.col("s_suppkey").alias("row_no"), F.col("s_acctbal").alias("half_life"))
    coding = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("Gene_id"))
    out = L.rna_level(abundance, {"m": ["r1", "r2"]}, kinetics, coding)
    return out.select("Gene_id", F.col("m_mean").alias("mean"), F.col("m_std").alias("std"), "half_life")


@query("with g as (select c_custkey as k, case when c_custkey % 3 = 0 then 'E' else 'V' end as e from customer where c_custkey % 5 <> 0) select k as \"Gene_id\", e as essentiality, case when k % 4 = 0 then case when k % 8 = 0 then 'E' end else e end as revised_essentiality, c_nationkey as viability from g join customer on k = c_custkey where c_custkey % 2 = 0")
def phenotype_level(t: Tables) -> DataFrame:
    key = F.col("c_custkey").alias("Gene_id")
    library = t.customer.where("c_custkey % 5 <> 0").select(key, F.when(F.col("c_custkey") % 3 == 0, "E").otherwise("V").alias("essentiality"))
    verified = t.customer.where("c_custkey % 4 = 0").select(key, F.when(F.col("c_custkey") % 8 == 0, "E").alias("verified"))
    viability = t.customer.where("c_custkey % 5 <> 0").select(key, F.col("c_nationkey").alias("viability"))
    return L.phenotype_level(library, verified, [viability], t.customer.where("c_custkey % 2 = 0").select(key))


@query("with h as (select p_partkey, 'hash' as module from part where contains(lower(p_brand), '#1') and not contains(lower(p_brand), '#11') union all select p_partkey, 'even' from part where contains(p_brand, '2') or contains(p_brand, '4')) select module, count(distinct p_partkey) as n, min(p_partkey) as first from h group by 1")
def keyword_modules(t: Tables) -> DataFrame:
    found = L.modules(t.part, "p_brand", "p_partkey", [("hash", ["#1"], ["#11"]), ("even", ["2", "4"], [])])
    return found.select("module", F.col("n").cast("long").alias("n"), F.element_at("genes", 1).alias("first"))


@query("select o_orderkey, coalesce(s, 'Not verified') as bucket, case when s is null then 1 when s = 'O' then 2 else 3 end as bucket_no from (select o_orderkey, case when o_orderkey % 7 > 0 then o_orderstatus end as s from orders) where s is null or s in ('O', 'F')")
def ordered_buckets(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("s"))
    return relational.bucketed(rows, "s", ["O", "F"]).select("o_orderkey", "bucket", "bucket_no")


@query("select 't' || p_partkey as term_id, case p_size % 4 when 0 then 'KEGG Pathways' when 1 then 'Biological Process (Gene Ontology)' when 2 then 'Annotated Keywords (UniProt)' end as namespace, round_even(p_size / 60, 2) as gene_ratio, round_even(p_size / (p_size + 7), 2) as term_coverage, p_size || '/60' as ratio_in_study, (p_size + 7) || '/5000' as ratio_in_pop from part")
def web_enrichment(t: Tables) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(x) for x in ("KEGG", "Process", "Keyword", "Other")]), F.col("p_size") % 4 + 1)
    rows = t.part.select(F.concat(F.lit("t"), "p_partkey").alias("term"), category.alias("category"), F.col("p_name").alias("description"), F.lit(0.01).alias("p_value"), F.lit(0.02).alias("fdr"),
                         F.col("p_size").alias("number_of_genes"), (F.col("p_size") + 7).alias("number_of_genes_in_background"), F.lit("a,b").alias("preferredNames"))
    return ontology.web_enrichment(rows, 60, 5000).select("term_id", "namespace", "gene_ratio", "term_coverage", "ratio_in_study", "ratio_in_pop")


@query("with e as (select p_partkey, p_size from part) select e.*, case when p_size % 2 = 0 then p_size / 100 end as \"Dispensability_0.7\", case when p_size % 3 = 0 then p_size / 100 end as \"Dispensability_0.4\" from e")
def redundancy_columns(t: Tables) -> DataFrame:
    def response(n: int) -> DataFrame:
        return t.part.where(F.col("p_size") % n == 0).select("p_partkey", (F.col("p_size") / 100).alias("Dispensability"), F.lit(False).alias("Eliminated"), F.lit("r").alias("Representative"))

    found = ontology.redundancy(t.part.select("p_partkey", "p_size"), {0.7: response(2), 0.4: response(3)}, ("p_partkey",))
    return found.select("p_partkey", "p_size", F.col("`Dispensability_0.7`"), F.col("`Dispensability_0.4`"))


@query("with p as (select p_partkey, upper(p_name) as s from part) select p_partkey, round(10.0 * list_sum(list_transform(range(1, length(s)), lambda i: case substr(s, i::int, 2) when 'RE' then -6.54 when 'ST' then 20.26 else 1.0 end)) / length(s), 6) as instability from p")
def instability_index(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", six(Q.instability(F.col("p_name"), {"RE": -6.54, "ST": 20.26})).alias("instability"))


@query()
def peptide_scales(t: Tables) -> DataFrame:
    peptide = F.regexp_replace(F.upper("p_name"), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    # A small file is one task; the work is by row, so the rows are dealt out first.
    rows = t.part.select("p_partkey", "p_name").repartition(4 * t.spark.sparkContext.defaultParallelism)
    return rows.select("p_partkey", six(Q.flexibility(peptide)).alias("flexibility"), six(Q.isoelectric_point(peptide)).alias("isoelectric_point"), six(Q.charge_at(peptide, F.lit(7.0))).alias("charge"))


@query("select p_partkey, round(p_size - 25.0, 6) as back from part")
def power_round_trip(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") - 25).cast("double").alias("x"))
    params = ml.fit_power(rows.where("p_partkey % 5 <> 0"), ["x"])
    return ml.apply_power(rows, params).select("p_partkey", six(ml.invert_power(F.col("x"), params["x"])).alias("back"))


@query("select p_partkey, i as time, case i when 0 then p_size else p_retailprice end as observed, case i when 0 then p_size * 2.0 end as fitted from part, unnest([0, 1]) as u(i)")
def depletion_curves(t: Tables) -> DataFrame:
    wide = t.part.select("p_partkey", F.col("p_size").cast("double").alias("t0"), F.col("p_retailprice").alias("t1"), (F.col("p_size") * 2.0).alias("t0_fitted"))
    return L.curves(wide, ["t0", "t1"], "p_partkey")


@query("select l_returnflag as cluster, l_linestatus as variant, count(*) as n, count(distinct l_partkey) as terms from lineitem where l_discount < 0.05 group by 1, 2")
def terms_per_variant(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("cluster"), F.col("l_linestatus").alias("variant"), F.col("l_partkey").alias("term"), F.col("l_discount").alias("p"))
    return L.scored_terms(rows, 0.05, ["cluster", "variant"])


@query("select o_orderkey, o_totalprice, c_custkey as \"Gene_id\", c_acctbal from orders join customer on o_custkey = c_custkey and c_custkey % 2 = 0")
def assay_overlay(t: Tables) -> DataFrame:
    assay = t.orders.select(F.col("o_custkey").alias("alias"), "o_orderkey", "o_totalprice")
    alias = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("alias"), F.col("c_custkey").alias("Gene_id"))
    return L.assay_overlay(assay, alias, t.customer.select(F.col("c_custkey").alias("Gene_id"), "c_acctbal")).drop("alias")


@query()
def variant_scores(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_acctbal") > 4000).cast("int").alias("a"), (F.col("s_nationkey") % 3).alias("b"))
    return cluster.compare_variants({"a": rows.withColumn("raw", F.col("a")), "b": rows.withColumn("raw", F.col("b"))}, "s_suppkey", "raw")
