"""Queries of the relational, counting and string operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import semantics as S
from tarnwick.functions import strings as T
from tarnwick.operators import coherence, ml
from tarnwick.operators import relational as R
from tarnwick.plans import stages
from tarnwick.plans.registry import Tables, query, six

#: lineitem as insertions: half the rows lie in genes, distances come from the numbers at hand.
INSERTIONS = """select l_orderkey as k1, l_linenumber as k2, l_partkey, l_suppkey, l_returnflag as flag, l_linestatus as status,
  case when l_returnflag = 'N' then 'Intergenic region' else 'gene' end as kind, cast(l_quantity as bigint) - 10 as d_stop,
  cast(floor(l_extendedprice / 100) as bigint) as d_start, l_discount, l_extendedprice from lineitem"""


def insertions(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") == "N", "Intergenic region").otherwise("gene").alias("kind"), (F.col("l_quantity").cast("long") - 10).alias("d_stop"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("d_start"), "l_discount", "l_extendedprice")


@query(f"""with i as ({INSERTIONS}), g as (select p_partkey, case when p_size > 5 then p_size / 50.0 end as dr, case when p_size % 3 = 0 then 'E' when p_size % 3 = 1 then 'V' else 'n.d.' end as ess from part)
select 'insertions' as metric, 'all' as category, count(*) as total, count(*) filter (kind <> 'Intergenic region' and d_stop > 4) as covered, count(*) - count(*) filter (kind <> 'Intergenic region' and d_stop > 4) as not_covered from i
union all select 'insertions_by_status', status, count(*), count(*) filter (kind <> 'Intergenic region' and d_stop > 4), count(*) - count(*) filter (kind <> 'Intergenic region' and d_stop > 4) from i group by 2
union all select 'genes', 'all', count(*), count(dr), count(*) - count(dr) from g
union all select 'genes_by_essentiality', ess, count(*), count(dr), count(*) - count(dr) from g where ess in ('E', 'V') group by 2""")
def coverage_stats(t: Tables) -> DataFrame:
    cov = stages.in_gene(F.col("kind"), F.col("d_stop"))
    i = insertions(t)
    rest = F.col("p_size") % 3
    g = t.part.select(F.when(F.col("p_size") > 5, F.col("p_size") / 50.0).alias("dr"), F.when(rest == 0, "E").when(rest == 1, "V").otherwise("n.d.").alias("ess"))

    def counted(df, cat, covered):
        return df.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(covered).alias("covered"))

    return R.long_stats({"insertions": counted(i, F.lit("all"), cov), "insertions_by_status": counted(i, F.col("status"), cov), "genes": counted(g, F.lit("all"), F.col("dr").isNotNull()),
                         "genes_by_essentiality": counted(g.where(F.col("ess").isin("E", "V")), F.col("ess"), F.col("dr").isNotNull())})


@query(f"with i as ({INSERTIONS}) select flag, status, count(*) as total, count(*) filter (kind <> 'Intergenic region' and d_stop > 4) as in_gene, count(*) - count(*) filter (kind <> 'Intergenic region' and d_stop > 4) as rest, count(*) filter (l_discount > 0.05) as covered from i group by 1, 2")
def coverage_by_group(t: Tables) -> DataFrame:
    covered = F.col("l_discount") > 0.05
    return R.coverage(insertions(t), ["flag", "status"], stages.in_gene(F.col("kind"), F.col("d_stop")), covered)


@query(f"with i as ({INSERTIONS}), r as (select *, row_number() over (partition by k1 order by case when kind <> 'Intergenic region' and d_stop > 4 then 0 else 1 end, k2, d_stop, kind) as n from i) select k1, k2, kind, d_stop from r where n = 1")
def dedupe_priority(t: Tables) -> DataFrame:
    return R.dedupe_priority(insertions(t), ["k1"], stages.in_gene(F.col("kind"), F.col("d_stop")), [F.col("k2"), F.col("d_stop"), F.col("kind")]).select("k1", "k2", "kind", "d_stop")


@query("with l as (select l_orderkey as o_orderkey, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) select o.o_orderkey, round(l.q, 6) as q from orders o left join l using (o_orderkey)")
def reindex_left(t: Tables) -> DataFrame:
    table = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return R.reindex_left(t.orders, table, ["o_orderkey"]).select("o_orderkey", six("q").alias("q"))


@query("select p_partkey, p_size as \"DR\", round(p_retailprice, 6) as \"DL\" from part")
def legacy_names(t: Tables) -> DataFrame:
    return R.normalize_metrics(t.part.select("p_partkey", F.col("p_size").alias("um"), six("p_retailprice").alias("lam")))


@query(f"with i as ({INSERTIONS}) select k1, k2, round(case when d_start + d_stop = 0 then null else least(greatest(d_start / (d_start + d_stop)::double, 0), 1) end, 6) as fraction from i")
def insertion_fraction(t: Tables) -> DataFrame:
    return insertions(t).select("k1", "k2", six(S.insertion_fraction(F.col("d_start"), F.col("d_stop"))).alias("fraction"))


@query(f"with i as ({INSERTIONS}), h as (select p_partkey, p_name, p_size / 50.0 as dr from part where p_size / 50.0 > 0.15), f as (select l_partkey, case when d_start + d_stop = 0 then null else least(greatest(d_start / (d_start + d_stop)::double, 0), 1) end as x from i) select l_partkey as gene, count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, any_value(p_name) as name from f join h on l_partkey = p_partkey group by 1")
def domain_stats(t: Tables) -> DataFrame:
    genes = t.part.select(F.col("p_partkey").alias("Systematic_ID"), F.col("p_name").alias("Name"), (F.col("p_size") / 50.0).alias("um"))
    rows = insertions(t).select(F.col("l_partkey").alias("Systematic_ID"), F.col("d_start").alias("Distance_to_start_codon"), F.col("d_stop").alias("Distance_to_stop_codon"))
    return stages.domain_stage(rows, genes).select(F.col("Systematic_ID").alias("gene"), F.col("n_insertions").alias("n"), six("mean").alias("mean"), six("std").alias("std"), F.col("Name").alias("name"))


@query(f"with i as ({INSERTIONS}) select k1, k2, d_start, d_stop from i where kind = 'Intergenic region' and (d_start < 100 or d_stop < 5)")
def utr_near(t: Tables) -> DataFrame:
    rows = insertions(t).where(stages.near_gene(F.col("kind"), F.col("d_start"), F.col("d_stop"), 100, 5))
    return rows.select("k1", "k2", "d_start", "d_stop")


_UTR = """select l_orderkey as k1, l_linenumber as k2, cast(l_quantity as bigint) * 20 as s, cast(l_tax * 10000 as bigint) as e, case when l_linestatus = 'O' then '+' else '-' end as strand,
 case when l_suppkey % 2 = 0 then '+' else '-' end as gl, case when l_partkey % 2 = 0 then '+' else '-' end as gr, 'S' || l_suppkey as nl, 'P' || l_partkey as nr from lineitem"""


@query(f"with u as ({_UTR}), v as (select *, case when s < 400 and e > 400 then 'l' when s > 400 and e < 400 then 'r' when s < 400 and e < 400 and s <= e then 'l' when s < 400 and e < 400 then 'r' end as side from u), "
       "w as (select *, case side when 'l' then nl when 'r' then nr else '' end as gene, case when side = 'l' and gl = '+' then '3UTR' when side = 'l' then '5UTR' when side = 'r' and gr = '+' then '5UTR' when side = 'r' then '3UTR' else 'neither' end as utr, case side when 'l' then s else e end as near, case side when 'l' then gl else gr end as gs from v) "
       "select k1, k2, gene, utr, case utr when '3UTR' then near when '5UTR' then -near else 0 end as distance, case when side is null then '' when strand = gs then 'Forward' else 'Reverse' end as direction from w")
def utr_classify(t: Tables) -> DataFrame:
    def sign(c):
        return F.when(F.col(c) % 2 == 0, "+").otherwise("-")

    rows = t.lineitem.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), (F.col("l_quantity").cast("long") * 20).alias("Distance_to_region_start"), F.round(F.col("l_tax") * 10000).cast("long").alias("Distance_to_region_end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("Strand"), F.concat_ws("|", sign("l_suppkey"), sign("l_partkey")).alias("Strand_Interval"),
        F.concat(F.lit("S"), "l_suppkey", F.lit("|P"), "l_partkey").alias("Name")).withColumn("Systematic_ID", F.col("Name"))
    return stages.parental_gene(rows, 400).select("k1", "k2", F.col("Parental_gene").alias("gene"), F.col("UTR_type").alias("utr"), F.col("Distance_to_gene").alias("distance"), F.col("Direction").alias("direction"))


@query("select l_orderkey, l_linenumber, case when (p_size - 25) = 0 then (case when l_quantity > 0 then 'Infinity'::double end) else round(l_quantity / (p_size - 25), 6) end as r from lineitem join part on l_partkey = p_partkey")
def utr_ratio(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    r = S.ratio(F.col("l_quantity"), F.col("p_size") - 25)
    return rows.select("l_orderkey", "l_linenumber", F.when(F.abs(r) == S.INF, r).otherwise(six(r)).alias("r"))


@query("select p_partkey, case when p_retailprice > 1200 then 1200.0 else p_retailprice end as capped, case when p_size < 10 then 10 when p_size > 40 then 40 else p_size end as clamped from part")
def clip_and_clamp(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.clip_upper(F.col("p_retailprice"), 1200.0).alias("capped"), S.clamp(F.col("p_size"), 10, 40).alias("clamped"))


@query("select l_orderkey, l_linenumber, round(case when l_discount = 0 then '-Infinity'::double else log2(l_discount) end, 6) as l2, round(-log10(greatest(l_tax, 0.015)), 6) as nl from lineitem")
def logs_with_floor(t: Tables) -> DataFrame:
    l2 = S.log2_or_inf(F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(l2 == -S.INF, l2).otherwise(six(l2)).alias("l2"), six(S.neg_log10(F.col("l_tax"), 0.015)).alias("nl"))


@query("select l_partkey, l_suppkey, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std, round(stddev_samp(l_quantity) / avg(l_quantity), 6) as cv, count(*) as n from lineitem group by 1, 2")
def replicate_stats(t: Tables) -> DataFrame:
    return R.spread(t.lineitem, ["l_partkey", "l_suppkey"], "l_quantity").select("l_partkey", "l_suppkey", *[six(c).alias(c) for c in ("mean", "std", "cv")], "n")


@query("select l_orderkey, l_linenumber, round(list_avg([case when l_discount > 0.02 then l_discount end, case when l_tax > 0.02 then l_tax end]), 6) as m from lineitem")
def condition_mean(t: Tables) -> DataFrame:
    a, b = F.when(F.col("l_discount") > 0.02, F.col("l_discount")), F.when(F.col("l_tax") > 0.02, F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", six(S.mean_present(a, b)).alias("m"))


@query("select l.l_orderkey, l.l_linenumber, e.event_id from lineitem l left join (select user_id, event_type, min(event_id) as event_id from events group by 1, 2) e on e.user_id = l.l_orderkey % 1000 and e.event_type = case l.l_returnflag when 'A' then 'click' when 'N' then 'view' else 'purchase' end")
def positional_join(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    kind = S.lookup(F.col("l_returnflag"), {"A": "click", "N": "view", "R": "purchase"})
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 1000).alias("user_id"), kind.alias("event_type"))
    return rows.join(e, ["user_id", "event_type"], "left").select("l_orderkey", "l_linenumber", "event_id")


@query("with a as (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 5000 group by 1), b as (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 5000 group by 1), c as (select n_nationkey as k, n_name from nation where n_nationkey % 2 = 0) select k, customers, suppliers, n_name from a full outer join b using (k) full outer join c using (k)")
def full_outer_merge(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return R.merge_outer([a, b, t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), "n_name")], ["k"])


@query("select c.c_custkey, case when o.total is null and c.c_mktsegment = 'BUILDING' then 0.0 else round(o.total, 6) end as total from (select o_custkey, sum(o_totalprice) as total from orders group by 1) o right join customer c on o.o_custkey = c.c_custkey")
def right_zero_fill(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    rows = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").withColumn("total", six("total"))
    return R.zero_fill_when(rows, F.col("total").isNull() & (F.col("c_mktsegment") == "BUILDING"), ["total"]).select("c_custkey", "total")


@query("select 'semi' as kind, count(*) as n from customer where c_custkey in (select o_custkey from orders) union all select 'anti', count(*) from customer where c_custkey not in (select o_custkey from orders)")
def semi_anti(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_semi").agg(F.lit("semi").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(t.customer.join(keys, "c_custkey", "left_anti").agg(F.lit("anti").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("with m as (select distinct p_brand as g, p_size as v from part), o as (select a.g, a.v, b.g as other from m a join m b on a.v = b.v and a.g <> b.g) select g as p_brand, count(distinct v) as shared, count(distinct other) as n_others from o group by 1")
def shared_members(t: Tables) -> DataFrame:
    return R.shared_members(t.part, "p_brand", "p_size").select("p_brand", "shared", F.size("others").cast("long").alias("n_others"))


@query("select p_partkey, case when p_size > 25 then null else p_brand end as v, case when p_size <= 25 or p_partkey % 2 = 0 then case when p_size > 25 then null else p_brand end else p_type end as chosen from part")
def override_lookup(t: Tables) -> DataFrame:
    base = t.part.select("p_partkey", "p_type", F.col("p_type").alias("chosen"))
    other = t.part.where("p_size <= 25 or p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 25, None).otherwise(F.col("p_brand")).alias("v"))
    out = R.override(base, other, ["p_partkey"], "chosen", "v")
    return out.join(t.part.select("p_partkey", F.when(F.col("p_size") > 25, None).otherwise(F.col("p_brand")).alias("v")), "p_partkey").select("p_partkey", "v", "chosen")


@query("select p_partkey, p_brand, case when p_size % 5 = 0 then null else count(*) over (partition by p_brand, case when p_size % 5 = 0 then null else p_type end) end as copies from part")
def copy_number(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    return R.copies(t.part.withColumn("kind", kind), ["p_brand", "kind"]).select("p_partkey", "p_brand", "copies")


@query("select event_id, nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') as k, regexp_matches(event_type, '^(click|view)') as seen, cast(json_extract(props, '$.k') as integer) as j from events")
def regex_and_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.match_or_null(F.col("props"), '"k": ([0-9]+)').alias("k"), F.col("event_type").rlike("^(click|view)").alias("seen"), F.from_json("props", "k int")["k"].alias("j"))


@query("select c_custkey, string_split(c_name, '#')[2] as third, string_split(c_name, 'zzz')[2] as none, upper(left(c_mktsegment, 3)) || '.' || lower(c_mktsegment) as dotted, replace(cast(cast(c_nationkey as varchar) as varchar), '1', '') as cut, list_min(string_split(c_mktsegment, 'I')) as first_sorted, len(string_split(c_mktsegment, 'I')) as tokens from customer")
def string_fields(t: Tables) -> DataFrame:
    c = F.col("c_mktsegment")
    return t.customer.select("c_custkey", T.token(F.col("c_name"), "#", 2).alias("third"), T.token(F.col("c_name"), "zzz", 2).alias("none"), T.dotted_id_case(F.concat(F.substring(c, 1, 3), F.lit("."), c)).alias("dotted"),
                             F.regexp_replace(F.col("c_nationkey").cast("string"), "1", "").alias("cut"), T.first_sorted(c, "I").alias("first_sorted"), T.token_count(c, "I").cast("long").alias("tokens"))


_META = "select 'P' || p_partkey as id, p_brand || '-' || p_size as name, 'S' || (p_partkey % 300) || ', T' || p_partkey as synonyms from part"


@query(f"with m as ({_META}), n as (select name as k, count(distinct id) as n, min(id) as id from m group by 1), s as (select trim(unnest(string_split(synonyms, ','))) as k, id from m), sn as (select k, count(distinct id) as n, min(id) as id from s group by 1), "
       "v as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'P' || l_partkey when 1 then 'T' || l_partkey when 2 then 'S' || (l_partkey % 400) else p_brand || '-' || p_size end as v from lineitem join part on l_partkey = p_partkey) "
       "select l_orderkey, l_linenumber, case when v in (select id from m) then v when n.n = 1 then n.id when n.n > 1 then null when sn.n = 1 then sn.id when sn.n > 1 then null else v end as resolved from v left join n on v.v = n.k left join sn on v.v = sn.k")
def id_resolution(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    meta = t.part.select(F.concat(F.lit("P"), key).alias("id"), F.concat_ws("-", "p_brand", "p_size").alias("name"), F.concat(F.lit("S"), F.col("p_partkey") % 300, F.lit(", T"), key).alias("synonyms"))
    k = F.col("l_linenumber") % 4
    v = F.when(k == 0, F.concat(F.lit("P"), "l_partkey")).when(k == 1, F.concat(F.lit("T"), "l_partkey")).when(k == 2, F.concat(F.lit("S"), F.col("l_partkey") % 400)).otherwise(F.concat_ws("-", "p_brand", "p_size"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", v.alias("v"))
    return R.resolve_ids(rows, "v", meta).select("l_orderkey", "l_linenumber", "resolved")


@query("select trim(unnest(string_split(p_name, ' '))) as token, p_partkey from part")
def explode_tokens(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("token"), "p_partkey").select(F.trim("token").alias("token"), "p_partkey")


@query("select case when c_acctbal < 0 then null else c_mktsegment end as category, count(*) as n from customer group by 1")
def category_counts(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 200000 then 'F (large)' else o_orderstatus end as label, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 1 else null end as urgent, case when o_orderstatus like 'chr_%' then o_orderstatus else 'chr_' || o_orderstatus end as chr from orders")
def relabel(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.coalesce(S.label([((s == "F") & (F.col("o_totalprice") > 200000), "F (large)")]), s).alias("label"), S.lookup(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 1}).alias("urgent"), S.prefixed(s, "chr_").alias("chr"))


@query("select count(*) filter (quality = toxic) as match, count(*) filter (quality <> toxic) as mismatch from labels")
def match_stats(t: Tables) -> DataFrame:
    return R.match_counts(t.labels, "quality", "toxic")


@query("select o_orderstatus, count(*) filter (o_orderpriority = '1-URGENT') as urgent, count(*) filter (o_orderpriority = '2-HIGH') as high from orders group by 1")
def crosstab(t: Tables) -> DataFrame:
    wide = R.crosstab(t.orders, "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return wide.select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"))


@query("with c as (select p_brand, p_type, count(*) as n from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) as k from c) select p_brand, p_type, n from r where k = 1")
def mode_per_key(t: Tables) -> DataFrame:
    return R.mode_per(t.part, ["p_brand"], "p_type")


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75, round(avg(l_extendedprice), 4) as mean, count(*) as n from lineitem group by 1")
def quartiles(t: Tables) -> DataFrame:
    return R.quartiles(t.lineitem, ["l_returnflag"], "l_extendedprice").select("l_returnflag", *[six(c).alias(c) for c in ("q25", "q50", "q75")], F.round("mean", 4).alias("mean"), "n")


@query("select cast(case when p_size = 50 then 9 else floor(p_size / 5.0) end as integer) as bin, count(*) as n from part where p_size between 0 and 50 group by 1")
def histogram_bins(t: Tables) -> DataFrame:
    return R.histogram(t.part, F.col("p_size").cast("double"), 0.0, 5.0, 10)


@query("select 'a' as \"column\", count(*) filter (p_size < 10) as missing from part union all select 'b', count(*) filter (p_retailprice > 1000) from part")
def missing_report(t: Tables) -> DataFrame:
    return R.missing_report(t.part.select(F.when(F.col("p_size") >= 10, 1).alias("a"), F.when(F.col("p_retailprice") <= 1000, 1).alias("b")), ["a", "b"])


@query("select p_brand, coalesce(round(avg(p_retailprice) filter (p_size < 10), 6), 0) as small, coalesce(round(avg(p_retailprice) filter (p_size >= 40), 6), 0) as large from part group by 1")
def pivot_mean(t: Tables) -> DataFrame:
    size = S.label([(F.col("p_size") < 10, "small"), (F.col("p_size") >= 40, "large")], "other")
    return R.pivot_mean(t.part.withColumn("size", size), "p_brand", "size", ["small", "large"], "p_retailprice").select("p_brand", six("small").alias("small"), six("large").alias("large"))


@query("select p_name as term, min(p_retailprice) as score from part group by 1 order by 2, 1 limit 20")
def top_terms(t: Tables) -> DataFrame:
    return R.top_distinct(t.part.select(F.col("p_name").alias("term"), F.col("p_retailprice").alias("score")), "term", "score", 20)


@query("with r as (select s_nationkey, s_name, row_number() over (partition by s_nationkey order by s_name) as row from supplier where s_nationkey < 4) select row, max(s_name) filter (s_nationkey = 0) as n0, max(s_name) filter (s_nationkey = 1) as n1, max(s_name) filter (s_nationkey = 2) as n2, max(s_name) filter (s_nationkey = 3) as n3 from r group by 1")
def ragged_matrix(t: Tables) -> DataFrame:
    m = R.ragged_matrix(t.supplier.where("s_nationkey < 4"), "s_nationkey", "s_name", [0, 1, 2, 3])
    return m.select("row", *[F.col(str(k)).alias(f"n{k}") for k in range(4)])


@query("select o_custkey, count(*) as n, count(distinct o_orderpriority) as kinds, count(*) filter (o_orderstatus = 'F') as done, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as listed from orders group by 1")
def group_summary(t: Tables) -> DataFrame:
    return R.group_summary(t.orders, ["o_custkey"], {"done": F.col("o_orderstatus") == "F"}, {"kinds": "o_orderpriority"}, {"listed": "o_orderpriority"})


@query("with c as (select p_brand, avg(p_size / 50.0) as cx, avg(p_retailprice / 1000) as cy from part where p_brand <> 'Brand#2' group by 1), d as (select p_brand, case when p_size % 4 = 0 then null when p_size % 3 = 0 then true else false end as flip, sqrt((p_size / 50.0 - cx) ** 2 + (p_retailprice / 1000 - cy) ** 2) as d from part left join c using (p_brand)), "
       "g as (select p_brand, avg(d) filter (flip) as a, avg(d) filter (flip is not true) as b, count(d) filter (flip) as na, count(d) filter (flip is not true) as nb from d group by 1), x as (select *, case when na >= 2 and nb >= 2 then a - b end as delta from g) "
       "select p_brand, round(a, 6) as flip, round(b, 6) as others, round(delta, 6) as delta, case when delta is null then 'insufficient_data' when delta > 0.05 then 'flip_peripheral' when delta < -0.05 then 'flip_central' else 'no_difference' end as signal from x")
def flip_contrast(t: Tables) -> DataFrame:
    x, y = F.col("p_size") / 50.0, F.col("p_retailprice") / 1000
    outcome = S.label([(F.col("p_size") % 4 == 0, None), (F.col("p_size") % 3 == 0, "flip_V2E")], "concordant_E")
    centroids = t.part.where("p_brand <> 'Brand#2'").groupBy("p_brand").agg(F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"))
    g = coherence.flip_contrast(t.part.select("p_brand", outcome.alias("outcome"), x.alias("x"), y.alias("y")), centroids, ["p_brand"])
    return g.select("p_brand", six("flip_mean_distance").alias("flip"), six("nonflip_mean_distance").alias("others"), six("distance_delta").alias("delta"), F.col("enrichment_signal").alias("signal"))


@query("with g as (select p_brand, count(*) filter (p_size > 20 and p_retailprice > 950) as hit, count(*) filter (p_size > 20) as called, count(*) filter (p_retailprice > 950) as truth from part group by 1) select p_brand, round(hit / nullif(called, 0)::double, 6) as precision, round(hit / nullif(truth, 0)::double, 6) as recall, case when hit / nullif(called, 0)::double >= 0.75 then 'good' when hit / nullif(called, 0)::double >= 0.5 then 'fair' else 'poor' end as verdict from g")
def precision_recall(t: Tables) -> DataFrame:
    g = ml.precision_recall(t.part, ["p_brand"], F.col("p_size") > 20, F.col("p_retailprice") > 950)
    return g.select("p_brand", six("precision").alias("precision"), six("recall").alias("recall"), "verdict")


@query("select c_custkey, substr(sha1(c_name || '||' || c_mktsegment), 1, 16) as k, replace(cast(cast('2024-01-02' as date) as varchar), '-', '') as d from customer")
def cache_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.cache_key(F.col("c_name"), F.col("c_mktsegment")).alias("k"), T.iso_to_compact(F.lit("2024-01-02")).alias("d"))


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as q, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_tumbling(t: Tables) -> DataFrame:
    from tarnwick.streaming.events import tumbling

    return tumbling(t.events, "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("with s as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, min(ts) as start, count(*) as n from g group by user_id, k")
def ext_sessions(t: Tables) -> DataFrame:
    from tarnwick.streaming.events import sessions

    return sessions(t.events, "30 minutes").select("user_id", "start", "n")


@query("with e as (select *, case event_type when 'purchase' then 0 when 'click' then 1 else 2 end as p from events), r as (select *, row_number() over (partition by user_id, date_trunc('day', ts) order by p, ts, event_id) as n from e) select date_trunc('day', ts)::timestamp as start, user_id, event_id, event_type from r where n = 1")
def ext_best_rows(t: Tables) -> DataFrame:
    from tarnwick.streaming.events import best_rows

    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return best_rows(t.events.select("ts", "user_id", "event_id", "event_type"), ["user_id"], [order, F.col("ts"), F.col("event_id")]).select("start", "user_id", "event_id", "event_type")
