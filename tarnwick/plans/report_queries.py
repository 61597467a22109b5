"""Queries of the tables behind figures, of groups met again, of neighbours on a chromosome and of alike terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.strings import first_kind
from tarnwick.operators import intervals, ontology, similarity
from tarnwick.plans import closed_loop, figures, stages
from tarnwick.plans import features as L
from tarnwick.plans.level_queries import _members
from tarnwick.plans.registry import Tables, query, six
from tarnwick.plans.stats_queries import _EDGES, _edges

_EDGE_SQL = {f: f"[{', '.join(repr(e) for e in figures.edge_list(*spec))}]" for f, spec in figures.EDGES.items()}


@query(f"""with g as (select p_size / 40.0::double - 0.2 as dr, p_retailprice / 130.0 as dl, case p_partkey % 4 when 0 then 'E' when 1 then 'V' when 2 then 'Not_determined' end as e from part),
r(k, want) as (values ('All genes', null), ('Essential', 'E'), ('Non-essential', 'V')), s as (select k, dr, dl from r join g on g.e is not null and (want is null or g.e = want)),
v as (select k as "rows", 'DR' as feature, dr as v, {_EDGE_SQL['DR']}::double[] as e from s union all select k, 'DL', dl, {_EDGE_SQL['DL']}::double[] from s),
b as (select "rows", feature, case when v = e[-1] then len(e) - 2 when v >= e[1] and v < e[-1] then len([x for x in e if x <= v]) - 1 end as bin from v),
f as (select k as "rows", feature, unnest(range(0, n)) as bin from r, (values ('DR', 33), ('DL', 29)) t(feature, n)), n as (select "rows", feature, bin, count(*) as n from b where bin is not null group by all)
select "rows", feature, bin, coalesce(n, 0) as n from f left join n using ("rows", feature, bin)""")
def dr_dl_histograms(t: Tables) -> DataFrame:
    call = F.when(F.col("p_partkey") % 4 == 0, "E").when(F.col("p_partkey") % 4 == 1, "V").when(F.col("p_partkey") % 4 == 2, "Not_determined")
    genes = t.part.select((F.col("p_size") / 40.0 - 0.2).alias("DR"), (F.col("p_retailprice") / 130.0).alias("DL"), call.alias("DeletionLibrary_essentiality"))
    return figures.dr_dl_histograms(genes).select("rows", "feature", "bin", "n")


@query("""with r as (select l_orderkey, l_linenumber, nullif(l_returnflag || l_linestatus, 'NF') as c, case when l_quantity > 3 then l_tax end as v from lineitem),
s as (select c, count(v) as n from r where c is not null group by 1), p as (select c, n, row_number() over (order by case c when 'RO' then 1 when 'AF' then 2 else 3 end, c) - 1 as place from s)
select l_orderkey, l_linenumber, c as category, place, n, v as y, true as near from r join p using (c) where v is not null""")
def category_points(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif(F.concat("l_returnflag", "l_linestatus"), F.lit("NF")).alias("category"), F.when(F.col("l_quantity") > 3, F.col("l_tax")).alias("v"))
    points = figures.category_points(rows, ["l_orderkey", "l_linenumber"], "category", "v", ["RO", "AF", "nowhere"])
    return points.select("l_orderkey", "l_linenumber", "category", "place", "n", "y", (F.abs(F.col("x") - F.col("place")) <= 0.15).alias("near"))


@query("with k as (select l_partkey, max(l_extendedprice) as v from lineitem where l_returnflag <> 'A' group by 1) select l_partkey, row_number() over (order by v desc nulls last, l_partkey) - 1 as place from k")
def ids_in_order(t: Tables) -> DataFrame:
    return figures.ordered_ids(t.lineitem, "l_partkey", "l_extendedprice", F.col("l_returnflag") != "A")


def _loop(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    annotation = t.lineitem.select(F.col("l_linestatus").alias("group_type"), F.col("l_returnflag").alias("group_name"), F.col("l_partkey").alias("gene"))
    targets = t.lineitem.where("l_linestatus = 'O' and l_returnflag <> 'N' or l_returnflag = 'R'").select(F.col("l_linestatus").alias("group_type"), F.col("l_returnflag").alias("group_name"))
    outcomes = t.part.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("outcome"), (F.col("p_size") / 50).alias("DR"), F.col("p_retailprice").alias("DL"))
    coherence = t.orders.select(F.when(F.col("o_orderstatus") == "O", "O").otherwise("F").alias("group_type"), F.lit("R").alias("group_name"), (F.col("o_custkey") / 1e3).alias("centroid_x"), (F.col("o_totalprice") / 1e5).alias("centroid_y"))
    return annotation, targets, outcomes, coherence


@query("""with c as (select case when o_orderstatus = 'O' then 'O' else 'F' end as gt, 'R' as gn, avg(o_custkey / 1e3) as x, avg(o_totalprice / 1e5) as y from orders group by 1)
select l_linestatus as group_type, l_returnflag as group_name, l_partkey as gene, case when p_partkey % 3 > 0 then p_type end as outcome, round(x, 6) as x, round(y, 6) as y,
round(sqrt(pow(case when p_partkey % 3 > 0 then p_size end / 50.0 - x, 2) + pow(case when p_partkey % 3 > 0 then p_retailprice end / 10 - y, 2)), 6) as distance
from lineitem left join part on l_partkey = p_partkey left join c on l_linestatus = gt and l_returnflag = gn where l_linestatus = 'O' and l_returnflag <> 'N' or l_returnflag = 'R'""")
def target_groups(t: Tables) -> DataFrame:
    return closed_loop.target_groups(*_loop(t)).select("group_type", "group_name", "gene", "outcome", six("centroid_x").alias("x"), six("centroid_y").alias("y"), six("distance_to_centroid").alias("distance"))


_GENES = "select 'c' || p_partkey % 3 as c, p_partkey * 37 % 5000 as s, p_partkey * 37 % 5000 + p_size * (p_partkey % 5) as e, p_partkey as g, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part"


@query(f"""with g as ({_GENES}), i as (select o_orderkey, 'c' || o_custkey % 4 as c, o_orderkey * 13 % 5400 as p from orders),
l as (select o_orderkey, max(struct_pack(e := e, s := -s, g := -g)) as l from i join g on g.c = i.c and e < p group by 1), r as (select o_orderkey, min(struct_pack(s := s, e := e, g := g)) as r from i join g on g.c = i.c and s > p group by 1),
n as (select o_orderkey, max(struct_pack(e := e, s := -s, g := -g)) as n from i join g on g.c = i.c and s <= p and e >= p group by 1)
select i.o_orderkey, case when n is not null then 'Gene' else 'Intergenic region' end as kind, case when n is not null then 'n' || -n.g else coalesce('n' || -l.g, '') || '|' || coalesce('n' || r.g, '') end as name,
case when n is not null then p + n.s else p - l.e end as from_start, case when n is not null then n.e - p else r.s - p end as to_end from i left join l using (o_orderkey) left join r using (o_orderkey) left join n using (o_orderkey)""")
def flanking_genes(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    # Ids with zeros in front are ordered as their numbers are.
    genes = t.part.select(F.concat(F.lit("c"), key % 3).alias("Chr"), (key * 37 % 5000).alias("Start"), (key * 37 % 5000 + F.col("p_size") * (key % 5)).alias("End"), F.format_string("%012d", key).alias("Name"), key.cast("string").alias("Systematic_ID"), F.when(key % 2 == 0, "+").otherwise("-").alias("Strand"))
    points = t.orders.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 4).alias("Chr"), (F.col("o_orderkey") * 13 % 5400).alias("Coordinate"))
    rows = intervals.regions(points, genes, width=700)
    return rows.select("o_orderkey", F.col("Type").alias("kind"), F.regexp_replace("Name", r"0*(\d+)", "n$1").alias("name"), F.col("Distance_to_region_start").alias("from_start"), F.col("Distance_to_region_end").alias("to_end"))


@query(f"""with recursive {_EDGES}, a as (select distinct c_custkey as gene, ancestor as term from customer join c on c.term = 'N' || c_nationkey), w as (select count(distinct gene) as total from a),
i as (select term, count(*) / any_value(total)::double as share, -ln(count(*) / any_value(total)::double) as ic from a, w group by 1),
o as (select distinct c_mktsegment as grp, 'N' || c_nationkey as term from customer where c_custkey % 2 = 0), u as (select grp, o.term, ancestor, i.ic, j.ic * (1 - j.share) as worth from o join i on i.term = o.term join c on c.term = o.term join i j on j.term = ancestor),
p as (select x.grp, x.term as a, y.term as b, max(coalesce(2 * x.worth / nullif(x.ic + y.ic, 0), 0)) as similarity from u x join u y on x.grp = y.grp and x.ancestor = y.ancestor and x.term < y.term group by all)
select grp, a, b, round(similarity, 6) as similarity from p where similarity >= 0.1""")
def alike_terms(t: Tables) -> DataFrame:
    closed = ontology.closure(_edges(t))
    terms = t.customer.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("grp"), F.concat(F.lit("N"), "c_nationkey").alias("term"))
    info = similarity.information(closed, _members(t), closed.select("term", F.lit("all").alias("namespace")).distinct())
    return similarity.relevance(terms, closed, info).select("grp", "a", "b", six("similarity").alias("similarity"))


@query()
def reduced_terms(t: Tables) -> DataFrame:
    """The terms of each segment without redundant ones, at two cutoffs."""
    closed = ontology.closure(_edges(t))
    terms = t.customer.groupBy(F.col("c_mktsegment").alias("grp"), F.concat(F.lit("N"), "c_nationkey").alias("term")).agg((1 / F.count(F.lit(1))).alias("p_fdr"))
    info = similarity.information(closed, _members(t), closed.select("term", F.lit("all").alias("namespace")).distinct())
    return similarity.reduced(terms, closed, info, [0.4, 0.7]).toDF("grp", "namespace", "term", "dispensability_4", "eliminated_4", "representative_4", "dispensability_7", "eliminated_7", "representative_7")


@query("select p_partkey, case when regexp_matches(lower(p_name), 'red|blue') then 'shared' when regexp_matches(lower(p_name), 'small|gr') then 'peripheral' when regexp_matches(lower(p_name), 'a') then 'core' else 'unclear' end as kind from part")
def first_kinds(t: Tables) -> DataFrame:
    kinds = (("shared", ("RED", "blue")), ("peripheral", ("Small", "gr")), ("core", ("a",)))
    return t.part.select("p_partkey", first_kind(F.col("p_name"), kinds).alias("kind"))


@query("with m as (select distinct concat_ws('-', l_suppkey, l_returnflag, l_linestatus) as grp, l_partkey as gene from lineitem), j as (select m.* from m join part on p_partkey = gene and p_size > 10), s as (select grp from j group by 1 having count(*) between 3 and 300) select grp, gene, round(p_size / 50.0, 6) as x from j join s using (grp) join part on p_partkey = gene")
def group_members(t: Tables) -> DataFrame:
    annotation = t.lineitem.select(F.concat_ws("-", "l_suppkey", "l_returnflag", "l_linestatus").alias("GO_term_name"), F.col("l_partkey").alias("Systematic_ID"))
    background = t.part.where("p_size > 10").select(F.col("p_partkey").alias("Systematic_ID"), (F.col("p_size") / 50).alias("x"), F.col("p_retailprice").alias("y"))
    return stages.group_members(annotation, background).select("grp", "gene", six("x").alias("x"))


@query("select o_orderkey::varchar as gene, coalesce(case when o_orderkey % 3 > 0 then o_orderpriority end, o_orderkey::varchar) as name, p_type as call, p_brand as category from orders left join part on o_orderkey = p_partkey")
def gene_metadata(t: Tables) -> DataFrame:
    genes = t.orders.select(F.col("o_orderkey").cast("string").alias("gene_systematic_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("gene_name"))
    library = t.part.select(F.col("p_partkey").cast("string").alias("Systematic ID"), F.col("p_type").alias(L.LIBRARY_COLUMNS[0]), F.lit("d").alias(L.LIBRARY_COLUMNS[1]), F.lit("c").alias(L.LIBRARY_COLUMNS[2]), F.col("p_brand").alias("Category"))
    rows = L.gene_metadata(genes, library)
    return rows.select(F.col("gene_systematic_id").alias("gene"), F.col("gene_name").alias("name"), F.col(f"`{L.LIBRARY_COLUMNS[0]}`").alias("call"), F.col("Category").alias("category"))
