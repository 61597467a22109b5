"""Queries of the statistics, enrichment and ontology operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import ml, ontology, relational, stats
from tarnwick.plans.registry import Tables, query, six


@query("select 'p_size' as x, 'p_retailprice' as y, round(corr(p_size, p_retailprice), 6) as r, count(*) as n from part union all select 'p_size', 'key', round(corr(p_size, p_partkey), 6), count(*) from part union all select 'p_retailprice', 'key', round(corr(p_retailprice, p_partkey), 6), count(*) from part")
def pairwise_pearson(t: Tables) -> DataFrame:
    rows = t.part.select("p_size", "p_retailprice", F.col("p_partkey").alias("key"))
    names = stats.usable_columns(rows, ["p_size", "p_retailprice", "absent", "key"])
    return stats.pairwise_correlation(rows, names).select("x", "y", six("r").alias("r"), "n")


@query()
def pearson_p_values(t: Tables) -> DataFrame:
    return stats.pairwise_correlation(t.part.select("p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(corr(l_extendedprice, l_quantity), 6) as r, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity) / (count(*) - 2)), 4) as stderr, count(*) as n from lineitem group by 1")
def ols_fit(t: Tables) -> DataFrame:
    fit = stats.ols(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), six("r").alias("r"), six("r2").alias("r2"), F.round("stderr", 4).alias("stderr"), "n")


@query("with p as (select log10(l_quantity) as a, log10(l_extendedprice) as b from lineitem where l_quantity > 0 and l_extendedprice > 0) select round(corr(b, a), 6) as r, round(regr_r2(b, a), 6) as r2, round(regr_slope(b, a), 6) as slope, round(regr_intercept(b, a), 6) as intercept, round(sqrt((1 - regr_r2(b, a)) * regr_syy(b, a) / count(*)), 6) as rmse, count(*) as n from p")
def loglog_fit(t: Tables) -> DataFrame:
    f = stats.loglog(t.lineitem, "l_quantity", "l_extendedprice")
    return f.select(*[six(c).alias(c) for c in ("r", "r2", "slope", "intercept", "rmse")], "n")


@query("with l as (select l_orderkey, l_linenumber, l_quantity as q from lineitem), r as (select *, cast(floor(rank() over (partition by l_orderkey order by q) + (count(*) over (partition by l_orderkey, q) - 1) / 2.0) as integer) as k, q - min(q) over (partition by l_orderkey) as s from l), x as (select *, list_extract(cast([1.5, 4, 16, 64, 256, 1024] as double[]), k) as ratio, case when max(s) over (partition by l_orderkey) = 0 then null else s / max(s) over (partition by l_orderkey) end as relative from r) "
       "select l_orderkey, l_linenumber, ratio, round(relative, 6) as relative, case when relative = 0 then '-Infinity'::double else round(log2(relative), 6) end as log2_relative from x")
def spikein_ratio(t: Tables) -> DataFrame:
    out = stats.rank_ratio(t.lineitem, ["l_orderkey"], "l_quantity", [1.5, 4, 16, 64, 256, 1024])
    l2 = F.col("log2_relative")
    return out.select("l_orderkey", "l_linenumber", "ratio", six("relative").alias("relative"), F.when(l2 == -float("inf"), l2).otherwise(six(l2)).alias("log2_relative"))


@query("with p as (select p_partkey, p_size / 50.0::double as a, 0.5::double as dr, p_retailprice / 1000 as dl from part where p_size > 2), g as (select p_partkey, a, dr, dl, unnest(range(0, 11)) as t from p) select p_partkey, cast(t as integer) as t, round(a * exp(-exp(least(greatest(dr * exp(1) / a * (dl - t) + 1, -700), 700))), 6) as y from g")
def gompertz_grid(t: Tables) -> DataFrame:
    p = t.part.where("p_size > 2").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), F.lit(0.5).alias("dr"), (F.col("p_retailprice") / 1000).alias("dl"))
    g = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("t"))
    return g.select("p_partkey", "t", six(stats.gompertz(F.col("t"), F.col("a"), F.col("dr"), F.col("dl"))).alias("y"))


@query("select p_partkey, round(greatest(p_size - 25, 0), 6)::double as x0, round(greatest((p_size - 25) + p_retailprice / p_size, 1), 6)::double as x1 from part")
def inflection_segment(t: Tables) -> DataFrame:
    a, b = stats.inflection_segment(F.col("p_retailprice"), F.col("p_size"), (F.col("p_size") - 25).cast("double"))
    return t.part.select("p_partkey", six(a).alias("x0"), six(b).alias("x1"))


@query("""with p as (select p_size::double as x, p_retailprice as y from part), s as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, var_samp(x) * power(count(*), -1.0/3) as xx, var_samp(y) * power(count(*), -1.0/3) as yy, covar_samp(x, y) * power(count(*), -1.0/3) as xy, count(*) as n from p),
g as (select a.i, b.j, x0 + a.i * (x1 - x0) / 14 as gx, y0 + b.j * (y1 - y0) / 14 as gy, s.* from s, (select unnest(range(15))::int as i) a, (select unnest(range(15))::int as j) b)
select i, j, round(sum(exp(-((gx - x) * (gx - x) * yy - 2 * (gx - x) * (gy - y) * xy + (gy - y) * (gy - y) * xx) / (xx * yy - xy * xy) / 2)) / (2 * pi() * sqrt(any_value(xx * yy - xy * xy)) * any_value(n)) * 1000, 6) as density from g, p group by 1, 2""")
def kde_grid(t: Tables) -> DataFrame:
    return stats.kde_grid(t.part, "p_size", "p_retailprice", 15).select("i", "j", six(F.col("density") * 1000).alias("density"))


_STUDY = "with s as (select c_custkey as gene, c_nationkey % 5 as grp from customer where c_nationkey % 5 < 4), a as (select distinct o_custkey as gene, o_orderpriority as term from orders), ns as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as term, unnest(['BP', 'BP', 'BP', 'CC', 'CC']) as namespace), bg as (select distinct c_custkey as gene from customer), pn as (select count(*) as pop_n from bg), sn as (select grp, count(*) as study_n from s group by 1), pop as (select namespace, term, count(*) as pop_count from a join ns using (term) join bg using (gene) group by 1, 2), h as (select grp, term, count(*) as k from a join s using (gene) group by 1, 2), x as (select sn.grp, namespace, pop.term, coalesce(k, 0) as study_count, study_n, pop_count, pop_n from sn cross join pop cross join pn left join h on h.grp = sn.grp and h.term = pop.term), y as (select *, unnest(range(greatest(0, study_n + pop_count - pop_n), least(study_n, pop_count) + 1)) as i from x), z as (select *, lgamma(pop_count + 1) - lgamma(i + 1) - lgamma(pop_count - i + 1) + lgamma(pop_n - pop_count + 1) - lgamma(study_n - i + 1) - lgamma(pop_n - pop_count - study_n + i + 1) - lgamma(pop_n + 1) + lgamma(study_n + 1) + lgamma(pop_n - study_n + 1) as lp from y), w as (select grp, namespace, term, study_count, study_n, pop_count, pop_n, max(lp) filter (i = study_count) as lk, list(lp) as lps from z group by all), p as (select *, least(1, list_sum(list_transform(list_filter(lps, lambda v: exp(v) <= exp(lk) * (1 + 1e-7)), lambda v: exp(v)))) as p from w), q as (select *, row_number() over (partition by grp, namespace order by p, term) as rn, count(*) over (partition by grp, namespace) as m from p), f as (select *, least(1, min(p * m / rn) over (partition by grp, namespace order by rn desc rows unbounded preceding)) as q from q)"


def _enriched(t: Tables, significant: bool) -> DataFrame:
    study = t.customer.where("c_nationkey % 5 < 4").select((F.col("c_nationkey") % 5).alias("grp"), F.col("c_custkey").alias("gene"))
    assoc = t.orders.select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("term"))
    spaces = t.spark.createDataFrame([("1-URGENT", "BP"), ("2-HIGH", "BP"), ("3-MEDIUM", "BP"), ("4-NOT SPECIFIED", "CC"), ("5-LOW", "CC")], "term string, namespace string")
    return ontology.enrich(study, t.customer.select(F.col("c_custkey").alias("gene")), assoc, spaces, significant=significant)


@query(_STUDY + " select grp, namespace, term, study_count, study_n, pop_count, pop_n, round(p, 6) as p, round(q, 6) as p_fdr, case when study_count / study_n::double > pop_count / pop_n::double then 'e' else 'p' end as direction from f")
def enrich_fisher_bh(t: Tables) -> DataFrame:
    return _enriched(t, False).select("grp", "namespace", "term", "study_count", "study_n", "pop_count", "pop_n", six("p_uncorrected").alias("p"), six("p_fdr").alias("p_fdr"), "direction")


@query(_STUDY + " select grp, term, pop_count from f where q < 0.05 and study_count / study_n::double > pop_count / pop_n::double and pop_count < 100000 and namespace <> 'MF'")
def enrich_filtered(t: Tables) -> DataFrame:
    return ontology.filter_terms(_enriched(t, True), 100_000).select("grp", "term", "pop_count")


_EDGES = "e as (select 'N' || n_nationkey as child, 'R' || n_regionkey as parent from nation union all select 'R' || r_regionkey, 'ROOT' from region union all select 'N' || n_nationkey, 'G' || (n_nationkey % 3) from nation union all select 'G' || k, 'ROOT' from (select unnest([0, 1, 2]) as k)), c as (select distinct child as term, child as ancestor from e union select parent, parent from e union select c.term, e.parent from c join e on c.ancestor = e.child)"


def _edges(t: Tables) -> DataFrame:
    n, r = t.nation, t.region

    def edge(child, parent):
        return [child.alias("child"), parent.alias("parent"), F.lit("is_a").alias("relation")]

    n_ = F.concat(F.lit("N"), "n_nationkey")
    third = F.concat(F.lit("G"), F.col("n_nationkey") % 3)
    return n.select(*edge(n_, F.concat(F.lit("R"), "n_regionkey"))).unionByName(r.select(*edge(F.concat(F.lit("R"), "r_regionkey"), F.lit("ROOT")))).unionByName(n.select(*edge(n_, third))).unionByName(n.select(*edge(third, F.lit("ROOT"))))


@query(f"with recursive {_EDGES} select term, ancestor from c")
def ontology_closure(t: Tables) -> DataFrame:
    return ontology.closure(_edges(t), ["is_a"])


@query(f"with recursive {_EDGES}, a as (select term, ancestor as slim from c where ancestor in ('R0', 'R1', 'G1', 'ROOT', 'N3')) select x.term, x.slim, not exists (select 1 from a y join a z on z.term = y.slim and z.slim = x.slim where y.term = x.term and y.slim <> x.slim) as direct from a x")
def slim_mapping(t: Tables) -> DataFrame:
    closed = ontology.closure(_edges(t))
    slim = t.spark.createDataFrame([(x,) for x in ("R0", "R1", "G1", "ROOT", "N3")], "term string")
    direct = ontology.slim_direct(closed, slim).withColumn("direct", F.lit(True))
    return ontology.slim_all(closed, slim).join(direct, ["term", "slim"], "left").na.fill(False, ["direct"])


@query(f"with recursive {_EDGES} select ancestor as term, count(distinct c_custkey) as genes from customer join c on c.term = 'N' || c_nationkey group by 1")
def propagate_counts(t: Tables) -> DataFrame:
    assoc = t.customer.select(F.col("c_custkey").alias("gene"), F.concat(F.lit("N"), "c_nationkey").alias("term"))
    return ontology.propagate(assoc, ontology.closure(_edges(t))).groupBy("term").agg(F.countDistinct("gene").alias("genes"))


@query("select n_nationkey, 'N' || n_nationkey as term, case when n_nationkey < 10 then n_name else 'No record for N' || n_nationkey end as name from nation")
def term_names(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("term"))
    names = t.nation.where("n_nationkey < 10").select(F.concat(F.lit("N"), "n_nationkey").alias("term"), F.col("n_name").alias("name"))
    return ontology.named(rows, names).select("n_nationkey", "term", "name")


@query("select c_nationkey, min(p) as p from (select c_nationkey, round(c_acctbal, 6) as p from customer) group by 1 order by 2, 1 limit 10")
def top_distinct_terms(t: Tables) -> DataFrame:
    return relational.top_distinct(t.customer.withColumn("p", six("c_acctbal")), "c_nationkey", "p", 10)


@query("select p_partkey, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as z from part")
def standard_scale(t: Tables) -> DataFrame:
    return ml.standard_scale(t.part.select("p_partkey", F.col("p_size").cast("double").alias("z")), ["z"]).select("p_partkey", six("z").alias("z"))


@query("select p_partkey, (coalesce(b = 'Brand#11', false))::int as \"b_Brand#11\", (coalesce(b = 'Brand#12', false))::int as \"b_Brand#12\", (b is null)::int as b_nan from (select p_partkey, case when p_size > 3 then p_brand end as b from part)")
def one_hot(t: Tables) -> DataFrame:
    return ml.one_hot(t.part.select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("b")), "b", ["Brand#11", "Brand#12"])


@query("select p_partkey, round(case when x >= 0 then (power(x + 1, 0.5) - 1) / 0.5 else -(power(1 - x, 1.5) - 1) / 1.5 end, 6) as y from (select p_partkey, (p_size - 25)::double as x from part)")
def yeo_johnson(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", six(ml.yeo_johnson((F.col("p_size") - 25).cast("double"), 0.5)).alias("y"))


@query("select 'all' as split, count(*) as n from part union all select 'gt', count(*) from part where p_size > 15 union all select 'le', count(*) from part where p_size <= 15")
def threshold_splits(t: Tables) -> DataFrame:
    parts = ml.threshold_splits(t.part, "p_size", 15)
    return stats.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("split"), "n") for k, df in parts.items()])


@query("select l_orderkey, l_linenumber, p_size from lineitem left join part on l_partkey = p_partkey and p_size % 2 = 0 where p_size > 15")
def modeling_table(t: Tables) -> DataFrame:
    genes = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return ml.with_targets(t.lineitem, genes, "l_partkey", F.col("p_size") > 15).select("l_orderkey", "l_linenumber", "p_size")


@query("select round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(avg(abs(y - p)), 4) as mae, round(corr(y, p), 6) as r, count(*) as n from (select l_extendedprice as y, l_quantity * 1000 as p from lineitem)")
def regression_metrics(t: Tables) -> DataFrame:
    m = stats.regression_metrics(t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p")), "y", "p")
    return m.select(six("r2").alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), six("r").alias("r"), "n")


@query("select p_brand as feature, round(avg(p_size), 6) as importance from part group by 1")
def mean_importance(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("feature"), F.col("p_size").alias("importance"))
    return ml.mean_importance([rows.where("importance > 20"), rows.where("importance <= 20")]).select("feature", six("importance").alias("importance"))


@query()
def model_leaderboard(t: Tables) -> DataFrame:
    return ml.leaderboard(t.part.select("p_partkey", "p_size", (F.col("p_partkey") % 7).alias("m"), "p_retailprice"), ["p_size", "m"], "p_retailprice", ["p_partkey"])
