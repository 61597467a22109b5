"""Queries of the clustering and coherence operators over the first two embedding coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import cluster as C
from tarnwick.operators import coherence as H
from tarnwick.plans.registry import Tables, query, six

_P = "select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings"


def points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("select p_partkey, round(case when p_size / 30.0 > 1.3 then 1.3 else p_size / 30.0 end, 6)::double as x, round(p_retailprice / 10, 6) as y from part where p_size <> 7")
def scale_points(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_size") / 30.0).alias("DR"), F.col("p_retailprice").alias("DL"))
    return C.scale_points(rows).select("p_partkey", six("x").alias("x"), six("y").alias("y"))


@query("with g as (select p_partkey, p_size as dr, p_retailprice as dl, ((p_size >= 10)::int + (p_size >= 30)::int) * 2 + (p_retailprice >= 1000)::int as raw from part), m as (select raw, row_number() over (order by avg(dr) desc, avg(dl), raw) as r, count(*) over () as n from g group by raw) select p_partkey, raw, cast(case when r = n then n when r >= n then r + 1 else r end as integer) as cluster from g join m using (raw)")
def grid_renumber(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_size").alias("DR"), F.col("p_retailprice").alias("DL"))
    return C.renumber(C.grid_cells(rows, [10, 30], [1000.0])).select("p_partkey", "raw", "cluster")


@query(f"with p as ({_P}) select label, round(avg(x), 6) as cx, round(avg(y), 6) as cy, count(*) as n from p group by 1")
def cluster_centroids(t: Tables) -> DataFrame:
    return C.centroids(points(t), "label").select("label", six("cx").alias("cx"), six("cy").alias("cy"), "n")


@query(f"with p as ({_P}), c as (select label, avg(x) as cx, avg(y) as cy, count(*) as n from p group by 1), d as (select p.label, cx, cy, n, (x - cx) * (x - cx) + (y - cy) * (y - cy) as d2 from p join c using (label)), s as (select label, any_value(cx) as cx, any_value(cy) as cy, any_value(n) as n, sum(d2) as ss, avg(sqrt(d2)) as s from d group by 1), t as (select sum(cx * n) / sum(n) as mx, sum(cy * n) / sum(n) as my from s), w as (select a.label, max((a.s + b.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) as r from s a join s b on a.label <> b.label group by 1) select round((select sum(n * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) * (sum(n) - count(*)) / (sum(ss) * (count(*) - 1)) from s, t), 6) as calinski_harabasz, round((select avg(r) from w), 6) as davies_bouldin")
def ch_db_scores(t: Tables) -> DataFrame:
    return C.ch_db(points(t), "label").select(six("calinski_harabasz").alias("calinski_harabasz"), six("davies_bouldin").alias("davies_bouldin"))


@query(f"with p as ({_P}), m as (select a.vec_id, a.label, b.label as ol, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from p a join p b on a.vec_id <> b.vec_id group by 1, 2, 3), s as (select vec_id, min(d) filter (label = ol) as a, min(d) filter (label <> ol) as b from m group by 1) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s")
def silhouette(t: Tables) -> DataFrame:
    return C.silhouette(points(t), "vec_id", "label").select(six("silhouette").alias("silhouette"))


@query()
def kmeans_labels(t: Tables) -> DataFrame:
    rows = C.kmeans(points(t), 4).withColumnsRenamed({"x": "DR", "y": "DL"})
    return C.renumber(rows, ascending=True).select("vec_id", "cluster")


@query()
def gmm_labels(t: Tables) -> DataFrame:
    return C.gmm(points(t), 3).select("vec_id", "raw")


@query()
def k_sweep(t: Tables) -> DataFrame:
    return C.k_sweep(points(t), "vec_id", range(2, 5))


@query()
def ward_clusters(t: Tables) -> DataFrame:
    c = C.centroids(points(t).withColumn("cell", F.concat_ws("|", F.floor(F.col("x") * 20), F.floor(F.col("y") * 20))), "cell").withColumnsRenamed({"cx": "x", "cy": "y"})
    return C.hierarchical(c, "cell", 5)


@query()
def complete_linkage_clusters(t: Tables) -> DataFrame:
    c = C.centroids(points(t).withColumn("cell", F.concat_ws("|", F.floor(F.col("x") * 20), F.floor(F.col("y") * 20))), "cell").withColumnsRenamed({"cx": "x", "cy": "y"})
    return C.hierarchical(c, "cell", 5, "complete")


@query()
def auto_merge(t: Tables) -> DataFrame:
    return C.auto_merge(points(t), "label", 4).select("vec_id", "label", "merged")


_D = "select a.label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, a.vec_id as i, b.vec_id as j from p a join p b on a.label = b.label"


@query(f"with p as ({_P}), d as ({_D} and a.vec_id < b.vec_id) select label, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, round(max(d), 6) as max, round(stddev_pop(d), 6) as std, count(*) as pairs from d group by 1")
def pairwise_distances(t: Tables) -> DataFrame:
    return H.pairwise(points(t), "label", "vec_id").select("label", *[six(c).alias(c) for c in ("mean", "median", "max", "std")], "pairs")


@query(f"with p as ({_P}), d as ({_D} and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by label, i order by d, j) as k from d) select label, round(avg(d), 6) as knn from r where k <= 3 group by 1")
def knn_distance(t: Tables) -> DataFrame:
    return H.knn_mean(points(t), "label", "vec_id").select("label", six("knn").alias("knn"))


@query("with n as (select label, count(*) as term_size from embeddings group by 1) select e.vec_id, label, term_size from embeddings e join n using (label) where term_size between 3 and 55")
def size_window(t: Tables) -> DataFrame:
    return H.size_window(points(t), "label", 3, 55).select("vec_id", "label", "term_size")


@query()
def geometric_medians(t: Tables) -> DataFrame:
    return H.geometric_median(points(t), "label")


@query()
def permutation_z(t: Tables) -> DataFrame:
    return H.permutation_test(points(t), points(t), "label", "vec_id")


@query()
def major_minor_split(t: Tables) -> DataFrame:
    return H.major_minor(points(t).withColumn("grp", F.floor(F.col("vec_id") / 25)), "grp", "vec_id")
