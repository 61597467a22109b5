"""Likeness of terms by what they share in an ontology, and lists of terms without redundant ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def information(closed: DataFrame, associations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(term, namespace, share, ic): a term's share of its namespace's annotated genes, and its information content -ln(share).

    ``closed`` has (term, ancestor), ``associations`` (gene, term), ``namespaces`` (term,
    namespace). A gene counts for all ancestors of its terms, once each; terms without any have no row.
    """
    counted = associations.join(closed, "term").select("gene", F.col("ancestor").alias("term")).distinct()
    counted = counted.join(namespaces, "term")
    total = counted.groupBy("namespace").agg(F.countDistinct("gene").alias("total"))
    per = counted.groupBy("term", "namespace").agg(F.count(F.lit(1)).alias("genes")).join(total, "namespace")
    share = F.col("genes") / F.col("total")
    return per.select("term", "namespace", share.alias("share"), (-F.log(share)).alias("ic"))


def relevance(terms: DataFrame, closed: DataFrame, info: DataFrame, least: float = 0.1, group: str = "grp") -> DataFrame:
    """(group, namespace, a, b, similarity) of the terms of each group that are as alike as ``least``, a < b.

    Two terms are alike by their best common ancestor c: 2 ic(c) / (ic(a) + ic(b)) * (1 - share(c)).
    An ancestor can only make a term alike to another by ``least`` if the term holds no more than
    2 ic(c) (1 - share(c)) / least - ic(c); others leave the join before it, so terms that have
    nothing but the top of the ontology in common never become a pair.
    """
    own = terms.select(group, "term").distinct().join(info.select("term", "namespace", "ic"), "term")
    shared = info.select(F.col("term").alias("ancestor"), F.col("namespace").alias("ns"), F.col("ic").alias("ac"), (F.col("ic") * (1 - F.col("share"))).alias("worth"))
    up = own.join(closed, "term").join(shared, "ancestor").where("namespace = ns")
    up = up.where(F.col("ic") <= 2 * F.col("worth") / least - F.col("ac") + 1e-9).select(group, "namespace", "ancestor", "worth", "term", "ic")
    other = up.select(F.col(group).alias("og"), F.col("ancestor").alias("oa"), F.col("term").alias("b"), F.col("ic").alias("oc"))
    pairs = up.join(other, (F.col(group) == F.col("og")) & (F.col("ancestor") == F.col("oa")) & (F.col("term") < F.col("b")))
    alike = F.coalesce(F.try_divide(2 * F.col("worth"), F.col("ic") + F.col("oc")), F.lit(0.0))
    best = pairs.groupBy(group, "namespace", F.col("term").alias("a"), "b").agg(F.max(alike).alias("similarity"))
    return best.where(F.col("similarity") >= least)


def eliminate(terms: list[tuple], pairs: list[tuple], below: set[tuple], broad: float = 0.05, close: float = 0.05) -> dict:
    """(dispensability, merged into) of the terms that a list can do without, most alike pairs first.

    ``terms`` are (term, p, share), ``pairs`` (a, b, similarity), ``below`` (descendant, ancestor).
    Of a pair whose terms both are still in the list one goes: a very broad one (a share of over
    ``broad``) before one that is not; else that of the clearly greater p; with p alike within
    ``close`` of the greater, the descendant, unless it is the rest of its ancestor; else the
    greater p, at last the later name.
    """
    p, share = {t: v for t, v, _ in terms}, {t: s for t, _, s in terms}
    gone: dict = {}
    for a, b, similarity in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a in gone or b in gone:
            continue
        worse, better = (a, b) if (p[a], a) > (p[b], b) else (b, a)
        if (share[a] > broad) != (share[b] > broad):
            worse, better = (a, b) if share[a] > broad else (b, a)
        elif p[worse] - p[better] <= close * p[worse]:
            child = a if (a, b) in below else b if (b, a) in below else None
            if child is not None:
                parent = b if child == a else a
                worse, better = (parent, child) if share[child] > 0.75 * share[parent] else (child, parent)
        gone[worse] = (similarity, better)
    return gone


def reduced(terms: DataFrame, closed: DataFrame, info: DataFrame, cutoffs: list[float], least: float = 0.1, group: str = "grp", value: str = "p_fdr") -> DataFrame:
    """(group, namespace, term, Dispensability_c, Eliminated_c, Representative_c for each cutoff c), one row a term of a group.

    Dispensability is the similarity at which a term would leave the list, missing under
    ``least``; it is eliminated where that exceeds the cutoff, and its representative is the term
    that stays in its stead, else itself. All groups and namespaces in one query; a task sees the
    terms of one, which are at most those of the ontology.
    """
    own = terms.select(group, "term", F.col(value).cast("double").alias("p")).dropDuplicates([group, "term"]).join(info.select("term", "namespace", "share"), "term")
    pairs = relevance(terms, closed, info, least, group)
    ends = pairs.select("a", "b").distinct()
    below = ends.join(closed, (F.col("a") == F.col("term")) & (F.col("b") == F.col("ancestor"))).select("a", "b", F.lit(1).alias("up"))
    below = below.unionByName(ends.join(closed, (F.col("b") == F.col("term")) & (F.col("a") == F.col("ancestor"))).select("a", "b", F.lit(-1).alias("up")))
    pairs = pairs.join(below, ["a", "b"], "left").select(*[F.col(c).alias(c) for c in (group, "namespace", "a", "b", "similarity", "up")])
    own = own.select(*[F.col(c).alias(c) for c in (group, "namespace", "term", "p", "share")])
    kind, term = terms.schema[group].dataType.simpleString(), terms.schema["term"].dataType.simpleString()
    added = ", ".join(f"`Dispensability_{c}` double, `Eliminated_{c}` boolean, `Representative_{c}` {term}" for c in cutoffs)

    def run(name: tuple, t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        listed = list(zip(t["term"], t["p"], t["share"], strict=True))
        under = {(a, b) if up > 0 else (b, a) for a, b, up in zip(q["a"], q["b"], q["up"], strict=True) if up in (1, -1)}
        gone = eliminate(listed, list(zip(q["a"], q["b"], q["similarity"], strict=True)), under)
        out = t[[group, "namespace", "term"]].copy()
        for c in cutoffs:

            def stays(x, c=c):
                while x in gone and gone[x][0] > c:
                    x = gone[x][1]
                return x

            out[f"Dispensability_{c}"] = [gone[x][0] if x in gone else None for x in t["term"]]
            out[f"Eliminated_{c}"] = [x in gone and gone[x][0] > c for x in t["term"]]
            out[f"Representative_{c}"] = [stays(x) for x in t["term"]]
        return out

    left = own.groupBy(group, "namespace")
    return left.cogroup(pairs.groupBy(group, "namespace")).applyInPandas(run, f"{group} {kind}, namespace string, term {term}, {added}")
