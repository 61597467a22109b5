"""Queries that SQL cannot express, on whole tables, against plain versions of what they compute."""

import math

import numpy as np
import pytest

from tarnwick.operators import cluster, coherence
from tarnwick.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([[float(r.embedding[0]), float(r.embedding[1])] for r in rows]), np.array([r.label for r in rows])


def run(spark, name):
    return registry.queries()[name](spark, SF)


@pytest.mark.parametrize("name,linkage", [("ward_clusters", "ward"), ("complete_linkage_clusters", "complete")])
def test_trees(spark, points, name, linkage):
    _, p, _ = points
    cells = {}
    for x in p:
        cells.setdefault(f"{math.floor(x[0] * 20)}|{math.floor(x[1] * 20)}", []).append(x)
    keys = sorted(cells)
    want = cluster.merge_tree(np.array([np.mean(cells[k], axis=0) for k in keys]), 5, linkage)
    got = {r.cell: r.raw for r in run(spark, name).collect()}
    assert sorted(got) == keys and len(set(zip([got[k] for k in keys], want.tolist(), strict=True))) == 5 == len(set(got.values()))


def inertia(p, labels):
    return sum(((p[labels == c] - p[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels.tolist()))


def lloyd(p, k, tries=20):
    best = np.inf
    for seed in range(tries):
        rng = np.random.default_rng(seed)
        c = p[rng.choice(len(p), k, replace=False)]
        for _ in range(60):
            at = ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([p[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        best = min(best, inertia(p, at))
    return best


def test_k_means_reaches_plain_lloyd_runs(spark, points):
    ids, p, _ = points
    got = {r.vec_id: r.cluster for r in run(spark, "kmeans_labels").collect()}
    labels = np.array([got[i] for i in ids])
    assert inertia(p, labels) <= 1.02 * lloyd(p, 4)
    means = [p[labels == c, 0].mean() for c in sorted(set(labels.tolist()))]
    assert means == sorted(means)  # numbered by their first coordinate
    for r in run(spark, "k_sweep").collect():
        assert r.inertia <= 1.02 * lloyd(p, r.k) and -1 <= r.silhouette <= 1 and r.calinski_harabasz > 0


def test_auto_merge_of_labels(spark, points):
    ids, p, label = points
    names = sorted(set(label.tolist()))
    tree = cluster.merge_tree(np.array([p[label == c].mean(axis=0) for c in names]), 4, "ward")
    got = {r.vec_id: r.merged for r in run(spark, "auto_merge").collect()}
    pairs = {(got[i], int(tree[names.index(c)])) for i, c in zip(ids, label.tolist(), strict=True)}
    assert len(pairs) == 4


def test_geometric_medians_are_stationary(spark, points):
    _, p, label = points
    for r in run(spark, "geometric_medians").collect():
        own = p[label == r.label]
        c = np.array([r.centroid_x, r.centroid_y])
        total = lambda at, own=own: np.sqrt(((own - at) ** 2).sum(axis=1)).sum()
        assert all(total(c) <= total(c + np.array(step)) + 1e-6 for step in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
        away = np.sqrt(((own - c) ** 2).sum(axis=1))
        assert (r.mean_distance, r.median_distance, r.max_distance, r.covered) == (pytest.approx(away.mean()), pytest.approx(np.median(away)), pytest.approx(away.max()), len(own))


def test_dispersions_observed_and_drawn(spark):
    rows = run(spark, "dispersion_scores").collect()
    assert rows and all(0 <= r[f"{m}_pvalue"] <= 1 and math.isfinite(r[f"{m}_zscore"]) for r in rows for m in coherence.DISPERSIONS)
    assert all(round(r[f"{m}_pvalue"] * 1000, 6) == int(round(r[f"{m}_pvalue"] * 1000)) for r in rows for m in coherence.DISPERSIONS)  # shares of 1,000 draws
