import importlib
from collections import Counter

import numpy as np
import pytest

from tarnwick.operators import coherence


def test_blocks_give_the_mean_of_all_pairs():
    p = np.random.default_rng(3).normal(size=(300, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))[np.triu_indices(300, 1)]
    for block in (1, 7, 64, 300, 512):
        assert coherence.mean_pairwise(p, block) == pytest.approx(d.mean(), rel=1e-12)
    assert coherence.mean_pairwise(p[:1]) == 0.0


def test_permutation_z_takes_whole_groups_and_a_thousand_draws(spark):
    query = importlib.import_module("__spark_entry__").queries()["permutation_z"]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    cloud = np.array([[float(r.embedding[0]), float(r.embedding[1])] for r in rows])
    sizes = Counter(r.label for r in rows)
    got = {r.label: r for r in query(spark, "/root/testdata/sf0.001").collect()}
    assert {k: r.n for k, r in got.items()} == sizes
    label = min(sizes)
    # A draw is the first rows of one random order, which serves all sizes.
    orders = [np.random.default_rng([42, draw]).choice(len(cloud), max(sizes.values()), replace=False) for draw in range(1000)]
    null = np.array([coherence.mean_pairwise(cloud[o[: sizes[label]]]) for o in orders])
    seen = coherence.mean_pairwise(cloud[[r.label == label for r in rows]])
    assert got[label].observed == pytest.approx(seen) and got[label].z == pytest.approx((seen - null.mean()) / null.std())
    assert got[label].p == pytest.approx((null <= seen).mean(), abs=1e-9)


def test_prefixes_grow_as_whole_sets_do():
    p = np.random.default_rng(4).normal(size=(90, 2))
    sizes = np.array([2, 3, 5, 40, 90])
    assert coherence.prefix_means(p, sizes, 16) == pytest.approx([coherence.mean_pairwise(p[:n]) for n in sizes])
    plain = []
    for n in sizes.tolist():
        d = np.sqrt(((p[:n, None] - p[None, :n]) ** 2).sum(axis=2))
        pairs, away = d[np.triu_indices(n, 1)], np.sqrt(((p[:n] - coherence.weiszfeld(p[:n])) ** 2).sum(axis=1))
        plain.append([away.mean(), np.median(away), pairs.mean(), np.median(pairs), pairs.max(), np.sort(d, axis=1)[:, 1 : min(3, n - 1) + 1].mean()])
    assert coherence.prefix_dispersions(p, sizes) == pytest.approx(np.array(plain))


def test_draws_are_alike_when_the_background_is_joined(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    back = spark.createDataFrame(rows, "gene int, x double, y double")
    groups = back.selectExpr("cast(gene % 7 as string) as grp", "gene", "x", "y").where("grp <> '3' or gene < 60")
    sent, joined = ({r.grp: tuple(r)[1:] for r in coherence.permutation_test(groups, back, "grp", "gene", times=50, most=m).collect()} for m in (1000, 10))
    assert sent.keys() == joined.keys() and all(sent[g] == pytest.approx(joined[g]) for g in sent)
