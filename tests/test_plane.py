"""Merge trees, nearest members and pairs in the plane against plain versions."""

import numpy as np
import pytest

from tarnwick.operators import agglomerate, cluster, coherence, nearest, pairs


def crowded(seed, n=700):
    rng = np.random.default_rng(seed)
    p = np.r_[rng.normal(0, 0.02, (n // 2, 2)), rng.random((n - n // 2, 2)) * 3]
    return np.round(p, 6)


@pytest.mark.parametrize("linkage", ["ward", "complete"])
@pytest.mark.parametrize("k", [1, 6, 50])
def test_tree_of_rounds_equals_the_tree_of_all_distances(spark, linkage, k):
    p = crowded(3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    got = [r.raw for r in agglomerate.agglomerate(df, "id", k, linkage, block=48, last=90).orderBy("id").collect()]
    want = cluster.merge_tree(p, k, linkage)
    first = {g: want.tolist().index(g) for g in set(want.tolist())}
    number = {g: n for n, g in enumerate(sorted(first, key=first.get))}
    assert got == [number[g] for g in want.tolist()]


def test_tree_of_two_thousand_points(spark):
    p = np.random.default_rng(8).normal(size=(2000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    for linkage in ("ward", "complete"):
        got = np.array([r.raw for r in agglomerate.agglomerate(df, "id", 9, linkage, block=200, last=400).orderBy("id").collect()])
        want = cluster.merge_tree(p, 9, linkage)
        assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == 9 == len(set(got.tolist()))


def test_odd_points(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 5.0, 5.0), ("d", None, 1.0), (None, 1.0, 1.0), ("e", float("nan"), 1.0)] + [(f"z{i}", 9.0, 9.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    got = {r.id: r.raw for r in agglomerate.agglomerate(df, "id", 2, block=20, last=30).collect()}
    assert got["a"] == got["b"] == 0 and len(got) == 303 and len({got[f"z{i}"] for i in range(300)}) == 1
    assert len({r.raw for r in agglomerate.agglomerate(df, "id", 10).collect()}) == 3
    assert agglomerate.agglomerate(df.where("id = 'd'"), "id", 2).count() == 0
    with pytest.raises(ValueError):
        agglomerate.agglomerate(df, "id", 2, "single")


@pytest.mark.parametrize("most,asks", [(2048, 8192), (24, 10)])
def test_nearest_members_equal_all_distances(spark, most, asks):
    p = crowded(5, 500)
    rows = [("g", float(a), float(b)) for a, b in p] + [("same", 1.0, 2.0)] * 80 + [("two", 0.0, 0.0), ("two", 3.0, 4.0), ("lone", 1.0, 1.0)] + [("line", float(i // 2), 0.0) for i in range(120)]
    df = spark.createDataFrame(rows + [("g", None, 1.0), (None, 1.0, 1.0)], "grp string, x double, y double")
    got = {(r.grp, r.x, r.y): (r.times, list(r.near)) for r in nearest.nearest_distances(df, "grp", 3, most=most, asks=asks).collect()}
    for g in ("g", "same", "two", "lone", "line"):
        own = np.array([r[1:] for r in rows if r[0] == g])
        for a in {tuple(x) for x in own.tolist()}:
            d = np.sort(np.hypot(*(own - np.array(a)).T))[1:4]
            times, near = got[(g, *a)]
            assert times == int((own == np.array(a)).all(axis=1).sum()) and near == pytest.approx(d.tolist())
    keyed = df.selectExpr("grp", "x", "y", "uuid() as id")
    means = {r.grp: r.knn for r in coherence.knn_mean(keyed, "grp", "id").collect()}
    assert means["lone"] == 0 and means["same"] == 0 and means["two"] == 5


def test_cells_are_small_however_points_crowd(spark):
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in crowded(6, 3000)], "g string, x double, y double").distinct()
    held = nearest.cells(df, "g", 64).groupBy("cell").count()
    assert held.agg({"count": "max"}).first()[0] <= 64 and held.count() > 30


@pytest.mark.parametrize("block", [2048, 40])
def test_pair_stats_equal_all_distances(spark, block):
    p = crowded(7, 301)
    sets = {"g": p, "even": p[:100], "ties": np.array([[0.0, 0.0], [1.0, 0.0]] * 50), "two": p[:2], "one": p[:1], "same": np.ones((90, 2))}
    df = spark.createDataFrame([(g, i, float(a), float(b)) for g, q in sets.items() for i, (a, b) in enumerate(q)] + [("g", 999, None, 1.0)], "g string, id int, x double, y double")
    got = {r.g: r for r in pairs.pair_stats(df, "g", "id", block=block).collect()}
    assert set(got) == set(sets) - {"one"}
    for g, r in got.items():
        q = sets[g]
        d = np.sqrt(((q[:, None] - q[None]) ** 2).sum(axis=2))[np.triu_indices(len(q), 1)]
        assert (r.mean, r.median, r.max, r.std, r.pairs) == (pytest.approx(d.mean()), pytest.approx(np.median(d), abs=1e-12), pytest.approx(d.max()), pytest.approx(d.std(), abs=1e-7), len(d))


def test_silhouette_of_copies_is_that_of_weighted_points(spark):
    import numpy as np

    from tarnwick.operators import cluster

    rng = np.random.default_rng(4)
    base = [(float(a), float(b), int(g)) for a, b, g in zip(rng.integers(0, 9, 70), rng.integers(0, 9, 70), rng.integers(0, 3, 70), strict=True)]
    rows = [(i, *p) for i, p in enumerate(base * 4 + [(50.0, 50.0, 7)])]
    p, label = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(rows)):
        mean = {g: d[i, label == g].sum() / ((label == g).sum() - (g == label[i])) for g in set(label.tolist()) if (label == g).sum() > (g == label[i])}
        a, b = mean.get(label[i]), min(v for g, v in mean.items() if g != label[i])
        s.append(0.0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame(rows, "k long, x double, y double, g int")
    for block in (16, 2048):
        assert abs(cluster.silhouette(df, "k", "g", block=block).first()[0] - np.mean(s)) < 1e-9
    plan = cluster.silhouette(df, "k", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "ows#" in plan
