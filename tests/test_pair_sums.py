import numpy as np
import pytest

from tarnwick.operators import coherence, pair_sums


@pytest.mark.parametrize("kind", ["plane", "line", "copies", "one"])
def test_a_grid_gives_the_sum_of_all_distances(kind):
    rng = np.random.default_rng(8)
    p = {"plane": rng.normal(size=(3000, 2)), "line": np.c_[rng.normal(size=3000), np.zeros(3000)], "copies": np.repeat(rng.normal(size=(300, 2)), 10, axis=0), "one": np.ones((3000, 2))}[kind]
    x, y = p.T.copy()
    want = pair_sums.grown(x, y, 0, len(x))
    for side in (8, 24) if kind != "one" else (0,):
        assert pair_sums.within(x, y, side) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_large_prefixes_take_the_grid_and_equal_plain_sums():
    p = np.random.default_rng(9).uniform(size=(9000, 2))
    x, y = p.T.copy()
    side, cost = pair_sums.grid_of(x, y)
    assert side and cost < 0.7 * len(x) ** 2 / 2
    sizes = np.array([2, 8000, 8010, 9000])
    want = [pair_sums.grown(x, y, 0, int(n)) / (n * (n - 1) / 2) for n in sizes]
    assert coherence.prefix_means(p, sizes) == pytest.approx(want, rel=1e-12)


def test_two_blocks_are_met_in_small_pieces_and_each_task_sends_one_row_a_group(spark):
    from tarnwick.operators import pairs

    p = np.random.default_rng(10).normal(size=(600, 2))
    xs, ys = (p[:, c].tobytes() for c in (0, 1))
    for same, n in ((True, 600 * 599 // 2), (False, 600 * 600)):
        pieces = list(pairs.distances(xs, ys, xs, ys, same))
        assert sum(map(len, pieces)) == n and max(map(len, pieces)) <= 32 * 600
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(p)], "g string, id int, x double, y double")
    met = pairs._met(pairs.packed(df, "g", "id", "x", "y", 30))
    tasks = met.rdd.getNumPartitions()
    counted = pairs._over_pairs(met, lambda _: [0], lambda t, d: t.__setitem__(0, t[0] + len(d)), lambda t: [t], "g string, n long").collect()
    assert met.count() == 20 * 21 // 2 and sum(r.n for r in counted) == 600 * 599 // 2 and len(counted) <= tasks
