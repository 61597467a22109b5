"""Sketched levels against exact answers, within the bounds of the sketches."""

import numpy as np
import pytest

from tarnwick.operators import sketches

SF = "/root/testdata/sf0.01"


def test_levels_merge_to_what_rows_give(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    by = ["l_returnflag", "l_linestatus"]
    fine = sketches.level(rows, by, ["l_extendedprice", "l_quantity"], ["l_partkey"])
    pdf = rows.select(*by, "l_extendedprice", "l_quantity", "l_partkey").toPandas()
    for keys in (by, by[:1], []):
        merged = fine if keys == by else sketches.rolled_up(fine, keys)
        got = sketches.figures(merged, keys).collect()
        groups = {k if isinstance(k, tuple) else (k,): g for k, g in pdf.groupby(keys)} if keys else {(): pdf}
        assert len(got) == len(groups)
        for r in got:
            g = groups[tuple(r[k] for k in keys)]
            assert r["rows"] == len(g) and r.mean_l_quantity == pytest.approx(g.l_quantity.mean())
            assert r.distinct_l_partkey == pytest.approx(g.l_partkey.nunique(), rel=0.04)
            x = np.sort(g.l_extendedprice.to_numpy())
            for share, value in ((0.25, r.q25_l_extendedprice), (0.5, r.q50_l_extendedprice), (0.75, r.q75_l_extendedprice)):
                low, high = np.searchsorted(x, value, "left") / len(x), np.searchsorted(x, value, "right") / len(x)
                assert low - 0.01 <= share <= high + 0.01
    ends = sketches.rolled_up(fine, []).select(sketches.quantile("l_quantity", 0.0).alias("lo"), sketches.quantile("l_quantity", 1.0).alias("hi")).first()
    assert tuple(ends) == (pdf.l_quantity.min(), pdf.l_quantity.max())


def test_overlaps_and_missing_values(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(600)] + [("b", i, None) for i in range(400, 1000)] + [("c", i, 1.0) for i in range(5000, 5100)] + [("d", None, 2.0)], "k string, m int, v double")
    held = sketches.level(df, ["k"], ["v"], ["m"])
    assert {(r.a, r.b): (r.both, r.either, r.only_a) for r in sketches.overlaps(held, "k", "m").collect()} == {("a", "b"): (200, 1000, 400)}
    rows = {r.k: r for r in sketches.figures(held, ["k"]).collect()}
    assert (rows["b"].mean_v, rows["b"].q50_v, rows["b"].distinct_m, rows["d"].distinct_m, rows["d"].q50_v) == (None, None, 600, 0, 2.0)
