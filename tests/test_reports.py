"""Tables behind figures, groups met again, neighbours on a line, alike terms: against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import intervals, relational, similarity
from tarnwick.plans import closed_loop, figures, stages
from tarnwick.sources import readers, writers


def test_histograms_count_as_closed_edges_do(spark):
    r = random.Random(2)
    rows = [(r.choice([None, -0.2, 1.45, 1.449, 0.0, 1.5, r.uniform(-0.5, 2)]), r.choice([None, 0.0, 14.5, 15.0, -0.1, r.uniform(0, 16)]), r.choice(["E", "V", "Not_determined", None])) for _ in range(400)]
    got = figures.dr_dl_histograms(spark.createDataFrame(rows, "DR double, DL double, DeletionLibrary_essentiality string")).collect()
    kept = {"All genes": [x for x in rows if x[2] is not None], "Essential": [x for x in rows if x[2] == "E"], "Non-essential": [x for x in rows if x[2] == "V"]}
    for name, some in kept.items():
        for i, (feature, e) in enumerate(figures.EDGES.items()):
            want, _ = np.histogram([x[i] for x in some if x[i] is not None], bins=np.array(figures.edge_list(*e)))
            assert [x.n for x in sorted(got, key=lambda x: x.bin) if (x["rows"], x.feature) == (name, feature)] == want.tolist()


def test_points_and_orders(spark):
    rows = [(1, "b", 2.0), (2, "a", None), (3, None, 1.0), (4, "zz", 3.0), (5, "b", 9.0), (5, "b", 1.0)]
    df = spark.createDataFrame(rows, "id int, c string, v double")
    points = figures.category_points(df, ["id"], "c", "v", ["zz", "none", "b"]).collect()
    assert {(p.c, p.place, p.n) for p in points} == {("zz", 0, 1), ("b", 1, 3)} and len(points) == 4
    assert all(abs(p.x - p.place) <= 0.15 for p in points) and len({p.x for p in points}) == 3
    again = figures.category_points(df.repartition(3), ["id"], "c", "v", ["zz", "none", "b"]).collect()
    assert sorted(points) == sorted(again)
    for up, want in ((True, [5, 1, 4, 2]), (False, [5, 4, 1, 2])):
        got = sorted(figures.ordered_ids(df, "id", "v", df["c"].isNotNull(), up).collect())
        assert [x.id for x in got] == want and [x.place for x in got] == [0, 1, 2, 3]
    many = spark.range(5000).selectExpr("id", "id % 7 as k")
    placed = relational.numbered(many, [many["k"], many["id"]], "at").orderBy("at").collect()
    assert [(x.k, x.id) for x in placed] == sorted((i % 7, i) for i in range(5000)) and [x.at for x in placed] == list(range(5000))


def test_trna_and_replicates(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 2, None), ("c", None, 3.0), ("d", 5, 4.0)], "Systematic_ID string, copies int, DR double")
    counts, points = figures.trna_summary(df)
    assert sorted(map(tuple, counts.collect())) == [(2, 2), (5, 1)]
    assert sorted((p.Systematic_ID, p.copy_number, p.y) for p in points.collect()) == [("a", 2, 1.0), ("d", 5, 4.0)]
    one = spark.createDataFrame([(i, float(10**i)) for i in range(4)] + [(9, 0.0)], "k int, v double")
    points, fit = figures.replicate_points(one, one, ["k"], "v")
    assert sorted((p.k, p.in_fit) for p in points.collect()) == [(0, True), (1, True), (2, True), (3, True), (9, False)]
    f = fit.first()
    assert (f.slope, f.n, f["from"], f.to) == (pytest.approx(1), 4, 1.0, 1000.0)


def test_members_of_target_groups(spark):
    long = spark.createDataFrame([("t", "g", "x"), ("t", "h", "x"), ("u", "g", "y"), (None, "g", "z"), ("t", "g", "w")], "group_type string, group_name string, gene string")
    targets = spark.createDataFrame([("t", "g"), ("t", "g"), (None, "g")], "group_type string, group_name string")
    outcomes = spark.createDataFrame([("x", "ok", 0.6, 5.0), ("z", None, None, 1.0)], "gene string, outcome string, DR double, DL double")
    centres = spark.createDataFrame([("t", "g", 0.0, 0.0, "BP"), ("t", "g", 0.6, 0.2, "MF")], "group_type string, group_name string, centroid_x double, centroid_y double, namespace string")
    got = {r.gene: r for r in closed_loop.target_groups(long, targets, outcomes, centres).collect()}
    assert set(got) == {"x", "w", "z"}
    assert got["x"].distance_to_centroid == pytest.approx(math.hypot(0.6 - 0.3, 0.5 - 0.1)) and got["w"].outcome is None and got["w"].distance_to_centroid is None
    assert got["z"].centroid_x is None


@pytest.mark.parametrize("width", [100_000, 37])
def test_flanking_intervals_equal_a_search(spark, width):
    r = random.Random(7)
    genes = [("I", s, s + r.choice([0, 3, 40, 300]), f"g{i:03}", r.choice("+-")) for i, s in enumerate(r.choices(range(2000), k=120))] + [("II", 5, 9, "only", "+"), ("I", 50, 40, "turned", "+"), (None, 1, 2, "nowhere", "+")]
    points = [(i, r.choice(["I", "I", "I", "II", "III", None]), r.choice([None, *r.choices(range(-20, 2400), k=9)])) for i in range(500)]
    g = spark.createDataFrame(genes, "Chr string, Start int, End int, Name string, Strand string").selectExpr("Chr", "Start", "End", "Name", "Name as Systematic_ID", "Strand")
    p = spark.createDataFrame(points, "id int, Chr string, Coordinate int")
    got = {x.id: x for x in intervals.flanked(p, g, ["Name", "Systematic_ID", "Strand"], width=width).collect()}
    kept = [x for x in genes if x[0] is not None and x[1] <= x[2]]
    for i, c, at in points:
        own = [x for x in kept if x[0] == c] if at is not None else []
        left = min((x for x in own if x[2] < at), key=lambda x: (-x[2], x[1], x[3]), default=(None,) * 5)
        right = min((x for x in own if x[1] > at), key=lambda x: (x[1], x[2], x[3]), default=(None,) * 5)
        inner = min((x for x in own if x[1] <= at <= x[2]), key=lambda x: (-x[2], x[1], x[3]), default=(None,) * 5)
        assert [(got[i][f"{s}_Start"], got[i][f"{s}_End"], got[i][f"{s}_Name"]) for s in ("left", "right", "inner")] == [x[1:4] for x in (left, right, inner)]
    rows = intervals.regions(p.where("Chr = 'II'"), g, width=width).where("Coordinate = 7 or Coordinate > 9 or Coordinate < 5").collect()
    for x in rows:
        want = ("Gene", "only", 2, 2) if x.Coordinate == 7 else ("Intergenic region", "only|", x.Coordinate - 9, None) if x.Coordinate > 9 else ("Intergenic region", "|only", None, 5 - x.Coordinate)
        assert (x.Type, x.Name, x.Distance_to_region_start, x.Distance_to_region_end) == want
    near = stages.parental_gene(intervals.regions(spark.createDataFrame([(1, "II", 20, "+"), (2, "II", 2, "-")], "id int, Chr string, Coordinate int, Strand string"), g, width=width).na.fill({"Distance_to_region_start": 10**9, "Distance_to_region_end": 10**9}), 400)
    assert {(x.id, x.Parental_gene, x.UTR_type, x.Distance_to_gene, x.Direction) for x in near.collect()} == {(1, "only", "3UTR", 11, "Forward"), (2, "only", "5UTR", -3, "Reverse")}


def ontology():
    edges = [("a", "r"), ("b", "r"), ("c", "a"), ("d", "a"), ("e", "c"), ("f", "c"), ("f", "b"), ("g", "b")]
    up = {t: {t} for t in "rabcdefg"}
    for _ in range(5):
        for child, parent in edges:
            up[child] |= up[parent]
    genes = {"e": range(0, 6), "f": range(4, 12), "d": range(12, 20), "g": range(18, 40), "b": range(40, 44), "c": [50]}
    return up, [(f"g{i}", t) for t, own in genes.items() for i in own]


def test_likeness_by_hand(spark):
    up, associations = ontology()
    closed = spark.createDataFrame([(t, a) for t, some in up.items() for a in some], "term string, ancestor string")
    spaces = spark.createDataFrame([(t, "BP") for t in up], "term string, namespace string")
    info = similarity.information(closed, spark.createDataFrame(associations, "gene string, term string"), spaces)
    have = {t: {g for g, own in associations if t in up[own]} for t in up}
    total = len(set().union(*have.values()))
    ic = {t: -math.log(len(g) / total) for t, g in have.items()}
    assert {r.term: r.ic for r in info.collect()} == pytest.approx(ic)
    terms = spark.createDataFrame([("x", t) for t in "abcdefg"] + [("y", t) for t in "rab"], "grp string, term string")
    for least in (0.01, 0.3):
        got = {(r.grp, r.a, r.b): r.similarity for r in similarity.relevance(terms, closed, info, least).collect()}
        want = {}
        for grp, some in (("x", "abcdefg"), ("y", "rab")):
            for i, a in enumerate(sorted(some)):
                for b in sorted(some)[i + 1 :]:
                    s = max((2 * ic[c] / (ic[a] + ic[b]) * (1 - len(have[c]) / total) for c in up[a] & up[b] if ic[a] + ic[b]), default=0)
                    if s >= least:
                        want[grp, a, b] = s
        assert got == pytest.approx(want)


def test_lists_without_redundant_terms(spark):
    gone = similarity.eliminate([("a", 0.01, 0.01), ("b", 0.001, 0.01), ("broad", 1e-9, 0.3), ("kid", 0.0100, 0.005), ("rest", 0.01, 0.0095)],
                                [("a", "b", 0.9), ("b", "broad", 0.8), ("a", "kid", 0.7), ("b", "kid", 0.6)], {("kid", "a")})
    assert gone == {"a": (0.9, "b"), "broad": (0.8, "b"), "kid": (0.6, "b")}
    assert similarity.eliminate([("up", 0.01, 0.01), ("kid", 0.01, 0.005)], [("kid", "up", 0.9)], {("kid", "up")}) == {"kid": (0.9, "up")}
    assert similarity.eliminate([("up", 0.01, 0.01), ("kid", 0.01, 0.009)], [("kid", "up", 0.9)], {("kid", "up")}) == {"up": (0.9, "kid")}
    up, associations = ontology()
    closed = spark.createDataFrame([(t, a) for t, some in up.items() for a in some], "term string, ancestor string")
    info = similarity.information(closed, spark.createDataFrame(associations, "gene string, term string"), spark.createDataFrame([(t, "BP") for t in up], "term string, namespace string"))
    terms = spark.createDataFrame([("x", t, 0.001 * (i + 1)) for i, t in enumerate("efcdg")] + [("y", "g", 0.1)], "grp string, term string, p_fdr double")
    rows = {(r.grp, r.term): r for r in similarity.reduced(terms, closed, info, [0.2, 0.9]).collect()}
    assert len(rows) == 6 and not any(r["Eliminated_0.9"] for r in rows.values())
    assert any(r["Eliminated_0.2"] for r in rows.values()) and all(not rows[r.grp, r["Representative_0.2"]]["Eliminated_0.2"] for r in rows.values())
    assert rows["y", "g"]["Representative_0.2"] == "g" and rows["y", "g"]["Dispensability_0.2"] is None


def test_sentinels_and_unique_levels(spark, tmp_path):
    path = f"{tmp_path}/deep/done.txt"
    assert readers.read_sentinel(spark, path) is None
    for counts in ({"a b": 3, "c": 0}, {"c": 7}):
        writers.write_sentinel(spark, path, "module_visualization", counts)
        assert readers.read_sentinel(spark, path) == ("module_visualization", counts)
    assert (tmp_path / "deep/done.txt").read_text() == "module_visualization complete\nc\t7\n"
    dna = spark.createDataFrame([("g", True), ("h", True)], "Gene_id string, Primary_candidate boolean")
    meta = spark.createDataFrame([("g", None)], "Gene_id string, essentiality string")
    twice = spark.createDataFrame([("g", 1), ("g", 2)], "Gene_id string, v int")
    assert stages.merge_features({"dna": dna, "rna": twice.where("v = 1")}, meta).collect()[0].essentiality == "Not_determined"
    with pytest.raises(ValueError, match="repeated"):
        stages.merge_features({"dna": dna, "rna": twice}, meta)


def test_p_values_of_many_correlations():
    from tarnwick.operators.stats import betainc, betainc_half

    rng = np.random.default_rng(1)
    a, x = rng.integers(1, 500, 300) / 2, np.r_[rng.random(296), 0.0, 1.0, 1e-12, 1 - 1e-12]
    assert betainc_half(a, x) == pytest.approx([betainc(float(p), 0.5, float(y)) for p, y in zip(a, x, strict=True)], rel=1e-9, abs=1e-300)


def test_roles_by_the_first_kind_of_words(spark):
    from tarnwick.functions.strings import first_kind

    texts = ["Shared with the core", "a non-essential part", "an essential one", "CATALYTIC", "nothing of the kind", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(first_kind(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == ["shared", "peripheral", "core", "core", "unclear", "unclear"]
