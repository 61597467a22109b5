import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.functions import semantics as S
from tarnwick.functions import sequence as Q
from tarnwick.operators import cluster, coherence, ml, ontology, relational, stats
from tarnwick.plans import stages


def one(spark, c, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in cols.items()) or "z int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(c).first()[0]


def test_ratio_and_clip(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.ratio(a, b), a=1.0, b=0.0) == math.inf and one(spark, S.ratio(a, b), a=-1.0, b=0.0) == -math.inf
    assert one(spark, S.ratio(a, b), a=0.0, b=0.0) is None and one(spark, S.ratio(a, b), a=3.0, b=2.0) == 1.5
    assert one(spark, S.clip_upper(a, 200.0), a=None) is None and one(spark, S.clip_upper(a, 200.0), a=300.0) == 200
    assert one(spark, S.half_even(F.lit(0.125), 2)) == 0.12
    df = spark.createDataFrame([(math.nan, None), (1.0, "x")], "v double, s string")
    assert [r.v for r in S.nan_to_null(df).collect()] == [None, 1.0]


def test_insertion_fraction(spark):
    rows = [(0, 100, 0.0), (30, 70, 0.3), (100, 0, 1.0), (-10, 110, 0.0), (150, -50, 1.0), (0, 0, None)]
    df = spark.createDataFrame(rows, "a long, b long, want double")
    assert all(r.got == r.want for r in df.withColumn("got", S.insertion_fraction(F.col("a"), F.col("b"))).collect())


def test_digitize_is_right_open(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(S.digitize(F.col("v"), [1.0, 2.0])).collect()] == [0, 1, 2, None]


def test_dedupe_priority_and_override(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, None), ("b", 2, False)], "k string, n int, ok boolean")
    assert sorted((r.k, r.n) for r in relational.dedupe_priority(df, ["k"], F.col("ok"), [F.col("n")]).collect()) == [("a", 2), ("b", 1)]
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    other = spark.createDataFrame([(1, None), (2, "w")], "k int, o string")
    assert sorted((r.k, r.v) for r in relational.override(base, other, ["k"], "v", "o").collect()) == [(1, None), (2, "w"), (3, "z")]


def test_resolve_ids_first_level_decides(spark):
    meta = spark.createDataFrame([("A1", "n1", "s1,s2"), ("A2", "n1", "s2"), ("A3", "A1", None)], "id string, name string, synonyms string")
    df = spark.createDataFrame([("A1",), ("n1",), ("s1",), ("s2",), ("what",), (None,)], "g string")
    got = {r.g: r.resolved for r in relational.resolve_ids(df, "g", meta).collect()}
    assert got == {"A1": "A1", "n1": None, "s1": "A1", "s2": None, "what": "what", None: None}


def test_legacy_names_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "um int, lam int, DL int")
    assert relational.normalize_metrics(df).columns == ["DR", "lam", "DL"]
    with pytest.raises(ValueError):
        relational.require_columns(df, ["nope"])


def test_coverage_fixture(spark):
    rows = [("c", i, "+", "t", "gene", 10, i) for i in range(30)] + [("c", 100 + i, "+", "t", "Intergenic region", 0, i) for i in range(10)] + [("c", 999, "+", "t", "gene", 3, 0)]
    ann = spark.createDataFrame(rows, "Chr string, Coordinate long, Strand string, Target string, Type string, Distance_to_stop_codon long, row_id long")
    genes = spark.createDataFrame([("a", 0.5, "E"), ("b", None, "V"), ("c", 0.8, "E"), ("d", None, None)], "id string, um double, DeletionLibrary_essentiality string")
    got = {(r.metric, r.category): (r.total, r.covered) for r in stages.coverage_stage(ann.select(*stages.KEY), ann, genes).collect()}
    assert got[("insertions", "all")] == (41, 30) and got[("genes", "all")] == (4, 2) and got[("genes_by_essentiality", "E")] == (2, 2)


def test_utr_fixtures(spark):
    rows = [("+", "+", 50, 600, "5UTR"), ("+", "+", 600, 80, "3UTR"), ("+", "-", 600, 100, "5UTR"), ("+", "-", 50, 600, "3UTR"), ("+", "+", 500, 600, None)]
    df = spark.createDataFrame(rows, "s string, g string, a long, b long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", stages.utr_type(F.col("s"), F.col("g"), F.col("a"), F.col("b"), 400)).collect())
    cols = "Name string, Systematic_ID string, Strand_Interval string, Strand string, Distance_to_region_start long, Distance_to_region_end long"
    none = ("", "neither", 0, "")
    cases = [
        ("+|+", "+", 100, 600, ("l", "3UTR", 100, "Forward")), ("+|+", "+", 600, 80, ("r", "5UTR", -80, "Forward")), ("+|+", "+", 150, 150, ("l", "3UTR", 150, "Forward")),
        ("+|+", "-", 200, 90, ("r", "5UTR", -90, "Reverse")), ("-|+", "+", 100, 600, ("l", "5UTR", -100, "Reverse")), ("+|-", "-", 600, 80, ("r", "3UTR", 80, "Forward")),
        ("+|+", "+", 400, 600, none), ("+|+", "+", 400, 100, none), ("+|+", "+", 100, 400, none), ("+|+", "+", 500, 600, none), ("+|+", "+", None, 600, none),
    ]
    for strands, strand, start, end, want in cases:
        r = stages.parental_gene(spark.createDataFrame([("l|r", "l|r", strands, strand, start, end)], cols), 400).first()
        assert (r.Parental_gene, r.UTR_type, r.Distance_to_gene, r.Direction) == want


def test_rank_ratio_and_regression(spark):
    df = spark.createDataFrame([("s", float(r)) for r in (10, 20, 40, 80, 160, 320)], "k string, reads double")
    rows = stats.rank_ratio(df, ["k"], "reads", [1.5e-5, 4e-5, 16e-5, 64e-5, 256e-5, 1024e-5]).orderBy("reads").collect()
    assert [r.ratio for r in rows] == [1.5e-5, 4e-5, 16e-5, 64e-5, 256e-5, 1024e-5] and rows[0].shifted == 0 and rows[0].log2_relative == -math.inf and rows[-1].relative == 1
    fit = stats.ols(spark.createDataFrame([(float(x), 0.95 * x + 1) for x in range(9)] + [(-math.inf, 1.0)], "x double, y double"), "x", "y").first()
    assert fit.slope == pytest.approx(0.95) and fit.r2 > 0.99 and fit.n == 9
    log = stats.loglog(spark.createDataFrame([(1.0, 1.0), (10.0, 10.0), (0.0, 5.0), (5.0, -1.0)], "x double, y double"), "x", "y").first()
    assert log.n == 2


def test_correlation_p_value(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), None if i > 3 else 1.0) for i in range(10)], "x double, y double, z double")
    rows = {(r.x, r.y): r for r in stats.pairwise_correlation(df, ["x", "y", "z"]).collect()}
    x, y = np.arange(10.0), np.array([i * i % 7 for i in range(10)], float)
    r = np.corrcoef(x, y)[0, 1]
    t = r * math.sqrt(8 / (1 - r * r))
    grid = np.linspace(-60, 60, 2_000_001)
    dens = (1 + grid**2 / 8) ** -4.5
    assert rows[("x", "y")].r == pytest.approx(r) and rows[("x", "y")].p == pytest.approx(dens[np.abs(grid) >= abs(t)].sum() / dens.sum(), abs=1e-4)
    assert rows[("x", "z")].r is None and rows[("x", "z")].n == 4


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 40), st.data())
def test_fisher_equals_exact_fractions(big_n, data):
    from fractions import Fraction

    import pandas as pd

    big_k, n = data.draw(st.integers(1, big_n)), data.draw(st.integers(1, big_n))
    k = data.draw(st.integers(max(0, n + big_k - big_n), min(n, big_k)))
    pmf = {i: Fraction(math.comb(big_k, i) * math.comb(big_n - big_k, n - i), math.comb(big_n, n)) for i in range(max(0, n + big_k - big_n), min(n, big_k) + 1)}
    want = float(sum(p for p in pmf.values() if p <= pmf[k]))
    got = stats.fisher_two_sided.func(pd.Series([k]), pd.Series([n]), pd.Series([big_k]), pd.Series([big_n]))[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_benjamini_hochberg_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(p)], "run int, t int, p double")
    got = [r.p_fdr for r in stats.benjamini_hochberg(df, ["run"], "p", ["t"]).orderBy("t").collect()]
    assert got == pytest.approx([0.1 / 3, 0.1 / 3, 0.1 / 3, 0.625, 0.9])


def test_closure_and_slim(spark):
    e = spark.createDataFrame([("c", "b", "is_a"), ("b", "a", "is_a"), ("c", "d", "part_of"), ("d", "a", "is_a")], "child string, parent string, relation string")
    closed = {(r.term, r.ancestor) for r in ontology.closure(e).collect()}
    assert closed == {(x, x) for x in "abcd"} | {("c", "b"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "a")}
    assert ("c", "d") not in {(r.term, r.ancestor) for r in ontology.closure(e, ["is_a"]).collect()}
    slim = spark.createDataFrame([("a",), ("b",)], "term string")
    direct = {(r.term, r.slim) for r in ontology.slim_direct(ontology.closure(e), slim).collect()}
    assert direct == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "a")}
    with pytest.raises(ValueError):
        ontology.closure(spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "child string, parent string"), max_depth=3)


def test_renumber(spark):
    df = spark.createDataFrame([(0, 0.9, 1.0), (1, 0.5, 2.0), (2, 0.5, 1.0), (3, 0.1, 0.0), (None, 0.3, 0.0)], "raw int, DR double, DL double")
    got = {r.raw: r.cluster for r in cluster.renumber(df, groups=4, wt=9).collect()}
    assert got == {0: 1, 2: 2, 1: 3, 3: 9, None: None}
    assert {r.raw: r.cluster for r in cluster.renumber(df, ascending=True).collect()}[3] == 1
    with pytest.raises(ValueError):
        cluster.renumber(df, groups=3)


def test_merge_tree_finds_blobs():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (2, 0), (0, 2))])
    for kind in ("ward", "complete"):
        labels = cluster.merge_tree(p, 3, kind)
        assert len(set(labels)) == 3 and all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40))


def test_coherence(spark):
    assert coherence.weiszfeld(np.array([[0.0, 0], [1, 0], [0, 1], [1, 1]])) == pytest.approx([0.5, 0.5], abs=1e-4)
    rng = np.random.default_rng(1)
    cloud = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)))]
    background = spark.createDataFrame(cloud, "gene int, x double, y double")
    tight = sorted(cloud, key=lambda r: r[1] ** 2 + r[2] ** 2)[:8]
    members = spark.createDataFrame([("tight", *r) for r in tight] + [("lone", *cloud[0])], "grp string, gene int, x double, y double")
    rows = {r.grp: r for r in coherence.permutation_test(members, background, "grp", "gene", times=200).collect()}
    assert rows["tight"].z < -2 and rows["tight"].p < 0.05 and (rows["lone"].z, rows["lone"].p) == (0, 1)
    assert {r.grp: r.knn for r in coherence.knn_mean(members, "grp", "gene").collect()}["lone"] == 0
    two = spark.createDataFrame([("g", i, float(rng.normal(5 * (i % 2), 0.1)), 0.0 + float(rng.normal(0, 0.1))) for i in range(20)], "grp string, gene int, x double, y double")
    assert {r.reason for r in coherence.major_minor(two, "grp", "gene").collect()} == {"split"}


def test_sequences(spark):
    c = F.lit("ATGGCCTAAGG")
    df = spark.range(1)
    r = df.select(Q.gc_fraction(c), Q.gc3(c), Q.codons(c), Q.reverse_complement(c), Q.translated(c), Q.aliphatic_index(F.lit("A")), Q.aliphatic_index(F.lit("VILA"))).first()
    assert r[0] == pytest.approx(6 / 11) and r[1] == pytest.approx(2 / 3) and r[2] == ["ATG", "GCC", "TAA"] and r[3] == "CCTTAGGCCAT" and r[4] == "MA"
    assert r[5] == 10000.0 and r[6] == pytest.approx((1 + 2.9 + 7.8) / 4 * 10000)
    counts = Q.anticodon_counts(spark.createDataFrame([("g", "ATGATGGC")], "k string, s string"), "k", "s").first()
    assert counts["CAT"] == 2 and len(counts) == 65
    assert Q.plddt_measures(spark.createDataFrame([("p", 87.5)], "k string, v double"), "k", "v").first()[1:] == (87.5, 0.0, 0.0, 0.0)


def test_feature_transforms(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    z = [r.v for r in ml.standard_scale(df, ["v"]).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    x = np.exp(np.random.default_rng(0).normal(size=400))
    lam = ml.fit_lambda(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    assert -2 < lam < 0.2
    train, test = ml.hash_split(spark.range(1000).toDF("k"), ["k"])
    assert train.count() + test.count() == 1000 and 150 < test.count() < 250


def test_outcome_chain(spark):
    from tarnwick.plans import outcomes

    schema = "gene string, gene_name string, verification_essentiality string, DeletionLibrary_essentiality string, comments string, R2 double, total_colonies double, filtering_fraction double, FYPOviability string, median_area_day6 double"
    rows = [
        ("a", "SPAC1.01", "E", "V", None, 0.99, 60.0, 0.9, "viable", 0.0), ("b", "abc1", "V", "E", None, 0.99, 60.0, 0.9, "inviable", 0.3),
        ("c", "pyp3", "E", "E", None, 0.99, 60.0, 0.9, "condition-dependent", None), ("d", "abc2", "V", "V", "小菌落", 0.99, 60.0, 0.9, "viable", None),
        ("e", "abc3", "E", "V", None, 0.5, 40.0, 0.1, "viable", None), ("f", "SPBC1.02", "E", None, None, None, None, None, None, None),
        ("g", "SPBC1.03", "V", "n.d.", "fine", 0.985, 60.0, 0.9, "viable", 0.5), ("h", "abc4", None, "V", None, 0.99, 60.0, 0.9, "viable", None),
        ("i", "abc5", "E", "V", "?", 0.99, 60.0, 0.9, "condition-dependent", 0.2),
    ]
    table = outcomes.outcome_table(spark.createDataFrame(rows, schema)).cache()
    got = {r.gene: (r.essentiality_concordance, r.qc_flag_reason, r.outcome) for r in table.collect()}
    assert got == {
        "a": ("flip_V2E", "", "flip_V2E"), "b": ("flip_E2V", "", "flip_E2V"), "c": ("concordant_E", "noised_gene", "ambiguous"), "d": ("concordant_V", "borderline_comment", "ambiguous"),
        "e": ("flip_V2E", "poor_fit;thin_colonies;low_filter_fraction", "ambiguous"), "f": ("no_library_ref", "", "no_library_ref"), "g": ("no_library_ref", "", "no_library_ref"),
        "h": ("flip_E2V", "", "flip_E2V"), "i": ("flip_V2E", "borderline_comment", "ambiguous"),
    }
    assert [(r.gene, r.priority) for r in outcomes.novel_genes(table).collect()] == [("a", 0), ("g", 9)]
    assert {r.gene: r.failure_cause for r in outcomes.failure_causes(table).collect()} == {"c": "both", "d": "borderline_observation", "e": "data_quality", "i": "biology_condition_dependent"}
    flipped = outcomes.flips(table)
    assert {r.gene: (r.flip_reason, r.area_confirms_flip) for r in flipped.collect()} == {
        "a": ("unconditional_viable_to_essential", True), "b": ("unconditional_essential_to_viable", True), "e": ("unconditional_viable_to_essential", True),
        "h": ("other", False), "i": ("condition_dependent_annotation", False),
    }
    assert [r.gene for r in outcomes.sure_flips(flipped).collect()] == ["a"]


def test_outlier_groups_and_review(spark):
    genes = spark.createDataFrame([
        ("a", "WT-like", 0.4, None), ("b", "small colonies", 0.8, "E"), ("c", "small colonies", 0.8, None), ("d", "spores", 0.2, "E"), ("e", "spores, germinated", 0.2, "E"), ("f", "WT-like", 0.35, None), ("g", "germinated", 0.1, "V"),
    ], "Systematic_ID string, Category string, DR double, DeletionLibrary_essentiality string")
    got = {name: [r.Systematic_ID for r in genes.where(cond).orderBy("Systematic_ID").collect()] for name, (cond, _) in stages.outlier_groups().items()}
    assert got == {"WT2nonWT": ["a"], "scE2E": ["b"], "sc2E": ["c"], "E2V": ["d", "g"]}
    verified = spark.createDataFrame([("d", "WT"), ("d", "WT"), ("d", "odd")], "Systematic_ID string, result string")
    assert [(r.Systematic_ID, r.bucket) for r in stages.outlier_review(genes, verified, "E2V").collect()] == [("g", "Not verified"), ("d", "WT")]


def test_attribution_needs_the_reason_of_the_split(spark):
    rows = [("a", "split", 0.9), ("b", "one component", 0.5), ("c", "too few members", 0.2), ("d", "too few members", 0.8), ("e", "not separated", None)]
    got = {r.k: r.cause for r in coherence.attribution(spark.createDataFrame(rows, "k string, reason string, shared_fraction double")).collect()}
    assert got == {"a": "major_minor_split", "b": "shared_subunits", "c": "data_limited", "d": "shared_subunits", "e": "intrinsic_heterogeneity"}


def test_pipeline_builds_what_is_missing(spark, tmp_path):
    calls = []

    def first():
        calls.append("first")
        return spark.range(3)

    p = stages.Pipeline(str(tmp_path)).add("first", [], first).add("second", ["first"], lambda df: df.where("id > 0"))
    assert p.table(spark, "second").count() == 2 and p.table(spark, "second").count() == 2 and calls == ["first"]


def test_peptide_scales_against_plain_sums(spark):
    peptide = "MKKLWDERGHACDYSTPNQVIF" * 3
    value = [Q.FLEXIBILITY[a] for a in peptide]
    pairs = [(0, 0.25), (1, 0.4375), (2, 0.625), (3, 0.8125)]
    windows = [sum((value[i + j] + value[i + 8 - j]) * w for j, w in pairs) + value[i + 5] for i in range(len(peptide) - 9)]
    assert one(spark, Q.flexibility(F.col("p")), p=peptide) == pytest.approx(sum(windows) / len(windows) / 5.25)
    assert one(spark, Q.flexibility(F.col("p")), p=peptide[:9]) is None
    assert one(spark, Q.instability(F.col("p"), {"AC": 3.0, "CA": -1.0}), p="ACAA*C") == pytest.approx(10 * (3 - 1 + 1) / 4)
    assert one(spark, Q.instability(F.col("p"), {}), p="") is None
    point = one(spark, Q.isoelectric_point(F.col("p")), p=peptide)
    assert abs(one(spark, Q.charge_at(F.col("p"), F.lit(point)), p=peptide)) < 1e-3
    assert one(spark, Q.isoelectric_point(F.col("p")), p="KKKKK") > 9 > 5 > one(spark, Q.isoelectric_point(F.col("p")), p="DDDDD")


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0, 2.0, 2.7])
def test_inverse_power(spark, lam):
    for x in (-3.0, -0.4, 0.0, 2.5):
        assert one(spark, ml.inverse_yeo_johnson(ml.yeo_johnson(F.col("x"), lam), lam), x=x) == pytest.approx(x, abs=1e-9)


def test_manual_merge_and_unique_keys(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.9, 1.0), (2, 0.8, 2.0), (None, 0.5, 1.0)], "raw int, DR double, DL double")
    got = {r.raw: r.cluster for r in cluster.manual_merge(df, {0: 7, 1: 5, 2: 5}).collect()}
    assert got == {0: 2, 1: 1, 2: 1, None: None}
    with pytest.raises(ValueError):
        cluster.manual_merge(df, {0: 7, 1: 5})
    assert relational.require_unique(df, ["raw"]) is df
    with pytest.raises(ValueError):
        relational.require_unique(df.union(df), ["raw"])


def test_keyword_groups_and_buckets(spark):
    df = spark.createDataFrame([(1, "Kinase complex"), (2, "kinase INHIBITOR"), (3, None)], "id int, t string")
    rows = relational.keyword_groups(df, "t", [("k", ["kinase"], ["inhibitor"]), ("any", ["complex", "inhib"], [])]).collect()
    assert sorted((r.id, r.module) for r in rows) == [(1, "any"), (1, "k"), (2, "any")]
    labels = spark.createDataFrame([(1, "E"), (2, None), (3, "other"), (4, "V")], "id int, v string")
    assert sorted((r.bucket_no, r.id) for r in relational.bucketed(labels, "v", ["V", "E"]).collect()) == [(1, 2), (2, 4), (3, 1)]


def test_levels_keep_first_complete_rows(spark):
    from tarnwick.plans import features

    a = spark.createDataFrame([("g1", 1, 1.0, 3.0), ("g1", 2, 9.0, 9.0), ("g2", 3, 1.0, None), ("x", 4, 1.0, 1.0)], "Gene_id string, row_no int, a1 double, a2 double")
    k = spark.createDataFrame([("g2", 1, 0.12345)], "Gene_id string, row_no int, half double")
    coding = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "Gene_id string")
    got = {r.Gene_id: (r.c_mean, r.c_std, r.half) for r in features.rna_level(a, {"c": ["a1", "a2"]}, k, coding).collect()}
    assert got == {"g1": (2.0, 1.414, None), "g2": (None, None, 0.123)}


def test_coherence_by_kind(spark):
    rng = np.random.default_rng(0)
    back = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(60)], "id long, x double, y double")
    df = back.where("id < 12").withColumn("grp", F.col("id") % 2).withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    got = coherence.permutation_by_kind(df, {"a": back, "b": back}, "kind", "grp", "id", times=50).collect()
    assert sorted((r.kind, r.grp) for r in got) == [("a", 0), ("b", 1)]


def test_effective_codons_gathers_no_group_in_one_row(spark):
    from tarnwick.plans import registry

    plan = registry.queries()["effective_codons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    rows = [("a", "TTTTTCCTTC"), ("a", "TTTTT"), ("a", None), ("b", "GGGGGAGGTGGT")]
    df = spark.createDataFrame(rows, "k string, s string").select("k", F.explode(Q.codons(F.col("s"))).alias("c"))
    assert sorted((r.k, r.c) for r in df.collect()) == [("a", "CTT"), ("a", "TTC"), ("a", "TTT"), ("a", "TTT"), ("b", "GGA"), ("b", "GGG"), ("b", "GGT"), ("b", "GGT")]


def test_charge_counts_letters_once_and_third_letters_walk_once(spark):
    plan = spark.range(1).select(Q.isoelectric_point(F.lit("MKDE")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") <= 2 * sum(map(len, Q.PKA.values()))
    for text in ("", "ab", "abc", "abcdefgh", "a\nbc\nef"):
        assert one(spark, Q.every_third(F.col("p")), p=text) == text[2::3]
        assert one(spark, Q.every_third(F.col("p"), 1), p=text) == text[::3]
