"""The transcript records, dispersion scores, services and registry against plain expectations."""

from itertools import combinations

import numpy as np
import pytest

from tarnwick.operators import coherence, ml, ontology
from tarnwick.plans import features as L
from tarnwick.sources import datasets, web


def test_dna_record_of_both_strands(spark):
    t = spark.createDataFrame([("g1", "g1.1", "I", "+", "GGCC"), ("g2", "g2.1", "I", "-", "ATAT"), ("SPMIT.03", "SPMIT.03.1", "M", "+", "")], "Gene_id string, mRNA_id string, Chromosome string, Strand string, gene_sequence string")
    cds = spark.createDataFrame([("g1.1", 201, 206, "ATGGCC"), ("g1.1", 301, 306, "GCATAA"), ("g2.1", 401, 406, "GCATAA"), ("g2.1", 501, 506, "ATGGCG"), ("SPMIT.03.1", 1, 6, "ATGTAA")], "mRNA_id string, start int, end int, sequence string")
    introns = spark.createDataFrame([("g2.1", 450, 453, "AAGG"), ("g2.1", 407, 410, "ATTT")], "mRNA_id string, start int, end int, sequence string")
    marks = spark.createDataFrame([("I", 1000, 100, 900, 400, 500)], "Chromosome string, length int, left int, right int, centromere_start int, centromere_end int")
    primary = spark.createDataFrame([("g1", 3), ("g2", 9), ("SPMIT.03", 99)], "Gene_id string, Primary_peptide_length int")
    out = {r.Gene_id: r for r in L.dna_record(t, cds, introns, marks, primary).collect()}
    assert len(out["g1"]) == 27
    a, b, m = out["g1"], out["g2"], out["SPMIT.03"]
    assert (a.Start, a.End, a.Abs_distance_from_telomere, a.Relative_distance_from_telomere, a.Abs_distance_from_centromere) == (201, 306, 153, 0.153, 197.0)
    assert (a.Gene_length, a.CDS_number, a.Peptide_length, a.Primary_candidate, a.Containing_intron, a.Average_intron_length, a.GC_content_of_intron) == (106, 2, 3, True, False, 0.0, 0.0)
    # The reverse strand is read from its last part down; its first intron is the one of the least start.
    assert (b.Start, b.End, b.Peptide_length, b.Primary_candidate) == (506, 401, 3, False)
    assert (b.Intron_number, b.Total_intron_length, b.Average_intron_length, b.GC_contents_of_first_intron, b.GC_content_of_intron) == (2, 8, 4.0, 0.0, 0.25)
    assert b.GC3 == 50.0 and b.Fraction_of_CDS == 0.113
    assert m.Abs_distance_from_telomere is None and m.Abs_distance_from_centromere is None and m.Primary_candidate


def test_half_lives_split_and_keep_first(spark):
    rows = [(1, "a;b", "x", 1.0, 5.0), (2, "b", "x", 1.0, 6.0), (3, None, "c", 1.0, 7.0), (4, "d", "x", None, 8.0)]
    t = spark.createDataFrame(rows, "row_no int, ids string, name string, rate double, half_life double")
    assert sorted(tuple(r) for r in L.half_lives(t).collect()) == [("a", 5.0), ("b", 5.0), ("c", 7.0)]


def test_dispersions_against_all_pairs():
    p = np.random.default_rng(1).normal(size=(9, 2))
    d = [np.linalg.norm(a - b) for a, b in combinations(p, 2)]
    near = [np.mean(sorted(np.linalg.norm(p[i] - p[j]) for j in range(9) if j != i)[:3]) for i in range(9)]
    got = dict(zip(coherence.DISPERSIONS, coherence.dispersions(p), strict=True))
    assert got["mean_pairwise_distance"] == pytest.approx(np.mean(d)) and got["median_pairwise_distance"] == pytest.approx(np.median(d))
    assert got["max_pairwise_distance"] == pytest.approx(max(d)) and got["mean_knn_distance"] == pytest.approx(np.mean(near))


def test_dispersion_scores_find_the_tight_group(spark):
    rng = np.random.default_rng(2)
    rows = [("loose", i, *map(float, rng.normal(size=2))) for i in range(40)] + [("tight", 100 + i, *map(float, rng.normal(size=2) * 0.01)) for i in range(10)] + [("lone", 200, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "grp string, gene int, x double, y double")
    out = {r.grp: r for r in coherence.dispersion_scores(df, df, "grp", "gene", times=60).collect()}
    assert all(out["tight"][f"{m}_zscore"] < -1 and out["tight"][f"{m}_pvalue"] <= 1 / 30 for m in coherence.DISPERSIONS)
    assert all((out["lone"][f"{m}_zscore"], out["lone"][f"{m}_pvalue"]) == (0.0, 1.0) for m in coherence.DISPERSIONS)
    # The one measure that permutation_test has must agree with it, draw for draw.
    one = {r.grp: r for r in coherence.permutation_test(df, df, "grp", "gene", times=60).collect()}
    assert out["tight"].mean_pairwise_distance_zscore == pytest.approx(one["tight"].z) and out["loose"].mean_pairwise_distance_pvalue == pytest.approx(one["loose"].p)


def test_bundled_terms_give_the_same_rates(spark):
    genes = spark.createDataFrame([(i,) for i in range(60)], "gene int")
    study = spark.createDataFrame([("a", i) for i in range(12)] + [("b", i) for i in range(30, 45)], "grp string, gene int")
    assoc = spark.createDataFrame([(i, f"t{k}") for i in range(60) for k in range(20) if (i * 7 + k * k) % (k + 3) == 0 or (k == 4 and i < 13)], "gene int, term string")
    spaces = spark.createDataFrame([(f"t{k}", "BP") for k in range(20)], "term string, namespace string")
    whole = ontology.enrich(study, genes, assoc, spaces, 0.9, significant=False).where("p_fdr < 0.9 and direction = 'e'")
    short = ontology.enrich(study, genes, assoc, spaces, 0.9)
    want, got = ({(r.grp, r.term): r.p_fdr for r in df.collect()} for df in (whole, short))
    assert got and got == pytest.approx(want)


def test_transform_map_powers(spark):
    rows = [(i, float(i * i), float(i)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "k int, `a.b` double, t double")
    out = ml.transform_map(df, {"a.b": "PowerTransformer"}, ["t"], "k").toPandas()
    assert list(out.columns) == ["k", "a.b", "t"]
    assert out["a.b"].mean() == pytest.approx(0, abs=1e-9) and out["a.b"].std(ddof=0) == pytest.approx(1) and out["a.b"].is_monotonic_increasing


STRING = {
    "get_string_ids": "<data><record><stringId>4896.a</stringId></record><record><stringId>4896.b</stringId></record></data>",
    "enrichment": "<data><record><category>KEGG</category><term>k1</term><number_of_genes>1</number_of_genes><number_of_genes_in_background>2</number_of_genes_in_background><preferredNames>a</preferredNames><p_value>0.01</p_value><fdr>0.02</fdr><description>path</description></record></data>",
}


def test_string_enrichment_tries_again_and_keeps(spark, tmp_path):
    asked = []

    def post(url, fields):
        asked.append((url.rsplit("/", 1)[1], fields))
        return "Something went wrong!" if len(asked) == 1 else STRING[url.rsplit("/", 1)[1]]

    got = web.string_enrichment(spark, ["a"], ["b", "a"], str(tmp_path), post, delay=0).collect()
    assert [(r.term_id, r.namespace, r.ratio_in_study, r.ratio_in_pop) for r in got] == [("k1", "KEGG Pathways", "1/1", "2/2")]
    assert [a for a, _ in asked] == ["get_string_ids", "get_string_ids", "enrichment"] and asked[2][1]["background_string_identifiers"] == "4896.a%0d4896.b"
    again = web.string_enrichment(spark, ["a"], ["a", "b"], str(tmp_path), post, delay=0).collect()
    assert again == got and len(asked) == 3


def test_string_enrichment_failures(spark, tmp_path):
    def half(url, fields):
        if url.endswith("enrichment"):
            raise OSError("down")
        return STRING["get_string_ids"]

    def dead(url, fields):
        raise OSError("down")

    assert web.string_enrichment(spark, ["a"], ["b"], str(tmp_path), half, delay=0) is None
    with pytest.raises(ValueError, match="5 times"):
        web.string_enrichment(spark, ["a"], ["b"], str(tmp_path), dead, delay=0)


def test_revigo_names_representatives(spark, tmp_path):
    page = "<html><table><tr><th>Term ID</th><th>Name</th><th>Dispensability</th><th>Eliminated</th><th>Representative</th></tr><tr><td>GO:0000001</td><td>one</td><td>0</td><td>False</td><td></td></tr><tr><td>GO:0000022</td><td>two</td><td>0.8</td><td>True</td><td>1</td></tr></table><table><tr><td>x</td></tr></table></html>"
    out = web.revigo(spark, [("GO:0000001", 0.01), ("GO:0000022", 0.02)], str(tmp_path), post=lambda u, f: page, delay=0)
    assert sorted((r.term_id, r.Dispensability, r.Representative) for r in out.collect()) == [("GO:0000001", 0.0, "one"), ("GO:0000022", 0.8, "one")]


def test_parse_rows():
    assert web.parse_rows("a\tb\n1\t2\n", "tsv") == [{"a": "1", "b": "2"}] and web.parse_rows("1\t2\n", "tsv-no-header") == [{"0": "1", "1": "2"}]
    assert web.parse_rows('[{"a": 1}]', "json") == [{"a": 1}]
    with pytest.raises(ValueError):
        web.parse_rows("", "pdf")


def test_registry_and_landmarks(spark, tmp_path):
    entry = {"label": "L", "release_dir": "r", "has_time_points": False, "has_imputation": True}
    registry = {"default_dataset": "d", "snakemake_repo": str(tmp_path), "datasets": {"d": entry}}
    one = datasets.dataset(registry)
    assert set(one.paths) == {"annotations", "baseMean", "LFCs", "imputation_statistics"}
    with pytest.raises(FileNotFoundError, match="baseMean"):
        one.validate(spark)
    for p in one.paths.values():
        path = tmp_path / p[len(str(tmp_path)) + 1 :]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    assert one.validate(spark) is one
    with pytest.raises(KeyError, match="registered"):
        datasets.dataset(registry, "other")
    marks = tmp_path / "marks.yaml"
    marks.write_text("chromosome_end: {left: {I: 10}, right: {I: 90}}\ncentromere_positions: {I: [40, 50]}\n")
    rows = datasets.landmarks(spark, str(marks), {"I": 100, "M": 20}).collect()
    assert [tuple(r) for r in rows] == [("I", 100, 10, 90, 40, 50), ("M", 20, None, None, None, None)]


def test_phenotype_sources_by_their_own_columns(spark):
    def table(schema, rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no int, " + schema)

    meta = spark.createDataFrame([("g1", "one", "old1"), ("g2", "two", None), ("g3", "three", None)], "id string, name string, synonyms string")
    sources = {
        "viability": table("gene_systematic_id string, FYPOviability string", [("g1", "viable"), ("g4", "inviable")]),
        "library": table("`Systematic ID` string, `Gene dispensability. This study` string, Category string, Sub_category string, Growth_tier string", [("g1", "E", "c", "s", "t"), ("g2", "V", None, None, None)]),
        "verification": table("systematic_id string, verification_essentiality string", [("g1", "E"), ("g1", "V")]),
        "barseq": table("gene string, yes double, `SM fitness defect from Koch et al` double", [("old1", 0.5, 0.1), ("two", 0.7, None)]),
        "density": table(f"`Gene name` string, `{L.DENSITY}` double", [(" zzz two ", 3.0), ("g3", 4.0), ("g3", 5.0)]),
        "divergence": table("gene string, ipkm double, uipkm double, `Malecki2016.KO.colony.size` double", [("three", 1.0, 2.0, 3.0)]),
        "crispri": table("`Systematic ID` string, `Max Growth Rate` string, `Colony Formation` string", [("units", "1/h", "-"), ("g2", "0.3", "yes"), ("g3", None, "no")]),
    }
    library, verified, others = L.phenotype_tables(**sources, meta=meta)
    coding = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "Gene_id string")
    got = {r.Gene_id: r.asDict() for r in L.phenotype_level(library, verified, others, coding, "DeletionLibrary_essentiality").collect()}
    assert set(got) == {"g1", "g2", "g3"} and len(got["g1"]) == 15
    assert (got["g1"]["DeletionLibrary_essentiality"], got["g1"]["revised_DeletionLibrary_essentiality"], got["g1"]["Barseq_from_dulab"], got["g1"]["FYPOviability"]) == ("E", "V", 0.5, "viable")
    assert (got["g2"]["revised_DeletionLibrary_essentiality"], got["g2"]["Barseq_from_dulab"], got["g2"][L.DENSITY], got["g2"]["Max Growth Rate"]) == ("V", None, 3.0, "0.3")
    assert (got["g3"][L.DENSITY], got["g3"]["colony_size_Malecki2016"], got["g3"]["Max Growth Rate"]) == (4.0, 3.0, None)
