"""A whole run of an ontology from its files to its workbooks; storage of what models need."""

import pytest

from tarnwick.operators import cluster, ml
from tarnwick.plans import ontologies
from tarnwick.sources import readers, workbook


def files(tmp_path):
    terms = [("GO:1", "process", "biological_process", []), ("GO:2", "part", "biological_process", [("is_a", "GO:1")]), ("GO:3", "piece", "biological_process", [("relationship: part_of", "GO:2")]),
             ("GO:4", "ruled", "biological_process", [("relationship: regulates", "GO:2")]), ("GO:5", "binding", "molecular_function", [])]
    lines = ["format-version: 1.2\n"]
    for t, name, space, up in terms:
        lines.append(f"[Term]\nid: {t}\nname: {name}\nnamespace: {space}\ndef: \"the {name}\" [x]\n" + "".join(f"{k}: {p} ! x\n" if k == "is_a" else f"{k} {p} ! x\n" for k, p in up))
    (tmp_path / "go-basic.obo").write_text("\n".join(lines))
    rows = [(f"g{i}", "GO:3") for i in range(12)] + [(f"g{i}", "GO:5") for i in range(30, 36)] + [("g50", "GO:4")]
    (tmp_path / "gene_ontology_annotation.gaf.tsv").write_text("!gaf-version: 2.2\n" + "".join("\t".join(["PomBase", g, g, "", t, *[""] * 12]) + "\n" for g, t in rows) + "\t".join(["PomBase", "g99", "g99", "NOT|x", "GO:3", *[""] * 12]) + "\n")
    (tmp_path / "bp_go_slim_terms.tsv").write_text("GO:2\tpart\nGO:777\tnot there\n")
    (tmp_path / "mf_go_slim_terms.tsv").write_text("GO:5\tbinding\n")
    (tmp_path / "cc_go_slim_terms.tsv").write_text("")


def test_files_to_workbooks(spark, tmp_path):
    files(tmp_path)
    loaded = ontologies.load(spark, "GO", str(tmp_path))
    assert {tuple(r) for r in loaded.closed.where("term = 'GO:3'").collect()} == {("GO:3", x) for x in ("GO:1", "GO:2", "GO:3")}
    assert loaded.closed.where("term = 'GO:4' and ancestor <> 'GO:4'").count() == 0  # regulates is no relation of the run
    assert {r.term for r in loaded.slim.collect()} == {"GO:2", "GO:5"} and loaded.associations.where("gene = 'g99'").count() == 0
    clusters = spark.createDataFrame([(f"g{i}", 1 if i < 12 else 9 if i < 40 else 2) for i in range(80)], "Systematic_ID string, cluster int")
    report = ontologies.enriched("GO", loaded, clusters)
    rows = report.collect()
    one = {(r.background, r.variant, r.term_id) for r in rows if r.grp == 1}
    assert {x for x in one if x[0] == "all"} == {("all", "full", f"GO:{i}") for i in (1, 2, 3)} | {("all", "slim", "GO:2")}
    assert {r.term_id for r in rows if r.grp == 9 and r.background == "all"} == {"GO:5"} and not [r for r in rows if r.grp == 9 and r.background == "nonWT"]
    whole = next(r for r in rows if (r.grp, r.background, r.variant, r.term_id) == (1, "all", "full", "GO:3"))
    assert (whole.namespace, whole.term, whole.level, whole.study_count, whole.pop_count, whole.definition) == ("BP", "piece", 2, 12, 12, "the piece")
    written = ontologies.write_reports(report, "GO", f"{tmp_path}/out")
    assert {k.rsplit("/", 1)[1]: v for k, v in written.items()} == {
        "gene_ontology_enrichment_results.xlsx": ["Full GO Enrichment", "GO Slim Enrichment", "BP", "MF", "Slim BP", "Slim MF"],
        "nonWT_gene_ontology_enrichment_results.xlsx": ["Full GO Enrichment", "GO Slim Enrichment", "BP", "Slim BP"]}
    back = readers.read_sheet(spark, f"{tmp_path}/out/gene_ontology_enrichment_results.xlsx", "BP")
    assert [r.term_id for r in back.collect()] == ["GO:1", "GO:2", "GO:3"] and back.columns[0] == "Cluster"
    ontologies.write_reports(report.where("grp = 77"), "GO", f"{tmp_path}/none")
    assert workbook.read_workbook(spark, f"{tmp_path}/none/gene_ontology_enrichment_results.xlsx", "GO Slim Enrichment").collect()[0].note == "no significant terms"
    with pytest.raises(ValueError, match="unknown ontology"):
        ontologies.load(spark, "KEGG", str(tmp_path))


def test_scalers_and_features(spark, tmp_path):
    params = {"mean.phylop": (0.5, 1.25, 2.0), "pI": (1.0, 0.0, 1.0)}
    ml.save_power(spark, params, f"{tmp_path}/p")
    assert ml.load_power(spark, f"{tmp_path}/p") == params
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "pI double, other double, `diversity.S` double")
    there, gone = ml.available_features(df)
    assert there == ["pI", "diversity.S"] and len(gone) == len(ml.FEATURE_COLUMNS) - 2 and len(set(ml.FEATURE_COLUMNS)) == len(ml.FEATURE_COLUMNS)


def test_auto_merge_numbers_its_groups(spark):
    rows = [(i, (i % 4) * 0.3 + 0.001 * i, 1.0 + (i % 4), i % 4 if i < 40 else None) for i in range(44)]
    df = spark.createDataFrame(rows, "id int, DR double, DL double, raw int")
    df = cluster.normalize_points(df.withColumn("DR", df["DR"] * 2))
    assert df.agg({"x": "max"}).first()[0] > 1.3  # not clipped
    got = {r.id: r.cluster for r in cluster.finalize_auto_merge(df, "raw", 4, wt=4).collect()}
    assert all(got[i] == {3: 1, 2: 2, 1: 3, 0: 4}[i % 4] for i in range(40)) and all(got[i] is None for i in range(40, 44))
    with pytest.raises(ValueError):
        cluster.finalize_auto_merge(df, "raw", 5)


@pytest.mark.parametrize("block", [2048, 9])
def test_silhouette_of_blocks(spark, block):
    import numpy as np

    rng = np.random.default_rng(4)
    p, label = rng.normal(size=(60, 2)), [f"c{i % 3}" for i in range(59)] + ["alone"]
    df = spark.createDataFrame([(i, c, float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(label, p, strict=True))], "id int, c string, x double, y double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    label = np.array(label)
    scores = []
    for i in range(60):
        own = (label == label[i]).sum()
        a = d[i][label == label[i]].sum() / (own - 1) if own > 1 else None
        b = min(d[i][label == c].mean() for c in set(label) - {label[i]})
        scores.append(0.0 if a is None else (b - a) / max(a, b))
    assert cluster.silhouette(df, "id", "c", block=block).first()[0] == pytest.approx(np.mean(scores))
