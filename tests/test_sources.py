import pytest
from pyspark.sql import functions as F

from tarnwick.sources import readers as R
from tarnwick.sources import writers as W
from tarnwick.streaming import events


def test_read_table_by_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert R.read_table(spark, f"{tmp_path}/a.tsv").first() == (1, 2) == R.read_table(spark, f"{tmp_path}/b.csv").first()
    with pytest.raises(ValueError):
        R.read_table(spark, f"{tmp_path}/c.unknown")
    (tmp_path / "c.bed").write_text("\t".join(["I", "1", "9", "n", ".", "+", "1", "9", "0", "1", "8", "0"]) + "\n")
    assert R.read_bed(spark, f"{tmp_path}/c.bed").first() == ("I", 1, 9, "n", ".", "+")
    (tmp_path / "pairs").write_text("a\tx|y\nb\tNONE\n")
    assert [tuple(r) for r in R.read_pairs(spark, f"{tmp_path}/pairs", ("k", "v")).collect()] == [("a", "x|y"), ("b", None)]
    (tmp_path / "two.tsv").write_text("\t\ts1\ts1\nChr\tPos\tt0\tt1\nI\t5\t1\t2\n")
    df = R.read_two_headers(spark, f"{tmp_path}/two.tsv", ["Chr", "Pos"])
    assert df.columns == ["Chr", "Pos", "s1_t0", "s1_t1"] and tuple(df.first()) == ("I", "5", "1", "2")
    (tmp_path / "list.txt").write_text("a\n\n  b \n")
    assert [r.value for r in R.read_lines(spark, f"{tmp_path}/list.txt").collect()] == ["a", "b"]


def test_sequences_and_annotations(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">g1 first gene\nACGT\nAC\n>g2\nTT\n")
    assert [tuple(r) for r in R.read_fasta(spark, f"{tmp_path}/x.fa").orderBy("id").collect()] == [("g1", "g1 first gene", "ACGTAC"), ("g2", "g2", "TT")]
    (tmp_path / "x.gff").write_text("##gff\nI\ts\tmRNA\t1\t90\t.\t+\t.\tID=m1;Parent=g1\nI\ts\tCDS\t50\t60\t.\t+\t0\tID=c2;Parent=m1\nI\ts\tCDS\t1\t9\t.\t+\t0\tID=c1;Parent=m1\n")
    parts = R.children(R.read_gff(spark, f"{tmp_path}/x.gff"), "mRNA", "CDS").first()
    assert parts.id == "m1" and [p.start for p in parts.parts] == [1, 50]
    (tmp_path / "x.obo").write_text('format: 1\n\n[Term]\nid: A:1\nname: one\nnamespace: BP\ndef: "first" [x]\n\n[Term]\nid: A:2\nname: two\nis_a: A:1 ! one\nrelationship: part_of A:3 ! three\n\n[Term]\nid: A:3\nname: gone\nis_obsolete: true\n')
    terms, edges = R.read_obo(spark, f"{tmp_path}/x.obo")
    assert sorted(r.term for r in terms.collect()) == ["A:1", "A:2"] and terms.where("term = 'A:1'").first().definition == "first"
    assert sorted(tuple(r) for r in edges.collect()) == [("A:2", "A:1", "is_a"), ("A:2", "A:3", "part_of")]
    (tmp_path / "AF-P1-F1-model.pdb").write_text("HEADER\n" + "ATOM      1  CA  MET A   1      11.000  12.000  13.000  1.00 87.50           C\n" + "ATOM      2  CB  MET A   1      11.000  12.000  13.000  1.00 10.00           C\n")
    assert [tuple(r) for r in R.read_pdb_confidence(spark, str(tmp_path)).collect()] == [("P1", "MET", 87.5)]


def test_cache(spark, tmp_path):
    calls = []

    def fetch(parts):
        calls.append(parts)
        return [("t1", 0.5)]

    for _ in range(2):
        assert R.cached(spark, str(tmp_path), ["genes", "x"], fetch, "term string, p double").first() == ("t1", 0.5)
    assert len(calls) == 1 and R.cached(spark, str(tmp_path), ["x", "genes"]) is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 0.12345), (1, "a", 2.0), (2, "c", 3.0)], "g int, v string, x double")
    assert W.unique_names(["A", "B", "A"]) == ["A", "B", "A__dup1"]
    W.write_parquet(df.select("g", "v", F.col("v").alias("v")), f"{tmp_path}/d.parquet")
    assert spark.read.parquet(f"{tmp_path}/d.parquet").columns == ["g", "v", "v__dup1"]
    W.write_text_table(df, f"{tmp_path}/t", digits=3)
    assert "0.123" in {r.x for r in spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).collect()}
    W.write_lists(df, f"{tmp_path}/l", "g", "v")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l/g=1").collect()) == ["a", "b"]
    W.write_matrix(df, f"{tmp_path}/m", "g", "v", [1, 2])
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/m", sep="\t", header=True).collect()] == [("a", "c"), ("b", None)]
    W.write_gaf(df, f"{tmp_path}/gaf", "2024-01-01")
    assert [r.value for r in spark.read.text(f"{tmp_path}/gaf").collect()][:2] == ["!gaf-version: 2.2", "!date-generated: 2024-01-01"]
    W.write_sheets(df, f"{tmp_path}/s", "v")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in", batch.schema.simpleString()[7:-1].replace(":", " "))
    out = events.tumbling(stream, "1 hour", "0 seconds")
    events.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    start = F.col("start").cast("string").alias("start")
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").select(start, "event_type", "n").collect()}
    want = {(r.start, r.event_type): r.n for r in events.tumbling(batch, "1 hour").select(start, "event_type", "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_structures(spark, tmp_path):
    line = "ATOM  {:>5}  {:<3} {} {}{:>4}    {:>8}{:>8}{:>8}{:>6}{:>6}\n"
    body = "".join(line.format(i, atom, res, chain, no, "1.000", "1.000", "1.000", "1.00", conf) for i, (atom, res, chain, no, conf) in enumerate(
        [("N", "MET", "A", 1, "80.00"), ("CA", "MET", "A", 1, "87.50"), ("CA", "LYS", "A", 2, "40.00"), ("CA", "GLY", "B", 1, "50.00")]))
    (tmp_path / "AF-P1-F1-model.pdb").write_text(body)
    assert tuple(R.read_pdb_sequence(spark, str(tmp_path)).first()) == ("P1", "MK")
    names = ("group_PDB", "id", "label_atom_id", "label_comp_id", "B_iso_or_equiv")
    rows = "ATOM 1 N MET 80.0\nATOM 2 CA MET 87.5\nATOM 3 CA LYS 40.0\n"
    (tmp_path / "AF-P2-F1-model.cif").write_text("data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + rows + "#\n")
    got = R.read_cif_confidence(spark, str(tmp_path)).collect()
    assert sorted((r.protein, r.residue, r.confidence) for r in got) == [("P2", "LYS", 40.0), ("P2", "MET", 87.5)]


def test_sheet_without_an_engine(spark, tmp_path):
    pytest.importorskip("openpyxl")
    import pandas as pd

    pd.DataFrame({"a": ["unit", "1"], "b": [None, "x"]}).to_excel(tmp_path / "x.xlsx", index=False)
    assert [tuple(r) for r in R.read_sheet(spark, str(tmp_path / "x.xlsx"), drop=1).collect()] == [("1", "x")]
