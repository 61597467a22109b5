"""The records of transcripts turn every text into letters once, and count codons in the row of their sequence."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import sequence as Q
from tarnwick.operators import genome
from tarnwick.plans import features as L


def test_chunks_are_met_once_and_no_codon_is_a_row(spark):
    chunks = genome.chunked(spark.createDataFrame([("c", "ACGTTGCA" * 40)], "n string, s string"), "n", "s", 64)
    rows = [("c", "mRNA", 10, 200, "-", "g", "g.1"), ("c", "CDS", 10, 90, "-", "g.1", None), ("c", "CDS", 120, 200, "-", "g.1", None), ("c", "intron", 91, 119, "-", "g.1", None)]
    features = spark.createDataFrame(rows, "seqid string, type string, start long, end long, strand string, parent string, id string")
    marks = spark.createDataFrame([("c", 1, 300, 100, 120)], "Chromosome string, left long, right long, centromere_start long, centromere_end long")
    primary = spark.createDataFrame([("g", 3)], "Gene_id string, Primary_peptide_length long")
    lengths = spark.createDataFrame([("c", 320)], "Chromosome string, length long")
    got = L.dna_records(features, chunks, marks, primary, 64, lengths)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1
    assert "codon string" not in plan and plan.count("collect_list(") == 2
    assert got.drop("Gene_id").collect() == L.dna_records(features, chunks, marks, primary, 64).drop("Gene_id").collect()


def test_codon_measures_of_odd_sequences(spark):
    r = random.Random(3)
    texts = ["", "A", "AT", "ATG", "TAA", "atgTARGCC", "GCCTRAGCC", "ATGNNNGCC", "GCUGCAGCS", "é" + "GCC" * 3, "GCé" * 4, None]
    texts += ["".join(r.choice("ACGTacgtNRSWU") for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts += ["".join(r.choice([c for c, a in Q.CODONS.items() if a != "*"]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    third = F.translate(Q.every_third(F.col("s")), "SWUswu", "")
    plain = df.select("k", Q.gc_known(F.col("s")).alias("gc"), Q.gc_known(third).alias("gc3"), F.length(Q.translated(F.col("s"))).alias("n")).join(Q.effective_codons(df, "k", "s"), "k", "left")
    want = {x.k: x for x in plain.collect()}
    for x in df.select("k", Q.codon_measures(F.col("s")).alias("m")).repartition(3).select("k", "m.*").collect():
        w = want[x.k]
        if texts[x.k] is None:
            assert x.peptide_length is None and x.gc is None and x.effective_codons is None
            continue
        assert (x.gc, x.gc3, x.peptide_length) == (w.gc, w.gc3, w.n), texts[x.k]
        assert x.effective_codons == (None if w.effective_codons is None else pytest.approx(w.effective_codons, abs=1e-9)), texts[x.k]


def test_gc_counts_of_odd_letters(spark):
    texts = ["", "GCSgcsATUWatuwNRYn-é", "ßﬁ", "GGGG", None]
    gc, known = Q.gc_counts(F.col("s"))
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(gc.alias("g"), known.alias("k")).collect()
    assert [tuple(x) for x in got] == [(0, 0), (6, 14), (0, 0), (4, 4), (None, None)]
