"""Sequences and records of features against a plain reading of FASTA and GFF3."""

import random
from types import SimpleNamespace

import pytest

from tarnwick.functions.sequence import CODONS
from tarnwick.operators import genome
from tarnwick.plans import features as L
from tarnwick.sources import readers

TURN = str.maketrans("ACGTNRYacgtnry", "TGCANYRtgcanyr")


def written(tmp_path, width=61):
    r = random.Random(5)
    chroms = {"I": "".join(r.choice("ACGT") for _ in range(5000)), "II": "".join(r.choice("ACGTacgtNRY") for _ in range(1733)), "tiny": "ACGTACG", "none": ""}
    with open(tmp_path / "g.fa", "w") as f:
        for name, s in chroms.items():
            f.write(f">{name} a description\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)))
            f.write("\n" if name == "I" else "")
    genes = []
    for n in range(24):
        chrom, at = ("I", 100 + n * 190) if n % 3 else ("II", 20 + n * 65)
        exons = sorted({(at + k * 45, at + k * 45 + r.randint(8, 29)) for k in range(n % 4 + 1)})
        genes.append(SimpleNamespace(gene=f"G{n}", id=f"G{n}.1", chrom=chrom, strand="-" if n % 2 else "+", exons=exons, introns=[(a[1] + 1, b[0] - 1) for a, b in zip(exons, exons[1:], strict=False)]))
    with open(tmp_path / "g.gff3", "w") as f:
        f.write("##gff-version 3\n")
        for g in genes:
            f.write(f"{g.chrom}\tx\tgene\t{g.exons[0][0]}\t{g.exons[-1][1]}\t.\t{g.strand}\t.\tID={g.gene}\n")
            f.write(f"{g.chrom}\tx\tmRNA\t{g.exons[0][0]}\t{g.exons[-1][1]}\t.\t{g.strand}\t.\tID={g.id};Parent={g.gene}\n")
            for kind, spans in (("CDS", g.exons), ("intron", g.introns)):
                for i, (a, b) in enumerate(spans):
                    f.write(f"{g.chrom}\tx\t{kind}\t{a}\t{b}\t.\t{g.strand}\t0\tID={g.id}:{kind}:{i};Parent={g.id}\n")
        f.write("I\tx\tmRNA\t1\t9\t.\t+\t.\tID=bare.1;Parent=bare\n")
    return chroms, genes


def gc(s, digits=3):
    known = [c for c in s.upper() if c in "ACGTSWU"]
    return round(sum(c in "GCS" for c in known) / len(known), digits) if known else 0.0


def cut(g, chroms, a, b):
    s = chroms[g.chrom][a - 1 : b]
    return s.translate(TURN)[::-1] if g.strand == "-" else s


@pytest.mark.parametrize("size,split", [(genome.CHUNK, 1 << 27), (50, 1 << 27), (64, 700)])
def test_chunks_of_fasta_files(spark, tmp_path, size, split):
    chroms, _ = written(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chunks = genome.fasta_chunks(spark, f"{tmp_path}/g.fa", size).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    glued = {}
    for r in sorted(chunks, key=lambda r: r.chunk):
        assert len(r.letters) <= size
        glued[r.Chromosome] = glued.get(r.Chromosome, "") + r.letters
    assert glued == {k: v for k, v in chroms.items() if v}
    if split > 1000:
        whole = readers.read_fasta(spark, f"{tmp_path}/g.fa")
        again = genome.chunked(whole, "id", "sequence", size).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, chunks))


@pytest.mark.parametrize("size", [genome.CHUNK, 37])
def test_records_from_files(spark, tmp_path, size):
    chroms, genes = written(tmp_path)
    features = readers.read_gff(spark, f"{tmp_path}/g.gff3")
    chunks = genome.fasta_chunks(spark, f"{tmp_path}/g.fa", size)
    marks = spark.createDataFrame([("I", 50, 4900, 2000, 2100)], "Chromosome string, left long, right long, centromere_start long, centromere_end long")
    primary = spark.createDataFrame([(g.gene, 10) for g in genes], "Gene_id string, Primary_peptide_length long")
    got = {r.mRNA_id: r.asDict() for r in L.dna_records(features, chunks, marks, primary, size).collect()}
    assert set(got) == {g.id for g in genes}
    coding = {r.mRNA_id: r.sequence for r in genome.coding_sequences(features, chunks, size).collect()}
    for g in genes:
        ordered = g.exons if g.strand == "+" else g.exons[::-1]
        cds = "".join(cut(g, chroms, a, b) for a, b in ordered)
        assert coding[g.id] == cds
        introns = [cut(g, chroms, a, b) for a, b in g.introns]
        lo, hi = g.exons[0][0], g.exons[-1][1]
        start, end = (lo, hi) if g.strand == "+" else (hi, lo)
        middle, length = (start + end) // 2, len(chroms[g.chrom])
        on_i = g.chrom == "I"
        to_end = min(abs(middle - 50), abs(middle - 4900)) if on_i else None
        peptide = ""
        for i in range(0, len(cds) - 2, 3):
            codon = cds[i : i + 3].upper()
            a = "*" if codon in ("TAR", "TRA") else CODONS.get(codon, "X")
            if a == "*":
                break
            peptide += a
        third = [c for c in cds[2::3].upper() if c in "ACGT"]
        want = {
            "Gene_id": g.gene, "mRNA_id": g.id, "Chromosome": g.chrom, "Start": start, "End": end, "Strand": g.strand, "Abs_distance_from_telomere": to_end,
            "Relative_distance_from_telomere": round(to_end / length, 3) if on_i else None, "Abs_distance_from_centromere": abs(middle - 2050.0) if on_i else None,
            "Relative_distance_from_centromere": round(abs(middle - 2050.0) / length, 3) if on_i else None, "Gene_length": hi - lo + 1, "GC_content_of_gene": gc(chroms[g.chrom][lo:hi]),
            "CDS_number": len(g.exons), "GC_content_of_CDS": gc(cds), "Fraction_of_CDS": round(len(cds) / (hi - lo + 1), 3), "GC3": round(100 * sum(c in "GC" for c in third) / len(third), 3),
            "Containing_intron": bool(introns), "Intron_number": len(introns), "GC_content_of_intron": gc("".join(introns)), "Total_intron_length": sum(map(len, introns)),
            "Average_intron_length": sum(map(len, introns)) / len(introns) if introns else 0.0, "Length_of_first_intron": len(introns[0]) if introns else 0,
            "GC_contents_of_first_intron": gc(introns[0]) if introns else 0.0, "Peptide_length": len(peptide), "Primary_peptide_length": 10, "Primary_candidate": len(peptide) == 10,
        }
        row = dict(got[g.id])
        row.pop("ENC")
        assert row.keys() == want.keys()
        assert row == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in want.items()}


def test_odd_ranges(spark):
    chunks = genome.chunked(spark.createDataFrame([("c", "ACGTTGCA" * 9), ("empty", ""), ("null", None)], "n string, s string"), "n", "s", 10)
    ranges = spark.createDataFrame([(1, "c", -3, 4, "+"), (2, "c", 70, 500, "-"), (3, "c", 9, 8, "+"), (4, "nowhere", 1, 5, "+"), (5, "empty", 1, 5, "+"), (6, None, 1, 5, "+"), (7, "c", 1, 72, "-")], "id int, Chromosome string, start long, end long, Strand string")
    got = {r.id: r.sequence for r in genome.cut_ranges(ranges, chunks, ["id"], 10).collect()}
    assert got == {1: "ACGT", 2: "TGC", 7: "TGCAACGT" * 9}
    assert {r.id: r.gc for r in genome.range_gc(ranges, chunks, ["id"], 10).collect()} == {1: 0.5, 2: pytest.approx(2 / 3), 7: 0.5}
