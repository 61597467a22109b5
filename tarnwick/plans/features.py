"""The levels of the per-gene feature matrix and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.semantics import neg_log10
from tarnwick.functions.sequence import codon_measures, gc_fraction, gc_known
from tarnwick.operators import genome, relational


#: Loci whose first isoform is the primary one whatever its length. Fixed values.
FIRST_ISOFORM_LOCI = ("SPBC119.04", "SPBC17A3.07", "SPAC212.11", "SPAC2E12.05", "SPAC977.01", "SPMIT.03", "SPMIT.06", "SPMIT.08")


#: Column of the insertion density. Fixed value.
DENSITY = "Integration density, in-vivo (integrations/kb/million inserts)"


def primary_candidate(gene: Column, transcript: Column, length: Column, primary_length: Column) -> Column:
    """Whether a transcript is the gene's primary one: by the known peptide length, or isoform .1 for some loci."""
    return F.when(gene.isin(*FIRST_ISOFORM_LOCI), transcript.endswith(".1")).otherwise(length == primary_length)


def dna_level(genes: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Length, GC and distances to the ends and the centromere, absolute and relative.

    ``genes`` has Gene_id, chromosome, start, end, sequence; ``chromosomes`` chromosome, length,
    centromere. A missing landmark leaves its distances missing.
    """
    rows = genes.join(F.broadcast(chromosomes), "chromosome", "left")
    middle = (F.col("start") + F.col("end")) / 2
    to_end = F.when(F.col("length").isNotNull(), F.least(F.col("start").cast("double"), (F.col("length") - F.col("end")).cast("double")))
    to_centre = F.abs(middle - F.col("centromere"))
    return rows.select("Gene_id", F.length("sequence").alias("cds_length"), F.bround(gc_fraction(F.col("sequence")), 3).alias("gc"), to_end.alias("to_telomere"), to_centre.alias("to_centromere"),
                       F.bround(F.try_divide(to_end, F.col("length")), 3).alias("to_telomere_relative"), F.bround(F.try_divide(to_centre, F.col("length")), 3).alias("to_centromere_relative"))


def replicates(df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """mean, std and cv over each group of columns, missing ones left out."""
    out = []
    for name, columns in groups.items():
        values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
        n = F.size(values)
        mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)
        square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
        std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (square - n * mean * mean) / (n - 1))))
        out += [mean.alias(f"{name}_mean"), std.alias(f"{name}_std"), F.try_divide(std, mean).alias(f"{name}_cv")]
    return df.select(key, *out)


def dna_record(transcripts: DataFrame, cds: DataFrame, introns: DataFrame, chromosomes: DataFrame, primary: DataFrame) -> DataFrame:
    """Place, length, base content, introns and peptide length of every transcript: 27 columns.

    ``transcripts`` has Gene_id, mRNA_id, Chromosome, Strand and gene_sequence (the forward strand
    from behind the first base of the coding region to its end) or its share of G and C as
    gene_gc; ``cds`` and ``introns`` have
    mRNA_id, start, end and sequence, each on the transcript's strand; ``chromosomes`` has
    Chromosome, length, left, right, centromere_start and centromere_end; ``primary`` has
    Gene_id and Primary_peptide_length. Start is where the reading begins, so above End on the
    reverse strand. The first intron is the one of the least start on both strands. Without
    introns their measures are 0; a chromosome without landmarks has no distances.
    """
    def gathered(parts: DataFrame, name: str) -> DataFrame:
        return parts.groupBy("mRNA_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "sequence"))).alias(name))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x: x["sequence"]), "")

    placed = transcripts.join(chromosomes, "Chromosome", "left").join(primary, "Gene_id", "left")
    rows = placed.join(gathered(cds, "up"), "mRNA_id").join(gathered(introns, "introns"), "mRNA_id", "left")
    return _measured(rows.withColumns({
        "cds": joined(F.when(F.col("Strand") == "+", F.col("up")).otherwise(F.reverse("up"))), "CDS_number": F.size("up"),
        "intron": joined(F.col("introns")), "Intron_number": F.array_size("introns"), "first_intron": F.get("introns", F.lit(0))["sequence"]}))


def _measured(rows: DataFrame) -> DataFrame:
    """``dna_record`` of transcripts with their place and primary length, their ordered parts ``up``, and the glued ``cds``, ``intron`` and ``first_intron``."""
    forward, first, last = F.col("Strand") == "+", F.element_at("up", 1), F.element_at("up", -1)
    rows = rows.withColumns({"Start": F.when(forward, first["start"]).otherwise(last["end"]), "End": F.when(forward, last["end"]).otherwise(first["start"])})
    rows = rows.withColumns({
        "intron": F.coalesce("intron", F.lit("")), "first_intron": F.coalesce("first_intron", F.lit("")), "Intron_number": F.coalesce("Intron_number", F.lit(0)), "codon": codon_measures(F.col("cds")),
        "middle": F.floor((F.col("Start") + F.col("End")) / 2), "Gene_length": F.abs(F.col("End") - F.col("Start")) + 1})
    whole, n, middle = F.length("intron"), F.col("Intron_number"), F.col("middle")
    first_intron = F.col("first_intron")
    left, right = F.abs(middle - F.col("left")), F.abs(middle - F.col("right"))
    to_end = F.when(left.isNotNull() & right.isNotNull(), F.least(left, right))
    to_centre = F.abs(middle - (F.col("centromere_start") + F.col("centromere_end")) / 2)
    codon = F.col("codon")

    def gc(c: Column) -> Column:
        return F.coalesce(F.bround(gc_known(c), 3), F.lit(0.0))

    gene_gc = F.coalesce(F.bround("gene_gc", 3), F.lit(0.0)) if "gene_gc" in rows.columns else gc(F.col("gene_sequence"))
    out = rows.select(
        "mRNA_id", "Gene_id", "Chromosome", "Start", "End", "Strand", to_end.alias("Abs_distance_from_telomere"), F.bround(to_end / F.col("length"), 3).alias("Relative_distance_from_telomere"),
        to_centre.alias("Abs_distance_from_centromere"), F.bround(to_centre / F.col("length"), 3).alias("Relative_distance_from_centromere"), "Gene_length", gene_gc.alias("GC_content_of_gene"),
        "CDS_number", F.bround(codon["gc"], 3).alias("GC_content_of_CDS"), F.bround(F.length("cds") / F.col("Gene_length"), 3).alias("Fraction_of_CDS"), F.bround(codon["gc3"] * 100, 3).alias("GC3"),
        (n > 0).alias("Containing_intron"), "Intron_number", gc(F.col("intron")).alias("GC_content_of_intron"), whole.alias("Total_intron_length"), F.coalesce(F.try_divide(whole.cast("double"), n), F.lit(0.0)).alias("Average_intron_length"),
        F.length(first_intron).alias("Length_of_first_intron"), gc(first_intron).alias("GC_contents_of_first_intron"), codon["peptide_length"].alias("Peptide_length"), "Primary_peptide_length", F.bround(codon["effective_codons"], 2).alias("enc"))
    first = primary_candidate(F.col("Gene_id"), F.col("mRNA_id"), F.col("Peptide_length"), F.col("Primary_peptide_length"))
    return out.select(*[c for c in out.columns if c != "enc"], first.alias("Primary_candidate"), F.col("enc").alias("ENC"))


def dna_records(features: DataFrame, chunks: DataFrame, marks: DataFrame, primary: DataFrame, size: int = genome.CHUNK, lengths: DataFrame | None = None) -> DataFrame:
    """The 27 columns of ``dna_record`` from GFF3 features and a genome in chunks of ``size`` letters.

    ``marks`` has left, right, centromere_start and centromere_end by Chromosome; ``primary`` as in
    ``dna_record``. Transcripts without coding parts have no row. The share of G and C of a gene
    is counted from behind the first base of its coding region to its end, piece by piece; coding
    parts and introns are cut, turned and glued. ``lengths`` (Chromosome, length) saves counting the letters of the chunks.
    """
    places = (genome.lengths(chunks) if lengths is None else lengths).join(marks.drop("length"), "Chromosome", "left")
    placed = genome.transcripts(features).join(places, "Chromosome", "left").join(primary, "Gene_id", "left")
    rows = placed.join(genome.transcript_parts(features, chunks, size).withColumnRenamed("gc", "gene_gc"), "mRNA_id")
    introns = F.col("introns")
    return _measured(rows.withColumns({
        "cds": genome.glued(F.col("up"), ~F.coalesce(F.col("Strand") == "+", F.lit(False))), "CDS_number": genome.n_parts(F.col("up")),
        "intron": genome.glued(introns), "Intron_number": F.when(introns.isNotNull(), genome.n_parts(introns)), "first_intron": genome.first_part(introns)}))


def half_lives(table: DataFrame, meta: DataFrame | None = None, order: str = "row_no") -> DataFrame:
    """(Gene_id, protein_half_life_minutes) of rows (ids, name, rate, half_life) that have both numbers.

    Ids are parted by semicolons; a row without any takes its name. The first row of a gene stays.
    """
    full = table.where("rate is not null and half_life is not null").withColumn("ids", F.coalesce("ids", "name"))
    each = full.select(order, "half_life", F.posexplode(F.split("ids", ";")).alias("place", "Gene_id"))
    if meta is not None:
        each = relational.resolve_ids(each, "Gene_id", meta).drop("Gene_id").withColumnRenamed("resolved", "Gene_id")
    one = relational.keep_first(each, ["Gene_id"], [F.col(order), F.col("place")])
    return one.select("Gene_id", F.col("half_life").alias("protein_half_life_minutes"))


def protein_level(metadata: DataFrame, peptides: DataFrame, copies: DataFrame, kinetics: DataFrame, confidence: DataFrame, domains: DataFrame, coding: DataFrame, key: str = "Gene_id") -> DataFrame:
    """Metadata, peptide measures, copies per cell, half-lives, confidence and PFAM domains of coding genes.

    ``copies`` (key, condition, copies) counts only for genes with a number in both conditions;
    ``domains`` (key, database) is counted for PFAM and 0 where a gene has none. All tables but the
    domains are outer-joined.
    """
    known = copies.where("copies is not null")
    growing, resting = (known.where(F.col("condition") == c).select(key, F.col("copies").cast("double").alias(f"copies_per_cell_{name}"))
                        for c, name in (("proliferating", "EMM_Proliferating_Cell"), ("quiescent", "EMMN_Quiescent_Cell")))
    pfam = domains.where("database = 'PFAM'").groupBy(key).agg(F.count(F.lit(1)).alias("PFAM_domain_count"))
    merged = relational.merge_outer([metadata, peptides, growing.join(resting, key), kinetics, confidence], [key])
    return merged.join(coding.select(key).distinct(), key, "left_semi").join(pfam, key, "left").na.fill({"PFAM_domain_count": 0})


def ortholog_counts(table: DataFrame, name: str, key: str = "Gene_id") -> DataFrame:
    """Orthologs per gene of (gene, orthologs): bars part them, null is none, a note in brackets after the gene goes."""
    n = F.when(F.col("orthologs").isNull(), 0).otherwise(F.size(F.split("orthologs", "\\|")))
    return table.select(F.substring_index(key, "(", 1).alias(key), n.alias(name))


def evolutionary_level(orthologs: dict[str, DataFrame], paralogs: DataFrame, rates: DataFrame, scores: DataFrame, coding: DataFrame, key: str = "Gene_id") -> DataFrame:
    """Orthologs in each species, paralogs, rate, conservation and diversity of coding genes, outer-joined.

    Paralogs are rows, repeats included, of a gene with a name; a gene without any has 0.
    """
    named = paralogs.where("name is not null").groupBy(key, "name").agg(F.count(F.lit(1)).alias("paralog_count")).drop("name")
    tables = [ortholog_counts(t, f"{species}_ortholog_count", key) for species, t in orthologs.items()]
    merged = relational.merge_outer([*tables, named, rates, scores], [key])
    return merged.join(coding.select(key).distinct(), key, "left_semi").na.fill({"paralog_count": 0})


def network_level(interactions: DataFrame, terms: DataFrame) -> DataFrame:
    """Degrees by type, counted on the first partner after dropping repeats, and term richness."""
    pairs = interactions.select("a", "b", "kind").distinct()
    degrees = pairs.groupBy(F.col("a").alias("Gene_id")).pivot("kind", ["physical", "genetic"]).count().na.fill(0)
    rich = terms.groupBy("Gene_id").agg(F.countDistinct("term").alias("terms"))
    return degrees.join(rich, "Gene_id", "full_outer")


def foundation(*memberships: DataFrame) -> DataFrame:
    """Members of all group kinds (kind, grp, gene), each with the number of its groups."""
    rows = memberships[0]
    for m in memberships[1:]:
        rows = rows.unionByName(m)
    n = rows.groupBy("gene").agg(F.countDistinct("kind", "grp").alias("groups"))
    return rows.join(n, "gene")


def donut(df: DataFrame, label: str) -> DataFrame:
    """Counts and percent by label."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def box_table(df: DataFrame, label: str, value: str, order: list[str]) -> DataFrame:
    """Quartiles by label in a given order; labels outside it vanish."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    return relational.quartiles(df.where(F.col(label).isin(order)), [label], value).withColumn("place", place)


def volcano(df: DataFrame, z: str, p: str, times: int) -> DataFrame:
    return df.select("*", neg_log10(F.col(p), 1 / times).alias("neg_log10_p"), (F.col(z) < 0).alias("tight"))


def residuals(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.select("*", (F.col(truth) - F.col(pred)).alias("residual"))


def variant_heatmap(df: DataFrame, variants: list[str], n: int, floor: float = 1e-50) -> DataFrame:
    """-log10 p of the best terms over all variants, 0 where a variant lacks a term."""
    best = relational.top_distinct(df, "term", "p", n).select("term")
    wide = df.join(F.broadcast(best), "term").groupBy("term").pivot("variant", variants).agg(F.max(neg_log10(F.col("p"), floor)))
    return wide.na.fill(0.0)


def extremes(df: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    """The first ``n`` rows per group."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__k", k).where(F.col("__k") <= n).drop("__k")


def rna_level(abundance: DataFrame, conditions: dict[str, list[str]], kinetics: DataFrame, coding: DataFrame, order: str = "row_no", key: str = "Gene_id") -> DataFrame:
    """Replicate statistics per condition and transcript kinetics of coding genes, outer-joined.

    Both tables keep complete rows only, rounded half-even to three digits, the first row per gene
    in the order of ``order``.
    """
    wide = replicates(abundance.withColumn("__id", F.struct(key, order)), "__id", conditions).select("__id.*", *[f"{c}_{m}" for c in conditions for m in ("mean", "std", "cv")])
    genes = coding.select(key).distinct()
    out = []
    for table in (wide, kinetics):
        values = [c for c in table.columns if c not in (key, order)]
        full = table.join(genes, key, "left_semi").na.drop(subset=values)
        first = relational.keep_first(full, [key], [F.col(order)])
        out.append(first.select(key, *[F.bround(F.col(c).cast("double"), 3).alias(c) for c in values]))
    return relational.merge_outer(out, [key])


def phenotype_level(library: DataFrame, verified: DataFrame, others: list[DataFrame], coding: DataFrame, essentiality: str = "essentiality", key: str = "Gene_id") -> DataFrame:
    """Library columns with the revised essentiality beside the old, and further tables, of coding genes.

    A gene that ``verified`` lists takes its value even if that is missing. Every table has a gene
    once; a repeated gene raises.
    """
    revised = relational.override(library.withColumn("revised_" + essentiality, F.col(essentiality)), verified, [key], "revised_" + essentiality, "verified")
    tables = [relational.require_unique(t, [key]) for t in (revised, *others)]
    return relational.merge_outer(tables, [key]).join(coding.select(key).distinct(), key, "left_semi")


#: Columns of the deletion library that go with the gene names. Fixed values.
LIBRARY_COLUMNS = ("Gene dispensability. This study", "Deletion mutant phenotype description", "Phenotypic classification used for analysis", "Category")


def gene_metadata(genes: DataFrame, library: DataFrame) -> DataFrame:
    """Gene names and products with the library's calls: every gene stays, one without a name has its id as name.

    ``genes`` has gene_systematic_id and gene_name, ``library`` "Systematic ID"; a gene that the
    library lists several times has a row for each.
    """
    named = genes.withColumn("gene_name", F.coalesce("gene_name", "gene_systematic_id"))
    held = library.select(F.col("Systematic ID").alias("gene_systematic_id"), *[F.col(f"`{c}`") for c in LIBRARY_COLUMNS])
    return named.join(held, "gene_systematic_id", "left")


def phenotype_tables(viability: DataFrame, library: DataFrame, verification: DataFrame, barseq: DataFrame, density: DataFrame, divergence: DataFrame, crispri: DataFrame, meta: DataFrame, order: str = "row_no") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The named sources of the phenotype level, as ``phenotype_level`` takes them: library, verified and the five others, by Gene_id.

    Every source has its own column names and a number ``order`` of its rows. Ids of bar-seq,
    density, divergence and CRISPRi rows are brought up to date by ``meta``. Bar-seq and CRISPRi
    rows count only with both of their values, and the first CRISPRi row, its units, goes; a
    density row stands under the first of its names in the order of the alphabet. Of rows of one
    gene the first stays, of verifications the last.
    """
    def renamed(df: DataFrame, key: Column, columns: dict[str, str], resolve: bool = True, last: bool = False) -> DataFrame:
        rows = df.select(F.col(order), key.alias("Gene_id"), *[F.col(f"`{c}`").alias(name) for c, name in columns.items()])
        if resolve:
            rows = relational.resolve_ids(rows, "Gene_id", meta).drop("Gene_id").withColumnRenamed("resolved", "Gene_id")
        return relational.keep_first(rows.where("Gene_id is not null"), ["Gene_id"], [F.col(order).desc() if last else F.col(order)]).drop(order)

    systematic = F.col("`Systematic ID`")
    held = renamed(library, systematic, {"Gene dispensability. This study": "DeletionLibrary_essentiality", "Category": "DeletionLibrary_category", "Sub_category": "Sub_category", "Growth_tier": "Growth_tier"}, False)
    verified = renamed(verification, F.col("systematic_id"), {"verification_essentiality": "verified"}, False, last=True)
    both = {"yes": "Barseq_from_dulab", "SM fitness defect from Koch et al": "Barseq_from_koch"}
    growth = {c: c for c in ("Max Growth Rate", "Colony Formation")}
    complete = lambda df, columns: df.where(" and ".join(f"`{c}` is not null" for c in columns))
    units = crispri.agg(F.min(order).alias("units"))
    others = [
        renamed(viability, F.col("gene_systematic_id"), {"FYPOviability": "FYPOviability"}, False),
        renamed(complete(barseq, both), F.col("gene"), both),
        renamed(density, F.array_min(F.split(F.trim("`Gene name`"), " ")), {DENSITY: DENSITY}),
        renamed(divergence, F.col("gene"), {"ipkm": "ipkm", "uipkm": "uipkm", "Malecki2016.KO.colony.size": "colony_size_Malecki2016"}),
        renamed(complete(crispri.join(F.broadcast(units), F.col(order) > F.col("units")), growth), systematic, growth),
    ]
    return held, verified, others


def curves(points: DataFrame, times: list[str], key: str = "Gene_id") -> DataFrame:
    """Long (key, time, observed, fitted) of wide columns t and t_fitted; of a repeated key the row of the least values stays."""
    one = relational.keep_first(points, [key], [F.col(t) for t in times])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("time"), F.col(t).alias("observed"), (F.col(t + "_fitted") if t + "_fitted" in points.columns else F.lit(None)).cast("double").alias("fitted")) for i, t in enumerate(times)]))
    return one.select(key, each.alias("p")).select(key, "p.*")


def modules(df: DataFrame, text: str, gene: str, groups: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """Genes of each module of terms, as a sorted list and its length."""
    rows = relational.keyword_groups(df, text, groups).groupBy("module").agg(F.array_sort(F.collect_set(gene)).alias("genes"))
    return rows.withColumn("n", F.size("genes"))


def scored_terms(df: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """Significant terms per variant and cluster, and how many different ones."""
    return df.where(F.col("p") < alpha).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"))


def assay_overlay(assay: DataFrame, alias: DataFrame, wide: DataFrame, key: str = "Gene_id") -> DataFrame:
    """An external assay (alias, generation, value) with the wide table's values, by an alias table."""
    return assay.join(alias, "alias").join(wide, key)
