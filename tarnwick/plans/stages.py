"""The named stages of the screening workflow, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.semantics import clip_upper, differs, flags, insertion_fraction, label, lookup, neg_log10, ratio
from tarnwick.functions.strings import match_or_null, token
from tarnwick.operators import coherence, ontology, relational, stats

#: Keys of an insertion. Fixed values.
KEY = ["Chr", "Coordinate", "Strand", "Target"]


def in_gene(kind: Column, to_stop: Column) -> Column:
    """Not intergenic and over four bases before the stop codon; a missing distance is outside."""
    return differs(kind, F.lit("Intergenic region")) & F.coalesce(to_stop > 4, F.lit(False))


def coverage_stage(insertions: DataFrame, annotations: DataFrame, genes: DataFrame) -> DataFrame:
    """Long coverage statistics of insertions by chromosome and of genes by essentiality."""
    passes = in_gene(F.col("Type"), F.col("Distance_to_stop_codon"))
    one = relational.dedupe_priority(annotations, KEY, passes, [F.col("row_id")])
    rows = relational.reindex_left(insertions, one, KEY)
    genes = relational.normalize_metrics(genes)

    def counted(df: DataFrame, cat: Column, cov: Column) -> DataFrame:
        return df.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(cov, F.lit(False))).alias("covered"))

    known = genes.where(F.col("DeletionLibrary_essentiality").isin("E", "V"))
    return relational.long_stats({
        "insertions": counted(rows, F.lit("all"), passes),
        "insertions_by_chromosome": counted(rows.where("Chr is not null"), F.col("Chr"), passes),
        "genes": counted(genes, F.lit("all"), F.col("DR").isNotNull()),
        "genes_by_essentiality": counted(known, F.col("DeletionLibrary_essentiality"), F.col("DR").isNotNull()),
    })


def domain_stage(insertions: DataFrame, genes: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Spread of insertion places in genes over the DR threshold, widest first."""
    high = relational.normalize_metrics(genes).where(F.col("DR") > threshold)
    placed = insertions.withColumn("insertion_fraction", insertion_fraction(F.col("Distance_to_start_codon"), F.col("Distance_to_stop_codon")))
    placed = placed.join(high.select("Systematic_ID").distinct(), "Systematic_ID", "left_semi")
    spread = placed.groupBy("Systematic_ID").agg(F.count(F.lit(1)).alias("n_insertions"), F.avg("insertion_fraction").alias("mean"), F.stddev_samp("insertion_fraction").alias("std"))
    named = relational.keep_first(high.select("Systematic_ID", "Name", "DR"), ["Systematic_ID"], [F.col("Name"), F.col("DR")])
    return spread.join(named, "Systematic_ID", "left").orderBy(F.desc_nulls_last("std"), "Systematic_ID")


def utr_type(strand: Column, gene_strand: Column, to_start: Column, to_end: Column, threshold: int) -> Column:
    """5UTR or 3UTR by the near boundary on the gene's strand; the 5' side is asked first."""
    forward = gene_strand == "+"
    five = F.when(forward, to_start).otherwise(to_end) < threshold
    three = F.when(forward, to_end).otherwise(to_start) < threshold
    return label([(five, "5UTR"), (three, "3UTR")])


def parental_gene(df: DataFrame, threshold: int) -> DataFrame:
    """The neighbour that an intergenic insertion belongs to, with type, distance and direction.

    Names, ids and strands hold the left and right neighbour parted by a bar. A neighbour nearer
    than the threshold counts if the other is beyond it, or is as near or farther below it (the
    left of equals). None does if the other distance is the threshold exactly, or both are beyond:
    then the type is neither, the distance 0 and the names are empty. The distance is positive
    behind a gene (3UTR) and negative before it (5UTR).
    """
    start, end = F.col("Distance_to_region_start"), F.col("Distance_to_region_end")
    both = (start < threshold) & (end < threshold)
    left = ((start < threshold) & (end > threshold)) | (both & (start <= end))
    right = ((start > threshold) & (end < threshold)) | (both & (start > end))
    df = df.withColumn("side", label([(left, "left"), (right, "right")], "none"))
    side = F.col("side")

    def part(name: str) -> Column:
        parts = F.split(F.col(name), "\\|")
        return F.when(side == "left", F.get(parts, 0)).when(side == "right", F.try_element_at(parts, F.lit(-1))).otherwise("")

    df = df.withColumns({"Parental_gene": part("Name"), "Parental_id": part("Systematic_ID"), "gene_strand": part("Strand_Interval")})
    behind = (side == "left") == (F.col("gene_strand") == "+")
    near = F.when(side == "left", start).otherwise(end)
    kind = label([(side == "none", "neither"), (behind, "3UTR")], "5UTR")
    distance = F.when(side == "none", 0).when(behind, near).otherwise(-near)
    direction = label([(side == "none", ""), (F.col("Strand") == F.col("gene_strand"), "Forward")], "Reverse")
    return df.withColumns({"UTR_type": kind, "Distance_to_gene": distance, "Direction": direction})


def near_gene(kind: Column, to_start: Column, to_end: Column, start: int, end: int) -> Column:
    """Between genes and nearer than a threshold to either; a missing distance is not near."""
    return (kind == "Intergenic region") & (F.coalesce(to_start < start, F.lit(False)) | F.coalesce(to_end < end, F.lit(False)))


def utr_stage(annotations: DataFrame, fitting: DataFrame, genes: DataFrame, threshold: int = 400) -> DataFrame:
    """Insertions near genes with their curves against the gene's; x/0 stays infinite."""
    near = annotations.where(near_gene(F.col("Type"), F.col("Distance_to_region_start"), F.col("Distance_to_region_end"), threshold, threshold))
    rows = parental_gene(near, threshold).join(fitting, KEY)
    gene = relational.normalize_metrics(genes).select(F.col("Name").alias("Parental_gene"), F.col("A").alias("A_gene"), F.col("DR").alias("DR_gene"))
    rows = rows.withColumnsRenamed({"A": "A_insertion", "DR": "DR_insertion"}).join(gene, "Parental_gene")
    return rows.withColumns({"A_ratio": ratio(F.col("A_insertion"), F.col("A_gene")), "DR_ratio": ratio(F.col("DR_insertion"), F.col("DR_gene"))})


def spikein_stage(reads: DataFrame, sites: DataFrame, keys: list[str], samples: list[str], ratios: list[float]) -> DataFrame:
    """Chosen sites in long form with dilution and relative reads; no site at all is an error."""
    rows = reads.join(F.broadcast(sites), keys, "left_semi")
    if rows.isEmpty():
        raise ValueError("none of the sites has reads")
    long = rows.unpivot(keys, samples, "sample", "reads")
    return stats.rank_ratio(long, keys, "reads", ratios)


def pcr_qc_stage(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replicates side by side and their log-log fit."""
    both = first.select(*keys, F.col(value).alias("r1")).join(second.select(*keys, F.col(value).alias("r2")), keys)
    return stats.loglog(both, "r1", "r2")


def ncrna_stage(bed: DataFrame, trna: DataFrame, fitting: DataFrame, abundance: DataFrame) -> DataFrame:
    """Non-coding genes with tRNA names, copy numbers, fits and abundance."""
    rows = bed.join(trna, ["Chrom", "Start", "End"], "left")
    rows = rows.withColumn("Amino_Acid", match_or_null(F.col("GtRNAdb_Name"), "^tRNA-([A-Za-z]+)-")).withColumn("Anticodon", token(F.col("GtRNAdb_Name"), "-", 3))
    rows = relational.copies(rows, ["Amino_Acid", "Anticodon"])
    return rows.join(fitting, "Systematic_ID", "full_outer").join(abundance, "Systematic_ID", "left")


def verification_stage(genes: DataFrame, library: DataFrame, verified: DataFrame) -> DataFrame:
    """Counts by category (missing is one), by result, and matches of library and verification."""
    rows = genes.join(library, "Systematic_ID", "left").join(verified, "Systematic_ID", "left")
    result = label([((F.col("phenotype") == "small colonies") & (F.col("verified") == "E"), "small colonies (E)")])
    rows = rows.withColumn("result", F.coalesce(result, F.col("phenotype")))

    def counted(c: str) -> DataFrame:
        return rows.groupBy(F.col(c).alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count("DR").alias("covered"))

    match = relational.match_counts(rows, "library", "verified").select(F.lit("match").alias("category"), (F.col("match") + F.col("mismatch")).alias("total"), F.col("match").alias("covered"))
    return relational.long_stats({"category": counted("Category"), "result": counted("result"), "concordance": match})


#: Results of the verification in the order of the review. Fixed values.
RESULT_ORDER = ["spores", "germinated", "microcolonies", "E", "E (tiny colonies)", "very small colonies", "small colonies", "WT"]


def outlier_groups() -> dict[str, tuple[Column, bool]]:
    """Predicates of genes whose curve and category disagree, and whether the highest DR comes first.

    Categories are the curated labels as they stand; a missing library label is not E.
    """
    c, dr, e = F.col("Category"), F.col("DR"), F.col("DeletionLibrary_essentiality").eqNullSafe(F.lit("E"))
    return {
        "WT2nonWT": ((c == "WT-like") & (dr > 0.35), True),
        "scE2E": ((c == "small colonies") & (dr > 0.75) & e, True),
        "sc2E": ((c == "small colonies") & (dr > 0.75) & ~e, True),
        "E2V": (c.isin("spores", "germinated", "microcolonies") & (dr < 0.35), False),
    }


def outlier_review(genes: DataFrame, verified: DataFrame, group: str) -> DataFrame:
    """A group's genes with the bucket of each result of their verification, in review order.

    ``verified`` has Systematic_ID and result; genes without a row are "Not verified", results
    outside the order vanish, and a gene of several results comes once for each.
    """
    cond, falling = outlier_groups()[group]
    rows = genes.where(cond).join(verified.select("Systematic_ID", "result").distinct(), "Systematic_ID", "left")
    dr = F.col("DR").desc() if falling else F.col("DR").asc()
    return relational.bucketed(rows, "result", RESULT_ORDER).withColumn("grp", F.lit(group)).orderBy("bucket_no", dr, "Systematic_ID")


def comparison_stage(df: DataFrame, densities: list[str], others: list[str], top: float = 200.0) -> DataFrame:
    """All pairwise correlations after capping the densities; thin columns are left out."""
    capped = df.withColumns({c: clip_upper(F.col(c), top) for c in densities if c in df.columns})
    return stats.pairwise_correlation(capped, stats.usable_columns(capped, densities + others))


def group_members(annotation: DataFrame, background: DataFrame, low: int = 3, high: int = 300, by: str = "GO_term_name", gene: str = "Systematic_ID") -> DataFrame:
    """(grp, gene, x, y) of the groups of an annotation: members that the background has, each gene once a group, groups of ``low`` to ``high``.

    ``background`` has the gene with x and y, once each; a gene annotated twice to a group counts once.
    """
    members = annotation.where(F.col(by).isNotNull()).select(F.col(by).alias("grp"), F.col(gene).alias("gene")).distinct()
    points = relational.require_unique(background.select(F.col(gene).alias("gene"), "x", "y"), ["gene"])
    return coherence.size_window(members.join(points, "gene"), "grp", low, high).select("grp", "gene", "x", "y")


def coherence_stage(members: DataFrame, background: DataFrame, low: int = 3, high: int = 300, times: int = 1000) -> DataFrame:
    """Distances, medians and permutation scores of groups (grp, gene, x, y), tightest first."""
    rows = coherence.size_window(members, "grp", low, high)
    tested = coherence.permutation_test(rows, background, "grp", "gene", times=times)
    out = coherence.geometric_median(rows, "grp").join(coherence.pairwise(rows, "grp", "gene"), "grp").join(tested, "grp")
    return out.withColumn("neg_log10_p", neg_log10(F.col("p"), 1 / times)).orderBy("z", "grp")


def enrichment_stage(clusters: DataFrame, associations: DataFrame, namespaces: DataFrame, wt: int = 9, alpha: float = 0.05, closed: DataFrame | None = None, slim: DataFrame | None = None) -> DataFrame:
    """All clusters against all genes, and the others than wt against the genes outside it.

    With a closed ontology and its slim terms the associations are propagated for the variant
    full, and the slim ancestors are tested as the variant slim.
    """
    genes = clusters.select(F.col("Systematic_ID").alias("gene"), "cluster")
    study = genes.where("cluster is not null").select(F.col("cluster").alias("grp"), "gene")

    def tested(members: DataFrame, background: DataFrame) -> DataFrame:
        if closed is None or slim is None:
            return ontology.enrich(members, background, associations, namespaces, alpha)
        return ontology.enrich_full_and_slim(members, background, associations, closed, slim, namespaces, alpha)

    whole = tested(study, genes).withColumn("background", F.lit("all"))
    part = tested(study.where(F.col("grp") < wt), genes.where(F.col("cluster") < wt)).withColumn("background", F.lit("nonWT"))
    return whole.unionByName(part).orderBy("grp", "background", "namespace", "term")


def merge_features(levels: dict[str, DataFrame], meta: DataFrame, key: str = "Gene_id") -> DataFrame:
    """All levels of primary transcripts outer-joined, kept for the genes of ``meta``, gaps filled.

    A gene that a level, or ``meta``, lists twice raises: it would multiply rows.
    """
    dna = levels["dna"].where("Primary_candidate")
    each = [relational.require_unique(df, [key]) for df in (dna, *[df for k, df in levels.items() if k != "dna"])]
    merged = relational.merge_outer(each, [key])
    meta = relational.require_unique(meta, [key])
    out = merged.join(meta, key, "right")
    return out.na.fill("Not_determined", [c for c in ("essentiality", "category") if c in out.columns])


def namespace_label(c: Column) -> Column:
    return lookup(c, {"BP": "biological process", "CC": "cellular component", "MF": "molecular function"})


@dataclass
class Pipeline:
    """Named stages that read and write tables below one folder; finished stages are not rerun."""

    root: str
    stages: dict[str, tuple[list[str], Callable[..., DataFrame]]] = field(default_factory=dict)

    def add(self, name: str, needs: list[str], build: Callable[..., DataFrame]) -> Pipeline:
        self.stages[name] = (needs, build)
        return self

    def table(self, spark, name: str) -> DataFrame:
        """The stage's table, built with all that it needs if it isn't there."""
        path = f"{self.root}/{name}.parquet"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if name in self.stages and not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            needs, build = self.stages[name]
            build(*[self.table(spark, n) for n in needs]).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
