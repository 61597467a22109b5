"""The three ontologies of the enrichment: their files, relations and workbooks, and the run of one of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import ontology
from tarnwick.plans import stages
from tarnwick.sources import readers, workbook


@dataclass(frozen=True)
class Ontology:
    """Files of an ontology below one folder, and what its enrichment is called."""

    name: str
    terms: str
    associations: str
    slims: tuple[str, ...]
    relations: tuple[str, ...]
    to_gaf: Callable[[DataFrame, DataFrame], DataFrame] | None
    report: str
    labels: tuple[str, str]


#: Files, relations and labels of the ontologies. Fixed values.
ONTOLOGIES = {o.name: o for o in (
    Ontology("GO", "go-basic.obo", "gene_ontology_annotation.gaf.tsv", ("bp_go_slim_terms.tsv", "mf_go_slim_terms.tsv", "cc_go_slim_terms.tsv"), ("is_a", "part_of"), None,
             "gene_ontology_enrichment_results.xlsx", ("Full GO Enrichment", "GO Slim Enrichment")),
    Ontology("FYPO", "fypo-simple-pombase.obo", "pombase_single_locus_haploid_phenotype_annotation.phaf.tsv", ("fypo_slim_ids_and_names.tsv",), ("is_a",), ontology.phenotype_gaf,
             "fission_yeast_phenotype_ontology_enrichment_results.xlsx", ("Full FYPO Enrichment", "FYPO Slim Enrichment")),
    Ontology("MONDO", "mondo-simple.obo", "human_disease_association.tsv", ("pombe_mondo_disease_slim_terms.tsv",), ("is_a",), ontology.disease_gaf,
             "mondo_disease_ontology_enrichment_results.xlsx", ("Full MONDO Enrichment", "MONDO Slim Enrichment")),
)}
NOTE = "no significant terms"
#: Names of the associations' aspects, and of terms' namespaces, in reports. Fixed values.
NAMESPACES = {"biological_process": "BP", "cellular_component": "CC", "molecular_function": "MF"}


@dataclass(frozen=True)
class Loaded:
    """An ontology's tables: terms with namespace, their closure, associations (gene, term) and slim terms."""

    terms: DataFrame
    edges: DataFrame
    closed: DataFrame
    associations: DataFrame
    slim: DataFrame
    namespaces: DataFrame


def load(spark: SparkSession, name: str, folder: str) -> Loaded:
    """The tables of a named ontology; an unknown name raises, as does a missing file where it is read.

    Slim terms that the ontology lacks go. Terms without a namespace have the ontology's name.
    """
    if name not in ONTOLOGIES:
        raise ValueError(f"unknown ontology {name!r}, expected one of {list(ONTOLOGIES)}")
    o = ONTOLOGIES[name]
    terms, edges = readers.read_obo(spark, f"{folder}/{o.terms}")
    edges = edges.where(F.col("relation").isin(*o.relations))
    if o.to_gaf is None:
        gaf = readers.read_gaf(spark, f"{folder}/{o.associations}")
    else:
        gaf = o.to_gaf(spark.read.csv(f"{folder}/{o.associations}", sep="\t", header=True), terms)
    associations = gaf.select(F.col("DB_Object_ID").alias("gene"), F.col("GO_ID").alias("term")).distinct()
    slim = None
    for path in o.slims:
        part = spark.read.schema("term string, description string").csv(f"{folder}/{path}", sep="\t")
        slim = part if slim is None else slim.unionByName(part)
    short = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    namespaces = terms.select("term", F.coalesce(F.try_element_at(short, F.col("namespace")), "namespace", F.lit(name)).alias("namespace"))
    # Terms without edges are their own ancestors too.
    closed = ontology.closure(edges).unionByName(terms.select("term", F.col("term").alias("ancestor"))).distinct()
    return Loaded(terms, edges, closed, associations, slim.select("term").distinct().join(terms.select("term"), "term", "left_semi"), namespaces)


def enriched(name: str, loaded: Loaded, clusters: DataFrame, wt: int = 9, alpha: float = 0.05) -> DataFrame:
    """The report rows of all clusters, full and slim, against all genes and against those outside the wild type.

    ``clusters`` has Systematic_ID and cluster. One plan for all clusters, variants and backgrounds.
    """
    found = stages.enrichment_stage(clusters, loaded.associations, loaded.namespaces, wt, alpha, loaded.closed, loaded.slim)
    info = loaded.terms.select("term", "name", "definition").join(ontology.term_levels(loaded.edges), "term", "left")
    genes = clusters.select(F.col("Systematic_ID").alias("gene")).distinct()
    return ontology.enrichment_report(found, genes, ontology.propagate(loaded.associations, loaded.closed), info).withColumn("ontology", F.lit(name))


def write_reports(report: DataFrame, name: str, out: str) -> dict[str, list[str]]:
    """Two workbooks of an ontology, of all clusters and without the wild type: path to names of sheets.

    Each holds full and slim terms, then a sheet for every namespace of either; a sheet without rows says so.
    """
    o, held, written = ONTOLOGIES[name], report.drop("ontology").persist(), {}
    try:
        for background, prefix in (("all", ""), ("nonWT", "nonWT_")):
            rows = held.where(F.col("background") == background)
            order = [F.col("grp"), F.col("namespace"), F.col("p_fdr"), F.col("term_id")]
            full, slim = (rows.where(F.col("variant") == v).drop("variant", "background").withColumnRenamed("grp", "Cluster").orderBy("Cluster", *order[1:]) for v in ("full", "slim"))
            path = f"{out}/{prefix}{o.report}"
            written[path] = workbook.write_workbook(workbook.ontology_sheets(full, slim, *o.labels), path, NOTE)
    finally:
        held.unpersist()
    return written
