"""Ontology closure, slim mapping, associations and over-representation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.stats import benjamini_hochberg, fisher_two_sided
from tarnwick.session import ensure_checkpoints


def different_edges(edges: DataFrame) -> DataFrame:
    """(child, parent) once each, written, for plans that join them in rounds.

    The least of a group's equal values stands for them: unlike a plain distinct it carries no
    constraints of the source into the rounds, where the optimiser would multiply them.
    """
    ensure_checkpoints(edges.sparkSession)
    pairs = edges.groupBy(F.col("child").alias("__c"), F.col("parent").alias("__p")).agg(F.min("child").alias("child"), F.min("parent").alias("parent"))
    return pairs.select("child", "parent").checkpoint()


def closure(edges: DataFrame, relations: list[str] | None = None, max_depth: int = 64) -> DataFrame:
    """(term, ancestor) for every term and itself over (child, parent, relation) edges.

    Each round joins the frontier with the edges and keeps the pairs that are new, so paths never
    multiply; rounds are cut by checkpoints and end with the depth of the ontology.
    """
    if relations and "relation" in edges.columns:
        edges = edges.where(F.col("relation").isin(relations))
    edges = different_edges(edges)
    terms = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    known = frontier = terms.select("term", F.col("term").alias("ancestor")).checkpoint()
    for _ in range(max_depth):
        step = frontier.join(edges, frontier["ancestor"] == edges["child"]).select("term", F.col("parent").alias("ancestor")).distinct()
        frontier = step.join(known, ["term", "ancestor"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise ValueError("the ontology is deeper than max_depth or has a cycle")


def propagate(associations: DataFrame, closed: DataFrame) -> DataFrame:
    """(gene, term) with all ancestors of each gene's terms; terms outside stay themselves."""
    joined = associations.join(closed, "term", "left")
    return joined.select("gene", F.coalesce("ancestor", "term").alias("term")).distinct()


def slim_all(closed: DataFrame, slim: DataFrame) -> DataFrame:
    """(term, slim) for every slim term among a term's ancestors, itself included."""
    return closed.join(slim.select(F.col("term").alias("ancestor")).distinct(), "ancestor", "left_semi").select("term", F.col("ancestor").alias("slim"))


def slim_direct(closed: DataFrame, slim: DataFrame) -> DataFrame:
    """The slim ancestors that no other slim ancestor of the term lies below."""
    whole = slim_all(closed, slim)
    above = whole.where("term <> slim").select(F.col("term").alias("slim"), F.col("slim").alias("higher"))
    covered = whole.join(above, "slim").select("term", F.col("higher").alias("slim")).distinct()
    return whole.join(covered, ["term", "slim"], "left_anti")


def slim_associations(associations: DataFrame, closed: DataFrame, slim: DataFrame, direct: bool = False) -> DataFrame:
    """(gene, term) with each term replaced by all its slim ancestors, or by the direct ones only."""
    mapped = slim_direct(closed, slim) if direct else slim_all(closed, slim)
    return associations.select("gene", "term").join(mapped, "term").select("gene", F.col("slim").alias("term")).distinct()


def enrich(study: DataFrame, background: DataFrame, associations: DataFrame, namespaces: DataFrame, alpha: float = 0.05, significant: bool = True) -> DataFrame:
    """Over-representation of terms per group, all groups and namespaces in one query.

    ``study`` is (grp, gene), ``background`` (gene), ``associations`` (gene, term) and
    ``namespaces`` (term, namespace). Fisher's exact test is two-sided, the false discovery rate
    counts all terms of a namespace in the background; ``significant`` keeps those below alpha
    in which the study has the larger share. Then terms that a group does not hit, which share
    their p where they share their count, stand as one row per count with its number of terms.
    """
    genes = background.select("gene").distinct()
    assoc = associations.select("gene", "term").distinct().join(genes, "gene", "left_semi").join(namespaces, "term")
    total = genes.agg(F.count(F.lit(1)).alias("pop_n"))
    members = study.select("grp", "gene").distinct().join(genes, "gene", "left_semi")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("study_n"))
    pop = assoc.groupBy("namespace", "term").agg(F.count(F.lit(1)).alias("pop_count"))
    hits = assoc.join(members, "gene").groupBy("grp", "namespace", "term").agg(F.count(F.lit(1)).alias("study_count"), F.array_join(F.array_sort(F.collect_list(F.col("gene").cast("string"))), ",").alias("study_items"))
    # Groups and the one-row total are small next to the terms; neither side is a pair of large tables.
    if significant:
        hit = hits.join(pop, ["namespace", "term"]).join(sizes, "grp").withColumn("terms", F.lit(1).cast("long"))
        counts = pop.groupBy("namespace", "pop_count").agg(F.count(F.lit(1)).alias("terms")).join(sizes, how="cross")
        seen = hit.groupBy("grp", "namespace", "pop_count").agg(F.count(F.lit(1)).alias("seen"))
        rest = counts.join(seen, ["grp", "namespace", "pop_count"], "left").withColumn("terms", F.col("terms") - F.coalesce("seen", F.lit(0))).drop("seen").where("terms > 0")
        tested = hit.unionByName(rest.withColumn("study_count", F.lit(0).cast("long")), allowMissingColumns=True).join(total, how="cross")
    else:
        tested = pop.join(sizes, how="cross").join(total, how="cross").join(hits, ["grp", "namespace", "term"], "left").na.fill({"study_count": 0, "study_items": ""}).withColumn("terms", F.lit(1).cast("long"))
    tested = tested.withColumn("p_uncorrected", fisher_two_sided("study_count", "study_n", "pop_count", "pop_n"))
    over = F.col("study_count") / F.col("study_n") > F.col("pop_count") / F.col("pop_n")
    out = benjamini_hochberg(tested, ["grp", "namespace"], "p_uncorrected", ["term", "pop_count"], weight="terms").drop("terms").withColumn("direction", F.when(over, "e").otherwise("p"))
    out = out.withColumn("gene_ratio", F.col("study_count") / F.col("study_n")).withColumn("term_coverage", F.col("study_count") / F.col("pop_count"))
    out = out.withColumn("ratio_in_study", F.concat_ws("/", "study_count", "study_n")).withColumn("ratio_in_pop", F.concat_ws("/", "pop_count", "pop_n"))
    return out.where((F.col("p_fdr") < alpha) & (F.col("direction") == "e")) if significant else out


def enrich_full_and_slim(study: DataFrame, background: DataFrame, associations: DataFrame, closed: DataFrame, slim: DataFrame, namespaces: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant terms of all propagated terms (variant full) and of all slim ancestors alone (variant slim)."""
    full = enrich(study, background, propagate(associations, closed), namespaces, alpha)
    short = enrich(study, background, slim_associations(associations, closed, slim), namespaces, alpha)
    return full.withColumn("variant", F.lit("full")).unionByName(short.withColumn("variant", F.lit("slim")))


def term_levels(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(term, level, depth): edges of the shortest and of the longest way up to a term without parents.

    Each round holds the different terms that some way of one length reaches.
    """
    edges = different_edges(edges)
    frontier = edges.select(F.col("parent").alias("term")).distinct().join(edges.select(F.col("child").alias("term")), "term", "left_anti").checkpoint()
    found = frontier.withColumn("d", F.lit(0))
    for d in range(1, max_depth + 2):
        frontier = edges.join(frontier, edges["parent"] == frontier["term"], "left_semi").select(F.col("child").alias("term")).distinct().checkpoint()
        if frontier.isEmpty():
            return found.groupBy("term").agg(F.min("d").alias("level"), F.max("d").alias("depth"))
        found = found.union(frontier.withColumn("d", F.lit(d)))
    raise ValueError("the ontology is deeper than max_depth or has a cycle")


def gene_lists(genes: DataFrame, known: DataFrame, by: list[str], out: str) -> DataFrame:
    """``by`` and the genes of each group as one text, in the order of their texts, parted by commas.

    The genes of ``known``, which has all of them, are cut into ranges of that order. A range of a
    group is glued by itself, so no task holds a large group gene by gene: only its text, range by
    range.
    """
    ranges = 4 * int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("gene").cast("string")
    placed = known.select(text.alias("gene")).distinct().repartitionByRange(ranges, "gene").select("gene", F.spark_partition_id().alias("range"))
    each = genes.select(*by, text.alias("gene")).join(placed, "gene").groupBy(*by, "range").agg(F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("some"))
    return each.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "some"))), lambda r: r["some"]), ",").alias(out))


def enrichment_report(found: DataFrame, background: DataFrame, associations: DataFrame, info: DataFrame) -> DataFrame:
    """Significant terms with name, level, depth and definition of ``info`` and the background's genes of the term.

    Shares are rounded half-even to two digits. Genes are gathered for the reported terms alone (``gene_lists``).
    """
    terms = found.select("term").distinct()
    genes = associations.select("gene", "term").distinct().join(background.select("gene").distinct(), "gene", "left_semi").join(terms, "term", "left_semi")
    items = gene_lists(genes, background, ["term"], "pop_items")
    rows = found.join(items, "term", "left").join(info.select("term", "name", "level", "depth", "definition"), "term", "left")
    extra = [c for c in ("grp", "variant", "background") if c in found.columns]
    return rows.select(
        *extra, "namespace", F.col("term").alias("term_id"), F.col("name").alias("term"), "level", "depth", "p_uncorrected", "p_fdr", F.bround("gene_ratio", 2).alias("gene_ratio"), F.bround("term_coverage", 2).alias("term_coverage"),
        "study_count", "study_n", "pop_count", "pop_n", "ratio_in_study", "ratio_in_pop", "study_items", "pop_items", "definition")


def filter_terms(df: DataFrame, max_pop: int, drop_namespace: str = "MF") -> DataFrame:
    return df.where((F.col("pop_count") < max_pop) & (F.col("namespace") != drop_namespace))


def named(df: DataFrame, names: DataFrame, term: str = "term") -> DataFrame:
    """Term names, or a placeholder for unknown terms."""
    found = df.join(names.select(F.col("term").alias(term), "name"), term, "left")
    return found.withColumn("name", F.coalesce("name", F.concat(F.lit("No record for "), F.col(term))))


GAF = ("DB", "DB_Object_ID", "DB_Object_Symbol", "Qualifier", "GO_ID", "Reference", "Evidence", "With", "Aspect", "DB_Object_Name", "Synonym", "DB_Object_Type", "Taxon", "Date", "Assigned_By", "Annotation_Extension", "Gene_Product_Form_ID")


#: Values that the association files must hold. Fixed values.
TAXON, STANDARD_CONDITION, FILL_DATE = "taxon:4896", "FYECO:0000005", "2025-09-01"


def to_gaf(df: DataFrame, **given: Column) -> DataFrame:
    """A table of the 17 association columns; those that are not given are empty."""
    date = {"Date": F.regexp_replace(given["Date"], "-", "")} if "Date" in given else {}
    filled = {"DB_Object_Type": F.lit("protein"), "Taxon": F.lit(TAXON)} | given | date
    return df.select(*[filled.get(c, F.lit("")).alias(c) for c in GAF])


def phenotype_gaf(phaf: DataFrame, names: DataFrame) -> DataFrame:
    """Associations of phenotypes, of deletion and disruption alleles under the standard condition only."""
    rows = phaf.where(F.col("Allele type").isin("deletion", "disruption") & F.col("Condition").contains(STANDARD_CONDITION))
    rows = named(rows.withColumnRenamed("FYPO ID", "term"), names)
    return to_gaf(
        rows, DB=F.lit("PomBase"), DB_Object_ID=F.col("Gene systematic ID"), DB_Object_Symbol=F.col("Gene symbol"), GO_ID=F.col("term"), Reference=F.col("Reference"), Evidence=F.col("Evidence"),
        Aspect=F.lit("FYPO"), DB_Object_Name=F.col("name"), Date=F.col("Date"), Assigned_By=F.col("#Database name"), Annotation_Extension=F.col("Extension"))


def disease_gaf(table: DataFrame, names: DataFrame) -> DataFrame:
    """Associations of diseases; a missing date becomes the date of the file."""
    rows = named(table.withColumnRenamed("mondo_id", "term"), names)
    return to_gaf(
        rows, DB=F.lit("Pombase"), DB_Object_ID=F.col("#gene_systematic_id"), DB_Object_Symbol=F.col("gene_name"), GO_ID=F.col("term"), Reference=F.col("reference"),
        Aspect=F.lit("MONDO"), DB_Object_Name=F.col("name"), Date=F.coalesce("date", F.lit(FILL_DATE)), Assigned_By=F.lit("PomBase"))


#: Namespaces of the web service and their names, in the order of the report. Fixed values.
WEB_NAMESPACES = {
    "Process": "Biological Process (Gene Ontology)",
    "Component": "Cellular Component (Gene Ontology)",
    "Function": "Molecular Function (Gene Ontology)",
    "PMID": "Reference Publications (PubMed)",
    "NetworkNeighborAL": "Local Network Cluster (STRING)",
    "KEGG": "KEGG Pathways",
    "RCTM": "Reactome Pathways",
    "COMPARTMENTS": "Subcellular Localization (COMPARTMENTS)",
    "Keyword": "Annotated Keywords (UniProt)",
    "InterPro": "Protein Domains and Features (InterPro)",
    "SMART": "Protein Domains and Features (SMART)",
}


def web_enrichment(df: DataFrame, study_n: int, pop_n: int) -> DataFrame:
    """A web response in the columns of ``enrich``: ratios, named namespaces (unknown: null, last), their order."""
    k, m = F.col("number_of_genes"), F.col("number_of_genes_in_background")
    order = F.array_position(F.array(*[F.lit(x) for x in WEB_NAMESPACES]), F.col("category"))
    named_as = F.try_element_at(F.create_map(*[F.lit(x) for pair in WEB_NAMESPACES.items() for x in pair]), F.col("category"))
    rows = df.orderBy(F.when(order > 0, order).asc_nulls_last(), "p_value", "term")
    return rows.select(
        F.col("term").alias("term_id"), named_as.alias("namespace"), F.col("description").alias("term"), F.col("p_value").alias("p_uncorrected"), F.col("fdr").alias("p_fdr"),
        F.bround(k / study_n, 2).alias("gene_ratio"), F.bround(F.try_divide(k, m), 2).alias("term_coverage"), k.alias("study_count"), F.lit(study_n).alias("study_n"),
        m.alias("pop_count"), F.lit(pop_n).alias("pop_n"), F.concat_ws("/", k, F.lit(study_n)).alias("ratio_in_study"), F.concat_ws("/", m, F.lit(pop_n)).alias("ratio_in_pop"),
        F.col("preferredNames").alias("study_items"),
    )


def redundancy(df: DataFrame, responses: dict[float, DataFrame], key: tuple[str, ...] = ("Cluster", "namespace", "term_id")) -> DataFrame:
    """Dispensability, Eliminated and Representative per cutoff, suffixed by it, joined on cluster, namespace and term."""
    for cutoff, table in responses.items():
        some = table.select(*key, *[F.col(c).alias(f"{c}_{cutoff}") for c in ("Dispensability", "Eliminated", "Representative")])
        df = df.join(some, list(key), "left")
    return df
