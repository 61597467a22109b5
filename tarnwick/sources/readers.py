"""Readers of the table, annotation, sequence, ontology and structure formats."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.writers import LOGICAL

#: Tried in this order on the whole name. Fixed values.
KINDS = (("tsv", "\t"), ("bed", "\t"), ("csv", ","))


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Read by what the file's name contains: tsv, bed, csv, xlsx, then parquet.

    A gz file can't be split: it is one task to read, and its rows are dealt out behind that.
    """
    name = path.rsplit("/", 1)[-1]
    for kind, sep in KINDS:
        if kind in name:
            reader = spark.read.options(sep=sep, header=True, **options)
            rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
            return rows.repartition(spark.sparkContext.defaultParallelism) if name.endswith(".gz") else rows
    if "xlsx" in name:
        from tarnwick.sources.workbook import inferred, read_workbook

        return inferred(read_workbook(spark, path, **options))
    if "parquet" in name:
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {name}")


def logical_names(columns: list[str]) -> list[str]:
    """The names that a table's columns had before the writer kept equal ones apart by ``__dupN``."""
    return [re.sub(r"__dup\d+$", "", c) for c in columns]


@dataclass(frozen=True)
class Logical:
    """A table as it was written: ``df`` has unique names, ``names`` the logical ones, some of which may be equal."""

    df: DataFrame
    names: tuple[str, ...]
    index: tuple[str, ...]
    series: bool
    series_name: str | None

    def frame(self) -> DataFrame:
        """The table under its logical names; equal ones can be listed and written, but not referred to."""
        return self.df.toDF(*self.names)

    def columns(self, name: str) -> list[Column]:
        """All columns of a logical name, in their order."""
        return [self.df[f"`{c}`"] for c, n in zip(self.df.columns, self.names, strict=True) if n == name]

    def values(self) -> DataFrame:
        """The table without its index."""
        return self.df.drop(*self.index)


def read_parquet(spark: SparkSession, path: str) -> Logical:
    """A table with the logical names, index and series that ``writers.write_parquet`` kept in its metadata.

    Columns without such metadata, as of files that others wrote, keep their names and are values.
    """
    df = spark.read.parquet(path)
    marks = {f.name: f.metadata.get(LOGICAL) or {"name": f.name, "place": len(df.columns) + i, "role": "value", "named": True} for i, f in enumerate(df.schema.fields)}
    order = sorted(df.columns, key=lambda c: marks[c]["place"])
    df = df.select(*[f"`{c}`" for c in order])
    of = lambda role: [c for c in order if marks[c]["role"] == role]
    series = of("series")
    name = marks[series[0]]["name"] if series and marks[series[0]]["named"] else None
    return Logical(df, tuple(marks[c]["name"] for c in order), tuple(of("index")), bool(series), name)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first six of twelve headerless columns."""
    names = "chrom string, start long, end long, name string, score string, strand string, thick_start long, thick_end long, rgb string, blocks int, sizes string, starts string"
    return spark.read.schema(names).csv(path, sep="\t").select("chrom", "start", "end", "name", "score", "strand")


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str], null: str = "NONE") -> DataFrame:
    """A headerless table of two columns."""
    return spark.read.schema(f"{names[0]} string, {names[1]} string").csv(path, sep="\t", nullValue=null)


def read_two_headers(spark: SparkSession, path: str, keys: list[str], sep: str = "\t") -> DataFrame:
    """Two header rows become names joined by an underscore; the first columns are the keys."""
    lines = spark.read.text(path)
    head = [r.value.split(sep) for r in lines.limit(2).collect()]
    names = keys + ["_".join(x for x in (a, b) if x) for a, b in zip(head[0][len(keys):], head[1][len(keys):], strict=True)]
    body = spark.read.csv(path, sep=sep).where(~F.col("_c0").isin(head[0][0], head[1][0]) if head[0][0] else F.col("_c0").isNotNull() & (F.col("_c0") != head[1][0]))
    return body.toDF(*names)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence), one row per record."""
    parts = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    head = F.get(lines, 0)
    return parts.select(F.substring_index(head, " ", 1).alias("id"), head.alias("description"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("sequence"))


def attribute(name: str) -> Column:
    found = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.nullif(found, F.lit(""))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features with ID, Parent and Name."""
    names = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
    rows = spark.read.schema(names).csv(path, sep="\t", comment="#").where("type is not null")
    return rows.select("*", attribute("ID").alias("id"), attribute("Parent").alias("parent"), attribute("Name").alias("name"))


def children(features: DataFrame, parent_type: str, child_type: str) -> DataFrame:
    """(id, parts) of a parent's children of a type, ordered by start."""
    up = features.where(F.col("type") == parent_type).select("id")
    down = features.where(F.col("type") == child_type).select(F.explode(F.split("parent", ",")).alias("id"), F.struct("start", "end", "strand").alias("part"))
    return up.join(down, "id").groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("parts"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (term, name, namespace, definition) and edges (child, parent, relation); obsolete terms go."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where("value like '%[Term]%'")

    def tag(name: str, pattern: str = r"([^\n]*)") -> Column:
        return F.nullif(F.regexp_extract("value", rf"(?m)^{name}: {pattern}", 1), F.lit(""))

    rows = stanza.where("value not rlike '(?m)^is_obsolete: true'").select(tag("id", r"(\S+)").alias("term"), "value", tag("name").alias("name"), tag("namespace").alias("namespace"), tag("def", r'"((?:[^"\\]|\\.)*)"').alias("definition"))
    is_a = rows.select(F.col("term").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent"), F.lit("is_a").alias("relation"))
    related = rows.select(F.col("term").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^relationship: (\S+ \S+)"), F.lit(1))).alias("r"))
    related = related.select("child", F.substring_index("r", " ", -1).alias("parent"), F.substring_index("r", " ", 1).alias("relation"))
    return rows.drop("value"), is_a.unionByName(related)


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """The 17 association columns without comments and negated rows."""
    from tarnwick.operators.ontology import GAF

    rows = spark.read.schema(", ".join(f"`{c}` string" for c in GAF)).csv(path, sep="\t", comment="!")
    return rows.where(~F.coalesce(F.col("Qualifier"), F.lit("")).contains("NOT"))


def read_pdb_confidence(spark: SparkSession, path: str, glob: str = "*.pdb*") -> DataFrame:
    """(protein, residue, confidence) of the alpha carbons; the id is taken from AF-<id>-F1-."""
    rows = spark.read.option("pathGlobFilter", glob).text(path).select("value", F.input_file_name().alias("file"))
    atoms = rows.where("value like 'ATOM%' and trim(substring(value, 13, 4)) = 'CA'")
    return atoms.select(F.regexp_extract("file", "AF-(.+?)-F1-", 1).alias("protein"), F.trim(F.substring("value", 18, 3)).alias("residue"), F.trim(F.substring("value", 61, 6)).cast("double").alias("confidence"))


def read_grouped_files(spark: SparkSession, path: str, pattern: str, glob: str = "*.txt") -> DataFrame:
    """(group, value): lines of many files, the group taken from the file's name."""
    rows = spark.read.option("pathGlobFilter", glob).text(path)
    return rows.select(F.regexp_extract(F.input_file_name(), pattern, 1).alias("group"), F.trim("value").alias("value")).where("value <> ''")


def read_sentinel(spark: SparkSession, path: str) -> tuple[str, dict[str, int]] | None:
    """What ``writers.write_sentinel`` wrote, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    head, *lines = spark.read.text(path, wholetext=True).first()[0].splitlines()
    return head.removesuffix(" complete"), {k: int(v) for k, _, v in (x.rpartition("\t") for x in lines)}


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def cached(spark: SparkSession, cache_dir: str, parts: list[str], fetch=None, schema: str | None = None) -> DataFrame | None:
    """A response table by the key of its request: from the cache, else fetched and kept, else None."""
    from hashlib import sha1

    path = f"{cache_dir}/{sha1('||'.join(parts).encode()).hexdigest()[:16]}.tsv"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = fetch(parts) if fetch else None
        if rows is None:
            return None
        spark.createDataFrame(rows, schema).coalesce(1).write.csv(path, sep="\t", header=True)
    return read_table(spark, path, schema)


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, skip: int = 0, comment: str | None = None, drop: int = 0) -> DataFrame:
    """One sheet of a workbook, or of each in a folder, as text; ``drop`` rows after the header go."""
    from tarnwick.sources.workbook import read_workbook

    return read_workbook(spark, path, sheet, skip, comment, drop)


def read_cif_confidence(spark: SparkSession, path: str, glob: str = "*.cif*") -> DataFrame:
    """(protein, residue, confidence) of the alpha carbons of mmCIF files, columns found by their names."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    lines = F.split("value", "\n")
    named = F.transform(F.filter(lines, lambda x: x.startswith("_atom_site.")), lambda x: F.trim(F.substring_index(x, ".", -1)))
    rows = files.select("file", named.alias("n"), F.explode(F.filter(lines, lambda x: x.startswith("ATOM"))).alias("a"))
    rows = rows.select("file", "n", F.split(F.trim("a"), " +").alias("a"))

    def column(name: str) -> Column:
        return F.get("a", (F.array_position("n", name) - 1).cast("int"))

    atoms = rows.where(F.regexp_replace(column("label_atom_id"), "\"", "") == "CA")
    return atoms.select(F.regexp_extract("file", "AF-(.+?)-F1-", 1).alias("protein"), column("label_comp_id").alias("residue"), column("B_iso_or_equiv").cast("double").alias("confidence"))


#: Three letters of a residue to one. Fixed values.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def read_pdb_sequence(spark: SparkSession, path: str, glob: str = "*.pdb*") -> DataFrame:
    """(protein, sequence) of the first chain of each structure, residues in the order of their numbers."""
    rows = spark.read.option("pathGlobFilter", glob).text(path).select("value", F.input_file_name().alias("file"))
    atoms = rows.where("value like 'ATOM%' and trim(substring(value, 13, 4)) = 'CA'")
    letters = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    place = F.struct(F.trim(F.substring("value", 23, 4)).cast("int").alias("no"), F.substring("value", 27, 1).alias("extra"))
    each = atoms.select("file", F.substring("value", 22, 1).alias("chain"), place.alias("at"), F.coalesce(F.try_element_at(letters, F.substring("value", 18, 3)), F.lit("X")).alias("a"))
    chains = each.groupBy("file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "a"))), lambda x: x["a"]), "").alias("sequence"))
    first = chains.groupBy("file").agg(F.min_by("sequence", "chain").alias("sequence"))
    return first.select(F.regexp_extract("file", "AF-(.+?)-F1-", 1).alias("protein"), "sequence")
