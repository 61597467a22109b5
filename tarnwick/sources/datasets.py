"""The registry of data sets and the landmarks of the genome, from YAML files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnwick.sources.readers import read_yaml

# Tables of a release, by level, below its folder. Fixed values.
ALWAYS = {"annotations": "insertion_level/annotations.tsv.gz", "baseMean": "insertion_level/baseMean.tsv", "LFCs": "insertion_level/LFC.tsv"}
WITH_TIMES = {
    "fitting_LFCs": "insertion_level/fitting_LFCs.tsv", "fitting_results": "insertion_level/fitting_results.tsv", "transformed_weights": "insertion_level/transformed_weights.tsv",
    "gene_LFCs": "gene_level/LFC.tsv", "gene_fitting_LFCs": "gene_level/fitting_LFCs.tsv", "gene_fitting_results": "gene_level/fitting_results.tsv",
}
WITH_IMPUTATION = {"imputation_statistics": "insertion_level/imputation_statistics.tsv"}


@dataclass(frozen=True)
class Dataset:
    """A registered release and the paths of the tables that it has."""

    name: str
    label: str
    has_time_points: bool
    has_imputation: bool
    paths: dict[str, str]

    def missing(self, spark: SparkSession) -> list[str]:
        """Paths that do not exist, on whatever file system they lie."""
        paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in self.paths.values()]
        return [str(p) for p in paths if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]

    def validate(self, spark: SparkSession) -> Dataset:
        if gone := self.missing(spark):
            raise FileNotFoundError(f"release files not found: {', '.join(gone)}")
        return self


def dataset(registry: str | dict, name: str | None = None) -> Dataset:
    """One data set of a registry (a file or its content), the default one without a name; unknown names raise KeyError."""
    known = read_yaml(registry) if isinstance(registry, str) else registry
    name = known["default_dataset"] if name is None else name
    if name not in known["datasets"]:
        raise KeyError(f"unknown data set {name!r}; registered: {sorted(known['datasets'])}")
    entry = known["datasets"][name]
    tables = ALWAYS | (WITH_TIMES if entry["has_time_points"] else {}) | (WITH_IMPUTATION if entry["has_imputation"] else {})
    root = f"{known['snakemake_repo'].rstrip('/')}/{entry['release_dir'].strip('/')}"
    return Dataset(name, entry["label"], entry["has_time_points"], entry["has_imputation"], {k: f"{root}/{p}" for k, p in tables.items()})


def landmarks(spark: SparkSession, path: str, lengths: dict[str, int]) -> DataFrame:
    """Ends and centromere of each chromosome as ``dna_record`` takes them; a landmark that the file lacks is null."""
    marks = read_yaml(path)
    ends, centres = marks["chromosome_end"], marks["centromere_positions"]
    rows = [(c, n, ends["left"].get(c), ends["right"].get(c), *centres.get(c, (None, None))) for c, n in lengths.items()]
    return spark.createDataFrame(rows, "Chromosome string, length long, left long, right long, centromere_start long, centromere_end long")
