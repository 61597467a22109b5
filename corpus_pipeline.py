"""A corpus pipeline: filter by rules, filter by model, deduplicate, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, whatever these are. Between stages the rows are written as Parquet and
read again; a stage's table is deleted as soon as the next one is written.

All stages go by row: rows without an id, rows that share one and repeated rows are handled like
all others. Null, empty and wordless texts fail the rules, so later stages see them only when
called by themselves. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm.common import discard, materialize
from tarnwick.llm.mixing import apply_mix
from tarnwick.llm.near_texts import keep_one_text
from tarnwick.llm.packing import pack
from tarnwick.llm.quality_model import fit_quality, keep_good
from tarnwick.llm.quality_rules import keep_fit
from tarnwick.session import ship

#: The stages have no SQL form; they are tested against plain versions.
ORACLE_SQL = None


#: Rows and bytes that a task holds of texts at once, unless the session names other ones: by Spark's own, tasks on a heap of 128 MB each ran out.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that its workers can run when it is called by itself: they import this package for it.

    What it returns is run later, so the session keeps the sizes of ``BATCHES``.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        for name in BATCHES.keys() - spark.conf.getAll.keys():
            spark.conf.set(name, BATCHES[name])
        return stage(spark, docs, sf_dir)

    return run


@_shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; a posterior of one half stays."""
    return keep_fit(docs)


@_shipped
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labelled documents of the corpus, keeps.

    Null texts are scored as empty ones; a score that equals the threshold stays.
    """
    corpus, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit_quality(corpus, labels))


@_shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints within two bits of each other name the first pairs to be compared, MinHash buckets the rest.
    It is the row of the group's smallest id, a null id last, and of the least text where rows
    share that id. Null and wordless texts are copies of each other.
    """
    return keep_one_text(docs)


@_shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order, texts whole.

    Null sources are one source; documents without words come once and last.
    """
    return apply_mix(docs)


@_shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that hold the mix: one row per piece of a document; null texts are one end token."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
