"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import TMP, crc_mod, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 10_000, folds: int = 5,
                    held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts (doc_id, text, y, fold) of at most ``per_class`` labelled ids of each class.

    Ids whose crc32 modulo ``folds`` is ``held_out`` are left out. The ids are taken in the order
    of a hash, so the sample is the same on every run. An id with labels 0 and 1 counts as 1.
    The id list has at most ``2 * per_class`` rows and is broadcast; the texts are written once.
    """
    known = labels.select(F.col("doc_id").alias(TMP + "id"), F.col(label).cast("int").alias("y")).where(f"{TMP}id is not null and y in (0, 1)")
    known = known.where(crc_mod(F.col(TMP + "id"), folds) != held_out).groupBy(TMP + "id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col(TMP + "id"), F.lit("sample"))
    ids = [known.where(F.col("y") == y).orderBy(order, TMP + "id").limit(per_class) for y in (0, 1)]
    ids = materialize(ids[0].unionByName(ids[1]), "sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col(TMP + "id"))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(10)).cast("int")
    return materialize(texts.select("doc_id", "text", "y", fold.alias("fold")), "sampled")
