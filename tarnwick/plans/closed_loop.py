"""Groups of interest met again with the outcomes of their genes and their centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["group_type", "group_name"]


def members_of(annotation: DataFrame, targets: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Rows of a long annotation whose tuple of group columns is among the targets, each once however often a target is listed.

    A tuple with a missing part is that tuple: missing equals missing.
    """
    wanted = targets.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return annotation.join(wanted, on, "left_semi")


def with_outcomes(members: DataFrame, outcomes: DataFrame, gene: str = "gene", columns: tuple[str, ...] = ("outcome", "DR", "DL")) -> DataFrame:
    """Members with the outcome, DR and DL of their gene; a gene of several outcomes gives a row each, one of none has none."""
    return members.join(outcomes.select(gene, *columns), gene, "left")


def with_centroids(members: DataFrame, coherence: DataFrame, by: list[str] = GROUP, dr_max: float = 1.0, dl_max: float = 10.0) -> DataFrame:
    """Members with their group's centroid and their distance to it, DR and DL as shares of fixed bounds.

    A group that the coherence table lists several times, once for each namespace, has one
    centroid: the mean. A group without one and a gene without DR or DL have no distance.
    """
    centre = coherence.groupBy(*by).agg(F.avg("centroid_x").alias("centroid_x"), F.avg("centroid_y").alias("centroid_y"))
    rows = members.join(centre, by, "left")
    dx, dy = F.col("DR") / dr_max - F.col("centroid_x"), F.col("DL") / dl_max - F.col("centroid_y")
    return rows.withColumn("distance_to_centroid", F.sqrt(dx * dx + dy * dy))


def target_groups(annotation: DataFrame, targets: DataFrame, outcomes: DataFrame, coherence: DataFrame) -> DataFrame:
    """Every member of the target groups with outcome, place and distance to its group's centroid."""
    return with_centroids(with_outcomes(members_of(annotation, targets), outcomes), coherence)
