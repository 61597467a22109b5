"""Outcome labels of verified genes: concordance, doubts, novel genes, causes of failure, flips.

Missing numbers raise no flag; a library label other than E and V counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.semantics import flags, label

# Genes left out by hand, comment fragments of unsure readings, thresholds.
NOISED_GENES = (
    "pyp3", "mam2", "hul6", "fub1", "csn5", "rdl1", "ymr1", "meu31", "msn5",
    "SPAC4C5.03", "SPAC977.03", "mal1", "num1", "dbl8", "fmo1", "erm2", "thp1", "pmc3",
)
UNSURE_COMMENTS = (
    "轻微可见", "可见但", "很小", "小", "一大一小", "一个长一个不长", "不都是", "一半",
    "极少数", "少数", "不规则", "形状", "难长", "部分", "几列", "?", "？",
)
R2_LEAST, COLONIES_LEAST, FRACTION_LEAST = 0.80, 50, 0.5
R2_HIGH, COLONIES_LOW, FRACTION_LOW, AREA_GROWS = 0.98, 52, 0.88, 0.1


def concordance(verified: Column, library: Column) -> Column:
    """concordant_E, concordant_V, flip_V2E, flip_E2V, or no_library_ref without a library call."""
    v, d = F.trim(verified), F.trim(library)
    cases = [
        (~F.coalesce(d.isin("E", "V"), F.lit(False)), "no_library_ref"),
        ((v == d) & (v == "E"), "concordant_E"),
        (v == d, "concordant_V"),
        ((d == "V") & (v == "E"), "flip_V2E"),
    ]
    return label(cases, "flip_E2V")


def doubts() -> Column:
    """The flags of one gene, as an array in a fixed order."""
    unsure = F.lit(False)
    for x in UNSURE_COMMENTS:
        unsure = unsure | F.col("comments").contains(x)
    return flags([
        (F.trim("gene_name").isin(*NOISED_GENES), "noised_gene"),
        (unsure, "borderline_comment"),
        (F.col("R2") < R2_LEAST, "poor_fit"),
        (F.col("total_colonies") < COLONIES_LEAST, "thin_colonies"),
        (F.col("filtering_fraction") < FRACTION_LEAST, "low_filter_fraction"),
    ])


def outcome_table(df: DataFrame) -> DataFrame:
    """Add essentiality_concordance, qc_flag_reason (; between), is_ambiguous, has_any_comment and outcome."""
    named = concordance(F.col("verification_essentiality"), F.col("DeletionLibrary_essentiality"))
    out = df.withColumns({"essentiality_concordance": named, "qc_flag_reason": F.array_join(doubts(), ";")})
    out = out.withColumns({"is_ambiguous": F.col("qc_flag_reason") != "", "has_any_comment": F.col("comments").isNotNull()})
    return out.withColumn("outcome", F.when(F.col("is_ambiguous"), "ambiguous").otherwise(F.col("essentiality_concordance")))


def novel_genes(outcomes: DataFrame) -> DataFrame:
    """Genes without a name of their own, well fitted and not in doubt; discoveries first, then by fit."""
    rank = F.when(F.col("outcome") == "flip_V2E", 0).when(F.col("outcome") == "concordant_E", 1).when(F.col("outcome") == "flip_E2V", 2).otherwise(9)
    plain = F.col("gene_name").rlike("^SP[AB]") & (F.col("R2") >= R2_HIGH) & ~F.col("is_ambiguous")
    return outcomes.where(plain).withColumn("priority", rank).orderBy("priority", F.col("R2").desc(), "gene")


def failure_causes(outcomes: DataFrame) -> DataFrame:
    """Why genes in doubt are: the data, an annotation that depends on conditions, both, or a comment alone."""
    reasons = F.col("qc_flag_reason")
    data = reasons.rlike("poor_fit|thin_colonies|noised_gene") | (F.col("total_colonies") < COLONIES_LOW) | (F.col("filtering_fraction") < FRACTION_LOW)
    data, depends = F.coalesce(data, F.lit(False)), F.col("FYPOviability") == "condition-dependent"
    cases = [(data & depends, "both"), (data, "data_quality"), (depends, "biology_condition_dependent"), (reasons == "borderline_comment", "borderline_observation")]
    return outcomes.where("is_ambiguous").withColumn("failure_cause", label(cases, "unattributed"))


def flips(outcomes: DataFrame) -> DataFrame:
    """Genes whose verification turns the library over: why, and whether growth on day 6 agrees.

    A missing area does not grow: it confirms a flip to E and not one to V.
    """
    turned, seen = F.col("essentiality_concordance"), F.col("FYPOviability")
    cases = [
        (seen == "condition-dependent", "condition_dependent_annotation"),
        ((turned == "flip_V2E") & (seen == "viable"), "unconditional_viable_to_essential"),
        ((turned == "flip_E2V") & (seen == "inviable"), "unconditional_essential_to_viable"),
    ]
    grows = F.coalesce(F.col("median_area_day6") > AREA_GROWS, F.lit(False))
    out = outcomes.where(turned.isin("flip_V2E", "flip_E2V")).withColumns({"day6_grows": grows, "flip_reason": label(cases, "other")})
    return out.withColumn("area_confirms_flip", F.when(turned == "flip_V2E", ~F.col("day6_grows")).otherwise(F.col("day6_grows")))


def sure_flips(flipped: DataFrame) -> DataFrame:
    """The surest discoveries: viable without conditions, not in doubt, no growth; best fits first."""
    return flipped.where("flip_reason = 'unconditional_viable_to_essential' and not is_ambiguous and area_confirms_flip").orderBy(F.col("R2").desc(), "gene")
