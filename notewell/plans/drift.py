"""Drift of extraction features between a reference and a current batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell import schemas
from notewell.functions import matching as m
from notewell.functions.payload import parse_analysis
from notewell.plans.metrics import feature_stats

FEATURES = (
    "num_products", "num_categories", "num_materials", "num_colors", "has_vip", "has_budget", "has_nba", "urgency",
    "confidence", "num_extractions", "processing_time", "tier", "text_length",
)
FEATURE_THRESHOLD = 0.3
OVERALL_THRESHOLD = 0.2


def drift_features(df: DataFrame, column: str = "extracted_data", text: str = "raw_text") -> DataFrame:
    """List sizes, flags and measures of each record; missing parts count as zero."""
    e = F.col("__e")

    def size(col):
        return F.size(m.list_or_empty(col))

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("int")

    sizes = {
        "num_products": size(e["produits"]), "num_categories": size(e["categories"]),
        "num_materials": size(e["materiaux"]), "num_colors": size(e["couleurs"]),
    }
    more = [e["profil_client"]["contextes"], e["profil_client"]["preferences"], e["hospitalite"]["occasions"], e["action"]["recommandations"]]
    return (
        df.withColumn("__e", parse_analysis(F.col(column), schemas.DRIFT_PAYLOAD))
        .withColumns(
            {
                **sizes,
                "has_vip": flag(e["profil_client"]["is_vip"]),
                "has_budget": flag(~m.blank(e["profil_client"]["budget"])),
                "has_nba": flag(~m.blank(e["action"]["next_best_action"])),
                "urgency": F.coalesce(e["action"]["urgence"], F.lit(0.0)),
                "confidence": F.coalesce(e["confidence"], F.lit(0.0)),
                "num_extractions": sum(sizes.values(), F.lit(0)) + sum((size(c) for c in more), F.lit(0)),
                "text_length": F.length(text),
            }
        )
        .drop("__e")
    )


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str] = FEATURES,
                 threshold: float = FEATURE_THRESHOLD) -> DataFrame:
    """(feature, means, stds, change, drifted, status); the joined tables have one row per feature."""
    present = [c for c in columns if c in reference.columns and c in current.columns]
    r, c = feature_stats(reference, present), feature_stats(current, present)
    joined = r.select("feature", F.col("mean").alias("reference_mean"), F.col("std").alias("reference_std")).join(
        c.select("feature", F.col("mean").alias("current_mean"), F.col("std").alias("current_std")), "feature"
    )
    change = F.when(
        F.col("reference_mean") != 0, F.abs(F.col("current_mean") - F.col("reference_mean")) / F.abs("reference_mean")
    ).otherwise(F.when(F.col("current_mean") != 0, 1.0).otherwise(0.0))
    return joined.withColumn("mean_change", change).withColumn("drifted", F.col("mean_change") > threshold).withColumn(
        "status", F.when(F.col("drifted"), "DRIFT").otherwise("OK")
    )


def drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] = FEATURES,
          threshold: float = FEATURE_THRESHOLD) -> DataFrame:
    """One row: drift_detected, drift_score, drifted and total columns. An empty reference is no drift."""
    n, bad = F.count("*"), F.count_if("drifted")
    score = F.when(n > 0, bad / n).otherwise(F.lit(0.0))
    return drift_report(reference, current, columns, threshold).agg(
        (score > OVERALL_THRESHOLD).alias("drift_detected"),
        F.round(score, 4).alias("drift_score"),
        bad.alias("num_drifted_columns"),
        n.alias("total_columns"),
    )
