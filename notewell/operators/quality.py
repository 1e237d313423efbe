"""Quarantine, constraint checks and the cleaning report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import lists, privacy, text
from notewell.operators import dedup, filters
from notewell.session import cut_lineage


def with_errors(df: DataFrame, rules: Mapping[str, Column], out: str = "errors") -> DataFrame:
    """``errors``: names of the rules (conditions that must hold) that a row breaks."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Mapping[str, Column], tier: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with error and metadata)."""
    checked = with_errors(df, rules)
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0).select(
        *df.columns,
        F.array_join("errors", "; ").alias("error"),
        (tier if tier is not None else F.lit("unknown")).alias("tier_attempted"),
        F.lit(0).alias("retry_count"),
        F.lit(True).alias("requires_manual_review"),
        F.to_json(F.struct(F.size("errors").alias("error_count"))).alias("metadata"),
    )
    return good, bad


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break uniqueness (nulls do not count)."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def check_constraints(users: DataFrame | None = None, clients: DataFrame | None = None,
                      actions: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """(table, rule, violations) of the enum and uniqueness rules of the store."""
    parts = []

    def enum(table: str, df: DataFrame, column: str, allowed: Sequence[str]) -> None:
        bad = F.count_if(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
        parts.append(df.agg(bad.alias("violations")).select(F.lit(table).alias("table"), F.lit(f"{column}_enum").alias("rule"), "violations"))

    def unique(table: str, df: DataFrame, column: str) -> None:
        parts.append(
            duplicate_keys(df, [column]).agg(F.count("*").alias("violations")).select(
                F.lit(table).alias("table"), F.lit(f"{column}_unique").alias("rule"), "violations"
            )
        )

    if users is not None:
        enum("users", users, "role", fv.USER_ROLES)
        unique("users", users, "email")
    if clients is not None:
        enum("clients", clients, "category", fv.CLIENT_CATEGORIES)
        unique("clients", clients, "external_client_id")
    if actions is not None:
        enum("opportunity_actions", actions, "action_type", fv.ACTION_TYPES)
        enum("opportunity_actions", actions, "status", fv.ACTION_STATUSES)
        unique("opportunity_actions", actions, "note_id")
    if products is not None:
        unique("products", products, "sku")
    return dedup.union_notes(parts)


def clean_dataset(df: DataFrame, text_col: str = "text", lang: str | None = "lang", id_col: str = "id") -> DataFrame:
    """The cleaned dataset: of equal cleaned texts of a language the row with the smallest id stays."""
    cleaned = cut_lineage(cleaned_rows(df, text_col, lang), "cleaned")  # cleaned once, read by both sides of the join
    return dedup.dedup_notes(cleaned, text_col, lang, id_col)


def cleaned_rows(df: DataFrame, text_col: str = "text", lang: str | None = "lang") -> DataFrame:
    """Empty rows out, texts cleaned and masked, null literals out; repeated texts are still there.

    Adds ``fillers_removed``, ``pii_hits`` and ``changed``; :func:`cleaning_report` reads them.
    """
    base = filters.drop_empty(df, text_col).withColumn("__original", F.col(text_col))
    code = F.upper(F.coalesce(F.col(lang), F.lit("FR"))) if lang and lang in df.columns else F.lit("FR")
    cleaned = text.clean_text(base.withColumn("__lang", code), text_col, "__lang")
    audited = (
        cleaned.withColumn("__masked", privacy.masked_and_counted(F.col("cleaned")))
        .withColumn("pii_hits", F.aggregate(F.col("__masked")["n"], F.lit(0), lambda acc, v: acc + v))
        .withColumn(text_col, F.col("__masked")["t"])
        .withColumn("changed", F.col(text_col) != F.col("__original"))
        .drop("__original", "__masked", "__lang", "cleaned", "compression_ratio", "tokens_saved", "duplicates_removed")
    )
    return filters.null_literals(audited, skip=[text_col])


def cleaning_report(df: DataFrame, cleaned: DataFrame, text_col: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row of counts; ``cleaned`` is the output of :func:`cleaned_rows`."""
    keys = [text_col] + ([lang] if lang and lang in cleaned.columns else [])
    before = filters.count_empty(df, text_col)
    # one pass over the cleaned rows: counts per distinct text first, their sums afterwards
    per_text = cleaned.groupBy(dedup.key_digest(keys).alias("__key")).agg(
        F.count("*").alias("__n"),
        F.count_if("changed").alias("__changed"),
        F.sum("fillers_removed").alias("__fillers"),
        F.count_if(F.col("pii_hits") > 0).alias("__pii"),
    )
    after = per_text.agg(
        F.sum("__n").alias("__kept"),
        F.sum("__changed").alias("rows_cleaned"),
        F.sum("__fillers").alias("fillers_removed"),
        F.sum("__pii").alias("pii_rows"),
        F.count("*").alias("final_rows"),
    )
    both = before.unionByName(after, allowMissingColumns=True)
    report = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both.columns])
    return report.select(
        F.col("rows").alias("original_rows"),
        (F.col("empty_rows") + F.col("blank_texts")).alias("empty_rows_removed"),
        "rows_cleaned",
        "fillers_removed",
        "pii_rows",
        (F.col("__kept") - F.col("final_rows")).alias("duplicates_removed"),
        "final_rows",
        F.round((F.col("rows") - F.col("final_rows")) / F.col("rows") * 100, 2).alias("reduction_percent"),
    )


def preview_dataset(df: DataFrame, rows: int = 3) -> tuple[list[str], DataFrame, DataFrame]:
    """(column names, one-row count, the first rows)."""
    return df.columns, df.agg(F.count("*").alias("row_count")), df.limit(rows)


def parity(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Differences of two projections ``(id, tier, contains_sensitive, tags)`` of the same notes."""
    x = a.select(id_col, F.struct("tier", "contains_sensitive", "tags").alias("__a"))
    y = b.select(id_col, F.struct("tier", "contains_sensitive", "tags").alias("__b"))
    return x.join(y, id_col).select(
        id_col,
        (~F.col("__a.tier").eqNullSafe(F.col("__b.tier"))).alias("tier_mismatch"),
        (~F.col("__a.contains_sensitive").eqNullSafe(F.col("__b.contains_sensitive"))).alias("rgpd_mismatch"),
        lists.jaccard(F.col("__a.tags"), F.col("__b.tags")).alias("tag_jaccard"),
    )
