"""Writers: results, warehouse rows, quarantine, statistics, cost log, catalogue export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell import schemas
from notewell.functions import matching as m

QUARANTINE_EXPORT = ("note_id", "timestamp", "tier_attempted", "retry_count", "error", "note_text", "metadata")
PRODUCT_EXPORT = ("sku", "name", "url", "image_url", "price_eur", "category1", "category2", "category3", "is_discount", "stock")


def csv_ready(df: DataFrame) -> DataFrame:
    """Lists of text joined with ', ', other nested values as JSON text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(f.name, ", ").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "csv":
        csv_ready(df).write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    elif fmt in ("parquet", "json"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def to_warehouse(df: DataFrame) -> DataFrame:
    """The flat warehouse row of a processed note.

    Input: id, timestamp, store_id, advisor_id, tier, processing_time_ms, cost_usd, points_awarded,
    original_text, processed_text, cache_hit, contains_sensitive and ``extraction``.
    """
    e = F.col("extraction")
    p1, p2, p3, p4 = (e[p] for p in schemas.PILLARS)
    meta = e["meta_analysis"]
    behavior = F.coalesce(p2["purchase_context"]["behavior"], p2["lifestyle"]["family"])

    def number(col: Column) -> Column:
        return F.coalesce(col, F.lit(0.0))

    return df.select(
        F.col("id").cast("string").alias("note_id"),
        "timestamp", "store_id", "advisor_id",
        F.coalesce("tier", F.lit(1)).alias("tier_used"),
        number(F.col("processing_time_ms")).alias("processing_time_ms"),
        number(F.col("cost_usd")).alias("cost_usd"),
        number(meta["confidence_score"]).alias("confidence_score"),
        number(meta["quality_score"]).alias("quality_score"),
        F.coalesce("points_awarded", F.lit(0)).alias("points_awarded"),
        m.list_or_empty(e["tags"]).alias("tags"),
        p4["budget_potential"].alias("budget_range"),
        behavior.alias("client_status"),
        p4["urgency"].alias("urgency"),
        (F.coalesce("contains_sensitive", F.lit(False)) | (F.size(m.list_or_empty(meta["risk_flags"])) > 0)).alias("has_risk_flag"),
        F.coalesce(F.lower(behavior).contains("vic"), F.lit(False)).alias("is_vic"),
        m.list_or_empty(p1["categories"]).alias("pilier_1_category"),
        m.list_or_empty(p1["preferences"]["styles"]).alias("pilier_1_style"),
        m.list_or_empty(p1["preferences"]["colors"]).alias("pilier_1_color"),
        m.list_or_empty(p1["preferences"]["materials"]).alias("pilier_1_material"),
        m.list_or_empty(p1["produits_mentionnes"]).alias("pilier_1_brand"),
        p2["purchase_context"]["type"].alias("pilier_2_purchase_context"),
        p2["profession"]["sector"].alias("pilier_2_socio_pro"),
        m.list_or_empty(p2["lifestyle"]["passions"]).alias("pilier_2_interests"),
        behavior.alias("pilier_2_vic_status"),
        p3["occasion"].alias("pilier_3_occasion"),
        F.concat(m.list_or_empty(p3["allergies"]["food"]), m.list_or_empty(p3["allergies"]["contact"])).alias("pilier_3_allergies"),
        m.list_or_empty(p3["values"]).alias("pilier_3_preferences"),
        p4["next_best_action"]["description"].alias("pilier_4_nba"),
        p4["urgency"].alias("pilier_4_urgency"),
        p4["budget_potential"].alias("pilier_4_budget_potential"),
        F.length(F.coalesce("original_text", F.lit(""))).alias("original_text_length"),
        F.length(F.coalesce("processed_text", F.lit(""))).alias("processed_text_length"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
    )


def append_warehouse(rows: DataFrame, path: str) -> None:
    """Append partitioned by day, clustered by store and advisor within files.

    Days are brought together as far as their measured size allows: adaptive execution
    splits a day that holds much of the data over several writers.
    """
    dated = rows.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "date").sortWithinPartitions("date", "store_id", "advisor_id").write.mode("append").partitionBy(
        "date"
    ).parquet(path)


def quarantine_rows(bad: DataFrame, now: Column | None = None) -> DataFrame:
    """Failure records; absent columns get their defaults."""
    defaults = {
        "note_id": F.lit(None), "note_text": F.lit(None), "error": F.lit("unknown"), "tier_attempted": F.lit("unknown"),
        "retry_count": F.lit(0), "timestamp": now if now is not None else F.current_timestamp(),
        "requires_manual_review": F.lit(True), "metadata": F.lit("{}"),
    }
    target = schemas.parse(schemas.QUARANTINE)
    return bad.select(
        *[(F.col(f.name) if f.name in bad.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in target.fields]
    )


def write_quarantine(bad: DataFrame, path: str, now: Column | None = None) -> None:
    """Append JSON lines below one folder per date."""
    rows = quarantine_rows(bad, now)
    rows.withColumn("date", F.to_date(F.col("timestamp").cast("timestamp"))).write.mode("append").partitionBy("date").json(path)


def export_quarantine(rows: DataFrame, path: str) -> None:
    rows.select(*QUARANTINE_EXPORT).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_stats(df: DataFrame, path: str, now: Column | None = None) -> None:
    """A one-row statistics frame with its export time, in one file."""
    stamped = df.withColumn("exported_at", (now if now is not None else F.current_timestamp()).cast("string"))
    stamped.coalesce(1).write.mode("overwrite").json(path)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += leaf_paths(f.dataType, path) if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def flatten_metrics(df: DataFrame) -> DataFrame:
    """(metric, value) rows of nested columns: dotted paths, arrays joined with '; '."""
    cells = []
    for path, kind in leaf_paths(df.schema):
        value = F.col(path)
        if isinstance(kind, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), "; ")
        elif isinstance(kind, T.MapType):
            value = F.to_json(value)
        cells.append(F.struct(F.lit(path).alias("metric"), value.cast("string").alias("value")))
    return df.select(F.inline(F.array(*cells)))


def append_cost_log(costs: DataFrame, path: str, model: str, now: Column | None = None) -> None:
    """Append timestamp, model, calls, tokens and cost of the total row of a cost roll-up."""
    costs.where("step IS NULL").select(
        (now if now is not None else F.current_timestamp()).cast("string").alias("timestamp"),
        F.lit(model).alias("model"),
        F.col("calls").alias("call_count"), "input_tokens", "output_tokens",
        F.round("cost_usd", 6).alias("total_cost_usd"),
    ).coalesce(1).write.mode("append").option("header", "true").csv(path)


def export_products(df: DataFrame, path: str) -> None:
    df.select(*PRODUCT_EXPORT).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def validation_template(df: DataFrame, columns: Sequence[str] = ("client_id", "ID", "language", "Language")) -> DataFrame:
    """Id, language, text and tags with empty columns for the labeller."""
    ids = [c for c in columns[:2] if c in df.columns][:1]
    langs = [c for c in columns[2:] if c in df.columns][:1]
    tags = next((c for c in ("tags", "tags_extracted") if c in df.columns), None)
    llm = F.lit("")
    if tags:
        listed = isinstance(df.schema[tags].dataType, T.ArrayType)
        llm = F.array_join(tags, ", ") if listed else F.col(tags)
    return df.select(*ids, *langs, "Transcription", llm.alias("llm_tags"), F.lit("").alias("manual_tags"), F.lit("").alias("notes"))
