"""Dashboard aggregates. Each is one pass with map-side combine over columns parsed once.

``notes`` below means the output of :func:`parse_notes` unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import lists, payload, privacy, scalars
from notewell.functions import matching as m
from notewell.operators import joins, paging, windows
from notewell.session import cut_lineage
from notewell.sources import writers


def parse_notes(notes: DataFrame, column: str = "analysis_json") -> DataFrame:
    """Parse the payload once into the columns that the aggregates read."""
    p = F.col("__p")
    routing, rgpd = p["routing"], p["rgpd"]
    return (
        notes.withColumn("__p", payload.parse_analysis(F.col(column)))
        .withColumns(
            {
                "parsed": p.isNotNull(),
                "tier": scalars.known_tier(routing["tier"]),
                "confidence": routing["confidence"],
                "processing_time_ms": p["processing_time_ms"],
                "from_cache": F.coalesce(p["from_cache"], F.lit(False)) | F.coalesce(p["cache_hit"], F.lit(False)),
                "contains_sensitive": F.coalesce(rgpd["contains_sensitive"], F.lit(False)),
                "categories_detected": m.list_or_empty(rgpd["categories_detected"]),
                "extraction": p["extraction"],
                "quality_score": p["quality_score"],
            }
        )
        .drop("__p", column)
    )


def tier_cost(tier: Column, costs: Mapping[int, float]) -> Column:
    out = None
    for key, value in costs.items():
        out = F.when(tier == key, F.lit(float(value))) if out is None else out.when(tier == key, F.lit(float(value)))
    return out.otherwise(F.lit(float(costs[1])))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def tier_counts(condition: Column | None = None) -> list[Column]:
    cond = F.lit(True) if condition is None else condition
    return [F.count_if(cond & (F.col("tier") == t)).alias(f"tier{t}") for t in (1, 2, 3)]


def pipeline_stats(notes: DataFrame) -> DataFrame:
    total = F.count("*")
    return notes.agg(
        total.alias("total_processed"),
        F.when(total > 0, F.lit(100.0)).otherwise(0.0).alias("success_rate"),
        F.count_if(~F.col("parsed")).alias("parse_failures"),
        *tier_counts(F.col("parsed")),
        F.round(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)), 1).alias("avg_processing_time_ms"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        pct(F.count_if("from_cache"), total).alias("cache_hit_rate"),
    )


def cost_stats(notes: DataFrame, costs: Mapping[int, float] = fv.DASHBOARD_TIER_COSTS) -> DataFrame:
    cost = tier_cost(F.col("tier"), costs)
    total = F.coalesce(F.sum(cost), F.lit(0.0))
    return notes.agg(
        F.round(total, 4).alias("total_cost_eur"),
        F.round(F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0), 6).alias("cost_per_note"),
        *[F.round(F.coalesce(F.sum(F.when(F.col("tier") == t, cost)), F.lit(0.0)), 4).alias(f"tier{t}_cost") for t in (1, 2, 3)],
        F.round(total * 30, 4).alias("estimated_monthly"),
    )


def overview(notes: DataFrame) -> DataFrame:
    total = F.count("*")
    sensitive = F.count_if("contains_sensitive")
    return notes.agg(
        total.alias("total_notes"),
        F.round(F.when(total > 0, F.coalesce(F.sum("points_awarded"), F.lit(0)) / total / 15 * 100).otherwise(0.0), 1).alias("avg_quality"),
        *tier_counts(),
        sensitive.alias("sensitive_count"),
        pct(sensitive, total).alias("sensitive_rate"),
        F.round(F.coalesce(F.sum(tier_cost(F.col("tier"), fv.DASHBOARD_TIER_COSTS)), F.lit(0.0)), 3).alias("total_cost"),
    )


def rgpd_categories(notes: DataFrame) -> DataFrame:
    return (
        notes.where("contains_sensitive")
        .select(F.explode("categories_detected").alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("count"))
    )


def rgpd_report(notes: DataFrame) -> DataFrame:
    total, hits = F.count("*"), F.count_if("contains_sensitive")
    return notes.agg(
        total.alias("total_notes"),
        hits.alias("notes_with_sensitive_data"),
        F.when(total > 0, hits / total * 100).otherwise(0.0).alias("percentage_sensitive"),
        F.when(hits == 0, "COMPLIANT").otherwise("REQUIRES_REVIEW").alias("compliance_status"),
    )


# --- feedback -------------------------------------------------------------------------------

def feedback_quality(feedback: DataFrame, predicted: str = "predicted_tags", corrected: str = "corrected_tags") -> DataFrame:
    total = F.count("*")
    return feedback.agg(
        F.round(F.avg(lists.jaccard(F.col(predicted), F.col(corrected))) * 100, 1).alias("accuracy_rate"),
        pct(F.count_if(lists.same_set(F.col(predicted), F.col(corrected))), total).alias("exact_match_rate"),
        F.round(F.sum(F.coalesce("rating", F.lit(0))) / total, 2).alias("avg_rating"),
        total.alias("total_feedback"),
    )


def top_corrections(feedback: DataFrame, n: int = 5, column: str = "corrections_json") -> DataFrame:
    """Most frequent "field ? value" corrections of a JSON map column."""
    pairs = feedback.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))
    counted = pairs.groupBy(F.concat_ws(" ? ", "field", "value").alias("correction")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "correction").limit(n)


# --- daily series -----------------------------------------------------------------------------

def alert_list(avg_time: Column, success: Column, cost: Column, accuracy: Column, feedback: Column) -> Column:
    """Which of the four alert rules fire."""
    return F.array_compact(
        F.array(
            F.when(avg_time > 5000, F.concat(F.lit("ALERT: High processing time ("), avg_time.cast("string"), F.lit("ms)"))),
            F.when(success < 95, F.concat(F.lit("ALERT: Low success rate ("), success.cast("string"), F.lit("%)"))),
            F.when(cost > 10, F.concat(F.lit("ALERT: High daily cost ("), F.format_string("%.2f", cost), F.lit(")"))),
            F.when(
                (feedback >= fv.MIN_FEEDBACK_FOR_ALERT) & (accuracy < 80),
                F.concat(F.lit("ALERT: Low accuracy ("), accuracy.cast("string"), F.lit("%)")),
            ),
        )
    )


def daily_series(notes: DataFrame, feedback: DataFrame, start: str, end: str,
                 costs: Mapping[int, float] = fv.DASHBOARD_TIER_COSTS) -> DataFrame:
    """One row per calendar day. Both facts are reduced to days before they meet the calendar."""
    spark = notes.sparkSession
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("date"))
    in_range = lambda c: (F.to_date(c) >= lo) & (F.to_date(c) <= hi)
    by_note = notes.where(in_range("timestamp")).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("notes_processed"),
        F.count_if("parsed").alias("__parsed"),
        F.avg("processing_time_ms").alias("__time"),
        F.sum(tier_cost(F.col("tier"), costs)).alias("__cost"),
        *tier_counts(),
    )
    by_feedback = feedback.where(in_range("created_at")).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("feedback_count"),
        F.avg(lists.jaccard(F.col("predicted_tags"), F.col("corrected_tags"))).alias("__overlap"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("notes_processed", "feedback_count", "tier1", "tier2", "tier3")}
    out = spine.join(by_note, "date", "left").join(by_feedback, "date", "left").withColumns(zero)
    out = out.withColumns(
        {
            "success_rate": pct(F.col("__parsed"), F.col("notes_processed")),
            "avg_processing_time_ms": F.round(F.coalesce("__time", F.lit(0.0)), 1),
            "cost_eur": F.round(F.coalesce("__cost", F.lit(0.0)), 4),
            "accuracy_rate": F.round(F.col("__overlap") * 100, 1),
        }
    )
    alerts = alert_list(*[F.col(c) for c in ("avg_processing_time_ms", "success_rate", "cost_eur", "accuracy_rate", "feedback_count")])
    return out.withColumn("alerts", alerts).withColumn("alerts_count", F.size("alerts")).drop("__parsed", "__time", "__cost", "__overlap")


def series_totals(series: DataFrame) -> DataFrame:
    return series.agg(
        F.sum("notes_processed").alias("notes_processed"),
        F.round(F.sum("cost_eur"), 4).alias("cost_eur"),
        F.sum("alerts_count").alias("alerts_count"),
        F.round(F.avg("avg_processing_time_ms"), 1).alias("avg_processing_time_ms"),
    )


def half_trend(series: DataFrame, measures: Sequence[str], start: str, days: int) -> DataFrame:
    """Change of each measure's sum from the first half of a dense daily series to the second."""
    half = days // 2
    late = F.datediff("date", F.lit(start).cast("date")) >= half
    sums = series.agg(
        *[F.coalesce(F.sum(F.when(~late, F.col(c))), F.lit(0.0)).alias(f"__{c}_1") for c in measures],
        *[F.coalesce(F.sum(F.when(late, F.col(c))), F.lit(0.0)).alias(f"__{c}_2") for c in measures],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"__{c}_1").cast("double").alias("first_half"), F.col(f"__{c}_2").cast("double").alias("second_half")) for c in measures])
    change = F.when(F.col("first_half") == 0, 0.0).otherwise((F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100)
    return sums.select(F.inline(rows)).select(
        "measure",
        F.round("first_half", 4).alias("first_half"),
        F.round("second_half", 4).alias("second_half"),
        F.round(F.abs(change), 1).alias("change_pct"),
        (change >= 0).alias("is_positive"),
        (F.abs(change) < 1).alias("is_neutral"),
    )


# --- warehouse ----------------------------------------------------------------------------------

def daily_metrics(warehouse: DataFrame, end=None, days: int = 30) -> DataFrame:
    """By day and store; the filter on the partition column prunes files."""
    if end is not None:
        warehouse = warehouse.where(F.col("timestamp") >= F.lit(end) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return warehouse.groupBy(F.to_date("timestamp").alias("date"), "store_id").agg(
        F.count("*").alias("note_count"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg("quality_score").alias("avg_quality"),
        F.avg("processing_time_ms").alias("avg_processing_ms"),
        F.sum("cost_usd").alias("total_cost"),
        F.sum("points_awarded").alias("total_points"),
        F.count_if("is_vic").alias("vic_count"),
        *[F.count_if(F.col("tier_used") == t).alias(f"tier{t}_count") for t in (1, 2, 3)],
        F.count_if("cache_hit").alias("cache_hits"),
    )


def advisor_metrics(warehouse: DataFrame, end=None, days: int = 30) -> DataFrame:
    if end is not None:
        warehouse = warehouse.where(F.col("timestamp") >= F.lit(end) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return warehouse.groupBy(F.to_date("timestamp").alias("date"), "advisor_id", "store_id").agg(
        F.count("*").alias("notes_count"),
        F.sum("points_awarded").alias("total_points"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.count_if("is_vic").alias("vic_served"),
    )


def refresh_daily(spark: SparkSession, warehouse: str, target: str, days: Sequence, aggregate: Callable[[DataFrame], DataFrame] = daily_metrics) -> None:
    """Recompute the stored daily aggregates of ``days`` from the warehouse's folders of these days; other days are neither read nor written."""
    if days:
        rows = spark.read.parquet(warehouse).where(F.col("date").isin(list(days)))
        aggregate(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)


def append_and_refresh(rows: DataFrame, warehouse: str, targets: dict[str, Callable[[DataFrame], DataFrame]]) -> list:
    """Append warehouse rows and refresh the aggregates of the days they touch; the days.

    ``rows`` are written once before, so that both uses see the same. An aggregate of a day is
    recomputed whole, so a refresh can be repeated.
    """
    staged = cut_lineage(rows, "appended")
    days = sorted(r["day"] for r in staged.select(F.to_date("timestamp").alias("day")).where("day IS NOT NULL").distinct().collect())  # days of the calendar
    writers.append_warehouse(staged, warehouse)
    for target, aggregate in targets.items():
        refresh_daily(rows.sparkSession, warehouse, target, days, aggregate)
    return days


# --- products, people -------------------------------------------------------------------------------

def product_categories(products: DataFrame) -> DataFrame:
    return products.where("category1 IS NOT NULL").groupBy(F.col("category1").alias("category")).agg(F.count("*").alias("count"))


def product_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_products"),
        F.round(F.avg("price_eur"), 2).alias("avg_price"),
        F.min("price_eur").alias("min_price"),
        F.max("price_eur").alias("max_price"),
        F.count_if("is_discount").alias("discount_count"),
        F.count_if(F.col("stock") > 0).alias("in_stock_count"),
        F.count_if("rag_indexed").alias("indexed_count"),
    )


def leaderboard(users: DataFrame, notes: DataFrame, n: int | None = None) -> DataFrame:
    """Advisors by score with their note counts; ``n`` cuts the board."""
    board = joins.user_inventory(users, notes).where("role = 'advisor'").select(
        "id", F.coalesce("full_name", F.substring_index("email", "@", 1)).alias("name"), F.col("notes_count").alias("notes"), "score"
    )
    ordered = board.orderBy(F.col("score").desc(), "id")
    return ordered if n is None else ordered.limit(n)


def advisor_stats(notes: DataFrame) -> DataFrame:
    """Per advisor: notes, mean non-null quality, recent notes counted up to ten."""
    return notes.groupBy("advisor_id").agg(
        F.count("*").alias("total_notes"),
        F.round(F.avg("quality_score"), 4).alias("avg_quality"),
        F.least(F.count("*"), F.lit(10)).alias("recent_notes"),
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


# --- extraction quality --------------------------------------------------------------------------------

def extraction_summary(results: DataFrame, tags: str = "tags", confidence: str = "confidence", cached: str = "from_cache") -> DataFrame:
    n = F.size(m.list_or_empty(F.col(tags)))
    return results.agg(
        F.count("*").alias("total_processed"),
        F.sum(n).alias("total_tags"),
        F.round(F.avg(n), 4).alias("avg_tags_per_note"),
        F.round(F.avg(confidence), 4).alias("avg_confidence"),
        F.count_if(cached).alias("from_cache"),
    )


def unique_tags(results: DataFrame, tags: str = "tags") -> DataFrame:
    return results.select(F.explode(tags).alias("tag")).agg(F.count_distinct("tag").alias("unique_tags_used"))


def tags_by_category(results: DataFrame, core: DataFrame, tags: str = "tags") -> DataFrame:
    """Occurrences per taxonomy category; unlisted tags count as ``other``."""
    counted = paging.tag_counts(results, tags)
    return counted.join(core.select("tag", "category"), "tag", "left").groupBy(
        F.coalesce("category", F.lit("other")).alias("category")
    ).agg(F.sum("count").alias("count"))


def run_totals(results: DataFrame, name: str) -> DataFrame:
    n = F.size(m.list_or_empty(F.col("tags")))
    return results.agg(
        F.lit(name).alias("run"),
        F.count("*").alias("notes"),
        F.sum(n).alias("total_tags"),
        F.avg(n).alias("avg_tags"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("compression_ratio").alias("compression_ratio"),
        F.count_if("contains_sensitive").alias("sensitive"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs side by side with their differences, from one union of one-row aggregates."""
    both = run_totals(a, "a").unionAll(run_totals(b, "b"))

    def of(run: str, column: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col(column)))

    tags_a, tags_b = of("a", "total_tags"), of("b", "total_tags")
    return both.agg(
        of("a", "notes").alias("notes_a"),
        of("b", "notes").alias("notes_b"),
        tags_a.alias("tags_a"),
        tags_b.alias("tags_b"),
        F.round(of("a", "avg_tags"), 2).alias("avg_tags_a"),
        F.round(of("b", "avg_tags"), 2).alias("avg_tags_b"),
        F.round(of("a", "avg_confidence"), 3).alias("avg_confidence_a"),
        F.round(of("b", "avg_confidence"), 3).alias("avg_confidence_b"),
        F.round(of("b", "compression_ratio"), 3).alias("compression_ratio_b"),
        of("b", "sensitive").alias("sensitive_b"),
        (tags_b - tags_a).alias("tag_increase"),
        F.when(tags_a > 0, F.round((tags_b / tags_a - 1) * 100, 1)).alias("tag_increase_pct"),
        (of("b", "notes") - of("a", "notes")).alias("coverage_increase"),
        F.round((of("b", "avg_confidence") - of("a", "avg_confidence")) * 100, 1).alias("confidence_delta_pct"),
    )


def tag_audit(results: DataFrame, core: DataFrame, min_frequency: int = 5, tags: str = "tags") -> DataFrame:
    """(tag, count, known, advice): frequent unknown tags are to be added, rare ones mapped."""
    counted = paging.tag_counts(results, tags)
    listed = core.select("tag").distinct().withColumn("__known", F.lit(True))
    known = F.coalesce("__known", F.lit(False))
    return counted.join(listed, "tag", "left").select(
        "tag", "count", known.alias("known"),
        F.when(known, "keep").when(F.col("count") >= min_frequency, "add").otherwise("map").alias("advice"),
    )


def quality_audit(results: DataFrame) -> DataFrame:
    """By tier: share of notes, mean time, zero-confidence notes, match rate and mean score, notes without categories.

    ``results``: tier, processing_time_ms, confidence, match_scores (array), categories (array).
    """
    matched = F.size(m.list_or_empty(F.col("match_scores").cast("array<string>"))) > 0
    score_sum = F.aggregate(F.coalesce("match_scores", F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + v)
    per_tier = results.groupBy("tier").agg(
        F.count("*").alias("notes"),
        F.round(F.avg("processing_time_ms"), 2).alias("avg_time_ms"),
        F.count_if(F.col("confidence") == 0).alias("zero_confidence"),
        F.count_if(matched).alias("notes_with_matches"),
        F.sum(score_sum).alias("__score"),
        F.sum(F.when(matched, F.size("match_scores")).otherwise(0)).alias("__scores"),
        F.count_if(F.size(m.list_or_empty(F.col("categories"))) == 0).alias("no_categories"),
    )
    w = windows.Window.partitionBy(F.lit(1))  # at most a handful of tiers
    return per_tier.select(
        "tier", "notes",
        F.round(F.col("notes") / F.sum("notes").over(w) * 100, 1).alias("share_pct"),
        "avg_time_ms", "zero_confidence", "notes_with_matches",
        F.round(F.when(F.col("__scores") > 0, F.col("__score") / F.col("__scores")).otherwise(0.0), 4).alias("avg_match_score"),
        "no_categories",
    )


def invalid_tags(results: DataFrame, core: DataFrame, tags: str = "categories") -> DataFrame:
    """(total_tags, invalid_tags) against the taxonomy and its dynamic prefixes."""
    flagged = joins.known_tags(paging.tag_counts(results, tags), core.select("tag"))
    return flagged.agg(
        F.sum("count").alias("total_tags"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("count"))), F.lit(0)).alias("invalid_tags")
    )


def set_prf(df: DataFrame, expected: str, actual: str, digits: int = 4) -> DataFrame:
    """Micro precision, recall and F1 over rows of tag sets."""
    counts = df.select(lists.set_counts(F.col(expected), F.col(actual)).alias("c"))
    sums = counts.agg(*[F.sum(f"c.{n}").alias(n) for n in ("tp", "fp", "fn")])
    prf = lists.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("tp", "fp", "fn", *[F.round(c, digits).alias(n) for n, c in prf.items()])


def within(expected: Column, actual: Column, tolerance: float) -> Column:
    """Numeric match; an expected 0 means unlimited (nothing or more than 100000)."""
    got = F.coalesce(actual, F.lit(0))
    return F.when(expected == 0, (got == 0) | (got > 100000)).otherwise((got != 0) & (F.abs(got - expected) < tolerance))


def text_match(expected: Column, actual: Column) -> Column:
    return F.contains(F.lower(F.coalesce(actual, F.lit(""))), F.lower(expected))


def field_accuracy(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(field, correct, total, accuracy); ``checks`` maps a field to (has an expectation, is right)."""
    sums = df.agg(
        *[F.count_if(has & F.coalesce(ok, F.lit(False))).alias(f"__{n}_c") for n, (has, ok) in checks.items()],
        *[F.count_if(has).alias(f"__{n}_t") for n, (has, _) in checks.items()],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"__{n}_c").alias("correct"), F.col(f"__{n}_t").alias("total")) for n in checks])
    return sums.select(F.inline(rows)).withColumn(
        "accuracy", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0), 4)
    )


def binary_confusion(df: DataFrame, predicted: Column, truth: Column, digits: int = 4) -> DataFrame:
    sums = df.agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"),
    )
    prf = lists.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("tp", "fp", "fn", "tn", *[F.round(c, digits).alias(n) for n, c in prf.items()])


def coverage(results: DataFrame) -> DataFrame:
    """Shares of notes with each field. ``results``: budget, status, allergies, diet, gender, relation, confidence."""
    total = F.count("*")

    def share(cond: Column, name: str) -> Column:
        return pct(F.count_if(cond), total).alias(name)

    return results.agg(
        total.alias("total"),
        share(F.coalesce(F.col("budget") != 0, F.lit(False)), "budget_pct"),
        share(F.coalesce(F.col("status") != "Unknown", F.lit(False)), "status_pct"),
        share(F.size("allergies") > 0, "allergies_pct"),
        share(F.size("diet") > 0, "diet_pct"),
        share(F.col("gender").isNotNull(), "gender_pct"),
        F.count_if(F.col("relation") == "Gift").alias("gifts"),
        F.count_if(F.col("relation") == "Self").alias("self_purchases"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
    )


# --- runs -------------------------------------------------------------------------------------------------

def routing_stats(decisions: DataFrame, costs: Mapping[int, float] = fv.TIER_COSTS) -> DataFrame:
    total = F.count("*")
    n = {t: F.count_if(F.col("tier") == t) for t in (1, 2, 3)}
    cost = sum((n[t] * F.lit(costs[t]) for t in (1, 2, 3)), F.lit(0.0))
    return decisions.agg(
        total.alias("total_routed"),
        *[n[t].alias(f"tier{t}") for t in (1, 2, 3)],
        *[pct(n[t], total).alias(f"tier{t}_pct") for t in (1, 2, 3)],
        F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 1).alias("avg_score"),
        pct(n[1] + n[2], total).alias("free_processing_pct"),
        F.round(cost, 6).alias("estimated_cost_usd"),
        F.round(total * F.lit(costs[2]) - cost, 6).alias("savings_vs_all_tier2"),
    )


def run_metrics(results: DataFrame, seconds: float) -> DataFrame:
    """``results``: tier, success, cached, processing_time_ms."""
    total = F.count("*")
    processed = F.greatest(total, F.lit(1))

    def share(cond: Column, name: str) -> Column:
        return F.round(F.count_if(cond) / processed * 100, 1).alias(name)

    return results.agg(
        total.alias("notes_processed"),
        F.count_if("success").alias("notes_success"),
        F.count_if(~F.col("success")).alias("notes_failed"),
        F.round(total / F.greatest(F.lit(1.0), F.lit(float(seconds))), 2).alias("throughput_notes_per_sec"),
        F.round(F.sum("processing_time_ms") / processed, 2).alias("avg_processing_time_ms"),
        share(F.col("success"), "success_rate"),
        share(F.col("cached"), "cache_hit_rate"),
        *[share(F.col("tier") == t, f"tier{t}_pct") for t in (1, 2, 3)],
    )


def errors_by_type(results: DataFrame, error: str = "error") -> DataFrame:
    return results.where(F.col(error).isNotNull()).groupBy(F.col(error).alias("error")).agg(F.count("*").alias("count"))


def latency_by_profile(results: DataFrame, last: int | None = None, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Per profile: count, p50, p95 (nearest rank), mean, notes without tags, fallback share.

    ``results``: profile, processing_time_ms, tags_count, fallback_used. ``last`` keeps the
    newest latencies of each profile for the percentiles and the mean.
    """
    recent = results if last is None else windows.last_n(results, ["profile"], ts, id_col, last)
    ranks = windows.nearest_rank(recent, ["profile"], "processing_time_ms", (50, 95))
    means = recent.groupBy("profile").agg(F.avg("processing_time_ms").alias("__mean"))
    counts = results.groupBy("profile").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("tags_count") == 0).alias("notes_without_tags"),
        pct(F.count_if("fallback_used"), F.count("*"), 2).alias("fallback_rate_pct"),
    )
    return counts.join(ranks, "profile", "left").join(means, "profile", "left").select(
        "profile", "count",
        F.round(F.coalesce("p50", F.lit(0.0)), 2).alias("p50_ms"),
        F.round(F.coalesce("p95", F.lit(0.0)), 2).alias("p95_ms"),
        F.round(F.coalesce("__mean", F.lit(0.0)), 2).alias("avg_ms"),
        "notes_without_tags", "fallback_rate_pct",
    )


def stage_averages(results: DataFrame, timings: str = "stage_timings_ms") -> DataFrame:
    """Total time of each stage over the number of notes of the profile."""
    # the timing map is summed stage by stage next to one row per note that carries the count
    parts = results.select("profile", F.explode(F.map_concat(F.coalesce(timings, F.create_map().cast("map<string,double>")), F.create_map(F.lit("__notes"), F.lit(1.0)))).alias("stage", "ms"))
    sums = parts.groupBy("profile", "stage").agg(F.sum("ms").alias("total"))
    notes = sums.where("stage = '__notes'").select("profile", F.col("total").alias("notes"))
    return sums.where("stage <> '__notes'").join(notes, "profile").select(
        "profile", "stage", F.round(F.col("total") / F.col("notes"), 2).alias("avg_ms")
    )


def token_cost(calls: DataFrame, prices: Mapping[str, tuple[float, float]] = fv.MODEL_PRICES) -> DataFrame:
    """Calls, tokens and cost per step with a total row (``step`` null); unknown models use the default price."""
    def price(index: int) -> Column:
        out = None
        for model, pair in prices.items():
            out = F.when(F.col("model") == model, F.lit(pair[index])) if out is None else out.when(F.col("model") == model, F.lit(pair[index]))
        return out.otherwise(F.lit(prices[fv.DEFAULT_PRICE_MODEL][index]))

    return calls.rollup("step").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)).alias("cost_usd"),
    )


def benchmark_report(results: DataFrame, total_notes: Column, seconds: float) -> DataFrame:
    """``results``: successful notes with tier, confidence and cost."""
    ok = F.count("*")
    return results.agg(
        F.max(total_notes).alias("total_notes"),
        ok.alias("successful"),
        (F.max(total_notes) - ok).alias("failed"),
        F.round(ok / F.lit(float(seconds)), 2).alias("notes_per_second"),
        F.round(F.lit(float(seconds)) / F.max(total_notes), 3).alias("seconds_per_note"),
        F.round(F.sum("cost"), 4).alias("total_cost_eur"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        *[pct(F.count_if(F.col("tier") == t), ok).alias(f"tier{t}_pct") for t in (1, 2, 3)],
    )


# --- manager view --------------------------------------------------------------------------------------------

def window_kpis(rows: DataFrame, end, days: int) -> DataFrame:
    """Window and preceding window in one pass. ``rows``: timestamp, is_vip, urgency_level, confidence, tier."""
    hi = F.lit(end)
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    ts = F.col("timestamp")
    now = (ts >= hi - span) & (ts <= hi)
    before = (ts >= hi - span - span) & (ts < hi - span)

    def kpis(cond: Column, suffix: str) -> list[Column]:
        n = F.count_if(cond)
        return [
            n.alias(f"total{suffix}"),
            F.round(F.when(n > 0, F.count_if(cond & F.col("is_vip")) / n * 100).otherwise(0.0), 4).alias(f"vip_share{suffix}"),
            F.count_if(cond & (F.col("urgency_level") == 3)).alias(f"urgent_count{suffix}"),
            F.round(F.when(n > 0, F.sum(F.when(cond, F.coalesce("confidence", F.lit(0.0)))) / n * 100).otherwise(0.0), 4).alias(f"avg_confidence_pct{suffix}"),
            F.count_if(cond & (F.col("tier") == 3)).alias(f"tier3_count{suffix}"),
        ]

    out = rows.where((ts >= hi - span - span) & (ts <= hi)).agg(*kpis(now, ""), *kpis(before, "_prev"))
    return out.withColumn("total_delta", F.col("total") - F.col("total_prev"))


def advisor_drilldown(rows: DataFrame) -> DataFrame:
    """``rows``: advisor_name, advisor_store, tier, urgency_level, is_vip, budget_value, confidence, timestamp."""
    tier3, urgent, vip = F.count_if(F.col("tier") == 3), F.count_if(F.col("urgency_level") == 3), F.count_if("is_vip")
    return rows.groupBy("advisor_name", "advisor_store").agg(
        F.count("*").alias("notes"),
        tier3.alias("tier3"), urgent.alias("urgent"), vip.alias("vip"),
        F.round(F.sum(F.coalesce("budget_value", F.lit(0.0))), 2).alias("budget_total"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("avg_confidence"),
        F.max("timestamp").alias("latest_timestamp"),
        (tier3 * 18 + urgent * 15 + vip * 8 + F.count("*") * 2).alias("priority_index"),
    )


def action_summary(opportunities: DataFrame) -> DataFrame:
    done = F.col("action_status") == "done"
    return opportunities.agg(
        F.count_if(done).alias("done"),
        F.count_if(~done).alias("open"),
        F.count_if(~done & (F.col("action_type") == "call")).alias("call"),
        F.count_if(~done & (F.col("action_type") == "schedule")).alias("schedule"),
        F.round(F.sum(F.coalesce("budget_value", F.lit(0.0))), 2).alias("budget_total"),
    )


def health(stats: DataFrame) -> DataFrame:
    """Health score of one row with avg_processing_time_ms, success_rate, total_cost_eur, accuracy_rate, total_feedback."""
    names = ("avg_processing_time_ms", "success_rate", "total_cost_eur", "accuracy_rate", "total_feedback")
    out = stats.withColumn("alerts", alert_list(*[F.col(n) for n in names]))
    score = (
        F.lit(100.0)
        - F.size("alerts") * 10
        - F.when(F.col("success_rate") < 99, (100 - F.col("success_rate")) * 2).otherwise(0.0)
        - F.when((F.col("total_feedback") >= fv.MIN_FEEDBACK_FOR_ALERT) & (F.col("accuracy_rate") < 90), 100 - F.col("accuracy_rate")).otherwise(0.0)
    )
    out = out.withColumn("health_score", F.greatest(F.lit(0.0), score))
    return out.withColumn(
        "health_status", F.when(F.col("health_score") > 80, "healthy").when(F.col("health_score") > 60, "warning").otherwise("critical")
    ).withColumn("alerts_count", F.size("alerts"))


def system_metrics(notes: DataFrame, feedback: DataFrame, costs: Mapping[int, float] = fv.DASHBOARD_TIER_COSTS) -> DataFrame:
    """Processing, cost and quality in one row. The two facts are aggregated apart and unioned, so nothing is joined."""
    cost = tier_cost(F.col("tier"), costs)
    a = notes.agg(
        F.count("*").alias("total_processed"),
        F.round(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)), 1).alias("avg_processing_time_ms"),
        pct(F.count_if("parsed"), F.count("*")).alias("success_rate"),
        F.round(F.sum(cost), 4).alias("total_cost_eur"),
    )
    b = feedback_quality(feedback).select("accuracy_rate", "avg_rating", "total_feedback")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- clusters ---------------------------------------------------------------------------------------------------

def cluster_profile(df: DataFrame, cluster: str, tags: str, budget: str, confidence: str, top: int = 5) -> DataFrame:
    """Size, most frequent tags, modal budget and mean confidence per cluster."""
    budgets = df.groupBy(cluster, budget).agg(F.count("*").alias("__n"))
    modal = budgets.where(F.col(budget).isNotNull()).groupBy(cluster).agg(
        F.min_by(budget, F.struct(-F.col("__n"), F.col(budget))).alias("dominant_budget")
    )
    counted = df.select(cluster, F.explode(tags).alias("__tag")).groupBy(cluster, "__tag").agg(F.count("*").alias("__n"))
    best = windows.top_n_per_group(counted, [cluster], [F.col("__n").desc(), F.col("__tag")], top)
    # at most `top` rows per cluster reach the list
    top_list = best.groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__tag").alias("tag")))).alias("__top")
    ).select(cluster, F.transform("__top", lambda t: t["tag"]).alias("top_tags"))
    base = df.groupBy(cluster).agg(F.count("*").alias("size"), F.round(F.avg(confidence), 4).alias("avg_confidence"))
    return base.join(modal, cluster, "left").join(top_list, cluster, "left").withColumn(
        "dominant_budget", F.coalesce(F.col("dominant_budget").cast("string"), F.lit("N/A"))
    )


def segment_summary(df: DataFrame, segment: str = "segment") -> DataFrame:
    """``df``: segment, budget_value, tier."""
    return df.groupBy(segment).agg(
        F.count("*").alias("count"),
        F.round(F.avg("budget_value"), 2).alias("avg_budget"),
        pct(F.count_if(F.col("tier") == 3), F.count("*")).alias("tier3_share_pct"),
    )


def segment_notes(rows: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """Segments of notes by tier, urgency, VIP flag, budget and confidence, with their summary."""
    from notewell.operators.vectors import cluster

    features = F.array(
        F.col("tier").cast("double"), F.col("urgency_level").cast("double"), F.col("is_vip").cast("double"),
        F.log1p(F.coalesce("budget_value", F.lit(0.0))), F.coalesce("confidence", F.lit(0.0)).cast("double"),
    )
    return segment_summary(cluster(rows.withColumn("__f", features), k, "__f", "segment", seed))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max, count), all features from one scan; std is 0 for one value."""
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        df.select(F.inline(values))
        .where("value IS NOT NULL")
        .groupBy("feature")
        .agg(
            F.avg("value").alias("mean"),
            F.when(F.count("*") > 1, F.stddev_samp("value")).otherwise(0.0).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count("*").alias("count"),
        )
    )


def marker_report(notes: DataFrame, text: str = "text") -> DataFrame:
    """Category counts of masked texts, from their mask tokens."""
    return notes.select(F.explode(privacy.rgpd_from_markers(F.col(text))["categories_detected"]).alias("category")).groupBy(
        "category"
    ).agg(F.count("*").alias("count"))
