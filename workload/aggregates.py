"""Dashboard aggregates, audits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.plans import board, drift, metrics, terms
from workload import tables as t
from workload.registry import case_of, query

_COST = case_of("tier", {k: f"{v:.10f}e0" for k, v in fv.DASHBOARD_TIER_COSTS.items()}, f"{fv.DASHBOARD_TIER_COSTS[1]}e0")
_TIERS = "count_if(tier = 1) AS tier1, count_if(tier = 2) AS tier2, count_if(tier = 3) AS tier3"


def _notes(spark, sf):
    return metrics.parse_notes(t.event_notes(spark, sf))


@query("processing_stats", f"""
SELECT count(*) AS total_processed, 100e0 AS success_rate, count_if(NOT parsed) AS parse_failures,
  count_if(parsed AND tier = 1) AS tier1, count_if(parsed AND tier = 2) AS tier2, count_if(parsed AND tier = 3) AS tier3,
  round(avg(processing_time_ms), 1) AS avg_processing_time_ms, round(avg(confidence), 3) AS avg_confidence,
  round(count_if(from_cache) / count(*) * 100, 1) AS cache_hit_rate FROM ({t.EVENTS_SQL})""")
def processing_stats(spark, sf):
    return metrics.pipeline_stats(_notes(spark, sf))


@query("cost_stats", f"""
SELECT round(sum(c), 4) AS total_cost_eur, round(sum(c) / count(*), 6) AS cost_per_note,
  round(sum(CASE WHEN tier = 1 THEN c ELSE 0 END), 4) AS tier1_cost, round(sum(CASE WHEN tier = 2 THEN c ELSE 0 END), 4) AS tier2_cost,
  round(sum(CASE WHEN tier = 3 THEN c ELSE 0 END), 4) AS tier3_cost, round(sum(c) * 30, 4) AS estimated_monthly
FROM (SELECT tier, {_COST} AS c FROM ({t.EVENTS_SQL}))""")
def cost_stats(spark, sf):
    return metrics.cost_stats(_notes(spark, sf))


@query("overview", f"""
SELECT count(*) AS total_notes, round(sum(points_awarded) / count(*) / 15 * 100, 1) AS avg_quality, {_TIERS},
  count_if(contains_sensitive) AS sensitive_count, round(count_if(contains_sensitive) / count(*) * 100, 1) AS sensitive_rate,
  round(sum({_COST}), 3) AS total_cost FROM ({t.EVENTS_SQL})""")
def overview(spark, sf):
    return metrics.overview(_notes(spark, sf))


@query("category_counts", f"""
SELECT category, count(*) AS "count" FROM (SELECT unnest(['cat' || (k % 4), 'any']) AS category FROM ({t.EVENTS_SQL}) WHERE contains_sensitive) GROUP BY category""")
def category_counts(spark, sf):
    return metrics.rgpd_categories(_notes(spark, sf))


@query("rgpd_report", f"""
SELECT count(*) AS total_notes, count_if(contains_sensitive) AS notes_with_sensitive_data,
  round(count_if(contains_sensitive) / count(*) * 100, 6) AS percentage_sensitive,
  CASE WHEN count_if(contains_sensitive) = 0 THEN 'COMPLIANT' ELSE 'REQUIRES_REVIEW' END AS compliance_status FROM ({t.EVENTS_SQL})""")
def rgpd_report(spark, sf):
    return metrics.rgpd_report(_notes(spark, sf)).withColumn("percentage_sensitive", F.round("percentage_sensitive", 6))


@query("feedback_quality", f"""
SELECT round(avg({t.JACCARD_SQL}) * 100, 1) AS accuracy_rate,
  round(count_if(list_sort(pset) = list_sort(cset)) / count(*) * 100, 1) AS exact_match_rate,
  round(sum(rating) / count(*), 2) AS avg_rating, count(*) AS total_feedback FROM ({t.FEEDBACK_SQL})""")
def feedback_quality(spark, sf):
    return metrics.feedback_quality(t.event_feedback(spark, sf))


@query("top_corrections", f"""
SELECT 'field' || (k % 3) || ' ? v' || (k % 5) AS correction, count(*) AS "count" FROM ({t.FEEDBACK_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_corrections(spark, sf):
    return metrics.top_corrections(t.event_feedback(spark, sf))


_DAYS = "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day"
SERIES_SQL = f"""
SELECT CAST(d.day AS VARCHAR) AS date, coalesce(n.notes_processed, 0) AS notes_processed,
  coalesce(n.tier1, 0) AS tier1, coalesce(n.tier2, 0) AS tier2, coalesce(n.tier3, 0) AS tier3,
  coalesce(f.feedback_count, 0) AS feedback_count,
  round(CASE WHEN n.notes_processed > 0 THEN n.parsed / n.notes_processed * 100 ELSE 0e0 END, 1) AS success_rate,
  round(coalesce(n.avg_time, 0e0), 1) AS avg_processing_time_ms, round(coalesce(n.cost, 0e0), 4) AS cost_eur,
  round(f.overlap * 100, 1) AS accuracy_rate
FROM ({_DAYS}) d
LEFT JOIN (SELECT CAST("timestamp" AS DATE) AS day, count(*) AS notes_processed, count_if(parsed) AS parsed,
  avg(processing_time_ms) AS avg_time, sum({_COST}) AS cost, {_TIERS} FROM ({t.EVENTS_SQL}) GROUP BY 1) n USING (day)
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS feedback_count, avg({t.JACCARD_SQL}) AS overlap FROM ({t.FEEDBACK_SQL}) GROUP BY 1) f USING (day)
"""
ALERTS_SQL = f"""
SELECT *, CAST(avg_processing_time_ms > 5000 AS INTEGER) + CAST(success_rate < 95 AS INTEGER) + CAST(cost_eur > 10 AS INTEGER)
  + CAST(coalesce(feedback_count >= 10 AND accuracy_rate < 80, false) AS INTEGER) AS alerts_count FROM ({SERIES_SQL})"""


def _series(spark, sf):
    return metrics.daily_series(_notes(spark, sf), t.event_feedback(spark, sf), "2024-01-01", "2024-02-05")


@query("daily_series", ALERTS_SQL)
def daily_series(spark, sf):
    return _series(spark, sf).withColumn("date", F.col("date").cast("string")).drop("alerts")


@query("series_totals", f"""
SELECT CAST(sum(notes_processed) AS BIGINT) AS notes_processed, round(sum(cost_eur), 4) AS cost_eur,
  CAST(sum(alerts_count) AS BIGINT) AS alerts_count, round(avg(avg_processing_time_ms), 1) AS avg_processing_time_ms FROM ({ALERTS_SQL})""")
def series_totals(spark, sf):
    return metrics.series_totals(_series(spark, sf))


@query("half_trend", f"""
WITH h AS (SELECT m AS measure, sum(CASE WHEN early THEN v ELSE 0 END) AS a, sum(CASE WHEN early THEN 0 ELSE v END) AS b FROM (
  SELECT unnest(['notes_processed', 'cost_eur', 'feedback_count']) AS m, unnest([CAST(notes_processed AS DOUBLE), cost_eur, CAST(feedback_count AS DOUBLE)]) AS v,
    CAST(date AS DATE) < DATE '2024-01-19' AS early FROM ({SERIES_SQL})) GROUP BY m)
SELECT measure, round(a, 4) AS first_half, round(b, 4) AS second_half, round(abs(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END), 1) AS change_pct,
  CASE WHEN a = 0 THEN true ELSE b >= a END AS is_positive, abs(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END) < 1 AS is_neutral FROM h""")
def half_trend(spark, sf):
    return metrics.half_trend(_series(spark, sf), ["notes_processed", "cost_eur", "feedback_count"], "2024-01-01", 36)


# --- warehouse facts: line items -------------------------------------------------------------

FACTS_SQL = """
SELECT l_shipdate AS "timestamp", 'store' || (l_suppkey % 7) AS store_id, l_suppkey AS advisor_id, l_discount * 10 AS confidence_score,
  l_tax * 100 AS quality_score, l_quantity * 100 AS processing_time_ms, l_extendedprice / 1000000 AS cost_usd, l_linenumber AS points_awarded,
  l_returnflag = 'A' AS is_vic, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS tier_used, l_linestatus = 'O' AS cache_hit
FROM lineitem"""


def _facts(spark, sf):
    flag = F.col("l_returnflag")
    return t.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"),
        F.concat(F.lit("store"), (F.col("l_suppkey") % 7).cast("string")).alias("store_id"),
        F.col("l_suppkey").alias("advisor_id"),
        (F.col("l_discount") * 10).alias("confidence_score"),
        (F.col("l_tax") * 100).alias("quality_score"),
        (F.col("l_quantity") * 100).alias("processing_time_ms"),
        (F.col("l_extendedprice") / 1000000).alias("cost_usd"),
        F.col("l_linenumber").alias("points_awarded"),
        (flag == "A").alias("is_vic"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("tier_used"),
        (F.col("l_linestatus") == "O").alias("cache_hit"),
    )


@query("daily_store_metrics", f"""
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, store_id, count(*) AS note_count, round(avg(confidence_score), 6) AS avg_confidence,
  round(avg(quality_score), 6) AS avg_quality, round(avg(processing_time_ms), 4) AS avg_processing_ms, round(sum(cost_usd), 9) AS total_cost,
  CAST(sum(points_awarded) AS BIGINT) AS total_points, count_if(is_vic) AS vic_count, count_if(tier_used = 1) AS tier1_count,
  count_if(tier_used = 2) AS tier2_count, count_if(tier_used = 3) AS tier3_count, count_if(cache_hit) AS cache_hits
FROM ({FACTS_SQL}) GROUP BY 1, 2""")
def daily_store_metrics(spark, sf):
    out = metrics.daily_metrics(_facts(spark, sf))
    return out.withColumns(
        {"date": F.col("date").cast("string"), "avg_confidence": F.round("avg_confidence", 6), "avg_quality": F.round("avg_quality", 6),
         "avg_processing_ms": F.round("avg_processing_ms", 4), "total_cost": F.round("total_cost", 9)}
    )


@query("daily_advisor_metrics", f"""
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, advisor_id, store_id, count(*) AS notes_count,
  CAST(sum(points_awarded) AS BIGINT) AS total_points, round(avg(quality_score), 6) AS avg_quality_score, count_if(is_vic) AS vic_served
FROM ({FACTS_SQL}) WHERE "timestamp" >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY GROUP BY 1, 2, 3""")
def daily_advisor_metrics(spark, sf):
    out = metrics.advisor_metrics(_facts(spark, sf), t.ORDERS_END)
    return out.withColumns({"date": F.col("date").cast("string"), "avg_quality_score": F.round("avg_quality_score", 6)})


# --- products, people --------------------------------------------------------------------------

@query("product_categories", f"SELECT category1 AS category, count(*) AS \"count\" FROM ({t.PRODUCTS_SQL}) GROUP BY 1")
def product_categories(spark, sf):
    return metrics.product_categories(t.products(spark, sf))


@query("product_stats", f"""
SELECT count(*) AS total_products, round(avg(price_eur), 2) AS avg_price, min(price_eur) AS min_price, max(price_eur) AS max_price,
  count_if(is_discount) AS discount_count, count_if(stock > 0) AS in_stock_count, count_if(rag_indexed) AS indexed_count FROM ({t.PRODUCTS_SQL})""")
def product_stats(spark, sf):
    return metrics.product_stats(t.products(spark, sf))


_LEADERS = f"""SELECT u.id, u.full_name AS name, u.score, coalesce(n.c, 0) AS notes FROM ({t.USERS_SQL}) u
LEFT JOIN (SELECT advisor_id, count(*) AS c FROM ({t.EVENTS_SQL}) GROUP BY 1) n ON n.advisor_id = u.id WHERE u.role = 'advisor'"""


@query("leaderboard", _LEADERS)
def leaderboard(spark, sf):
    return metrics.leaderboard(t.users(spark, sf), t.event_notes(spark, sf))


@query("leaderboard_top", _LEADERS + " ORDER BY score DESC, id LIMIT 5")
def leaderboard_top(spark, sf):
    return metrics.leaderboard(t.users(spark, sf), t.event_notes(spark, sf), 5)


@query("advisor_stats", f"""
SELECT advisor_id, count(*) AS total_notes, round(avg(confidence), 4) AS avg_quality, least(count(*), 10) AS recent_notes FROM ({t.EVENTS_SQL}) GROUP BY 1""")
def advisor_stats(spark, sf):
    return metrics.advisor_stats(_notes(spark, sf).withColumn("quality_score", F.col("confidence")))


@query("distinct_sorted", "SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sorted(spark, sf):
    return metrics.distinct_sorted(t.documents(spark, sf), "source")


# --- extraction quality ---------------------------------------------------------------------------

RESULTS_SQL = f"""
SELECT id, actual AS tags, p_size / 50e0 AS confidence, p_type = 'PROMO' AS from_cache, p_retailprice / 2000e0 AS compression_ratio,
  p_type = 'SMALL' AS contains_sensitive, p_size % 3 + 1 AS tier FROM ({t.PART_TAGS_SQL})"""


def _results(spark, sf):
    return t.part_tags(spark, sf).select(
        "id", F.col("actual").alias("tags"), (F.col("p_size") / 50.0).alias("confidence"), (F.col("p_type") == "PROMO").alias("from_cache"),
        (F.col("p_retailprice") / 2000.0).alias("compression_ratio"), (F.col("p_type") == "SMALL").alias("contains_sensitive"),
        (F.col("p_size") % 3 + 1).alias("tier"), "p_type", "p_size", "expected",
    )


def _core(spark, sf):
    """Taxonomy derived from the parts: the first words of the names of the first types."""
    return t.table(spark, sf, "part").where("p_type IN ('PROMO', 'SMALL')").groupBy(
        F.substring_index("p_name", " ", -1).alias("tag")
    ).agg(F.min("p_type").alias("category"))


CORE_SQL = "SELECT string_split(p_name, ' ')[2] AS tag, min(p_type) AS category FROM part WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1"


@query("extraction_summary", f"""
SELECT count(*) AS total_processed, CAST(sum(len(tags)) AS BIGINT) AS total_tags, round(avg(len(tags)), 4) AS avg_tags_per_note,
  round(avg(confidence), 4) AS avg_confidence, count_if(from_cache) AS from_cache FROM ({RESULTS_SQL})""")
def extraction_summary(spark, sf):
    return metrics.extraction_summary(_results(spark, sf))


@query("unique_tags", f"SELECT count(DISTINCT tag) AS unique_tags_used FROM (SELECT unnest(tags) AS tag FROM ({RESULTS_SQL}))")
def unique_tags(spark, sf):
    return metrics.unique_tags(_results(spark, sf))


@query("tags_by_category", f"""
SELECT coalesce(c.category, 'other') AS category, count(*) AS "count" FROM (SELECT unnest(tags) AS tag FROM ({RESULTS_SQL})) r
LEFT JOIN ({CORE_SQL}) c USING (tag) GROUP BY 1""")
def tags_by_category(spark, sf):
    return metrics.tags_by_category(_results(spark, sf), _core(spark, sf))


@query("compare_runs", f"""
WITH a AS (SELECT count(*) AS notes, CAST(sum(len(tags)) AS BIGINT) AS tags, avg(len(tags)) AS av, avg(confidence) AS conf FROM ({RESULTS_SQL}) WHERE tier = 1),
b AS (SELECT count(*) AS notes, CAST(sum(len(tags)) AS BIGINT) AS tags, avg(len(tags)) AS av, avg(confidence) AS conf, avg(compression_ratio) AS comp,
  count_if(contains_sensitive) AS sens FROM ({RESULTS_SQL}))
SELECT a.notes AS notes_a, b.notes AS notes_b, a.tags AS tags_a, b.tags AS tags_b, round(a.av, 2) AS avg_tags_a, round(b.av, 2) AS avg_tags_b,
  round(a.conf, 3) AS avg_confidence_a, round(b.conf, 3) AS avg_confidence_b, round(b.comp, 3) AS compression_ratio_b, b.sens AS sensitive_b,
  b.tags - a.tags AS tag_increase, round((b.tags / a.tags - 1) * 100, 1) AS tag_increase_pct, b.notes - a.notes AS coverage_increase,
  round((b.conf - a.conf) * 100, 1) AS confidence_delta_pct FROM a, b""")
def compare_runs(spark, sf):
    results = _results(spark, sf)
    return metrics.compare_runs(results.where("tier = 1"), results)


@query("tag_audit", f"""
SELECT tag, count(*) AS "count", c.category IS NOT NULL AS known,
  CASE WHEN c.category IS NOT NULL THEN 'keep' WHEN count(*) >= 240 THEN 'add' ELSE 'map' END AS advice
FROM (SELECT unnest(tags) AS tag FROM ({RESULTS_SQL})) r LEFT JOIN ({CORE_SQL}) c USING (tag) GROUP BY tag, c.category""")
def tag_audit(spark, sf):
    return metrics.tag_audit(_results(spark, sf), _core(spark, sf), 240)


@query("quality_audit", f"""
WITH r AS (SELECT tier, confidence * 1000 AS t, CASE WHEN from_cache THEN 0e0 ELSE confidence END AS conf,
  CASE WHEN contains_sensitive THEN [] ELSE [confidence, compression_ratio] END AS scores, CASE WHEN from_cache THEN 0 ELSE 1 END AS cats FROM ({RESULTS_SQL}))
SELECT tier, count(*) AS notes, round(count(*) / sum(count(*)) OVER () * 100, 1) AS share_pct, round(avg(t), 2) AS avg_time_ms,
  count_if(conf = 0) AS zero_confidence, count_if(len(scores) > 0) AS notes_with_matches,
  round(sum(list_sum(scores)) / sum(len(scores)), 4) AS avg_match_score, count_if(cats = 0) AS no_categories FROM r GROUP BY tier""")
def quality_audit(spark, sf):
    r = _results(spark, sf)
    none = F.array().cast("array<double>")
    return metrics.quality_audit(
        r.select(
            "tier", (F.col("confidence") * 1000).alias("processing_time_ms"),
            F.when(F.col("from_cache"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
            F.when(F.col("contains_sensitive"), none).otherwise(F.array("confidence", "compression_ratio")).alias("match_scores"),
            F.when(F.col("from_cache"), F.array().cast("array<string>")).otherwise(F.col("tags")).alias("categories"),
        )
    )


@query("invalid_tags", f"""
SELECT count(*) AS total_tags, count_if(c.category IS NULL AND NOT starts_with(tag, 'gift_for_')) AS invalid_tags
FROM (SELECT unnest(list_append(tags, 'gift_for_you')) AS tag FROM ({RESULTS_SQL})) r LEFT JOIN ({CORE_SQL}) c USING (tag)""")
def invalid_tags(spark, sf):
    r = _results(spark, sf).select(F.concat("tags", F.array(F.lit("gift_for_you"))).alias("categories"))
    return metrics.invalid_tags(r, _core(spark, sf))


_PRF = """round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1"""


@query("set_prf", f"""
SELECT tp, fp, fn, {_PRF} FROM (
  SELECT CAST(sum(len(list_intersect(e, a))) AS BIGINT) AS tp, CAST(sum(len(a) - len(list_intersect(e, a))) AS BIGINT) AS fp,
    CAST(sum(len(e) - len(list_intersect(e, a))) AS BIGINT) AS fn
  FROM (SELECT list_distinct(expected) AS e, list_distinct(actual) AS a FROM ({t.PART_TAGS_SQL})))""")
def set_prf(spark, sf):
    return metrics.set_prf(t.part_tags(spark, sf), "expected", "actual")


@query("field_accuracy", """
WITH p AS (SELECT o_totalprice AS exp, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 499 WHEN o_orderstatus = 'O' THEN o_totalprice + 501 END AS got,
  o_orderpriority FROM orders)
SELECT 'budget' AS field, count_if(coalesce(got <> 0 AND abs(got - exp) < 500, false)) AS correct, count(*) AS total,
  round(count_if(coalesce(got <> 0 AND abs(got - exp) < 500, false)) / count(*), 4) AS accuracy FROM p UNION ALL
SELECT 'status', count_if(contains(lower(o_orderpriority), 'urgent')), count(*), round(count_if(contains(lower(o_orderpriority), 'urgent')) / count(*), 4) FROM p
WHERE o_orderpriority <> '5-LOW'""")
def field_accuracy(spark, sf):
    status = F.col("o_orderstatus")
    p = t.table(spark, sf, "orders").withColumn(
        "got", F.when(status == "F", F.col("o_totalprice") + 499).when(status == "O", F.col("o_totalprice") + 501)
    )
    return metrics.field_accuracy(
        p,
        {
            "budget": (F.lit(True), metrics.within(F.col("o_totalprice"), F.col("got"), 500)),
            "status": (F.col("o_orderpriority") != "5-LOW", metrics.text_match(F.lit("URGENT"), F.col("o_orderpriority"))),
        },
    )


@query("confusion", f"""
SELECT tp, fp, fn, tn, {_PRF} FROM (SELECT count_if(p AND y) AS tp, count_if(p AND NOT y) AS fp, count_if(NOT p AND y) AS fn, count_if(NOT p AND NOT y) AS tn
  FROM (SELECT n_chars > 1000 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)))""")
def confusion(spark, sf):
    joined = t.table(spark, sf, "documents").select("doc_id", "n_chars").join(t.table(spark, sf, "labels"), "doc_id")
    return metrics.binary_confusion(joined, F.col("n_chars") > 1000, F.col("quality") == 1)


# --- runs --------------------------------------------------------------------------------------------

_RC = case_of("tier", {k: f"{v:.10f}e0" for k, v in fv.TIER_COSTS.items()})


@query("routing_stats", f"""
SELECT count(*) AS total_routed, {_TIERS}, round(count_if(tier = 1) / count(*) * 100, 1) AS tier1_pct, round(count_if(tier = 2) / count(*) * 100, 1) AS tier2_pct,
  round(count_if(tier = 3) / count(*) * 100, 1) AS tier3_pct, round(avg(confidence * 100), 1) AS avg_score,
  round(count_if(tier < 3) / count(*) * 100, 1) AS free_processing_pct, round(sum({_RC}), 6) AS estimated_cost_usd,
  round(count(*) * 0.0001e0 - sum({_RC}), 6) AS savings_vs_all_tier2 FROM ({RESULTS_SQL})""")
def routing_stats(spark, sf):
    return metrics.routing_stats(_results(spark, sf).withColumn("complexity", F.col("confidence") * 100))


@query("run_metrics", f"""
SELECT count(*) AS notes_processed, count_if(event_type <> 'error') AS notes_success, count_if(event_type = 'error') AS notes_failed,
  round(count(*) / 120e0, 2) AS throughput_notes_per_sec, round(sum(value) / count(*), 2) AS avg_processing_time_ms,
  round(count_if(event_type <> 'error') / count(*) * 100, 1) AS success_rate, round(count_if(k % 4 = 0) / count(*) * 100, 1) AS cache_hit_rate,
  round(count_if(k % 5 = 1) / count(*) * 100, 1) AS tier1_pct, round(count_if(k % 5 = 2) / count(*) * 100, 1) AS tier2_pct,
  round(count_if(k % 5 = 3) / count(*) * 100, 1) AS tier3_pct FROM ({t.EVENTS_SQL})""")
def run_metrics(spark, sf):
    e = t.event_notes(spark, sf)
    return metrics.run_metrics(
        e.select((F.col("k") % 5).alias("tier"), (F.col("event_type") != "error").alias("success"), (F.col("k") % 4 == 0).alias("cached"),
                 F.col("value").alias("processing_time_ms")), 120.0
    )


@query("errors_by_type", "SELECT event_type || '_' || (user_id % 3) AS error, count(*) AS \"count\" FROM events WHERE event_type = 'error' GROUP BY 1")
def errors_by_type(spark, sf):
    e = t.table(spark, sf, "events").withColumn(
        "error", F.when(F.col("event_type") == "error", F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")))
    )
    return metrics.errors_by_type(e)


def _latency_sql(source: str) -> str:
    return f"""
WITH r AS (SELECT event_type AS profile, value, k, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {source})
SELECT profile, (SELECT count(*) FROM events e WHERE e.event_type = profile) AS "count",
  round(max(CASE WHEN rn = CAST(round_even(0.5e0 * (n - 1), 0) AS BIGINT) + 1 THEN value END), 2) AS p50_ms,
  round(max(CASE WHEN rn = CAST(round_even(0.95e0 * (n - 1), 0) AS BIGINT) + 1 THEN value END), 2) AS p95_ms, round(avg(value), 2) AS avg_ms"""


def _latency_rows(spark, sf):
    return t.event_notes(spark, sf).select(
        F.col("event_type").alias("profile"), F.col("value").alias("processing_time_ms"), (F.col("k") % 3).alias("tags_count"),
        (F.col("k") % 10 == 0).alias("fallback_used"), "timestamp", "id",
    )


@query("latency_profile", _latency_sql(f"({t.EVENTS_SQL})") + """,
  count_if(k % 3 = 0) AS notes_without_tags, round(count_if(k % 10 = 0) / count(*) * 100, 2) AS fallback_rate_pct FROM r GROUP BY profile""")
def latency_profile(spark, sf):
    return metrics.latency_by_profile(_latency_rows(spark, sf))


@query("latency_last_n", _latency_sql(f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "timestamp" DESC, id DESC) AS rr FROM ({t.EVENTS_SQL})) WHERE rr <= 1000)""")
       + " FROM r GROUP BY profile")
def latency_last_n(spark, sf):
    return metrics.latency_by_profile(_latency_rows(spark, sf), last=fv.MAX_SNAPSHOTS).select("profile", "count", "p50_ms", "p95_ms", "avg_ms")


@query("stage_averages", f"""
SELECT profile, stage, round(sum(ms) / max(n), 2) AS avg_ms FROM (
  SELECT event_type AS profile, unnest(['clean', 'route', 'rag']) AS stage, unnest([value, value * 2, CASE WHEN k % 2 = 0 THEN value * 3 ELSE 0 END]) AS ms,
    count(*) OVER (PARTITION BY event_type) AS n FROM ({t.EVENTS_SQL})) GROUP BY 1, 2""")
def stage_averages(spark, sf):
    v = F.col("value")
    rows = t.event_notes(spark, sf).select(
        F.col("event_type").alias("profile"),
        F.when(F.col("k") % 2 == 0, F.create_map(F.lit("clean"), v, F.lit("route"), v * 2, F.lit("rag"), v * 3))
        .otherwise(F.create_map(F.lit("clean"), v, F.lit("route"), v * 2)).alias("stage_timings_ms"),
    )
    return metrics.stage_averages(rows)


@query("token_cost", f"""
WITH c AS (SELECT event_type AS step, k AS i, k * 2 AS o, CASE WHEN k % 3 = 0 THEN 0.005e0 / 1000 ELSE 0.00015e0 / 1000 END AS pi,
  CASE WHEN k % 3 = 0 THEN 0.015e0 / 1000 ELSE 0.0006e0 / 1000 END AS po FROM ({t.EVENTS_SQL}))
SELECT step, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(i * pi + o * po), 6) AS cost_usd
FROM c GROUP BY ROLLUP (step)""")
def token_cost(spark, sf):
    calls = t.event_notes(spark, sf).select(
        F.col("event_type").alias("step"), F.when(F.col("k") % 3 == 0, "gpt-4o").when(F.col("k") % 3 == 1, "gpt-4o-mini").otherwise("unknown").alias("model"),
        F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"),
    )
    return metrics.token_cost(calls).withColumn("cost_usd", F.round("cost_usd", 6))


@query("benchmark_report", f"""
SELECT max(id) + 1 AS total_notes, count(*) AS successful, max(id) + 1 - count(*) AS failed, round(count(*) / 60e0, 2) AS notes_per_second,
  round(60e0 / (max(id) + 1), 3) AS seconds_per_note, round(sum({_COST}), 4) AS total_cost_eur, round(avg(confidence), 3) AS avg_confidence,
  round(count_if(tier = 1) / count(*) * 100, 1) AS tier1_pct, round(count_if(tier = 2) / count(*) * 100, 1) AS tier2_pct,
  round(count_if(tier = 3) / count(*) * 100, 1) AS tier3_pct FROM ({t.EVENTS_SQL}) WHERE parsed""")
def benchmark_report(spark, sf):
    ok = _notes(spark, sf).where("parsed").withColumn("cost", metrics.tier_cost(F.col("tier"), fv.DASHBOARD_TIER_COSTS))
    return metrics.benchmark_report(ok, F.col("id") + 1, 60.0)


# --- manager view ----------------------------------------------------------------------------------------

def _opportunities(spark, sf):
    return board.opportunity_rows(t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf))


def _kpi(cond: str, suffix: str) -> str:
    return f"""count_if({cond}) AS total{suffix}, round(count_if({cond} AND is_vip) / count_if({cond}) * 100, 4) AS vip_share{suffix},
  count_if({cond} AND urgency_level = 3) AS urgent_count{suffix}, round(sum(CASE WHEN {cond} THEN confidence ELSE 0 END) / count_if({cond}) * 100, 4) AS avg_confidence_pct{suffix},
  count_if({cond} AND tier = 3) AS tier3_count{suffix}"""


_END = "TIMESTAMP '2001-08-01'"
_NOW = f"""("timestamp" >= {_END} - INTERVAL 365 DAY AND "timestamp" <= {_END})"""
_BEFORE = f"""("timestamp" >= {_END} - INTERVAL 730 DAY AND "timestamp" < {_END} - INTERVAL 365 DAY)"""


@query("window_kpis", f"SELECT *, total - total_prev AS total_delta FROM (SELECT {_kpi(_NOW, '')}, {_kpi(_BEFORE, '_prev')} FROM ({t.BOARD_SQL}))")
def window_kpis(spark, sf):
    return metrics.window_kpis(_opportunities(spark, sf), t.ORDERS_END, 365)


@query("advisor_drilldown", f"""
SELECT advisor_name, advisor_store, count(*) AS notes, count_if(tier = 3) AS tier3, count_if(urgency_level = 3) AS urgent, count_if(is_vip) AS vip,
  round(sum(CASE WHEN budget_value > 0 THEN budget_value ELSE 0 END), 2) AS budget_total, round(avg(confidence), 4) AS avg_confidence,
  strftime(max("timestamp"), '%Y-%m-%d') AS latest, count_if(tier = 3) * 18 + count_if(urgency_level = 3) * 15 + count_if(is_vip) * 8 + count(*) * 2 AS priority_index
FROM ({t.BOARD_SQL}) GROUP BY 1, 2""")
def advisor_drilldown(spark, sf):
    return metrics.advisor_drilldown(_opportunities(spark, sf)).withColumn("latest", F.date_format("latest_timestamp", "yyyy-MM-dd")).drop("latest_timestamp")


@query("action_summary", f"""
SELECT count_if(action_status = 'done') AS done, count_if(action_status <> 'done') AS "open", count_if(action_status <> 'done' AND action_type = 'call') AS call,
  count_if(action_status <> 'done' AND action_type = 'schedule') AS schedule, round(sum(CASE WHEN budget_value > 0 THEN budget_value ELSE 0 END), 2) AS budget_total
FROM ({t.BOARD_SQL})""")
def action_summary(spark, sf):
    return metrics.action_summary(_opportunities(spark, sf))


_SYSTEM = f"""
SELECT a.*, b.* FROM (SELECT count(*) AS total_processed, round(avg(processing_time_ms), 1) AS avg_processing_time_ms,
  round(count_if(parsed) / count(*) * 100, 1) AS success_rate, round(sum({_COST}), 4) AS total_cost_eur FROM ({t.EVENTS_SQL})) a,
(SELECT round(avg({t.JACCARD_SQL}) * 100, 1) AS accuracy_rate, round(sum(rating) / count(*), 2) AS avg_rating, count(*) AS total_feedback FROM ({t.FEEDBACK_SQL})) b"""
_ALERTS = """concat_ws(';', CASE WHEN avg_processing_time_ms > 5000 THEN 'time' END, CASE WHEN success_rate < 95 THEN 'success' END,
  CASE WHEN total_cost_eur > 10 THEN 'cost' END, CASE WHEN total_feedback >= 10 AND accuracy_rate < 80 THEN 'accuracy' END)"""


@query("alerts", f"SELECT total_processed, avg_processing_time_ms, success_rate, accuracy_rate, avg_rating, total_cost_eur, {_ALERTS} AS alerts FROM ({_SYSTEM})")
def alerts(spark, sf):
    row = metrics.system_metrics(_notes(spark, sf), t.event_feedback(spark, sf))
    fired = metrics.alert_list(*[F.col(c) for c in ("avg_processing_time_ms", "success_rate", "total_cost_eur", "accuracy_rate", "total_feedback")])
    kinds = F.transform(
        fired,
        lambda a: F.when(a.contains("processing time"), "time").when(a.contains("success"), "success").when(a.contains("cost"), "cost").otherwise("accuracy"),
    )
    return row.select("total_processed", "avg_processing_time_ms", "success_rate", "accuracy_rate", "avg_rating", "total_cost_eur", F.array_join(kinds, ";").alias("alerts"))


@query("health", f"""
SELECT round(greatest(0, score), 4) AS health_score, CASE WHEN score > 80 THEN 'healthy' WHEN score > 60 THEN 'warning' ELSE 'critical' END AS health_status, CAST(n AS INTEGER) AS alerts_count FROM (
  SELECT n, 100 - n * 10 - CASE WHEN success_rate < 99 THEN (100 - success_rate) * 2 ELSE 0 END
    - CASE WHEN total_feedback >= 10 AND accuracy_rate < 90 THEN 100 - accuracy_rate ELSE 0 END AS score
  FROM (SELECT *, len(list_filter(string_split({_ALERTS}, ';'), lambda x: x <> '')) AS n FROM ({_SYSTEM})))""")
def health(spark, sf):
    row = metrics.health(metrics.system_metrics(_notes(spark, sf), t.event_feedback(spark, sf)))
    return row.select(F.round("health_score", 4).alias("health_score"), "health_status", "alerts_count")


# --- clusters, drift, terms ------------------------------------------------------------------------------------

@query("cluster_profile", f"""
WITH p AS (SELECT p_size % 6 AS cluster, actual, p_type, p_retailprice FROM ({t.PART_TAGS_SQL})),
tags AS (SELECT cluster, tag, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, tag) AS rn FROM (SELECT cluster, unnest(actual) AS tag FROM p) GROUP BY 1, 2),
modal AS (SELECT cluster, p_type, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, p_type) AS rn FROM p GROUP BY 1, 2)
SELECT p.cluster, count(*) AS size, round(avg(p_retailprice), 4) AS avg_confidence,
  (SELECT p_type FROM modal m WHERE m.cluster = p.cluster AND rn = 1) AS dominant_budget,
  (SELECT string_agg(tag, ',' ORDER BY rn) FROM tags g WHERE g.cluster = p.cluster AND rn <= 5) AS top_tags FROM p GROUP BY p.cluster""")
def cluster_profile(spark, sf):
    p = t.part_tags(spark, sf).withColumn("cluster", F.col("p_size") % 6)
    return metrics.cluster_profile(p, "cluster", "actual", "p_type", "p_retailprice").withColumn("top_tags", F.array_join("top_tags", ","))


@query("segment_summary", f"""
SELECT urgency AS segment, count(*) AS "count", round(avg(CASE WHEN budget_value > 0 THEN budget_value END), 2) AS avg_budget,
  round(count_if(tier = 3) / count(*) * 100, 1) AS tier3_share_pct FROM ({t.BOARD_SQL}) GROUP BY 1""")
def segment_summary(spark, sf):
    return metrics.segment_summary(_opportunities(spark, sf).withColumn("segment", F.col("urgency")))


@query("segment_notes")
def segment_notes(spark, sf):
    return metrics.segment_notes(_opportunities(spark, sf))


@query("feature_stats", """
SELECT f AS feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, count(*) AS "count" FROM (
  SELECT unnest(['p_size', 'p_retailprice', 'name_length']) AS f, unnest([CAST(p_size AS DOUBLE), p_retailprice, CAST(length(p_name) AS DOUBLE)]) AS v FROM part) GROUP BY 1""")
def feature_stats(spark, sf):
    part = t.table(spark, sf, "part").withColumn("name_length", F.length("p_name"))
    return metrics.feature_stats(part, ["p_size", "p_retailprice", "name_length"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


DRIFT_SQL = """
WITH f AS (SELECT early, unnest(['num_products', 'has_vip', 'urgency', 'confidence', 'num_extractions', 'processing_time', 'text_length']) AS feature,
  unnest([CAST(k % 3 AS DOUBLE), CASE WHEN k % 4 = 0 THEN 1e0 ELSE 0e0 END, CAST(k % 5 AS DOUBLE), k / 100e0, CAST(k % 3 + 1 AS DOUBLE),
    CASE WHEN early THEN value ELSE value * 2 END, CAST(length(props) AS DOUBLE)]) AS v
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts < TIMESTAMP '2024-01-16' AS early FROM events)),
s AS (SELECT feature, avg(v) FILTER (early) AS rm, avg(v) FILTER (NOT early) AS cm, stddev_samp(v) FILTER (early) AS rs, stddev_samp(v) FILTER (NOT early) AS cs FROM f GROUP BY 1),
c AS (SELECT *, CASE WHEN rm <> 0 THEN abs(cm - rm) / abs(rm) WHEN cm <> 0 THEN 1 ELSE 0 END AS change FROM s)
"""


def _drift_frames(spark, sf):
    k = F.col("k")
    e = t.event_notes(spark, sf)
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    data = F.to_json(
        F.struct(
            F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda x: x < k % 3), lambda x: x.cast("string")).alias("produits"),
            F.array(F.lit("c")).alias("categories"),
            F.struct((k % 4 == 0).alias("is_vip")).alias("profil_client"),
            F.struct((k % 5).cast("double").alias("urgence")).alias("action"),
            (k / 100.0).alias("confidence"),
        )
    )
    rows = e.select(
        early.alias("early"), data.alias("extracted_data"), F.substring_index("transcription", "  ", -1).alias("raw_text"),
        F.when(early, F.col("value")).otherwise(F.col("value") * 2).alias("processing_time"),
    )
    features = drift.drift_features(rows)
    return features.where("early"), features.where("NOT early")


_DRIFT_COLUMNS = ("num_products", "has_vip", "urgency", "confidence", "num_extractions", "processing_time", "text_length")


@query("drift_report", DRIFT_SQL + """SELECT feature, round(rm, 6) AS reference_mean, round(cm, 6) AS current_mean, round(rs, 6) AS reference_std,
  round(cs, 6) AS current_std, round(change, 6) AS mean_change, change > 0.3 AS drifted, CASE WHEN change > 0.3 THEN 'DRIFT' ELSE 'OK' END AS status FROM c""")
def drift_report(spark, sf):
    reference, current = _drift_frames(spark, sf)
    out = drift.drift_report(reference, current, _DRIFT_COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in ("reference_mean", "current_mean", "reference_std", "current_std", "mean_change")})


@query("drift", DRIFT_SQL + """SELECT count_if(change > 0.3) / count(*) > 0.2 AS drift_detected, round(count_if(change > 0.3) / count(*), 4) AS drift_score,
  count_if(change > 0.3) AS num_drifted_columns, count(*) AS total_columns FROM c""")
def drift_check(spark, sf):
    reference, current = _drift_frames(spark, sf)
    return drift.drift(reference, current, _DRIFT_COLUMNS)


_W = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("candidate_terms", f"""
WITH d AS (SELECT conv_id * 1000 + turn AS id, {_W} AS w FROM conversations),
g AS (SELECT id, len(w) AS n, unnest(w) AS candidate FROM d UNION ALL
  SELECT id, len(w), unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
p AS (SELECT id, candidate, count(*) AS tf, max(n) AS n FROM g GROUP BY 1, 2)
SELECT candidate, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents,
  round(avg(tf / n) * (ln(((SELECT count(*) FROM d) + 1e0) / (count(*) + 1)) + 1), 6) AS tfidf_score FROM p GROUP BY 1 HAVING sum(tf) >= 20""")
def candidate_terms(spark, sf):
    out = terms.candidate_terms(t.table(spark, sf, "conversations"), "text", max_words=2, min_count=20)
    return out.withColumn("tfidf_score", F.round("tfidf_score", 6))


@query("candidate_terms_all", f"""
WITH d AS (SELECT conv_id * 1000 + turn AS id, {_W} AS w FROM conversations),
g AS (SELECT id, len(w) AS n, unnest(w) AS candidate FROM d UNION ALL
  SELECT id, len(w), unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM d UNION ALL
  SELECT id, len(w), unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
p AS (SELECT id, candidate, count(*) AS tf, max(n) AS n FROM g GROUP BY 1, 2)
SELECT candidate, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents,
  round(avg(tf / n) * (ln(((SELECT count(*) FROM d) + 1e0) / (count(*) + 1)) + 1), 6) AS tfidf_score FROM p GROUP BY 1 HAVING sum(tf) >= 2""")
def candidate_terms_all(spark, sf):
    """``candidate_terms`` with the operator's own defaults: runs of up to three words that occur twice."""
    out = terms.candidate_terms(t.table(spark, sf, "conversations"), "text")
    return out.withColumn("tfidf_score", F.round("tfidf_score", 6))


@query("coverage", f"""
WITH r AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS budget FROM ({t.PART_TAGS_SQL}))
SELECT count(*) AS total, round(count(budget) / count(*) * 100, 1) AS budget_pct, round(count_if(p_type <> 'SMALL') / count(*) * 100, 1) AS status_pct,
  round(count_if(p_type = 'PROMO') / count(*) * 100, 1) AS allergies_pct, round(count_if(p_type = 'LARGE') / count(*) * 100, 1) AS diet_pct,
  round(count_if(p_type <> 'MEDIUM') / count(*) * 100, 1) AS gender_pct, count_if(p_size > 25) AS gifts, count_if(p_size <= 25) AS self_purchases,
  round(avg(p_size / 50e0), 2) AS avg_confidence FROM r""")
def coverage(spark, sf):
    kind = F.col("p_type")
    none = F.array().cast("array<string>")
    r = t.part_tags(spark, sf).select(
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("budget"),
        F.when(kind == "SMALL", "Unknown").otherwise("vip").alias("status"),
        F.when(kind == "PROMO", F.array(F.lit("nut"))).otherwise(none).alias("allergies"),
        F.when(kind == "LARGE", F.array(F.lit("vegan"))).otherwise(none).alias("diet"),
        F.when(kind != "MEDIUM", "female").alias("gender"),
        F.when(F.col("p_size") > 25, "Gift").otherwise("Self").alias("relation"),
        (F.col("p_size") / 50.0).alias("confidence"),
    )
    return metrics.coverage(r)
