"""Opportunity board, day detail and advisor history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell import schemas
from notewell.functions import lists, payload, scalars
from notewell.functions import matching as m
from notewell.operators import filters, joins, paging, windows
from notewell.plans import metrics
from notewell.session import cut_lineage

P4 = schemas.PILLARS[3]
DEFAULT_ACTION = "Relance conseiller recommandee."


def opportunity_fields(notes: DataFrame, column: str = "analysis_json") -> DataFrame:
    """The payload fields that the score reads: urgency_text, budget_text, tier, confidence, next_action."""
    p4 = F.col("__p")["extraction"][P4]
    exact = p4["budget_specific"]
    return (
        notes.withColumn("__p", payload.parse_analysis(F.col(column)))
        .withColumns(
            {
                "urgency_text": F.coalesce(p4["urgency"], p4["lead_temperature"]),
                "budget_text": F.coalesce(F.when(exact != 0, exact.cast("string")), p4["budget_potential"]),
                "tier": scalars.known_tier(F.col("__p")["routing"]["tier"]),
                "confidence": F.col("__p")["routing"]["confidence"],
                "next_action": p4["next_best_action"]["description"],
                **{c: p4[c] for c in ("churn_risk", "churn_level", "clv_estimate", "clv_tier", "prediction_source")},
            }
        )
        .drop("__p", column)
    )


def score_rows(rows: DataFrame) -> DataFrame:
    """Adds the opportunity columns to enriched notes with the fields of :func:`opportunity_fields`."""
    urgency = scalars.norm_urgency(F.col("urgency_text"))
    conf = F.coalesce("confidence", F.lit(0.0))
    out = rows.withColumns(
        {
            "urgency_level": urgency["level"],
            "urgency": urgency["label"],
            "budget_value": scalars.budget_value(F.col("budget_text")),
            "budget_label": F.when(m.blank(F.col("budget_text")), F.lit("-")).otherwise(F.col("budget_text")),
            "is_vip": F.col("vip_label") != "Standard",
            "next_action": F.coalesce("next_action", F.lit(DEFAULT_ACTION)),
            "confidence_label": scalars.confidence_label(F.col("confidence")),
            "action_label": scalars.action_label(F.col("action_status"), F.col("action_type")),
        }
    )
    ratio = F.when(conf <= 1, conf).otherwise(conf / 100.0)
    score = (
        F.when(F.col("tier") == 3, 30).when(F.col("tier") == 2, 18).otherwise(8)
        + F.col("urgency_level") * 15
        + F.when(F.col("is_vip"), 25).otherwise(0)
        + F.coalesce(F.least(F.lit(35.0), F.col("budget_value") / 2000.0), F.lit(0.0))
        + F.bround(ratio * 12, 0)
    )
    return out.withColumn("priority_score", F.bround(score, 0).cast("bigint"))


def opportunity_rows(notes: DataFrame, users: DataFrame, clients: DataFrame, actions: DataFrame) -> DataFrame:
    return score_rows(joins.enrich_notes(opportunity_fields(notes), users, clients, actions))


def opportunity_board(notes: DataFrame, users: DataFrame, clients: DataFrame, actions: DataFrame, limit: int = 10,
                      end=None, window: str = "all", days: int | None = None, advisor: str | None = None,
                      priority: str = "all", status: str = "all", text: str | None = None, sort: str = "priority",
                      ids: str | None = None) -> DataFrame:
    """Newest candidates, scored, filtered, sorted, cut and numbered.

    The candidate cut (at most 5000 rows) precedes the JSON parsing and the joins. The pool is
    written once, so the notes are read once; the other tables are reduced to the pool's keys
    by semi-joins against that small table, so none of them is shuffled whole.
    """
    base = filters.in_window(notes, "timestamp", end=end, days=days, window=window)
    base = filters.with_ids(base, "id", ids)
    pool = cut_lineage(paging.recent_candidates(base, limit), "board-pool")

    def wanted(df: DataFrame, key: str, ids_of: DataFrame, column: str) -> DataFrame:
        return df.join(ids_of.select(F.col(column).alias(key)).distinct(), key, "left_semi")

    here = wanted(actions, "note_id", pool, "id")
    people = pool.select(F.col("advisor_id").cast("bigint").alias("id")).unionAll(here.select(F.col("manager_id").cast("bigint")))
    rows = opportunity_rows(pool, wanted(users, "id", people, "id"), wanted(clients, "id", pool, "client_id"), here).withColumnRenamed("id", "note_id")
    kept = filters.filter_opportunities(rows, advisor, priority, status, text)
    return windows.with_row_index(kept, paging.sort_columns(sort), limit)


def board_totals(pool: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """source_candidates, filtered, returned."""
    both = pool.agg(F.count("*").alias("source_candidates")).unionByName(
        kept.agg(F.count("*").alias("filtered")), allowMissingColumns=True
    )
    return both.agg(F.max("source_candidates").alias("source_candidates"), F.max("filtered").alias("filtered")).withColumn(
        "returned", F.least("filtered", F.lit(limit))
    )


def day_summary(notes: DataFrame, feedback: DataFrame, day: str) -> DataFrame:
    """The daily series of one day."""
    return metrics.daily_series(metrics.parse_notes(filters.on_day(notes, "timestamp", day)), filters.on_day(feedback, "created_at", day), day, day)


def day_notes(notes: DataFrame, users: DataFrame, day: str, limit: int) -> DataFrame:
    """The newest notes of a day with their previews; cut before parsing and joining."""
    newest = filters.on_day(notes, "timestamp", day).orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)
    names = users.select(F.col("id").alias("advisor_id"), F.coalesce("full_name", "email").alias("advisor_name"))
    return metrics.parse_notes(newest).join(names, "advisor_id", "left").select(
        F.col("id").alias("note_id"), "timestamp", "advisor_name", "tier",
        F.round("confidence", 3).alias("confidence"),
        F.round("processing_time_ms", 1).alias("processing_time_ms"),
        "from_cache", "quality_score",
        scalars.preview(F.col("transcription"), 220).alias("transcription_preview"),
    )


def history(notes: DataFrame, clients: DataFrame, advisor_id) -> DataFrame:
    """An advisor's notes, newest first, with a 100-character cut of the text."""
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("__client"))
    text = F.col("transcription")
    return (
        notes.where(F.col("advisor_id") == advisor_id)
        .join(names, "client_id", "left")
        .select(
            "id", "timestamp",
            F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text).alias("transcription"),
            F.col("points_awarded").alias("points"),
            F.coalesce("__client", F.lit("Inconnu")).alias("client"),
        )
        .orderBy(F.col("timestamp").desc(), F.col("id"))
    )


def note_detail(notes: DataFrame, column: str = "analysis_json") -> DataFrame:
    """Drill-down fields of notes: routing, quality, tags, action, products, preview."""
    p = F.col("__p")
    fields = payload.note_fields(p)
    meta = p["extraction"]["meta_analysis"]
    return notes.withColumn("__p", payload.parse_analysis(F.col(column))).select(
        "id", "timestamp",
        scalars.preview(F.coalesce("transcription", p["processed_text"]), 300).alias("transcription_preview"),
        fields["tier"].alias("tier"), fields["confidence"].alias("confidence"), p["routing"]["reasons"].alias("reasons"),
        meta["quality_score"].alias("quality_score"), meta["advisor_feedback"].alias("advisor_feedback"),
        lists.trimmed(meta["missing_info"]).alias("missing_info"),
        payload.derive_tags(p["extraction"]).alias("tags"),
        p["extraction"][P4]["next_best_action"].alias("next_best_action"),
        fields["matched_products"].alias("matched_products"),
    )
