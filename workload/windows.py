"""Ranking, running totals, histories; opportunity board and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.functions import scalars
from notewell.operators import windows
from notewell.plans import board, metrics
from workload import tables as t
from workload.registry import query


@query("row_index", """
SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS row_index FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)""")
def row_index(spark, sf):
    order = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return windows.with_row_index(t.table(spark, sf, "part"), order, 20).select("p_partkey", "row_index")


@query("recent_per_group", f"""
SELECT advisor_id, id FROM (SELECT *, row_number() OVER (PARTITION BY advisor_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM ({t.EVENTS_SQL})) WHERE rn <= 5""")
def recent_per_group(spark, sf):
    return windows.recent_per_advisor(t.event_notes(spark, sf), 5, ["advisor_id"]).select("advisor_id", "id")


@query("running_mean", f"""
SELECT id, round(avg(sentiment_score) OVER (PARTITION BY client_id ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_sentiment,
  count(*) OVER (PARTITION BY client_id ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS running_count
FROM (SELECT * REPLACE (value AS sentiment_score, k % 20 AS client_id) FROM ({t.EVENTS_SQL}))""")
def running_mean(spark, sf):
    notes = t.event_notes(spark, sf).withColumns({"sentiment_score": F.col("value"), "client_id": F.col("k") % 20})
    return windows.running_sentiment(notes).select("id", F.round(F.col("running_sentiment") + 1e-9, 6).alias("running_sentiment"), "running_count")


@query("running_sum", f"""
SELECT id, CAST(sum(points_awarded) OVER (PARTITION BY advisor_id ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_points FROM ({t.EVENTS_SQL})""")
def running_sum(spark, sf):
    return windows.running_points(t.event_notes(spark, sf)).select("id", "running_points")


@query("metrics_history", """
SELECT event_id, value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR""")
def metrics_history(spark, sf):
    e = t.table(spark, sf, "events").withColumn("timestamp", F.col("ts"))
    return windows.metrics_history(e, t.END, "event_id", 72).select("event_id", "value")


@query("first_pattern", f"""
SELECT id, CASE WHEN f IS NULL AND m IS NULL THEN NULL WHEN m IS NULL OR f <= m THEN 'female' ELSE 'male' END AS gender FROM (
  SELECT id, CASE WHEN regexp_matches(text, '(?i)\\b(Mme|Madame|Mrs|Ms|Dame|femme|cliente|elle|she)\\b') THEN length(regexp_extract(text, '(?is)^(.*?)\\b(Mme|Madame|Mrs|Ms|Dame|femme|cliente|elle|she)\\b', 1)) END AS f,
    CASE WHEN regexp_matches(text, '(?i)\\b(M\\.|Mr|Monsieur|Sir|homme|client|il|he)(\\W|$)') THEN length(regexp_extract(text, '(?is)^(.*?)\\b(M\\.|Mr|Monsieur|Sir|homme|client|il|he)(\\W|$)', 1)) END AS m
  FROM ({t.ORDER_TEXTS_SQL}))""")
def first_pattern(spark, sf):
    return t.order_texts(spark, sf).select("id", windows.client_gender(F.col("text")).alias("gender"))


@query("stratified_sample", "SELECT lang, least(count(*), greatest(1, 50 // (SELECT count(DISTINCT lang) FROM documents))) AS n FROM documents GROUP BY lang")
def stratified_sample(spark, sf):
    sample = windows.stratified_sample(t.documents(spark, sf), "lang", "id", 50)
    return sample.groupBy("lang").agg(F.count("*").alias("n"))


@query("conversation_turns", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""")
def conversation_turns(spark, sf):
    return windows.top_n_per_group(t.table(spark, sf, "conversations"), ["conv_id"], [F.col("turn").desc()], 2).select("conv_id", "turn", "role")


# --- opportunities ---------------------------------------------------------------------------

_COLUMNS = """client_name, advisor_name, advisor_store, vip_label, is_vip, tier, urgency_level, urgency,
  CASE WHEN budget_value > 0 THEN budget_value END AS budget_value, budget_label, CAST(round_even(confidence * 100, 0) AS BIGINT) || '%' AS confidence_label,
  priority_score, action_status, action_type, action_label, manager_name"""
_NAMES = ("client_name", "advisor_name", "advisor_store", "vip_label", "is_vip", "tier", "urgency_level", "urgency", "budget_value", "budget_label",
          "confidence_label", "priority_score", "action_status", "action_type", "action_label", "manager_name")


def _frames(spark, sf):
    return t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf)


@query("opportunity_rows", f"SELECT id, {_COLUMNS} FROM ({t.BOARD_SQL})")
def opportunity_rows(spark, sf):
    return board.opportunity_rows(*_frames(spark, sf)).select("id", *_NAMES)


@query("opportunity_board", f"""
WITH pool AS (SELECT * FROM ({t.BOARD_SQL}) WHERE "timestamp" >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND "timestamp" <= TIMESTAMP '2001-08-01' ORDER BY "timestamp" DESC, id LIMIT 500),
kept AS (SELECT * FROM pool WHERE urgency_level = 3 ORDER BY priority_score DESC, id LIMIT 40)
SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, id) AS INTEGER) AS row_index, id AS note_id, {_COLUMNS} FROM kept""")
def opportunity_board(spark, sf):
    out = board.opportunity_board(*_frames(spark, sf), limit=40, end=t.ORDERS_END, window="30d", priority="urgent")
    return out.select("row_index", "note_id", *_NAMES)


@query("board_totals", f"""
SELECT least(count(*), 500) AS source_candidates, count_if(is_vip) AS filtered, least(count_if(is_vip), 25) AS returned FROM (SELECT * FROM ({t.BOARD_SQL}) ORDER BY "timestamp" DESC, id LIMIT 500)""")
def board_totals(spark, sf):
    from notewell.operators import filters, paging

    notes, users, clients, actions = _frames(spark, sf)
    pool = paging.recent_candidates(notes, 25)
    kept = filters.filter_opportunities(board.opportunity_rows(pool, users, clients, actions), priority="vip")
    return board.board_totals(pool, kept, 25)


_DAY = """CAST("timestamp" AS DATE) = DATE '2024-01-15'"""


@query("day_detail", f"""
SELECT e.id AS note_id, u.full_name AS advisor_name, tier, round(confidence, 3) AS confidence, round(processing_time_ms, 1) AS processing_time_ms, from_cache,
  trim(regexp_replace(transcription, '\\s+', ' ', 'g')) AS transcription_preview
FROM (SELECT * FROM ({t.EVENTS_SQL}) WHERE {_DAY} ORDER BY "timestamp" DESC, id LIMIT 30) e LEFT JOIN ({t.USERS_SQL}) u ON u.id = e.advisor_id""")
def day_detail(spark, sf):
    return board.day_notes(t.event_notes(spark, sf), t.users(spark, sf), "2024-01-15", 30).drop("timestamp", "quality_score")


@query("day_summary", f"""
SELECT count(*) AS notes_processed, round(count_if(parsed) / count(*) * 100, 1) AS success_rate, round(avg(processing_time_ms), 1) AS avg_processing_time_ms,
  (SELECT count(*) FROM ({t.FEEDBACK_SQL}) WHERE CAST(created_at AS DATE) = DATE '2024-01-15') AS feedback_count FROM ({t.EVENTS_SQL}) WHERE {_DAY}""")
def day_summary(spark, sf):
    return board.day_summary(t.event_notes(spark, sf), t.event_feedback(spark, sf), "2024-01-15").select(
        "notes_processed", "success_rate", "avg_processing_time_ms", "feedback_count"
    )


@query("history", f"""
SELECT e.id, transcription, points_awarded AS points, coalesce(c.name, 'Inconnu') AS client FROM ({t.EVENTS_SQL}) e LEFT JOIN ({t.CLIENTS_SQL}) c ON c.id = e.client_id WHERE advisor_id = 7""")
def history(spark, sf):
    return board.history(t.event_notes(spark, sf), t.clients(spark, sf), 7).drop("timestamp")


@query("note_detail", f"""
SELECT id, CASE WHEN parsed THEN k % 5 ELSE 1 END AS tier, coalesce(confidence, 0) AS confidence,
  CASE WHEN parsed THEN 'tag' || (k % 7) || CASE WHEN k % 7 <> k % 5 THEN ',Tag' || (k % 5) ELSE '' END ELSE '' END AS tags,
  CASE WHEN parsed AND k % 2 = 0 THEN 'call ' || event_type END AS description FROM ({t.EVENTS_SQL})""")
def note_detail(spark, sf):
    return board.note_detail(t.event_notes(spark, sf)).select(
        "id", "tier", "confidence", F.array_join("tags", ",").alias("tags"), F.col("next_best_action.description").alias("description")
    )


@query("json_fields", f"""
SELECT id, CASE WHEN parsed THEN k % 5 ELSE 1 END AS tier, coalesce(confidence, 0) AS confidence, contains_sensitive, coalesce(CASE WHEN event_type NOT IN ('error') THEN processing_time_ms END, 0) AS processing_time_ms,
  from_cache, CASE WHEN parsed AND k % 2 = 0 THEN 'call ' || event_type ELSE 'Relance conseiller recommandee.' END AS next_action FROM ({t.EVENTS_SQL})""")
def json_fields(spark, sf):
    from notewell.functions import payload

    notes = t.event_notes(spark, sf).withColumn("p", payload.parse_analysis(F.col("analysis_json")))
    fields = payload.note_fields(F.col("p"))
    return notes.select("id", *[fields[n].alias(n) for n in ("tier", "confidence", "contains_sensitive", "processing_time_ms", "from_cache", "next_action")])


@query("confidence_labels", f"SELECT id, CASE WHEN confidence IS NULL THEN '-' ELSE CAST(round_even(confidence * 100, 0) AS BIGINT) || '%' END AS label FROM ({t.EVENTS_SQL})")
def confidence_labels(spark, sf):
    return metrics.parse_notes(t.event_notes(spark, sf)).select("id", scalars.confidence_label(F.col("confidence")).alias("label"))
