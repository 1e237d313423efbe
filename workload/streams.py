"""Streams over the driver's tables, run to completion into file tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.sources import readers
from notewell.session import cut_lineage, shared_folder
from notewell.streaming import streams
from workload.records import PACK
from workload.registry import query

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_STEP = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'routing' WHEN 'view' THEN 'cleaning' WHEN 'signup' THEN 'done' ELSE 'extraction' END"


def _stored(spark, sf, name, schema):
    """A stored table as a stream, be it one file or a folder of files; a plain path to a file is refused, a pattern is not."""
    return streams.note_stream(spark, f"{sf}/{name}.parque[t]", schema)


def _events(spark, sf):
    """Step events as a stream of the events table."""
    return _steps(_stored(spark, sf, "events", EVENTS))


def _steps(e):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    step = F.when(kind == "error", "error").when(kind == "click", "routing").when(kind == "view", "rgpd").when(kind == "signup", "done").otherwise("tier2_extraction")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", step.alias("step"), "value", (k % 3 + 1).alias("tier"), (k % 10).alias("task_id"), (k % 4).cast("string").alias("profile"), k.alias("k"))


@query("stream_step_metrics", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_STEP} AS step, CAST({_K} % 4 AS VARCHAR) AS profile, count(*) AS events, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2, 3""")
def stream_step_metrics(spark, sf):
    out = streams.run_available(streams.step_metrics(_events(spark, sf)), "step-metrics", "complete")
    return out.select(F.to_date("window_start").cast("string").alias("day"), "step", "profile", "events", F.round("avg_value", 6).alias("avg_value"))


@query("stream_alerts", f"""
SELECT event_id, {_STEP} AS step, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'click' AND {_K} % 3 = 2 THEN 'warning' WHEN event_type = 'view' AND {_K} > 90 THEN 'warning' ELSE 'info' END AS severity FROM events""")
def stream_alerts(spark, sf):
    events = _events(spark, sf).withColumn("contains_sensitive", F.col("k") > 90)
    return streams.run_available(streams.alert_stream(events), "alerts").select("event_id", "step", "severity")


@query("stream_newest_alerts", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def stream_newest_alerts(spark, sf):
    alerts = streams.run_available(streams.alert_stream(_events(spark, sf)), "alerts-newest")
    return streams.newest_alerts(alerts).select("event_id")


# --- ten files in the order of their arrival; some events come three files late ------------------------

FILES, LATE, DAY_MS = 10, 17, 86_400_000
_ARRIVED = f"""
WITH b AS (SELECT *, epoch_us(ts) AS us, {_STEP} AS step, {_K} AS k FROM events), m AS (SELECT min(us) AS lo, max(us) AS hi FROM b),
a AS (SELECT b.*, us // 1000 AS ms, ({FILES} * (us - lo)) // (hi - lo + 1) AS part FROM b, m),
f AS (SELECT *, part + CASE WHEN event_id % {LATE} = 0 AND part < {FILES} - 3 THEN 3 ELSE 0 END AS file FROM a),
w AS (SELECT n.file, coalesce(max(f.ms), 0) - {DAY_MS} AS late, (SELECT max(ms) FROM f) - {DAY_MS} AS ended FROM (SELECT DISTINCT file FROM f) n LEFT JOIN f ON f.file < n.file - 1 GROUP BY n.file),
e AS (SELECT f.*, late, ended FROM f JOIN w USING (file))"""


def _arrivals(spark, sf):
    """The events table replayed as a folder of ten files, written one after the other."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - lo) * FILES / F.lit((hi or 0) - (lo or 0) + 1))
    late = (F.col("event_id") % LATE == 0) & (part < FILES - 3)
    rows = cut_lineage(events.withColumn("file", (part + F.when(late, 3).otherwise(0)).cast("int")), "arriving")
    folder = shared_folder(spark, "arrivals")
    for number in range(FILES):
        rows.where(F.col("file") == number).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return _steps(streams.note_stream(spark, folder, EVENTS, files_per_trigger=1))


@query("stream_step_metrics_append", f"""{_ARRIVED}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, step, CAST(k % 4 AS VARCHAR) AS profile, count(*) AS events, round(avg(value), 6) AS avg_value
FROM (SELECT *, (us // 86400000000 + 1) * {DAY_MS} AS closes FROM e) WHERE closes > late AND closes <= ended GROUP BY 1, 2, 3""")
def stream_step_metrics_append(spark, sf):
    out = streams.run_available(streams.step_metrics(_arrivals(spark, sf)), "step-metrics-append")
    return out.select(F.to_date("window_start").cast("string").alias("day"), "step", "profile", "events", F.round("avg_value", 6).alias("avg_value"))


@query("stream_progress", f"""
SELECT {_K} % 10 AS task_id, count_if(event_type = 'signup') AS processed, count_if(event_type = 'error') AS failed, count(*) AS events, arg_max({_STEP}, ts) AS status FROM events GROUP BY 1""")
def stream_progress(spark, sf):
    return streams.run_merged(streams.progress(_arrivals(spark, sf)), "progress", ["task_id"]).read()


@query("stream_leaderboard", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 15 ELSE 5 END) AS BIGINT) AS score FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def stream_leaderboard(spark, sf):
    return streams.leaderboard(_scores(spark, sf))


@query("stream_scores", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 15 ELSE 5 END) AS BIGINT) AS score FROM events GROUP BY 1")
def stream_scores(spark, sf):
    return _scores(spark, sf)


def _scores(spark, sf):
    points = _arrivals(spark, sf).select("user_id", F.when(F.col("step") == "done", 15).otherwise(5).alias("points"))
    return streams.run_merged(streams.scores_stream(points), "scores", ["user_id"]).read()


TTL_MS = DAY_MS // 2
_CLIENT_STATE = f"""{_ARRIVED},
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > {TTL_MS} AS breaks FROM e WHERE us > late * 1000),
r AS (SELECT *, count(CASE WHEN breaks THEN 1 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
c AS (SELECT user_id AS client_id, run, round(sum(value) / count(*), 6) AS sentiment_score, count(*) AS total_interactions, min(ms) AS first_contact, max(ms) AS last_contact, max(ms) + {TTL_MS} < any_value(ended) AS idle FROM r GROUP BY 1, 2),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY run DESC) = 1)
SELECT client_id, sentiment_score, total_interactions, first_contact, last_contact FROM n WHERE """


def _client_states(spark, sf, gone):
    notes = _arrivals(spark, sf).select(F.col("user_id").alias("client_id"), F.col("value").alias("sentiment_score"), "ts")
    state = streams.client_state_stream(notes, ttl_ms=TTL_MS)
    table = streams.run_merged(state, "client-state", ["client_id"], gone).read()
    return table.select("client_id", F.round("sentiment_score", 6).alias("sentiment_score"), "total_interactions", "first_contact", "last_contact", "idle")


@query("stream_client_state", f"{_CLIENT_STATE}NOT idle")
def stream_client_state(spark, sf):
    return _client_states(spark, sf, F.col("idle")).drop("idle")


@query("stream_idle_clients", f"{_CLIENT_STATE}idle")
def stream_idle_clients(spark, sf):
    """Clients whose state the timer removed, as they were then."""
    return _client_states(spark, sf, None).where("idle").drop("idle")


@query("stream_dedup")
def stream_dedup(spark, sf):
    notes = _arrivals(spark, sf).select("ts", F.concat_ws(" ", "step", F.col("user_id").cast("string")).alias("text"))
    return streams.run_available(streams.dedup_stream(notes), "dedup").select("text_key", "text")


@query("stream_enrich", "SELECT count(*) AS notes, count(DISTINCT doc_id) AS ids FROM documents")
def stream_enrich(spark, sf):
    notes = _stored(spark, sf, "documents", DOCUMENTS).withColumnRenamed("doc_id", "id")
    enriched = streams.enrich_stream(notes, "text", "lang", PACK).select("id", "tier", "tags", "complexity")
    out = streams.run_available(enriched, "enriched")
    return out.agg(F.count("*").alias("notes"), F.count_distinct("id").alias("ids"))


@query("stream_warehouse", """
SELECT count_if(value <= 100) AS good, count_if(value > 100) AS bad, CAST(sum(CASE WHEN value <= 100 THEN length(props) ELSE 0 END) AS BIGINT) AS chars FROM events""")
def stream_warehouse(spark, sf):
    e = _stored(spark, sf, "events", EVENTS).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("original_text"), "value"
    )
    warehouse, quarantine = shared_folder(spark, "stream-warehouse"), shared_folder(spark, "stream-quarantine")
    streams.warehouse_sink(
        e, warehouse, quarantine, shared_folder(spark, "stream-warehouse-checkpoint"), rules=lambda: {"value": F.col("value") <= 100},
        to_rows=lambda good: good.select("id", "timestamp", F.length("original_text").alias("chars")),
    ).awaitTermination()
    good = spark.read.parquet(warehouse).agg(F.count("*").alias("good"), F.sum("chars").alias("chars"))
    bad = readers.read_quarantine(spark, quarantine).agg(F.count("*").alias("bad"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.agg(F.max("good").alias("good"), F.max("bad").alias("bad"), F.max("chars").alias("chars"))


