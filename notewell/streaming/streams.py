"""Streams of notes and step events.

Sources need an explicit schema. Event times are ``timestamp`` columns (watermarks do
not accept zone-less timestamps). Sinks are file tables, so results never pass through
the driver; checkpoints live in the shared folder of the session.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notewell.functions import packs, scalars, text
from notewell.functions.packs import RulePack
from notewell.operators import quality
from notewell.plans import extract, route
from notewell.session import cut_lineage, shared_folder
from notewell.sources import writers
from notewell.sources.keyed_store import KeyedTable, replacing

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def note_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def enrich_stream(notes: DataFrame, text_col: str = "text", lang: str = "lang", pack: RulePack = packs.EXTRA_KEYWORDS) -> DataFrame:
    """Clean, extract and route every arriving note; identical to the batch columns."""
    cleaned = text.clean_text(notes, text_col, lang)
    return route.route(extract.extract_note(cleaned, "cleaned", pack), "cleaned")


def run_available(stream: DataFrame, name: str, mode: str = "append", progress: list[dict] | None = None) -> DataFrame:
    """Process everything that is available and return the sink table.

    Append results go to a file sink. Complete results, for tables that are small by
    their nature, replace the table of the previous batch. ``progress`` receives what Spark reports of each batch.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    checkpoint = shared_folder(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        _finish(writer.outputMode("append").format("parquet").start(out), progress)
        return spark.read.schema(stream.schema).parquet(out)
    newest: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        newest.append(batch_id)

    _finish(writer.outputMode(mode).foreachBatch(save).start(), progress)
    if not newest:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(newest)}")


def _finish(query: StreamingQuery, progress: list[dict] | None) -> None:
    query.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def run_merged(stream: DataFrame, name: str, keys: Sequence[str], gone: Column | None = None, mode: str = "update",
               buckets: int = 16, progress: list[dict] | None = None) -> KeyedTable:
    """Process everything that is available into a keyed table: each batch brings only the rows that changed.

    A batch that is run again changes nothing (the table knows the last batch), so the sink is
    exactly-once. Rows for which ``gone`` holds leave the table.
    """
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    table = KeyedTable.create(spark.createDataFrame([], stream.schema), root, keys, buckets)
    query = (
        stream.writeStream.option("checkpointLocation", shared_folder(spark, f"{name}-checkpoint")).trigger(availableNow=True)
        .outputMode(mode).foreachBatch(merge_batch(table, gone)).start()
    )
    _finish(query, progress)
    table.expire()
    return table


def merge_batch(table: KeyedTable, gone: Column | None = None) -> Callable[[DataFrame, int], None]:
    def save(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, replacing(table.keys, gone), batch_id)

    return save


def warehouse_sink(stream: DataFrame, warehouse: str, quarantine: str, checkpoint: str,
                   rules: Callable[[], dict[str, Column]], to_rows: Callable[[DataFrame], DataFrame] = writers.to_warehouse,
                   bad_columns: dict[str, str] | None = None) -> StreamingQuery:
    """Good rows to the warehouse, rows that break a rule to quarantine.

    The checked batch is written once to a staging table that both outputs read. Both write below their
    day's folder and, there, below the batch's, so that a retried batch replaces itself.
    """
    names = bad_columns or {"id": "note_id", "original_text": "note_text"}

    def save(batch: DataFrame, batch_id: int) -> None:
        staged = cut_lineage(batch, "staged")
        good, bad = quality.split_valid(staged, rules())
        for old, new in names.items():
            bad = bad.withColumnRenamed(old, new)
        day = F.to_date("timestamp")
        rows = to_rows(good).withColumn("date", day).withColumn("batch_id", F.lit(batch_id))
        dynamic = {"partitionOverwriteMode": "dynamic"}  # only the folders of this batch are replaced
        rows.write.mode("overwrite").options(**dynamic).partitionBy("date", "batch_id").parquet(warehouse)
        lost = writers.quarantine_rows(bad).withColumn("date", F.to_date(F.col("timestamp").cast("timestamp"))).withColumn("batch_id", F.lit(batch_id))
        lost.write.mode("overwrite").options(**dynamic).partitionBy("date", "batch_id").json(quarantine)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def step_metrics(events: DataFrame, window: str = "1 day", delay: str = "1 day", profile: str | None = "profile") -> DataFrame:
    """Count and mean value per step (and profile) in tumbling windows.

    In append mode a window is emitted, and its state ends, when the watermark (the newest event time of earlier
    batches less ``delay``) has passed its end; events of windows that ended before are late and left out.
    """
    keys = [F.window("ts", window).alias("window"), scalars.norm_step(F.col("step")).alias("step")]
    if profile:
        keys.append(F.col(profile))
    grouped = events.withWatermark("ts", delay).groupBy(*keys).agg(
        F.count("*").alias("events"), F.avg("value").alias("avg_value")
    )
    return grouped.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def alert_stream(events: DataFrame) -> DataFrame:
    """Severity of every step event: failures critical, tier-3 routing and sensitive data warnings, else info."""
    step = scalars.norm_step(F.col("step"))
    sensitive = F.col("contains_sensitive") if "contains_sensitive" in events.columns else F.lit(False)
    return events.withColumn("step", step).where("step IS NOT NULL").withColumn(
        "severity",
        F.when(F.col("step") == "failed", "critical")
        .when((F.col("step") == "routing") & (F.col("tier") == 3), "warning")
        .when((F.col("step") == "cleaning") & sensitive, "warning")
        .otherwise("info"),
    )


def newest_alerts(alerts: DataFrame, n: int = 30, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    return alerts.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def progress(events: DataFrame, task: str = "task_id") -> DataFrame:
    """Processed notes and latest status per task; in update mode a batch brings the tasks that changed."""
    step = scalars.norm_step(F.col("step"))
    return events.groupBy(task).agg(
        F.count_if(step == "done").alias("processed"),
        F.count_if(step == "failed").alias("failed"),
        F.count("*").alias("events"),
        F.max(F.struct("ts", step.alias("step"))).alias("__last"),
    ).withColumn("status", F.col("__last.step")).drop("__last")


def scores_stream(points: DataFrame, user: str = "user_id", value: str = "points") -> DataFrame:
    """Running points per user; in update mode a batch brings the users whose points changed."""
    return points.groupBy(user).agg(F.sum(value).alias("score"))


def leaderboard(scores: DataFrame, n: int = 5, user: str = "user_id") -> DataFrame:
    """The best ``n`` of the scores kept so far."""
    return scores.orderBy(F.col("score").desc(), F.col(user)).limit(n)


def dedup_stream(notes: DataFrame, ttl: str = "24 hours", text_col: str = "text", ts: str = "ts", step: str = "note") -> DataFrame:
    """First note of every normalised text within the time to live; a text's state ends when the watermark passes it."""
    keyed = notes.withColumn("text_key", scalars.text_key(F.col(text_col), step))
    return keyed.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["text_key"])


STATE_BUCKETS = 256  # groups of clients that share one state
_HELD = ["client_id", "count", "total", "first", "last", "due"]


def client_state_stream(notes: DataFrame, client: str = "client_id", score: str = "sentiment_score", ts: str = "ts",
                        ttl_ms: int = 30 * 86_400_000, delay: str = "1 day", buckets: int = STATE_BUCKETS) -> DataFrame:
    """Running sentiment, interaction count, first and last contact per client, with a time to live (update mode).

    Every contact restarts the client's timer. A client without contact for ``ttl_ms`` of event time
    loses its state: the timer emits a last row with ``idle``, and a later contact begins anew, also
    where the timer has not fired yet. Contacts behind the watermark are late and left out.

    Clients are dealt over ``buckets`` groups; a group's state holds its clients as columns, and its timer is the earliest of theirs.
    """
    kind = notes.schema[client].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(client), F.lit(buckets)).cast("int").alias("bucket")
    rows = notes.select(bucket, F.col(client).alias("client_id"), F.col(score).cast("double").alias("score"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"))
    out = f"client_id {kind}, sentiment_score double, total_interactions long, first_contact long, last_contact long, idle boolean"

    def contacts(frames, held: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """The state of the clients that these contacts belong to."""
        new = pd.concat([f[["client_id", "ms", "score"]] for f in frames])
        code, clients = pd.factorize(new["client_id"])
        order = np.lexsort((new["ms"].to_numpy(), code))
        code, ms, scores = code[order], new["ms"].to_numpy()[order], np.nan_to_num(new["score"].to_numpy(np.float64)[order], posinf=np.inf, neginf=-np.inf)
        start = np.searchsorted(code, np.arange(len(clients)))
        last = ms[np.append(start[1:], len(code)) - 1]
        begin = start.copy()
        gap = np.flatnonzero((np.diff(ms) > ttl_ms) & (np.diff(code) == 0)) + 1
        np.maximum.at(begin, code[gap], gap)  # the contacts since the last gap
        counted = np.arange(len(code)) >= begin[code]
        now = pd.DataFrame({"client_id": clients, "count": np.bincount(code, counted, len(clients)).astype(np.int64), "total": np.bincount(code, np.where(counted, scores, 0.0), len(clients)), "first": ms[begin], "last": last})
        at = pd.Index(held["client_id"]).get_indexer(clients) if len(held) else np.full(len(clients), -1)
        go_on = at >= 0
        go_on[go_on] = (begin == start)[go_on] & (ms[start][go_on] - held["last"].to_numpy()[at[go_on]] <= ttl_ms)
        old, which = held.iloc[at[go_on]], np.flatnonzero(go_on)
        for name, merge in (("count", np.add), ("total", np.add), ("first", np.minimum), ("last", np.maximum)):
            values = now[name].to_numpy().copy()
            values[which] = merge(old[name].to_numpy(), values[which])
            now[name] = values
        now["due"] = np.maximum(now["last"].to_numpy() + ttl_ms, watermark + 1)
        return now

    def update(key, frames, state: GroupState):
        watermark = state.getCurrentWatermarkMs()
        held = pickle.loads(state.get[0]) if state.exists else pd.DataFrame({n: [] for n in _HELD})
        now = held.iloc[:0] if state.hasTimedOut else contacts(frames, held, watermark)
        rest = held[~held["client_id"].isin(now["client_id"])]
        over = rest["due"].to_numpy() < watermark
        left = [part for part in (now, rest[~over]) if len(part)]
        if left:
            kept = pd.concat(left, ignore_index=True)[_HELD]
            state.update((pickle.dumps(kept),))
            state.setTimeoutTimestamp(int(kept["due"].min()))
        else:
            state.remove()
        for part, idle in ((now, False), (rest[over], True)):
            if len(part):
                yield pd.DataFrame({
                    "client_id": part["client_id"].to_numpy(), "sentiment_score": part["total"].to_numpy() / part["count"].to_numpy(), "total_interactions": part["count"].to_numpy(),
                    "first_contact": part["first"].to_numpy(), "last_contact": part["last"].to_numpy(), "idle": idle,
                })

    watched = rows.where("client_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return watched.groupBy("bucket").applyInPandasWithState(update, out, "clients binary", "update", GroupStateTimeout.EventTimeTimeout)
