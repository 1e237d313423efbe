"""Merges into stored tables, and streams whose sinks and states hold only what they must."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notewell.operators import mutate
from notewell.plans import metrics
from notewell.sources.keyed_store import KeyedTable, replacing
from notewell.streaming import streams


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS sku", "concat('n', id) AS name", "id * 1.5 AS price")
    return KeyedTable.create(rows, str(tmp_path / "t"), ["sku"], 16)


def replace(old, new):
    return mutate.upsert(old, new, ["sku"]).drop("change")


def test_merge_touches_only_its_buckets(spark, table):
    before = files(f"{table.root}/rows")
    changes = spark.createDataFrame([(7, "seven", 1.0), (9999, "new", 2.0)], "sku long, name string, price double")
    seen = []

    def combine(old, new):
        seen.extend((old.count(), table.read().where("sku = 9999").count()))  # a reader during the merge
        return replace(old, new)

    assert table.merge(changes, combine) == 1
    assert 0 < seen[0] < 200 and seen[1] == 0
    after = files(f"{table.root}/rows")
    assert all(after[f] == t for f, t in before.items())
    assert {f for f in after if f not in before} and all("__stored=1" in f for f in after if f not in before)
    found = {r["sku"]: r["name"] for r in table.read().collect()}
    assert len(found) == 501 and found[7] == "seven" and found[9999] == "new" and found[8] == "n8"
    assert table.read(0).where("sku = 9999").isEmpty() and table.read(0).count() == 500


def test_failed_merge_is_not_seen_and_can_be_repeated(spark, table):
    changes = spark.createDataFrame([(1, "x", 0.0)], "sku long, name string, price double")
    broken = F.udf(lambda s: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        table.merge(changes, lambda old, new: replace(old, new).withColumn("name", broken("name")))
    assert table.versions() == [0] and table.read().count() == 500
    table.merge(changes, replace)
    assert table.read().where("sku = 1").first()["name"] == "x"


def test_repeated_batch_changes_nothing(spark, table):
    add = spark.createDataFrame([(1, "a", 0.0)], "sku long, name string, price double")
    assert table.merge(add, replace, batch=0) == 1
    before = files(table.root)
    assert table.merge(add.withColumn("name", F.lit("again")), replace, batch=0) == 1
    assert files(table.root) == before
    assert table.merge(add.withColumn("name", F.lit("next")), replace, batch=1) == 2


def test_rows_can_leave_and_old_versions_expire(spark, table):
    for k in range(4):
        gone = spark.range(k * 100, k * 100 + 100).selectExpr("id AS sku", "'' AS name", "-1D AS price")
        table.merge(gone, replacing(["sku"], F.col("price") < 0))
    assert table.read().count() == 100
    assert table.expire(1) > 0
    assert table.versions() == [4] and table.read().count() == 100
    empty = KeyedTable.create(spark.createDataFrame([], table.schema), table.root + "-empty", ["sku"])
    assert empty.read().count() == 0 and empty.read().columns == ["sku", "name", "price"]


def test_daily_refresh_touches_only_its_days(spark, tmp_path):
    def rows(days):
        values = [(f"n{d}-{k}", START + timedelta(days=d, hours=k), f"s{k % 2}", "a", 1, 10.0, 0.1, 0.5, 50.0, 5, k == 0, False) for d, n in days for k in range(n)]
        names = "note_id string, timestamp timestamp, store_id string, advisor_id string, tier_used int, processing_time_ms double, cost_usd double, confidence_score double, quality_score double, points_awarded int, is_vic boolean, cache_hit boolean"
        return spark.createDataFrame(values, names)

    warehouse, target, whole = (str(tmp_path / n) for n in ("w", "t", "whole"))
    assert len(metrics.append_and_refresh(rows([(d, 4) for d in range(5)]), warehouse, {target: metrics.daily_metrics})) == 5
    before = files(target)
    days = metrics.append_and_refresh(rows([(4, 3), (5, 2)]), warehouse, {target: metrics.daily_metrics})
    assert [d.day for d in days] == [5, 6]
    after = files(target)
    assert {f for f, t in before.items() if after.get(f) == t} == {f for f in before if "2024-01-05" not in f}
    metrics.refresh_daily(spark, warehouse, whole, [START.date() + timedelta(days=d) for d in range(6)])
    assert sorted(map(str, spark.read.parquet(target).collect())) == sorted(map(str, spark.read.parquet(whole).collect()))
    assert spark.read.parquet(target).agg(F.sum("note_count")).first()[0] == 25
    metrics.refresh_daily(spark, warehouse, target, [])
    assert files(target) == after


START = datetime(2024, 1, 1)
EVENTS = "ts timestamp, client_id long, value double, step string, profile string, text string"


def arrive(spark, folder, days):
    """One file per list of (hours since the start, client)."""
    for rows in days:
        data = [(START + timedelta(hours=h), c, float(h), "done", "p", f"note {c}") for h, c in rows]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return streams.note_stream(spark, folder, EVENTS, files_per_trigger=1)


def held(progress):
    return [op["numRowsTotal"] for p in progress for op in p["stateOperators"][:1]]


def test_windows_end_and_late_rows_are_left_out(spark, tmp_path):
    days = [[(24 * d + h, d) for h in range(0, 24, 3)] for d in range(10)]
    days[6] += [(24 * 1 + 5, 99)]  # five days late
    days[5] += [(24 * 4 + 5, 98)]  # a day late, its window is still open
    progress = []
    out = streams.run_available(streams.step_metrics(arrive(spark, str(tmp_path / "in"), days)), "t-windows", progress=progress)
    got = {r["window_start"].day: r["events"] for r in out.collect()}
    assert got == {d + 1: 8 + (d == 4) for d in range(8)}  # the last two windows are not over
    assert max(held(progress)) <= 4 and sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 1


def test_states_of_texts_end(spark, tmp_path):
    days = [[(24 * d + h, h + 24 * (d % 5)) for h in range(10)] for d in range(10)]  # each text again after five days
    progress = []
    out = streams.run_available(streams.dedup_stream(arrive(spark, str(tmp_path / "in"), days)), "t-texts", progress=progress)
    assert out.count() == 100  # beyond the time to live a text is new again
    assert max(held(progress)) <= 40 and held(progress)[-1] <= 20
    same = [[(h, 5) for h in (0, 3, 6)], [(9, 5), (12, 5)]]
    assert streams.run_available(streams.dedup_stream(arrive(spark, str(tmp_path / "same"), same)), "t-same").count() == 1


def runs(days, ttl, delay):
    """Client states by plain loops: contacts that are not late, cut where a gap is longer than the time to live."""
    state, late, seen, before = {}, 0, 0, 0
    for rows in days:
        late, before = before, seen
        for h, c in sorted(rows):
            if h > late - delay or not late:
                count, total, last = state.get(c, (0, 0.0, None))
                if last is not None and h - last > ttl:
                    count, total = 0, 0.0
                state[c] = (count + 1, total + h, h)
        seen = max([seen, *(h for h, _ in rows)])
    return {c: (n, round(t / n, 6)) for c, (n, t, last) in state.items() if last + ttl >= seen - delay}


def test_client_states_equal_loops_and_idle_clients_leave(spark, tmp_path):
    days = [[(24 * d + h, (d * 7 + h) % 23) for h in range(24)] for d in range(10)]
    days[3] += [(24 * 3 + 1, 50), (24 * 3 + 23, 50)]
    days[9] += [(24 * 2, 51), (24 * 9 + 1, 50)]  # 51 is late; 50 comes back after its timer
    progress = []
    notes = arrive(spark, str(tmp_path / "in"), days).withColumnRenamed("value", "sentiment_score")
    table = streams.run_merged(streams.client_state_stream(notes, ttl_ms=30 * 3_600_000), "t-clients", ["client_id"], F.col("idle"), progress=progress)
    assert {r["client_id"]: (r["total_interactions"], round(r["sentiment_score"], 6)) for r in table.read().collect()} == runs(days, 30, 24)
    assert len(table.versions()) <= 2 and min(held(progress)[2:]) < max(held(progress))


def test_merged_stream_holds_changed_rows_only(spark, tmp_path):
    days = [[(24 * d + h, 100 * d + h) for h in range(5)] for d in range(6)]
    stream = streams.progress(arrive(spark, str(tmp_path / "in"), days), "client_id")
    written = []
    original = KeyedTable.merge

    def merge(self, changes, combine, batch=None):
        written.append(changes.count())
        return original(self, changes, combine, batch)

    KeyedTable.merge = merge
    try:
        table = streams.run_merged(stream, "t-progress", ["client_id"])
    finally:
        KeyedTable.merge = original
    assert max(written) == 5 and table.read().count() == 30
