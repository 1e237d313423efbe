"""Sources, sinks, table mutation, quality control."""

from __future__ import annotations


from pyspark.sql import functions as F

from notewell.operators import dedup, mutate, quality
from notewell.plans import extract, metrics, route
from notewell.session import cut_lineage, shared_folder
from notewell.sources import readers, writers
from notewell.sources.keyed_store import KeyedTable
from workload import tables as t
from workload.records import PACK
from workload.registry import query


# --- sources and sinks -----------------------------------------------------------------------

@query("io_roundtrip", """
SELECT 'csv' AS fmt, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part UNION ALL SELECT 'json', count(*), CAST(sum(length(p_name)) AS BIGINT) FROM part UNION ALL
SELECT 'parquet', count(*), CAST(sum(length(p_name)) AS BIGINT) FROM part""")
def io_roundtrip(spark, sf):
    rows = t.part_tags(spark, sf).select("id", F.concat_ws(" ", "actual").alias("name"), F.col("actual").alias("tags"))
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = shared_folder(spark, f"results-{fmt}")
        writers.write_results(rows, path, fmt)
        back = readers.read_csv(spark, path) if fmt == "csv" else spark.read.schema("id bigint, name string").format(fmt).load(path)
        parts.append(back.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum(F.length("name")).alias("chars")))
    return dedup.union_notes(parts)


@query("read_notes", """
SELECT upper(lang) AS language, count(*) AS n, count_if(length(text) > 1000) AS long_notes FROM documents GROUP BY 1""")
def read_notes(spark, sf):
    path = shared_folder(spark, "notes-csv")
    t.documents(spark, sf).select(F.col("id").alias("ID "), F.col("text").alias("Note"), F.col("lang").alias(" Language")).write.option("header", "true").option("escape", '"').csv(path)
    notes = readers.read_notes(spark, path)
    return notes.groupBy(F.col("Language").alias("language")).agg(F.count("*").alias("n"), F.count_if(F.length("Transcription") > 1000).alias("long_notes"))


@query("read_latest", "SELECT count(*) AS n FROM part WHERE p_type = 'PROMO'")
def read_latest(spark, sf):
    folder = shared_folder(spark, "runs")
    part = t.table(spark, sf, "part")
    part.repartition(3).write.option("header", "true").csv(f"{folder}/run=1")
    part.where("p_type = 'PROMO'").repartition(5).write.option("header", "true").csv(f"{folder}/run=2")
    return readers.read_latest(spark, folder, "csv", "*.csv").agg(F.count("*").alias("n"))


@query("read_products", "SELECT p_brand AS category1, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def read_products(spark, sf):
    path = shared_folder(spark, "catalogue") + ".csv"
    t.table(spark, sf, "part").select(F.col("p_partkey").alias("product_code"), F.col("p_name").alias("Title"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("category1_code")).write.option("header", "true").csv(path)
    return readers.read_products(spark, path).groupBy("category1").agg(F.count("*").alias("n"), F.round(F.sum("price_eur"), 2).alias("total"))


@query("read_lexicon", "SELECT p_type AS tag, 'FR' AS language, p_brand AS keyword FROM (SELECT DISTINCT p_type, lower(p_brand) AS p_brand FROM part) UNION ALL SELECT DISTINCT p_type, 'EN', 'all' FROM part")
def read_lexicon(spark, sf):
    brands = t.table(spark, sf, "part").groupBy(F.col("p_type").alias("tag_name")).agg(F.array_join(F.collect_set("p_brand"), ", ").alias("keywords_fr"))
    wide = brands.select("tag_name", F.lit("x").alias("category"), "keywords_fr", F.lit("all,").alias("keywords_en"))
    return readers.unpivot_lexicon(wide).select("tag", "language", "keyword")


@query("io_flatten_metrics", f"""
SELECT 'tiers.tier1' AS metric, CAST(count_if(tier = 1) AS VARCHAR) AS value FROM ({t.EVENTS_SQL}) UNION ALL SELECT 'tiers.tier3', CAST(count_if(tier = 3) AS VARCHAR) FROM ({t.EVENTS_SQL}) UNION ALL
SELECT 'kinds', string_agg(DISTINCT event_type, '; ' ORDER BY event_type) FROM ({t.EVENTS_SQL}) UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM ({t.EVENTS_SQL})""")
def io_flatten_metrics(spark, sf):
    notes = metrics.parse_notes(t.event_notes(spark, sf))
    row = notes.agg(
        F.count("*").alias("total"), F.count_if(F.col("tier") == 1).alias("t1"), F.count_if(F.col("tier") == 3).alias("t3"), F.array_sort(F.collect_set("event_type")).alias("kinds")
    )
    nested = row.select("total", F.struct(F.col("t1").alias("tier1"), F.col("t3").alias("tier3")).alias("tiers"), "kinds")
    return writers.flatten_metrics(nested)


def _processed(spark, sf):
    def read(texts):
        return route.route(extract.extract_note(texts, "text", PACK)).select("text", "tier", "estimated_time_ms", "estimated_cost", "extraction")

    return t.read_once(spark, sf, read, "o_custkey", "c_mktsegment").select(
        "id", F.make_timestamp(F.lit(2024), F.lit(1), (F.col("o_custkey") % 28 + 1), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"), F.col("c_mktsegment").alias("store_id"), F.lit("a").alias("advisor_id"),
        "tier", F.col("estimated_time_ms").alias("processing_time_ms"), F.col("estimated_cost").alias("cost_usd"), F.lit(10).alias("points_awarded"),
        F.col("text").alias("original_text"), F.col("text").alias("processed_text"), F.lit(False).alias("cache_hit"), F.lit(False).alias("contains_sensitive"), "extraction",
    )


_DAY = "lpad(CAST(o_custkey % 28 + 1 AS VARCHAR), 2, '0')"


@query("io_warehouse_rows", f"""
SELECT '2024-01-' || {_DAY} AS date, c_mktsegment AS store_id, count(*) AS n, count_if(regexp_matches(text, 'VIC')) AS vics, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({t.ORDER_TEXTS_SQL}) GROUP BY 1, 2""")
def io_warehouse_rows(spark, sf):
    path = shared_folder(spark, "warehouse")
    writers.append_warehouse(writers.to_warehouse(_processed(spark, sf)), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("date").cast("string").alias("date"), "store_id").agg(
        F.count("*").alias("n"), F.count_if("is_vic").alias("vics"), F.sum("original_text_length").alias("chars")
    )




@query("daily_refresh", f"""
SELECT 'store' AS kind, '2024-01-' || {_DAY} AS date, c_mktsegment AS store_id, count(*) AS notes, count_if(regexp_matches(text, 'VIC')) AS vics FROM ({t.ORDER_TEXTS_SQL}) GROUP BY 2, 3""")
def daily_refresh(spark, sf):
    """A-09 and A-10 kept as tables: three loads, each of which recomputes only the days it touches."""
    warehouse, stores, advisors = (shared_folder(spark, name) for name in ("daily-warehouse", "daily-stores", "daily-advisors"))
    rows = cut_lineage(writers.to_warehouse(_processed(spark, sf)), "processed")
    late = F.dayofmonth("timestamp") > 14
    for load in (~late, late & (F.pmod(F.xxhash64("note_id"), F.lit(3)) > 0), late & (F.pmod(F.xxhash64("note_id"), F.lit(3)) == 0)):
        metrics.append_and_refresh(rows.where(load), warehouse, {stores: metrics.daily_metrics, advisors: metrics.advisor_metrics})
    by_store = spark.read.parquet(stores).select(F.lit("store").alias("kind"), F.col("date").cast("string").alias("date"), "store_id", F.col("note_count").alias("notes"), F.col("vic_count").alias("vics"))
    by_advisor = spark.read.parquet(advisors).groupBy("date", "store_id").agg(F.sum("notes_count").alias("notes"), F.sum("vic_served").alias("vics"))
    same = by_advisor.select(F.col("date").cast("string").alias("date"), "store_id", "notes", "vics")
    return by_store.join(same, ["date", "store_id", "notes", "vics"], "left_semi").select(by_store.columns)  # both tables agree on every row


@query("quarantine_sink", """
SELECT error, count(*) AS n, count_if(requires_manual_review) AS manual FROM (
  SELECT concat_ws('; ', CASE WHEN length(text) > 10000 THEN 'not_long' END, CASE WHEN lang = 'es' THEN 'language' END) AS error, true AS requires_manual_review FROM documents) WHERE error <> '' GROUP BY 1""")
def quarantine_sink(spark, sf):
    folder = shared_folder(spark, "quarantine")
    rules = {"not_long": F.length("text") <= 10000, "language": F.col("lang") != "es"}
    _, bad = quality.split_valid(t.documents(spark, sf), rules)
    records = bad.select(F.col("id").cast("string").alias("note_id"), F.col("text").alias("note_text"), "error", "tier_attempted", "retry_count", "requires_manual_review", "metadata")
    writers.write_quarantine(records, folder, F.lit("2024-01-30 10:00:00"))
    return readers.read_quarantine(spark, folder).groupBy("error").agg(F.count("*").alias("n"), F.count_if("requires_manual_review").alias("manual"))


@query("stats_sink", "SELECT count(*) AS total, '2024-01-30' AS exported_at FROM part")
def stats_sink(spark, sf):
    path = shared_folder(spark, "stats")
    writers.write_stats(t.table(spark, sf, "part").agg(F.count("*").alias("total")), path, F.lit("2024-01-30"))
    return spark.read.schema("total bigint, exported_at string").json(path)


@query("cost_log", f"""
SELECT 'gpt-4o' AS model, count(*) AS call_count, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens FROM ({t.EVENTS_SQL})""")
def cost_log(spark, sf):
    path = shared_folder(spark, "cost-log")
    calls = t.event_notes(spark, sf).select(F.col("event_type").alias("step"), F.lit("gpt-4o").alias("model"), F.col("k").alias("input_tokens"), F.col("k").alias("output_tokens"))
    writers.append_cost_log(metrics.token_cost(calls), path, "gpt-4o", F.lit("2024-01-30"))
    schema = "timestamp string, model string, call_count bigint, input_tokens bigint, output_tokens bigint, total_cost_usd double"
    return spark.read.option("header", "true").schema(schema).csv(path).drop("timestamp", "total_cost_usd")


@query("catalogue_export", f"SELECT count(*) AS n, round(sum(price_eur), 2) AS total FROM ({t.PRODUCTS_SQL})")
def catalogue_export(spark, sf):
    path = shared_folder(spark, "export")
    writers.export_products(t.products(spark, sf), path)
    return readers.read_csv(spark, path).agg(F.count("*").alias("n"), F.round(F.sum(F.col("price_eur").cast("double")), 2).alias("total"))


@query("labelling_template", """
SELECT p_partkey AS "ID", 'EN' AS "Language", p_name AS "Transcription", replace(p_name, ' ', ', ') AS llm_tags, '' AS manual_tags, '' AS notes FROM part""")
def labelling_template(spark, sf):
    rows = t.part_tags(spark, sf).select(F.col("id").alias("ID"), F.lit("EN").alias("Language"), F.array_join("actual", " ").alias("Transcription"), F.col("actual").alias("tags"))
    return writers.validation_template(rows)


# --- mutation -------------------------------------------------------------------------------------

@query("upsert", """
WITH src AS (SELECT p_partkey + 1000 AS k, 'new ' || p_name AS name, p_retailprice + 1 AS price FROM part)
SELECT coalesce(p.p_partkey, s.k) AS sku, coalesce(s.name, p.p_name) AS name, coalesce(s.price, p.p_retailprice) AS price,
  CASE WHEN p.p_partkey IS NULL THEN 'inserted' WHEN s.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM part p FULL JOIN src s ON s.k = p.p_partkey""")
def upsert(spark, sf):
    part = t.table(spark, sf, "part")
    target = part.select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    source = part.select((F.col("p_partkey") + 1000).alias("sku"), F.concat(F.lit("new "), "p_name").alias("name"), (F.col("p_retailprice") + 1).alias("price"))
    return mutate.upsert(target, source, ["sku"])


@query("upsert_products", """
WITH src AS (SELECT CASE WHEN p_type = 'PROMO' THEN '' ELSE CAST(p_partkey + 1000 AS VARCHAR) END AS k, CASE WHEN p_type = 'SMALL' THEN ' ' ELSE p_name END AS name FROM part)
SELECT count_if(k <> '' AND trim(name) <> '' AND CAST(k AS BIGINT) NOT IN (SELECT p_partkey FROM part)) AS imported, count_if(k <> '' AND trim(name) <> '' AND CAST(k AS BIGINT) IN (SELECT p_partkey FROM part)) AS updated,
  count_if(k = '') AS missing_sku, count_if(k <> '' AND trim(name) = '') AS missing_name FROM (SELECT nullif(k, '') AS kk, coalesce(k, '') AS k0, * FROM src)""".replace("CAST(k AS BIGINT)", "CAST(kk AS BIGINT)"))
def upsert_products(spark, sf):
    raw = t.table(spark, sf, "part").select(
        F.when(F.col("p_type") == "PROMO", "").otherwise((F.col("p_partkey") + 1000).cast("string")).alias("product_code"),
        F.when(F.col("p_type") == "SMALL", " ").otherwise(F.col("p_name")).alias("title"), F.lit("bad").alias("price"), F.lit("x").alias("stock"),
    )
    changed, rejected = mutate.upsert_products(t.products(spark, sf).drop("rag_indexed"), raw)
    errors = rejected.agg(F.count_if(F.col("error") == "missing_sku").alias("missing_sku"), F.count_if(F.col("error") == "missing_name").alias("missing_name"))
    both = mutate.change_counts(changed).unionByName(errors, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- the same mutations as merges into stored tables ---------------------------------------------------

@query("store_merge_products", """
WITH a AS (SELECT p_partkey + 1000 AS k, 'new ' || p_name AS name, p_retailprice + 1 AS price FROM part),
b AS (SELECT p_partkey AS k, 'sale ' || p_name AS name, p_retailprice / 2 AS price FROM part WHERE p_size > 40)
SELECT sku, CASE WHEN b.k IS NOT NULL THEN b.name ELSE m.name END AS name, CASE WHEN b.k IS NOT NULL THEN b.price ELSE m.price END AS price
FROM (SELECT coalesce(p_partkey, k) AS sku, coalesce(a.name, p_name) AS name, coalesce(a.price, p_retailprice) AS price FROM part FULL JOIN a ON k = p_partkey) m LEFT JOIN b ON b.k = sku""")
def store_merge_products(spark, sf):
    """M-01 on a stored table: two merges; a repeated second one changes nothing."""
    part = t.table(spark, sf, "part")
    start = part.select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    table = KeyedTable.create(start, shared_folder(spark, "products-table"), ["sku"])
    more = part.select((F.col("p_partkey") + 1000).alias("sku"), F.concat(F.lit("new "), "p_name").alias("name"), (F.col("p_retailprice") + 1).alias("price"))
    sale = part.where("p_size > 40").select(F.col("p_partkey").alias("sku"), F.concat(F.lit("sale "), "p_name").alias("name"), (F.col("p_retailprice") / 2).alias("price"))
    for number, changes in enumerate((more, sale, sale)):
        table.merge(changes, lambda old, new: mutate.upsert(old, new, ["sku"]).drop("change"), min(number, 1))
    return table.read()


@query("store_merge_vectors", """
SELECT coalesce(a.vec_id, b.vec_id + 100) AS id, coalesce(-b.label, a.label) AS label, round(coalesce(CAST(b.embedding[2] AS DOUBLE), CAST(a.embedding[1] AS DOUBLE)), 6) AS head, a.vec_id % 7 AS keep
FROM embeddings a FULL JOIN (SELECT * FROM embeddings WHERE label < 5) b ON b.vec_id + 100 = a.vec_id""")
def store_merge_vectors(spark, sf):
    """M-04 on a stored table."""
    v = t.table(spark, sf, "embeddings")
    table = KeyedTable.create(v.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 7).alias("keep")), shared_folder(spark, "vectors-table"), ["id"])
    docs = v.where("label < 5").select((F.col("vec_id") + 100).alias("id"), F.slice("embedding", 2, 63).alias("embedding"), (-F.col("label")).alias("label"))
    table.merge(docs, mutate.upsert_vectors)
    return table.read().select("id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("head"), "keep")


@query("store_merge_actions", f"""
WITH v AS (SELECT o_orderkey AS note_id, o_orderdate + INTERVAL 2 DAY AS updated_at FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 3 = 0)
SELECT coalesce(a.note_id, v.note_id) AS note_id, CASE WHEN v.note_id IS NOT NULL THEN 'call' ELSE a.action_type END AS action_type, CASE WHEN v.note_id IS NOT NULL THEN 'done' ELSE a.status END AS status,
  strftime(coalesce(a.created_at, v.updated_at), '%Y-%m-%d') AS created FROM ({t.ACTIONS_SQL}) a FULL JOIN v ON v.note_id = a.note_id""")
def store_merge_actions(spark, sf):
    """M-05 on a stored table: enums are checked, the note must exist, ``created_at`` survives."""
    o, notes = t.table(spark, sf, "orders"), t.order_notes(spark, sf)
    table = KeyedTable.create(t.order_actions(spark, sf), shared_folder(spark, "actions-table"), ["note_id"])
    updates = o.where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("note_id"), F.lit(1).cast("bigint").alias("manager_id"), F.when(F.col("o_orderpriority") == "5-LOW", "bogus").otherwise(" Call").alias("action_type"),
        F.lit("DONE").alias("status"), F.lit("x").alias("details"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"),
    )
    table.merge(updates, lambda old, new: mutate.upsert_actions(old, new, notes).drop("change"))
    return table.read().select("note_id", "action_type", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("adjust_stock", """
SELECT CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_size % 10 + coalesce(d, 0) < 0 THEN p_size % 10 ELSE p_size % 10 + coalesce(d, 0) END AS stock, p_size % 10 + coalesce(d, 0) < 0 AS rejected
FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS BIGINT) AS d FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def adjust_stock(spark, sf):
    deltas = t.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("sku"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("delta"))
    return mutate.adjust_stock(t.products(spark, sf), deltas).select("sku", "stock", "rejected")


@query("set_stock", """
SELECT CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_type = 'PROMO' THEN p_size % 10 WHEN p_type = 'SMALL' THEN 99 ELSE p_size % 10 END AS stock, p_type = 'PROMO' AS rejected FROM part""")
def set_stock(spark, sf):
    p = t.products(spark, sf)
    values = p.where("category2 IN ('PROMO', 'SMALL')").select("sku", F.when(F.col("category2") == "PROMO", -5).otherwise(99).alias("stock"))
    return mutate.set_stock(p, values).select("sku", "stock", "rejected")


@query("delete_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_keys(spark, sf):
    gone = t.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return mutate.delete_keys(t.table(spark, sf, "customer"), gone, ["c_custkey"]).select("c_custkey")


@query("upsert_vectors", """
SELECT coalesce(a.vec_id, b.vec_id + 100) AS id, coalesce(-b.label, a.label) AS label, round(coalesce(CAST(b.embedding[2] AS DOUBLE), CAST(a.embedding[1] AS DOUBLE)), 6) AS head, a.vec_id % 7 AS keep
FROM embeddings a FULL JOIN embeddings b ON b.vec_id + 100 = a.vec_id""")
def upsert_vectors(spark, sf):
    v = t.table(spark, sf, "embeddings")
    collection = v.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 7).alias("keep"))
    docs = v.select((F.col("vec_id") + 100).alias("id"), F.slice("embedding", 2, 63).alias("embedding"), (-F.col("label")).alias("label"))
    out = mutate.upsert_vectors(collection, docs)
    return out.select("id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("head"), "keep")


@query("upsert_actions", f"""
WITH u AS (SELECT o_orderkey AS note_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'bogus' ELSE 'call' END AS action_type, o_orderdate + INTERVAL 2 DAY AS updated_at FROM orders),
valid AS (SELECT * FROM u WHERE action_type = 'call')
SELECT coalesce(a.note_id, v.note_id) AS note_id, coalesce(v.action_type, a.action_type) AS action_type, CASE WHEN v.note_id IS NOT NULL THEN 'done' ELSE a.status END AS status,
  strftime(coalesce(a.created_at, v.updated_at), '%Y-%m-%d') AS created, CASE WHEN a.note_id IS NULL THEN 'inserted' WHEN v.note_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
FROM ({t.ACTIONS_SQL}) a FULL JOIN valid v ON v.note_id = a.note_id""")
def upsert_actions(spark, sf):
    o = t.table(spark, sf, "orders")
    def update(days, status):
        return o.select(
            F.col("o_orderkey").alias("note_id"), F.lit(1).cast("bigint").alias("manager_id"), F.when(F.col("o_orderpriority") == "5-LOW", "bogus").otherwise(" Call").alias("action_type"),
            F.lit(status).alias("status"), F.lit("x").alias("details"), (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("updated_at"),
        )
    # the later of two updates of a note wins
    out = mutate.upsert_actions(t.order_actions(spark, sf), update(1, "planned").unionAll(update(2, "DONE")), t.order_notes(spark, sf))
    return out.select("note_id", "action_type", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "change")


@query("cascade_delete", f"""
SELECT 'notes' AS kind, count(*) AS n, NULL AS score FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL
SELECT 'actions', count(*), NULL FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' UNION ALL
SELECT 'users', count(*), CAST(sum(greatest(0, u.score - coalesce(p.pts, 0))) AS BIGINT) FROM ({t.USERS_SQL}) u LEFT JOIN (
  SELECT o_custkey % 25 AS aid, sum(CASE WHEN o_orderstatus = 'F' THEN 15 ELSE 10 END) AS pts FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) p ON p.aid = u.id""")
def cascade_delete(spark, sf):
    ids = t.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    notes, actions, users = mutate.delete_notes(t.order_notes(spark, sf), t.order_actions(spark, sf), t.users(spark, sf), ids)
    none = F.lit(None).cast("bigint")
    return dedup.union_notes(
        [
            notes.agg(F.lit("notes").alias("kind"), F.count("*").alias("n"), none.alias("score")),
            actions.agg(F.lit("actions").alias("kind"), F.count("*").alias("n"), none.alias("score")),
            users.agg(F.lit("users").alias("kind"), F.count("*").alias("n"), F.sum("score").alias("score")),
        ]
    )


@query("reset_points", f"SELECT id, CASE WHEN role = 'advisor' THEN 0 ELSE score END AS score, role = 'advisor' AND score <> 0 AS reset FROM ({t.USERS_SQL})")
def reset_points(spark, sf):
    return mutate.reset_points(t.users(spark, sf), "advisor").select("id", "score", "reset")


_BATCH = f"""
SELECT coalesce(c.id, -1) AS id, b.* FROM (SELECT o_orderkey, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'EXT-' || o_custkey END AS ref, CASE WHEN o_orderstatus = 'O' THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name,
  (o_custkey % 5) / 4e0 AS s, o_orderpriority = '1-URGENT' AS vic FROM orders WHERE o_orderstatus <> 'P') b LEFT JOIN ({t.CLIENTS_SQL}) c ON c.external_client_id = b.ref OR lower(c.name) = b.name"""


@query("upsert_clients", f"""
SELECT c.id, CASE WHEN b.vic THEN 'VIC' ELSE c.category END AS category, round(CASE WHEN b.n IS NULL THEN c.sentiment_score ELSE (c.sentiment_score * c.total_interactions + b.s) / (c.total_interactions + b.n) END, 6) AS sentiment_score,
  c.total_interactions + coalesce(b.n, 0) AS total_interactions FROM ({t.CLIENTS_SQL}) c LEFT JOIN (SELECT id, count(*) AS n, sum(s) AS s, bool_or(vic) AS vic FROM ({_BATCH}) GROUP BY 1) b ON b.id = c.id
UNION ALL
SELECT (SELECT max(id) FROM ({t.CLIENTS_SQL})) + row_number() OVER (ORDER BY 'ref:NEW-' || o_custkey), CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'VIC' ELSE 'Regular' END,
  round(sum((o_custkey % 5) / 4e0) / count(*), 6), count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def upsert_clients(spark, sf):
    o = t.table(spark, sf, "orders")
    prefix = F.when(F.col("o_orderstatus") == "F", "EXT-").when(F.col("o_orderstatus") == "P", "NEW-")
    batch = o.select(
        F.concat(prefix, F.col("o_custkey").cast("string")).alias("client_ref"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("client_name"),
        ((F.col("o_custkey") % 5) / 4.0).alias("sentiment"), F.when(F.col("o_orderpriority") == "1-URGENT", "vic").alias("behavior"), F.col("o_orderdate").alias("ts"),
    )
    out = mutate.upsert_clients(t.clients(spark, sf), batch)
    return out.select("id", "category", F.round("sentiment_score", 6).alias("sentiment_score"), "total_interactions")


@query("ingest_feedback", f"""
SELECT id, k % 7 = k % 3 AND false AS was_correct, '["t' || (k % 5) || '"," T' || (k % 7) || '"]' AS predicted_tags_json, CASE WHEN k % 6 = 0 THEN true ELSE actual_tier = processing_tier END AS routing_correct FROM ({t.FEEDBACK_SQL})""")
def ingest_feedback(spark, sf):
    return mutate.ingest_feedback(t.event_feedback(spark, sf)).select("id", "was_correct", "predicted_tags_json", "routing_correct")


# --- quality ------------------------------------------------------------------------------------------

@query("split_valid", """
SELECT concat_ws('; ', CASE WHEN o_totalprice <= 100000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS error, count(*) AS n FROM orders GROUP BY 1""")
def split_valid(spark, sf):
    rules = {"price": F.col("o_totalprice") > 100000, "status": F.col("o_orderstatus") != "P"}
    good, bad = quality.split_valid(t.table(spark, sf, "orders"), rules)
    return good.agg(F.lit("").alias("error"), F.count("*").alias("n")).unionByName(bad.groupBy("error").agg(F.count("*").alias("n")))


@query("constraints", f"""
SELECT 'users' AS "table", 'role_enum' AS rule, 0 AS violations UNION ALL SELECT 'users', 'email_unique', 0 UNION ALL
SELECT 'clients', 'category_enum', 0 UNION ALL SELECT 'clients', 'external_client_id_unique', (SELECT count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1)) UNION ALL
SELECT 'opportunity_actions', 'action_type_enum', (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') UNION ALL SELECT 'opportunity_actions', 'status_enum', 0 UNION ALL
SELECT 'opportunity_actions', 'note_id_unique', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL
SELECT 'products', 'sku_unique', (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))""")
def constraints(spark, sf):
    clients = t.clients(spark, sf).join(t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment")), "id")
    actions = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("note_id"), F.when(F.col("o_orderpriority") == "5-LOW", "mail").otherwise("call").alias("action_type"), F.lit("open").alias("status")
    )
    return quality.check_constraints(
        t.users(spark, sf), clients.withColumn("external_client_id", F.col("c_mktsegment")), actions, t.products(spark, sf).withColumn("sku", F.col("name"))
    )


@query("cleaning_report")
def cleaning_report(spark, sf):
    docs = t.documents(spark, sf).withColumn("text", F.when(F.col("source") == "src3", " ").otherwise(F.col("text")))
    return quality.cleaning_report(docs, quality.cleaned_rows(docs))


@query("clean_dataset")
def clean_dataset(spark, sf):
    kept = quality.clean_dataset(t.documents(spark, sf))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.min("id").alias("first_id"))


@query("preview_dataset", "SELECT 'doc_id,text,lang,source,n_chars' AS columns, count(*) AS row_count, 3 AS sample_rows FROM documents")
def preview_dataset(spark, sf):
    columns, count, sample = quality.preview_dataset(t.table(spark, sf, "documents"))
    n = sample.agg(F.count("*").cast("int").alias("sample_rows"))
    both = count.unionByName(n, allowMissingColumns=True)
    return both.agg(F.lit(",".join(columns)).alias("columns"), F.max("row_count").alias("row_count"), F.max("sample_rows").alias("sample_rows"))


