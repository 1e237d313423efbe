"""The driver's tables seen as notes, users, clients, actions, feedback, products and vectors.

Every view is derived by Spark from whole tables. ``*_SQL`` are the same views for the
comparison engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.operators import dedup
from notewell.session import spread

END = datetime(2024, 1, 30, 0, 0, 0)
ORDERS_END = datetime(2001, 8, 1, 0, 0, 0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- events as stored notes ------------------------------------------------------------

EVENTS_SQL = """
SELECT event_id AS id, user_id AS advisor_id, k AS client_id, ts AS "timestamp", event_type, value, k,
  event_type <> 'error' AS parsed,
  CASE WHEN event_type <> 'error' AND k % 5 IN (1, 2, 3) THEN k % 5 ELSE 1 END AS tier,
  CASE WHEN event_type <> 'error' AND k % 10 <> 0 THEN k / 100e0 END AS confidence,
  CASE WHEN event_type NOT IN ('error', 'view') THEN value * 100e0 END AS processing_time_ms,
  event_type <> 'error' AND k % 4 = 0 AS from_cache,
  event_type <> 'error' AND k % 3 = 0 AS contains_sensitive,
  CASE event_type WHEN 'purchase' THEN 15 WHEN 'click' THEN 10 ELSE 5 END AS points_awarded,
  ((k % 21) - 10) / 10e0 AS sentiment_score,
  concat(event_type, '  ', props) AS transcription
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def event_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored notes: events with a JSON payload; 'error' events carry a malformed one."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    payload = F.to_json(
        F.struct(
            F.struct((k % 5).alias("tier"), F.when(k % 10 != 0, k / 100.0).alias("confidence")).alias("routing"),
            F.when(F.col("event_type") != "view", F.col("value") * 100.0).alias("processing_time_ms"),
            (k % 4 == 0).alias("from_cache"),
            F.struct(
                (k % 3 == 0).alias("contains_sensitive"),
                F.array(F.concat(F.lit("cat"), (k % 4).cast("string")), F.lit("any")).alias("categories_detected"),
            ).alias("rgpd"),
            F.struct(
                F.array(F.concat(F.lit("tag"), (k % 7).cast("string")), F.concat(F.lit("Tag"), (k % 5).cast("string"))).alias("tags"),
                F.struct(
                    F.col("event_type").alias("urgency"),
                    F.concat(k.cast("string"), F.lit("K")).alias("budget_potential"),
                    F.struct(F.when(k % 2 == 0, F.concat(F.lit("call "), F.col("event_type"))).alias("description")).alias("next_best_action"),
                ).alias("pilier_4_action_business"),
            ).alias("extraction"),
            F.concat(F.lit("note "), k.cast("string")).alias("processed_text"),
        )
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("advisor_id"),
        k.cast("bigint").alias("client_id"),
        F.col("ts").alias("timestamp"),
        F.concat("event_type", F.lit("  "), "props").alias("transcription"),
        F.when(F.col("event_type") == "error", F.lit('{"routing": {"tier": ')).otherwise(payload).alias("analysis_json"),
        F.when(F.col("event_type") == "purchase", 15).when(F.col("event_type") == "click", 10).otherwise(5).alias("points_awarded"),
        ((k % 21) - 10).cast("double").__truediv__(10.0).alias("sentiment_score"),
        "event_type", "value", "k",
    )


FEEDBACK_SQL = """
SELECT event_id AS id, ts AS created_at, k,
  ['t' || (k % 5), 'T' || (k % 7)] AS predicted, ['t' || (k % 5), 't' || (k % 3)] AS corrected,
  list_distinct(['t' || (k % 5), 't' || (k % 7)]) AS pset, list_distinct(['t' || (k % 5), 't' || (k % 3)]) AS cset,
  k % 5 + 1 AS rating, k % 3 + 1 AS processing_tier, nullif(k % 4, 0) AS actual_tier
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""
JACCARD_SQL = "len(list_intersect(pset, cset)) / len(list_distinct(list_concat(pset, cset)))"


def event_feedback(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")

    def tag(prefix: str, n: int):
        return F.concat(F.lit(prefix), (k % n).cast("string"))

    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("note_id"),
        F.col("ts").alias("created_at"),
        F.concat("event_type", F.lit(" "), "props").alias("original_text"),
        F.array(tag("t", 5), tag(" T", 7)).alias("predicted_tags"),
        F.array(tag("t", 5), tag("t", 3)).alias("corrected_tags"),
        F.to_json(F.create_map(tag("field", 3), tag("v", 5))).alias("corrections_json"),
        (k % 5 + 1).alias("rating"),
        (k % 3 + 1).alias("processing_tier"),
        F.nullif(k % 4, F.lit(0)).alias("actual_tier"),
        F.when(k % 6 == 0, F.lit(True)).alias("routing_correct"),
    )


# --- people -------------------------------------------------------------------------------

USERS_SQL = """
SELECT s_suppkey AS id, lower(s_name) || '@shop.example' AS email, s_name AS full_name,
  CASE WHEN s_nationkey < 20 THEN 'advisor' ELSE 'manager' END AS role,
  CAST(floor(s_acctbal) AS BIGINT) AS score, n_name AS store
FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    s = table(spark, sf, "supplier")
    return s.join(nation, s.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lower("s_name"), F.lit("@shop.example")).alias("email"),
        F.col("s_name").alias("full_name"),
        F.when(F.col("s_nationkey") < 20, "advisor").otherwise("manager").alias("role"),
        F.floor("s_acctbal").cast("bigint").alias("score"),
        F.col("n_name").alias("store"),
    )


CLIENTS_SQL = """
SELECT c_custkey AS id, c_name AS name, 'EXT-' || c_custkey AS external_client_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'VIC' WHEN 'MACHINERY' THEN 'Ultimate' WHEN 'FURNITURE' THEN 'Premium' ELSE 'Regular' END AS category,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'VIC' WHEN 'MACHINERY' THEN 'ULTIMATE' ELSE 'Standard' END AS vic_status,
  c_acctbal / 10000e0 AS sentiment_score, CAST(c_nationkey AS BIGINT) AS total_interactions
FROM customer
"""


def clients(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("EXT-"), F.col("c_custkey").cast("string")).alias("external_client_id"),
        F.when(seg == "BUILDING", "VIC").when(seg == "MACHINERY", "Ultimate").when(seg == "FURNITURE", "Premium").otherwise("Regular").alias("category"),
        F.when(seg == "BUILDING", "VIC").when(seg == "MACHINERY", "ULTIMATE").otherwise("Standard").alias("vic_status"),
        (F.col("c_acctbal") / 10000.0).alias("sentiment_score"),
        F.col("c_nationkey").cast("bigint").alias("total_interactions"),
        F.lit(datetime(2023, 12, 1)).alias("last_contact_date"),
        F.lit(None).cast("int").alias("days_since_contact"),
    )


# --- orders as opportunities ------------------------------------------------------------------

ORDERS_SQL = """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey % 25 END AS advisor_id, o_custkey AS client_id,
  o_orderdate AS "timestamp", o_totalprice, o_orderpriority, o_orderstatus,
  CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 1 END AS tier,
  (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0 AS confidence,
  CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'K' AS budget_label,
  floor(o_totalprice / 1000) * 1000e0 AS budget_value,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 3 WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 1 END AS urgency_level,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS urgency
FROM orders
"""
ACTIONS_SQL = """
SELECT o_orderkey AS note_id, o_custkey AS manager_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'call' WHEN '2-HIGH' THEN 'assign' WHEN '3-MEDIUM' THEN 'schedule' ELSE 'other' END AS action_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'planned' WHEN '2-HIGH' THEN 'done' ELSE 'open' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at
FROM orders WHERE o_orderstatus = 'F'
"""
BOARD_SQL = f"""
SELECT n.*, coalesce(u.full_name, 'Inconnu') AS advisor_name, coalesce(u.store, 'N/A') AS advisor_store,
  coalesce(c.name, 'Client inconnu') AS client_name, coalesce(c.vic_status, 'Standard') AS vip_label,
  coalesce(c.vic_status, 'Standard') <> 'Standard' AS is_vip,
  coalesce(a.status, 'open') AS action_status, coalesce(a.action_type, '') AS action_type, m.full_name AS manager_name,
  CASE WHEN coalesce(a.status, 'open') = 'done' THEN 'Action finalisee' WHEN a.action_type = 'call' THEN 'Appel planifie'
    WHEN a.action_type = 'schedule' THEN 'Rappel planifie' WHEN coalesce(a.status, 'open') = 'planned' THEN 'Action planifiee'
    ELSE 'Action en cours' END AS action_label,
  CAST(round_even(CASE n.tier WHEN 3 THEN 30 WHEN 2 THEN 18 ELSE 8 END + n.urgency_level * 15
    + CASE WHEN coalesce(c.vic_status, 'Standard') <> 'Standard' THEN 25 ELSE 0 END
    + least(35e0, CASE WHEN n.budget_value > 0 THEN n.budget_value ELSE 0 END / 2000e0)
    + round_even(n.confidence * 12, 0), 0) AS BIGINT) AS priority_score
FROM ({ORDERS_SQL}) n
LEFT JOIN ({USERS_SQL}) u ON u.id = n.advisor_id
LEFT JOIN ({CLIENTS_SQL}) c ON c.id = n.client_id
LEFT JOIN ({ACTIONS_SQL}) a ON a.note_id = n.id
LEFT JOIN ({USERS_SQL}) m ON m.id = a.manager_id
"""


def order_notes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    tier = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 3).otherwise(1)
    payload = F.to_json(
        F.struct(
            F.struct(tier.alias("tier"), ((F.floor("o_totalprice") % 100) / 100.0).alias("confidence")).alias("routing"),
            F.struct(
                F.struct(
                    F.col("o_orderpriority").alias("urgency"),
                    F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("K")).alias("budget_potential"),
                ).alias("pilier_4_action_business")
            ).alias("extraction"),
        )
    )
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 25).alias("advisor_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.concat_ws(" ", F.lit("order"), F.col("o_orderpriority")).alias("transcription"),
        payload.alias("analysis_json"),
        F.when(F.col("o_orderstatus") == "F", 15).otherwise(10).alias("points_awarded"),
    )


def order_actions(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("note_id"),
        F.col("o_custkey").alias("manager_id"),
        F.when(p == "1-URGENT", "call").when(p == "2-HIGH", "assign").when(p == "3-MEDIUM", "schedule").otherwise("other").alias("action_type"),
        F.when(p == "1-URGENT", "planned").when(p == "2-HIGH", "done").otherwise("open").alias("status"),
        F.lit(None).cast("string").alias("details"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    )


# --- orders and customers as free-text notes ------------------------------------------------------
# One expression, valid in both engines: the sentences depend on the row's own attributes.

NOTE_TEXT = """
concat_ws(' ',
  CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN 'Mme Dubois, VIC, cherche un sac noir.'
    WHEN 'BUILDING' THEN 'Client VIP looking for a watch, birthday gift for his wife.'
    WHEN 'FURNITURE' THEN 'First visit, the lady wants shoes for her daughter or a belt.'
    WHEN 'HOUSEHOLD' THEN 'Regular client, travel bag in smooth leather, vegan, no receipt needed.'
    ELSE 'Monsieur Martin est content du service, comme celui en toile, ceinture rouge.' END,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN 'Urgent, rdv lundi 11h avec son mari.'
    WHEN '2-HIGH' THEN 'Cette semaine, anniversaire de mariage le 12 mars.'
    WHEN '3-MEDIUM' THEN 'Allergie nickel severe, peanut allergy.'
    WHEN '4-NOT SPECIFIED' THEN 'Not interested in leather, retour et retard, erreur.'
    ELSE 'Merci, service excellent!' END,
  CASE o_orderstatus
    WHEN 'F' THEN concat('Budget ', CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS STRING), 'k flexible.')
    WHEN 'O' THEN concat('budget de ', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING), ' euros.')
    ELSE 'Prix luxe.' END)
"""
ORDER_TEXTS_SQL = f"SELECT o_orderkey AS id, o_custkey, c_mktsegment, o_orderpriority, o_totalprice, {NOTE_TEXT} AS text FROM orders JOIN customer ON c_custkey = o_custkey"


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    o, c = spread(table(spark, sf, "orders")), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), "o_custkey", "c_mktsegment", "o_orderpriority", "o_totalprice", F.expr(NOTE_TEXT).alias("text")
    )


def read_once(spark: SparkSession, sf: str, rules, *columns: str) -> DataFrame:
    """The orders' notes (``id`` and the named columns) with what ``rules`` finds in their texts; equal texts are read once."""
    return dedup.per_text(order_texts(spark, sf).select("id", *columns, "text"), rules)


# --- products, vectors ---------------------------------------------------------------------------------

PRODUCTS_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_retailprice AS price_eur, p_brand AS category1, p_type AS category2,
  p_size % 10 AS stock, p_type = 'PROMO' AS is_discount, p_size > 25 AS rag_indexed
FROM part
"""


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"),
        F.lit("").alias("url"),
        F.lit("").alias("image_url"),
        F.col("p_retailprice").alias("price_eur"),
        F.col("p_brand").alias("category1"),
        F.col("p_type").alias("category2"),
        F.lit("").alias("category3"),
        (F.col("p_type") == "PROMO").alias("is_discount"),
        (F.col("p_size") % 10).alias("stock"),
        (F.col("p_size") > 25).alias("rag_indexed"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).withColumnRenamed("doc_id", "id")


def part_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Two tag lists per part: the words of its name, and its type with the first word of the name."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.split("p_name", " ").alias("actual"),
        F.array(F.lower("p_type"), F.substring_index("p_name", " ", 1)).alias("expected"),
        "p_brand", "p_size", "p_retailprice", "p_type",
    )


PART_TAGS_SQL = """
SELECT p_partkey AS id, string_split(p_name, ' ') AS actual, [lower(p_type), string_split(p_name, ' ')[1]] AS expected,
  p_brand, p_size, p_retailprice, p_type FROM part
"""
