"""Joins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import scalars
from notewell.functions.packs import RulePack
from notewell.operators import joins
from workload import tables as t
from workload.registry import lit, query

_TS = """strftime("timestamp", '%Y-%m-%d %H:%M:%S')"""


@query("join_enrich", f"""
SELECT id, client_name, advisor_name, advisor_store, vip_label, action_status, action_type, manager_name FROM ({t.BOARD_SQL})""")
def join_enrich(spark, sf):
    return joins.enrich_notes(t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf)).select(
        "id", "client_name", "advisor_name", "advisor_store", "vip_label", "action_status", "action_type", "manager_name"
    )


@query("join_inner", f"""
SELECT n.id, u.full_name AS advisor_full_name, c.name AS client_name FROM ({t.EVENTS_SQL}) n
JOIN ({t.USERS_SQL}) u ON u.id = n.advisor_id JOIN ({t.CLIENTS_SQL}) c ON c.id = n.client_id""")
def join_inner(spark, sf):
    return joins.recordings(t.event_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf)).select(
        "id", "advisor_full_name", "client_name"
    )


@query("join_recent", f"""
SELECT a.note_id, a.status FROM ({t.ACTIONS_SQL}) a JOIN ({t.ORDERS_SQL}) n ON n.id = a.note_id
WHERE n."timestamp" >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY AND a.status = 'planned' ORDER BY a.updated_at DESC, a.note_id LIMIT 500""")
def join_recent(spark, sf):
    return joins.recent_actions(t.order_actions(spark, sf), t.order_notes(spark, sf), t.ORDERS_END, 365, "planned", limit=500).select("note_id", "status")


@query("merge_results", """
SELECT d.doc_id AS id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def merge_results(spark, sf):
    results = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return joins.merge_results(t.documents(spark, sf), results).select("id", "lang", "quality", "toxic")


@query("user_inventory", f"""
SELECT u.id, u.role, u.score, count(n.id) AS notes_count, strftime(max(n."timestamp"), '%Y-%m-%d %H:%M:%S') AS last_note
FROM ({t.USERS_SQL}) u LEFT JOIN ({t.EVENTS_SQL}) n ON n.advisor_id = u.id GROUP BY ALL""")
def user_inventory(spark, sf):
    return joins.user_inventory(t.users(spark, sf), t.event_notes(spark, sf)).select(
        "id", "role", "score", "notes_count", F.date_format("last_note_at", "yyyy-MM-dd HH:mm:ss").alias("last_note")
    )


# words of the generated prose; ASCII words with non-ASCII neighbours exercise the boundaries
LEXICON = {
    "article": ("the", "and", "this"), "french": ("les", "des", "elle", "dans"), "german": ("der", "und", "nicht"),
    "spanish": ("los", "para", "que"), "pair": ("of the", "de la"),
    "long": ("and attion to thanedble the", "be the over to", "in of the and"), "marked": ("the, anea.", "an. the", "it, the"),
}


def _word(text: str, word: str) -> str:
    return f"regexp_matches({text}, {lit('(?:^|[^\\p{L}\\p{N}])' + re.escape(word) + '(?:$|[^\\p{L}\\p{N}])')})"


_TAGS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {' OR '.join(_word('lower(text)', w) for w in words)} THEN '{tag}' END" for tag, words in LEXICON.items()
) + ")"


@query("tag_lexicon", f"SELECT doc_id AS id, {_TAGS} AS tags FROM documents")
def tag_lexicon(spark, sf):
    pack = RulePack.from_keywords("words", LEXICON)
    return joins.tag_by_lexicon(t.documents(spark, sf), "text", pack).select("id", F.array_join("tags", ",").alias("tags"))


@query("tag_lexicon_table", f"SELECT doc_id AS id, unnest(string_split({_TAGS}, ',')) AS tag FROM documents WHERE {_TAGS} <> ''")
def tag_lexicon_table(spark, sf):
    rows = [(tag, w, k) for k, (tag, words) in enumerate(LEXICON.items()) for w in words]
    lexicon = spark.createDataFrame(rows, "tag string, keyword string, position int")
    return joins.tag_by_lexicon_table(t.documents(spark, sf), lexicon, "id", "text")


@query("tag_lexicon_trie", f"SELECT doc_id AS id, unnest(string_split({_TAGS}, ',')) AS tag FROM documents WHERE {_TAGS} <> ''")
def tag_lexicon_trie(spark, sf):
    rows = [(tag, w, k) for k, (tag, words) in enumerate(LEXICON.items()) for w in words]
    lexicon = spark.createDataFrame(rows, "tag string, keyword string, position int")
    return joins.tag_by_lexicon_trie(t.documents(spark, sf), lexicon, "id", "text")


_RUN = "list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_PHRASES = f"SELECT DISTINCT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT {_RUN} AS w FROM benchmark))"


@query("tag_benchmark_phrases", f"""
WITH p AS ({_PHRASES.replace("{{", "{").replace("}}", "}")}),
d AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+') AS w, string_split_regex(lower(text), '[\p{{L}}\p{{N}}]+') AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w, s FROM d),
r AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT doc_id, w, s, unnest(generate_series(1, len(w) - 1)) AS i FROM c) WHERE s[i + 1] = ' ')
SELECT doc_id AS id, phrase AS tag FROM r JOIN p USING (phrase)""")
def tag_benchmark_phrases(spark, sf):
    """Thousands of two-word keywords: every pair of neighbouring words of the benchmark, looked up in all documents."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.concat_ws(" ", F.element_at("__w", i), F.element_at("__w", i + 1)))
    phrases = t.table(spark, sf, "benchmark").select(w.alias("__w")).where(F.size("__w") > 1).select(F.explode(pairs).alias("keyword")).distinct()
    return joins.tag_by_lexicon_trie(t.documents(spark, sf), phrases.withColumn("tag", F.col("keyword")), "id", "text")


@query("known_tags", """
SELECT p_partkey AS id, tag, tag IN (SELECT lower(p_type) FROM part) OR starts_with(tag, 'gift_for_') AS known
FROM (SELECT p_partkey, unnest([string_split(p_name, ' ')[1], lower(p_type), CASE WHEN p_size > 25 THEN 'gift_for_me' ELSE 'other_tag' END]) AS tag FROM part)""")
def known_tags(spark, sf):
    part = t.table(spark, sf, "part")
    tags = part.select(
        F.col("p_partkey").alias("id"),
        F.explode(F.array(F.substring_index("p_name", " ", 1), F.lower("p_type"), F.when(F.col("p_size") > 25, "gift_for_me").otherwise("other_tag"))).alias("tag"),
    )
    return joins.known_tags(tags, part.select(F.lower("p_type").alias("tag"))).select("id", "tag", "known")


VOCABULARY = ["standard", "promotion", "large_size", "small_size", "economy", "medium", "widget", "washer", "gear_wheel", "birthday_gift", "ring"]


@query("fuzzy_tags")
def fuzzy_tags(spark, sf):
    part = t.table(spark, sf, "part")
    tags = part.select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("tag")).unionAll(
        part.select("p_partkey", F.concat(F.lower("p_type"), F.lit("s")))
    ).unionAll(part.select("p_partkey", F.lit("Birthday")))
    return joins.normalize_tags(tags, VOCABULARY)


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("text_key", f"SELECT doc_id AS id, md5('v1:note:' || {_NORM.format('text')}) AS text_key FROM documents")
def text_key(spark, sf):
    return t.documents(spark, sf).select("id", scalars.text_key(F.col("text"), "note").alias("text_key"))


@query("reuse_results", f"""
WITH keyed AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, md5('v1:note:' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_\\s]', '', 'g')) || ' ' || o_custkey) AS k FROM orders),
fresh AS (SELECT k, arg_max(o_totalprice, o_orderdate) AS result, count(*) AS n FROM keyed WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 31536000 SECOND GROUP BY k)
SELECT keyed.o_orderkey AS id, fresh.n IS NOT NULL AS from_cache FROM keyed LEFT JOIN fresh USING (k)""")
def reuse_results(spark, sf):
    orders = t.table(spark, sf, "orders").withColumn("text", F.concat_ws(" ", "o_orderpriority", "o_custkey"))
    results = orders.select(
        scalars.text_key(F.col("text"), "note").alias("cache_key"), F.col("o_orderdate").alias("cached_at"), F.col("o_totalprice").alias("result")
    )
    notes = orders.select(F.col("o_orderkey").alias("id"), "text")
    return joins.reuse_results(notes, results, t.ORDERS_END, "note", ttl_seconds=31536000).select("id", "from_cache")


# every order is a note some days after its date; the finished ones are stored results of their date
_ASOF_TTL = 90 * 86400


@query("reuse_as_of", f"""
WITH keyed AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS ts, md5('v1:note:' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_\\s]', '', 'g')) || ' ' || (o_custkey % 50)) AS k FROM orders),
stored AS (SELECT k, o_orderdate AS cached_at, max(o_orderkey) AS result FROM keyed WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT n.o_orderkey AS id, CASE WHEN fresh THEN strftime(r.cached_at, '%Y-%m-%d') END AS cached_on, CASE WHEN fresh THEN r.result END AS result, coalesce(fresh, false) AS from_cache
FROM (SELECT n.*, r.cached_at, r.result, r.cached_at >= n.ts - INTERVAL {_ASOF_TTL} SECOND AS fresh FROM keyed n ASOF LEFT JOIN stored r ON n.k = r.k AND n.ts >= r.cached_at) r JOIN keyed n USING (o_orderkey)""")
def reuse_as_of(spark, sf):
    orders = t.table(spark, sf, "orders").withColumn("text", F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")))
    results = orders.where("o_orderstatus = 'F'").select(
        scalars.text_key(F.col("text"), "note").alias("cache_key"), F.col("o_orderdate").cast("timestamp").alias("cached_at"), F.col("o_orderkey").alias("result")
    )
    notes = orders.select(F.col("o_orderkey").alias("id"), "text", F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(CAST(o_orderkey % 40 AS INT))").alias("ts"))
    out = joins.reuse_as_of(notes, results, "note", ttl_seconds=_ASOF_TTL)
    return out.select("id", F.date_format("cached_at", "yyyy-MM-dd").alias("cached_on"), "result", "from_cache")


@query("stock_flag", """
SELECT l_orderkey, l_linenumber, p.p_size % 10 <> 0 OR p.p_partkey IS NULL AS in_stock
FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey AND p.p_type <> 'PROMO'""")
def stock_flag(spark, sf):
    matches = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("sku"))
    stock = t.products(spark, sf).where("category2 <> 'PROMO'")
    return joins.with_stock(matches, stock).select("l_orderkey", "l_linenumber", "in_stock")


@query("contains_join", """
WITH q AS (SELECT DISTINCT lower(p_name) AS needle FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT 'customer#00000000' || (n_nationkey % 10) FROM nation),
h AS (SELECT c_custkey AS id, lower(c_name || ' ' || c_mktsegment) AS hay FROM customer UNION ALL
      SELECT p_partkey + 10000000, lower(p_name || ' ' || p_brand) FROM part)
SELECT needle, min(id) AS id FROM q JOIN h ON contains(hay, needle) GROUP BY needle""")
def contains_join(spark, sf):
    part, customer, nation = (t.table(spark, sf, n) for n in ("part", "customer", "nation"))
    needles = part.select(F.col("p_name").alias("needle")).unionAll(part.select("p_brand")).unionAll(
        nation.select(F.concat(F.lit("Customer#00000000"), (F.col("n_nationkey") % 10).cast("string")))
    )
    hay = customer.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("hay")).unionAll(
        part.select((F.col("p_partkey") + 10000000), F.concat_ws(" ", "p_name", "p_brand"))
    )
    return joins.contains_join(needles, hay, "needle", "hay", "id")
