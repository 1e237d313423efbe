"""Filters, projections, paging, sorting, set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import lists, scalars
from notewell.operators import dedup, filters, paging
from notewell.plans import board
from notewell.session import cut_lineage
from workload import tables as t
from workload.registry import any_contains, lit, query

_TS = """strftime("timestamp", '%Y-%m-%d %H:%M:%S')"""


def _ts(col="timestamp"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias("ts")


@query("filter_time_window", f"""
SELECT id, {_TS} AS ts, tier FROM ({t.EVENTS_SQL}) WHERE "timestamp" >= TIMESTAMP '2024-01-23' AND "timestamp" <= TIMESTAMP '2024-01-30'""")
def filter_time_window(spark, sf):
    from notewell.plans import metrics

    rows = filters.in_window(t.event_notes(spark, sf), "timestamp", end=t.END, window="7d")
    return metrics.parse_notes(rows).select("id", _ts(), "tier")


@query("filter_day", f"""
SELECT id, advisor_id, {_TS} AS ts FROM ({t.EVENTS_SQL}) WHERE CAST("timestamp" AS DATE) = DATE '2024-01-15'""")
def filter_day(spark, sf):
    return filters.on_day(t.event_notes(spark, sf), "timestamp", "2024-01-15").select("id", "advisor_id", _ts())


@query("filter_search", r"""
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ed w%' OR p_brand ILIKE '%ed w%' UNION ALL
SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE '%#2%'""")
def filter_search(spark, sf):
    part = t.table(spark, sf, "part")
    a = filters.search(part, ["p_name", "p_brand"], "ED w").select("p_partkey", "p_name")
    b = filters.search(part, ["p_brand"], "#2").select("p_partkey", F.col("p_brand").alias("p_name"))
    return a.unionAll(b)


@query("search_literal_wildcards", "SELECT count(*) AS hits FROM documents WHERE contains(lower(text), '%%%') OR contains(lower(source), 'c_1')")
def search_literal_wildcards(spark, sf):
    return filters.search(t.documents(spark, sf), ["text"], "%%%").unionAll(
        filters.search(t.documents(spark, sf), ["source"], "c_1")
    ).agg(F.count("*").alias("hits"))


@query("filter_ids", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 7, 77, 777)")
def filter_ids(spark, sf):
    return filters.with_ids(t.table(spark, sf, "orders"), "o_orderkey", "1, 7,77,777").select("o_orderkey", "o_orderstatus")


@query("filter_ids_table", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filter_ids_table(spark, sf):
    toxic = t.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return filters.with_ids(t.table(spark, sf, "documents"), "doc_id", toxic).select("doc_id", "lang", "n_chars")


@query("filter_products", f"""
SELECT sku, name, price_eur FROM ({t.PRODUCTS_SQL}) WHERE category1 = 'Brand#2' AND price_eur >= 900 AND price_eur <= 1050 AND name ILIKE '%in%' AND stock > 0""")
def filter_products(spark, sf):
    return filters.filter_products(t.products(spark, sf), "Brand#2", 900.0, 1050.0, "in", True).select("sku", "name", "price_eur")


@query("filter_metadata_ops", """
WITH p AS (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS brand, CASE WHEN p_size > 5 THEN p_size END AS size, p_retailprice AS price FROM part)
SELECT 'eq' AS op, count(*) AS n FROM p WHERE brand IS NOT DISTINCT FROM 'Brand#3' UNION ALL
SELECT 'ne', count(*) FROM p WHERE brand IS DISTINCT FROM 'Brand#3' UNION ALL
SELECT 'gt', count(*) FROM p WHERE size > 20 UNION ALL SELECT 'gte', count(*) FROM p WHERE size >= 20 UNION ALL
SELECT 'lt', count(*) FROM p WHERE size < 20 UNION ALL SELECT 'lte', count(*) FROM p WHERE size <= 20 UNION ALL
SELECT 'in', count(*) FROM p WHERE brand IN ('Brand#1', 'Brand#2') UNION ALL
SELECT 'nin', count(*) FROM p WHERE NOT coalesce(brand IN ('Brand#1', 'Brand#2'), false) UNION ALL
SELECT 'and', count(*) FROM p WHERE price >= 950 AND brand IN ('Brand#1', 'Brand#2') AND size IS DISTINCT FROM 7""")
def filter_metadata_ops(spark, sf):
    p = t.table(spark, sf, "part").select(
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    pair = ["Brand#1", "Brand#2"]
    rules = {
        "eq": [("brand", "$eq", "Brand#3")], "ne": [("brand", "$ne", "Brand#3")],
        "gt": [("size", "$gt", 20)], "gte": [("size", "$gte", 20)], "lt": [("size", "$lt", 20)], "lte": [("size", "$lte", 20)],
        "in": [("brand", "$in", pair)], "nin": [("brand", "$nin", pair)],
        "and": [("price", "$gte", 950), ("brand", "$in", pair), ("size", "$ne", 7), ("absent", "$eq", 1)],
    }
    parts = [filters.apply_filters(p, f).agg(F.lit(n).alias("op"), F.count("*").alias("n")) for n, f in rules.items()]
    return dedup.union_notes(parts)


@query("filter_results", f"""
SELECT id, tier FROM ({t.EVENTS_SQL}) WHERE tier = 3 AND contains_sensitive AND transcription ILIKE '%purchase%'""")
def filter_results(spark, sf):
    from notewell.plans import metrics

    return filters.filter_results(metrics.parse_notes(t.event_notes(spark, sf)), 3, "PURCHASE", True).select("id", "tier")


@query("filter_opportunities", f"""
SELECT id AS note_id, advisor_name, priority_score, action_status FROM ({t.BOARD_SQL})
WHERE urgency_level = 3 AND action_status = 'planned' AND lower(advisor_name) = 'supplier#000000007'
  AND contains(lower(concat_ws(' ', client_name, advisor_name, 'Relance conseiller recommandee.', vip_label, budget_label)), 'customer#')""")
def filter_opportunities(spark, sf):
    rows = board.opportunity_rows(t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf))
    kept = filters.filter_opportunities(rows, " SUPPLIER#000000007", "urgent", "planned", "Customer#")
    return kept.select(F.col("id").alias("note_id"), "advisor_name", "priority_score", "action_status")


@query("filter_empty", """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN '   ' WHEN lang = 'es' THEN NULL ELSE text END AS text,
  CASE WHEN lang <> 'es' THEN source END AS source FROM documents)
SELECT count(*) AS "rows", count_if(text IS NULL AND source IS NULL) AS empty_rows, count_if(NOT (text IS NULL AND source IS NULL) AND coalesce(trim(text), '') = '') AS blank_texts FROM d""")
def filter_empty(spark, sf):
    d = t.documents(spark, sf).select(
        F.when(F.col("lang") == "de", "   ").when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lang") != "es", F.col("source")).alias("source"),
    )
    return filters.count_empty(d, "text")


@query("drop_empty", "SELECT doc_id AS id, n_chars FROM documents WHERE lang NOT IN ('de', 'es')")
def drop_empty(spark, sf):
    d = t.documents(spark, sf).withColumn(
        "text", F.when(F.col("lang") == "de", "   ").when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("text"))
    )
    return filters.drop_empty(d, "text").select("id", "n_chars")


@query("null_literals", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_name AS name FROM customer""")
def null_literals(spark, sf):
    c = t.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", " NaN ").otherwise(F.concat(F.col("c_mktsegment"), F.lit("  "))).alias("segment"),
        F.concat(F.lit(" "), "c_name").alias("name"),
    )
    return filters.null_literals(c)


@query("high_signal", f"""
SELECT id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 18 OR
  ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in fv.HIGH_SIGNAL_WORDS)}) >= 2 AS high_signal FROM ({t.ORDER_TEXTS_SQL})""")
def high_signal(spark, sf):
    return t.order_texts(spark, sf).select("id", scalars.is_high_signal(F.col("text")).alias("high_signal"))


@query("validate_notes", """
SELECT doc_id AS id, concat_ws(',', CASE WHEN length(text) < 10 THEN 'too_short' END, CASE WHEN length(text) > 10000 THEN 'too_long' END,
  CASE WHEN contains(lower(text), '<script') THEN 'script_tag' END) AS errors,
  CASE WHEN upper(lang) IN ('FR', 'EN', 'IT', 'ES', 'DE') THEN upper(lang) ELSE 'FR' END AS lang FROM documents UNION ALL
SELECT page_id, concat_ws(',', CASE WHEN length(html) < 10 THEN 'too_short' END, CASE WHEN length(html) > 10000 THEN 'too_long' END,
  CASE WHEN contains(lower(html), '<script') THEN 'script_tag' END), 'EN' FROM pages""")
def validate_notes(spark, sf):
    d = filters.validate_notes(t.documents(spark, sf))
    p = filters.validate_notes(t.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("en-gb").alias("lang")))
    return d.select("id", F.array_join("errors", ",").alias("errors"), "lang").unionAll(
        p.select("id", F.array_join("errors", ",").alias("errors"), "lang")
    )


_GAP = {g: (any_contains("lower(text)", w), any_contains("tags", c)) for g, (w, c) in fv.GAP_GROUPS.items()}


@query("tag_gaps", f"""
SELECT count_if({_GAP['profession'][0]} AND NOT {_GAP['profession'][1]}) AS profession_gap,
  count_if({_GAP['relation'][0]} AND NOT {_GAP['relation'][1]}) AS relation_gap,
  count_if({any_contains('lower(text)', fv.GAP_ALLERGY)}) AS allergy,
  count_if({any_contains('lower(text)', fv.GAP_ALLERGY)} AND {any_contains('lower(text)', fv.GAP_SEVERITY)}) AS allergy_severity
FROM (SELECT text, CASE WHEN o_orderpriority = '1-URGENT' THEN 'gift_for_spouse' ELSE 'watches' END AS tags FROM ({t.ORDER_TEXTS_SQL}))""")
def tag_gaps(spark, sf):
    notes = t.order_texts(spark, sf).withColumn(
        "tags", F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "gift_for_spouse").otherwise("watches"))
    )
    return filters.tag_gap_counts(notes, "text", "tags")


@query("preview", """
SELECT doc_id AS id, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 60) || '...' ELSE flat END AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)""")
def preview(spark, sf):
    return t.documents(spark, sf).select("id", scalars.preview(F.col("text"), 60).alias("preview"))


# --- sorting, paging ------------------------------------------------------------------------------

@query("topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk(spark, sf):
    return paging.topk(t.table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 25, "p_partkey")


@query("shortlist_rerank", """
WITH s AS (SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30)
SELECT p_partkey, p_retailprice + CASE WHEN contains(p_name, 'red') THEN 100 ELSE 0 END AS score FROM s ORDER BY score DESC, p_partkey LIMIT 5""")
def shortlist_rerank(spark, sf):
    short = paging.shortlist(t.table(spark, sf, "part"), "p_retailprice", "p_partkey", 5)
    scored = short.select("p_partkey", (F.col("p_retailprice") + F.when(F.col("p_name").contains("red"), 100).otherwise(0)).alias("score"))
    return paging.topk(scored, "score", 5, "p_partkey")


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(spark, sf):
    orders = t.table(spark, sf, "orders")
    return paging.page(orders, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3, 50).select("o_orderkey", "o_totalprice")


@query("page_deep", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET (SELECT (count(*) // 100) * 50 FROM lineitem)")
def page_deep(spark, sf):
    """A page in the middle of the order, far behind the first rows."""
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    order = [F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return paging.page(lines, order, lines.count() // 100 + 1, 50, near=1000).select("l_orderkey", "l_linenumber")


@query("page_info", "SELECT count(*) AS total, 3 AS page, 50 AS page_size, CAST(ceil(count(*) / 50e0) AS BIGINT) AS total_pages FROM orders")
def page_info(spark, sf):
    return paging.page_info(t.table(spark, sf, "orders"), 3, 50)


def _sorted_sql(order: str) -> str:
    return f"SELECT id AS note_id FROM ({t.BOARD_SQL}) ORDER BY {order}, id LIMIT 40"


@query("sort_modes", "SELECT 'priority' AS mode, note_id FROM (" + _sorted_sql("priority_score DESC") + ") UNION ALL SELECT 'recent', note_id FROM ("
       + _sorted_sql('"timestamp" DESC') + ") UNION ALL SELECT 'budget', note_id FROM (" + _sorted_sql("budget_value DESC")
       + ") UNION ALL SELECT 'urgency', note_id FROM (" + _sorted_sql("urgency_level DESC, priority_score DESC") + ")")
def sort_modes(spark, sf):
    rows = board.opportunity_rows(t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf))
    rows = rows.withColumnRenamed("id", "note_id")
    return dedup.union_notes(
        [paging.sort_opportunities(rows, m).limit(40).select(F.lit(m).alias("mode"), "note_id") for m in paging.SORT_MODES]
    )


def _ranked_sql(mode: str, order: str) -> str:
    return f"SELECT {lit(mode)} AS mode, id AS note_id, row_number() OVER (ORDER BY {order}, id) AS rank FROM ({t.BOARD_SQL})"


@query("sort_ranks", " UNION ALL ".join(_ranked_sql(mode, order) for mode, order in {
    "priority": "priority_score DESC", "recent": '"timestamp" DESC NULLS LAST', "budget": "coalesce(budget_value, 0) DESC", "urgency": "urgency_level DESC, priority_score DESC"}.items()))
def sort_ranks(spark, sf):
    """``sort_modes`` over the whole order: every row of every mode."""
    rows = board.opportunity_rows(t.order_notes(spark, sf), t.users(spark, sf), t.clients(spark, sf), t.order_actions(spark, sf))
    rows = rows.select(F.col("id").alias("note_id"), "priority_score", "timestamp", "budget_value", "urgency_level")
    rows = cut_lineage(rows, "opportunities")
    return dedup.union_notes(
        [paging.ranked_opportunities(rows, m).select(F.lit(m).alias("mode"), "note_id", "rank") for m in paging.SORT_MODES]
    )


@query("candidate_pool", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 600")
def candidate_pool(spark, sf):
    return paging.recent_candidates(t.order_notes(spark, sf), 60).select("id")


@query("top_tags", """
SELECT tag, count(*) AS "count" FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY 2 DESC, tag LIMIT 10""")
def top_tags(spark, sf):
    return paging.top_tags(t.part_tags(spark, sf), "actual", 10)


# --- set operations ------------------------------------------------------------------------------------

@query("union_inputs", """
SELECT doc_id AS id, NULL AS label, 'doc' AS kind FROM documents UNION ALL SELECT item_id, NULL, 'benchmark' FROM benchmark UNION ALL
SELECT doc_id, CAST(quality AS INTEGER), 'label' FROM labels""")
def union_inputs(spark, sf):
    a = t.documents(spark, sf).select("id", F.lit("doc").alias("kind"))
    b = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"))
    c = t.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), F.lit("label").alias("kind"))
    return dedup.union_notes([a, b, c])


@query("dedup_keep_first", "SELECT min(doc_id) AS id, lang, any_value(n_chars) AS n_chars FROM documents GROUP BY text, lang")
def dedup_keep_first(spark, sf):
    return dedup.dedup_notes(t.documents(spark, sf)).select("id", "lang", "n_chars")


_MERGED = "[string_split(p_name, ' ')[1], lower(p_type), string_split(p_name, ' ')[2]]"


@query("merge_unique", f"""
SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), string_split(p_name, ' ')[1]]))), ',') AS merged,
  CAST(len(list_distinct({_MERGED})) AS INTEGER) AS n FROM part""")
def merge_unique(spark, sf):
    merged = lists.merge_unique(
        F.transform("actual", lambda v: F.concat(F.lit(" "), v)), F.concat("expected", F.array(F.lit(" "), F.lit(None).cast("string")))
    )
    return t.part_tags(spark, sf).select("id", F.array_join(F.array_sort(merged), ",").alias("merged"), F.size(merged).alias("n"))


@query("dedup_ci", """
SELECT p_partkey AS id, concat_ws(',', w1, CASE WHEN w2 <> w1 THEN w2 END, CASE WHEN lower(p_type) NOT IN (w1, w2) THEN p_type END) AS deduped
FROM (SELECT *, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part)""")
def dedup_ci(spark, sf):
    mixed = F.concat("actual", F.transform("actual", lambda v: F.upper(v)), F.array("p_type"))
    return t.part_tags(spark, sf).select("id", F.array_join(lists.dedup_ci(mixed), ",").alias("deduped"))


@query("dedup_sentences")
def dedup_sentences(spark, sf):
    return dedup.dedup_sentences(t.documents(spark, sf), "text").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("duplicates_removed").alias("removed"), F.sum(F.length("text")).alias("chars")
    )
