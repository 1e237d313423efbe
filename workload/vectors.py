"""Vector search, catalogue matching, clustering, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import vectors as vec
from notewell.operators import vector_index, vectors
from notewell.plans import catalog as match
from workload import tables as t
from workload.registry import any_contains, lit, query

_E = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
_PAIRS = f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, a.label AS ql, b.label AS il, list_cosine_similarity(a.e, b.e) AS s FROM ({_E}) a, ({_E}) b"


def _vectors(spark, sf):
    return t.table(spark, sf, "embeddings")


@query("normalize_vectors", f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS total, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM ({_E})")
def normalize_vectors(spark, sf):
    v = vectors.normalize_vectors(_vectors(spark, sf))
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("cosine", f"""
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM ({_E}) a JOIN ({_E}) b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    a = _vectors(spark, sf).select("vec_id", F.col("embedding").alias("a"))
    b = _vectors(spark, sf).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(vec.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


_TEXT_ID = "'V' || lpad(CAST({} AS VARCHAR), 9, '0')"


@query("knn", f"""
SELECT {_TEXT_ID.format("query_id")} AS query_id, {_TEXT_ID.format("item_id")} AS item_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ({_PAIRS}) WHERE query_id <> item_id) WHERE rank <= 5""")
def knn(spark, sf):
    v = _vectors(spark, sf).withColumn("vec_id", F.concat(F.lit("V"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    return vectors.knn(v, v, 5, skip_same=True).withColumn("score", F.round("score", 6))


@query("hybrid_search", f"""
SELECT query_id, item_id, round(s, 4) AS score, round(1 - s, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ({_PAIRS}) WHERE il IN (1, 3, 5) AND il <> 3) WHERE rank <= 3""")
def hybrid_search(spark, sf):
    v = _vectors(spark, sf)
    return vectors.hybrid_search(v, v, [("label", "$in", [1, 3, 5]), ("label", "$ne", 3)], 3, block_rows=64)  # many blocks


# vectors with structure: each is moved along the axis of its label, so that labels form clusters
_C = "SELECT vec_id, label, list_transform(e, lambda x, i: x + CASE WHEN i = label + 1 THEN 20 ELSE 0 END) AS e FROM (" + _E + ")"
_CLUSTER_PAIRS = f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS il, list_cosine_similarity(a.e, b.e) AS s FROM ({_C}) a, ({_C}) b"
_PRUNED = {"cell_rows": 128, "block_rows": 512}


def _clustered(spark, sf):
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("label"), 20).otherwise(0))
    return _vectors(spark, sf).withColumn("embedding", moved)


@query("knn_pruned", f"""
SELECT query_id, item_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ({_CLUSTER_PAIRS}) WHERE query_id <> item_id) WHERE rank <= 5""")
def knn_pruned(spark, sf):
    v = _clustered(spark, sf)
    return vector_index.knn(v, v, 5, skip_same=True, **_PRUNED).withColumn("score", F.round("score", 6))


@query("knn_pruned_work")
def knn_pruned_work(spark, sf):
    """Per round how many groups were visited and how many pairs were scored, and all pairs there are."""
    v = _clustered(spark, sf)
    found = vector_index.search(vector_index.build(v, cell_rows=_PRUNED["cell_rows"]), v, 5, skip_same=True)
    return found.visits.groupBy("round").agg(F.count("*").alias("visits"), F.sum("items").alias("scored_pairs"), F.lit(v.count() ** 2).alias("all_pairs"))


@query("hybrid_search_pruned", f"""
SELECT query_id, item_id, round(s, 4) AS score, round(1 - s, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ({_CLUSTER_PAIRS}) WHERE il IN (1, 3, 5) AND il <> 3) WHERE rank <= 3""")
def hybrid_search_pruned(spark, sf):
    v = _clustered(spark, sf)
    return vectors.hybrid_search(v, v, [("label", "$in", [1, 3, 5]), ("label", "$ne", 3)], 3, vector_index.knn, **_PRUNED)


@query("semantic_reuse", f"""
SELECT vec_id AS id, vec_id AS match_id, 1e0 AS score, 'exact' AS kind FROM embeddings WHERE label = 0 UNION ALL
SELECT query_id, item_id, round(s, 6), 'similar' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ({_PAIRS}) WHERE ql = il AND query_id <> item_id AND ql <> 0) WHERE rank = 1 AND s >= 0.3""")
def semantic_reuse(spark, sf):
    number = F.col("vec_id").cast("string")
    rows = _vectors(spark, sf).select(F.col("vec_id").alias("id"), number.alias("number"), "label", "embedding")
    new = rows.withColumn("text", F.concat_ws(" ", F.when(F.col("label") == 0, "same").otherwise("new"), "number"))
    seen = rows.withColumn("text", F.concat_ws(" ", F.when(F.col("label") == 0, "same").otherwise("seen"), "number"))
    return vectors.semantic_reuse(new, seen, 0.3, key="label", skip_same=True).withColumn("score", F.round("score", 6))


# --- catalogue: the part with the number of a vector is the product, the order with it is the need ----

_GOODS = f"SELECT vec_id AS item_id, p_name AS name, p_retailprice AS price, p_name || ' ' || p_type AS text, e FROM ({_E}) JOIN part ON p_partkey = vec_id"
_NEEDS = f"SELECT vec_id AS id, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 500) + 400 AS BIGINT) AS budget, e FROM ({_E}) JOIN orders ON o_orderkey = vec_id"
_COLOR = "CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'blue' ELSE '' END"


# in the queries named _all every part and order counts; vectors go round: the one with the number modulo their count

_ROUND = f"({_E}) JOIN {{0}} ON vec_id = {{1}} % (SELECT count(*) FROM embeddings)"
_ALL_GOODS = f"SELECT p_partkey AS item_id, p_name AS name, p_retailprice AS price, p_name || ' ' || p_type AS text, e FROM {_ROUND.format('part', 'p_partkey')}"
_NEED = "SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 500) + 400 AS BIGINT) AS budget"
_ALL_NEEDS = f"{_NEED}, e FROM {_ROUND.format('orders', 'o_orderkey')}"


def _frames(spark, sf, every=False):
    v, part, orders = _vectors(spark, sf), t.table(spark, sf, "part"), t.table(spark, sf, "orders")
    count = F.lit(max(v.count(), 1)) if every else None

    def number(key):
        return key % count if every else key

    goods = v.join(part, v.vec_id == number(part.p_partkey)).select(
        F.col("p_partkey").alias("item_id"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") % 10).alias("stock"), "embedding",
    )
    return match.build_query(_needs(v.join(orders, v.vec_id == number(orders.o_orderkey)), "embedding")), goods


def _needs(orders, *more):
    color = F.when(F.col("o_orderpriority") == "1-URGENT", "red").when(F.col("o_orderpriority") == "2-HIGH", "blue")
    none = F.array().cast("array<string>")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.lit("a bag").alias("text"), *more, F.array_compact(F.array(color)).alias("colors"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("widget"))).otherwise(none).alias("produits_mentionnes"), none.alias("categories"),
        (F.floor(F.col("o_totalprice") / 500) + 400).alias("budget_specific"), F.lit(None).cast("string").alias("budget_potential"),
    )


_QUERY = f"""
SELECT id, concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN 'widget' END, nullif({_COLOR}, ''), 'sac') AS primary_query, 'bags' AS category_filter, {_COLOR} AS color_filter,
  budget * 0.75e0 AS price_low, budget * 1.25e0 AS price_high, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'widget' END, 'sac', 'iconique', 'maroquinerie') AS boost_keywords, 'bags' AS intents FROM """


@query("build_query", f"{_QUERY}({_NEEDS})")
def build_query(spark, sf):
    return _query_rows(_frames(spark, sf)[0])


@query("build_query_all", f"{_QUERY}({_NEED} FROM orders)")
def build_query_all(spark, sf):
    return _query_rows(match.build_query(_needs(t.table(spark, sf, "orders"))))


def _query_rows(q):
    return q.select("id", "primary_query", "category_filter", F.array_join("color_filter", ",").alias("color_filter"), "price_low", "price_high",
                    F.array_join("boost_keywords", ",").alias("boost_keywords"), F.array_join("intents", ",").alias("intents"))


def _color_sql(color: str) -> str:
    return any_contains("lower(g.text)", fv.COLOR_ALIASES[color])


_OK = f"""(g.price BETWEEN n.budget * 0.75e0 AND n.budget * 1.25e0) AND ({_COLOR} = '' OR ({_COLOR} = 'red' AND {_color_sql('red')}) OR ({_COLOR} = 'blue' AND {_color_sql('blue')}))"""
_ADJ = f"""least(1e0, greatest(0e0, s + CASE WHEN {any_contains('lower(text)', fv.APPAREL_TERMS)} THEN -0.30e0 ELSE 0 END + CASE WHEN {any_contains('lower(text)', fv.BAG_TERMS)} THEN 0.18e0 ELSE 0 END
  + CASE WHEN color <> '' AND contains(lower(text), color) THEN 0.06e0 ELSE 0 END + CASE WHEN contains(lower(text), 'sac') OR (o_orderstatus = 'F' AND contains(lower(text), 'widget')) THEN 0.06e0 ELSE 0 END))"""


def _candidates_sql(needs: str, goods: str) -> str:
    return f"""
WITH c AS (SELECT n.id, g.item_id, g.text, {_COLOR} AS color, n.o_orderstatus, list_cosine_similarity(n.e, g.e) AS s FROM ({needs}) n, ({goods}) g WHERE {_OK}),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, item_id) AS r FROM c) WHERE r <= 18),
adj AS (SELECT *, {_ADJ} AS a FROM short)
SELECT query_id, item_id, match_score FROM (SELECT id AS query_id, item_id, round(a, 2) AS match_score, row_number() OVER (PARTITION BY id ORDER BY round(a, 2) DESC, s DESC, item_id) AS rr FROM adj WHERE a >= 0.2) WHERE rr <= 3"""


@query("product_candidates", _candidates_sql(_NEEDS, _GOODS))
def product_candidates(spark, sf):
    q, goods = _frames(spark, sf)
    return match.match_products(q, goods, 3, 0.2, pruned=False).select("query_id", "item_id", "match_score")


@query("product_candidates_all", _candidates_sql(_ALL_NEEDS, _ALL_GOODS))
def product_candidates_all(spark, sf):
    q, goods = _frames(spark, sf, every=True)
    return match.match_products(q, goods, 3, 0.2).select("query_id", "item_id", "match_score")


@query("rerank", f"""
SELECT p_partkey, round(least(1e0, greatest(0e0, p_size / 50e0 + CASE WHEN contains(p_name, 'red') THEN 0.06e0 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 0.06e0 ELSE 0 END
  + CASE WHEN {any_contains("lower(p_name || ' pant')", fv.APPAREL_TERMS)} THEN -0.3e0 + 0.08e0 ELSE 0 END)), 6) AS score FROM part""")
def rerank(spark, sf):
    score = match.rerank(
        F.col("p_size") / 50.0, F.concat_ws(" ", "p_name", F.lit("pant")), F.array(F.lit("bags"), F.lit("apparel")), F.array(F.lit("red")), F.array(F.lit("ring")), F.lit("watches")
    )
    return t.table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


_ALIASES = " ".join(f"WHEN {lit(k)} THEN {any_contains('lower(c)', v)}" for k, v in fv.CATEGORY_ALIASES.items())


@query("category_match", f"""
SELECT p_partkey, CASE tgt {_ALIASES} ELSE contains(lower(c), tgt) END AS category_ok, {any_contains('p_name', fv.COLOR_ALIASES['red'])} OR {any_contains('p_name', fv.COLOR_ALIASES['blue'])} AS color_ok
FROM (SELECT *, CASE WHEN p_size > 30 THEN 'Sac cuir' WHEN p_size > 10 THEN 'Montre' ELSE p_type END AS c, CASE WHEN p_size % 2 = 0 THEN 'bags' ELSE lower(p_type) END AS tgt FROM part)""")
def category_match(spark, sf):
    size = F.col("p_size")
    cat = F.when(size > 30, "Sac cuir").when(size > 10, "Montre").otherwise(F.col("p_type"))
    target = F.when(size % 2 == 0, "bags").otherwise(F.lower("p_type"))
    return t.table(spark, sf, "part").select(
        "p_partkey", match.matches_category(cat, target).alias("category_ok"), match.matches_color(F.col("p_name"), F.array(F.lit("red"), F.lit("blue"))).alias("color_ok")
    )


@query("kmeans")
def kmeans(spark, sf):
    return vectors.cluster(_vectors(spark, sf), 6).groupBy("cluster").agg(F.count("*").alias("n"))


@query("pca3")
def pca3(spark, sf):
    out = vectors.reduce_dims(_vectors(spark, sf), 3)
    return out.select("vec_id", F.size("coords").alias("dims"))
