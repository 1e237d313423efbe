"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.llm import chat_format, decontamination, embedding_dedup, language_id, near_dedup, packing, quality_model, sharding, suffix_dedup, toxicity
from notewell.llm.labelled import held
from notewell.llm.registry import query
from notewell.llm.tables import table

CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.*, perspective,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
        text || '<|end|>' || chr(10) AS body
      FROM t JOIN p USING (conv_id)),
w AS (SELECT *, length(head || body) AS width FROM r),
s AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
SELECT conv_id, perspective, turn,
       CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
       CASE WHEN role <> 'system' AND role <> perspective THEN role END AS name,
       head || body AS segment, CAST(start AS BIGINT) AS start, CAST(start + width AS BIGINT) AS "end",
       CAST(CASE WHEN role = perspective THEN start + length(head) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = perspective THEN start + width - 1 END AS BIGINT) AS mask_end
FROM s
"""


@query("op2_chat_format", CHAT_SQL)
def op2_chat_format(spark, sf_dir):
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version", "next_shard", "next_version",
    )


def scored(spark, sf_dir, operator, column, modulus, rest, least):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label")).where(~held(modulus, rest))
    rows = operator.score(docs, operator.fit(docs, labels))
    return rows.select("doc_id", held(modulus, rest).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return scored(spark, sf_dir, toxicity, "toxic", 5, 0, 0.5)


@query("op9_quality_model")
def op9_quality_model(spark, sf_dir):
    return scored(spark, sf_dir, quality_model, "quality", 4, 2, 0.7)


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = docs.where(~held(3, 1)).select("doc_id", F.col("lang").alias("label"))
    rows = language_id.predict(docs, language_id.fit(docs, labels))
    return rows.select("doc_id", held(3, 1).alias("held_out"), "lang_pred", "score")


WORDS_OF = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
DECONTAMINATION_SQL = f"""
WITH iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {WORDS_OF.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[p : p + least(len(w), 10) - 1] AS win
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM win),
dw AS (SELECT doc_id, coalesce({WORDS_OF.format("text")}, []) AS w FROM documents),
dwin AS (SELECT doc_id, k, p, w[p : p + k - 1] AS win FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS p FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, k, p FROM dwin JOIN win USING (win)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def op6_decontamination(spark, sf_dir):
    rows = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (vec_id)
"""


@query("op10_embedding_dedup", EMBEDDING_SQL)
def op10_embedding_dedup(spark, sf_dir):
    rows = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))
