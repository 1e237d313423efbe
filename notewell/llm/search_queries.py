"""Registered queries of the prefix trie, the URL filter and the ranked search, with their SQL."""

from __future__ import annotations

from notewell.llm import prefix_trie, ranked_search, url_filter
from notewell.llm.registry import query
from notewell.llm.tables import table

#: CRC32 of a decimal number's characters, bit by bit.
CRC32 = (
    "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), "
    "lambda crc, byte: list_reduce([xor(crc, byte)] || range(8)::BIGINT[], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"
)
TRIE_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY c),
h AS (SELECT c, own, {CRC32.format("c")} % 9 AS h FROM o),
r AS (SELECT a.c, coalesce(b.own[1 : a.h], []) || a.own[a.h + 1 :] AS s FROM h a LEFT JOIN o b ON b.c = a.c - a.c % 5),
p AS (SELECT c, s, unnest(generate_series(0, len(s))) AS d FROM r),
m AS (SELECT s[1 : d] AS k, d, c, len(s) = d AS is_end FROM p),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256 FROM m GROUP BY k, d),
k AS (SELECT n.*, (SELECT count(*) FROM n y WHERE y.d = n.d + 1 AND y.k[1 : n.d] = n.k) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(k[d].text) ELSE 0 END AS own_saved FROM n),
a AS (SELECT k[1 : e] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS e FROM k) GROUP BY 1)
SELECT k.conv_id, CAST(k.d AS INTEGER) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.k = k.k LEFT JOIN n u ON k.d > 0 AND u.d = k.d - 1 AND u.k = k.k[1 : k.d - 1]
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _url_sql(order: int) -> str:
    """The models level by level, as ``url_filter`` counts and mixes them."""
    fits = "WHEN (host = '{0}' OR host LIKE '%.{0}') AND path LIKE '{1}%' THEN {2} "
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    cases = [" ".join(fits.format(rule.partition("/")[0], "/" + rule.partition("/")[2], f"'{value}'") for says, rule in ordered for value in [(rule, says)[k]]) for k in (0, 1)]
    ctes = [f"""p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE {cases[0]} END AS rule, CASE {cases[1]} END AS said FROM p),
d AS (SELECT url, min(said) AS said FROM r WHERE url IS NOT NULL GROUP BY url),
f AS (SELECT *, said IS NOT NULL AND md5(url)[1] IN ('0', '1', '2') AS held FROM d),
o AS (SELECT url, said, held, substr(repeat(chr(2), {order}) || url || chr(3), i, {order + 1}) AS gram FROM (SELECT *, unnest(generate_series(1, length(url) + 1)) AS i FROM f)),
g{order} AS (SELECT gram, count(*) FILTER (WHERE said = 'allow' AND NOT held) AS n_allow, count(*) FILTER (WHERE said = 'block' AND NOT held) AS n_block FROM o GROUP BY gram)"""]
    for k in range(order - 1, -1, -1):
        ctes.append(f"g{k} AS (SELECT substr(gram, 2) AS gram, sum(n_allow) AS n_allow, sum(n_block) AS n_block FROM g{k + 1} GROUP BY 1)")
    for k in range(order + 1):
        lower = f"JOIN c{k - 1} l ON l.gram = substr(g.gram, 2)" if k else ""
        parts = ", ".join(
            f"CASE WHEN sum(n_{s}) OVER w >= {url_filter.LEAST} THEN (n_{s} + count(*) FILTER (WHERE n_{s} > 0) OVER w * {before}) / CAST(sum(n_{s}) OVER w + count(*) FILTER (WHERE n_{s} > 0) OVER w AS DOUBLE) ELSE {before} END AS p_{s}"
            for s in url_filter.SIDES for before in [f"l.p_{s}" if k else f"CAST({1 / url_filter.CHARACTERS} AS DOUBLE)"]
        )
        ctes.append(f"c{k} AS (SELECT g.gram, {parts} FROM g{k} g {lower} WINDOW w AS (PARTITION BY substr(g.gram, 1, {k})))")
    ctes.append(f"""x AS (SELECT gram, CASE WHEN (SELECT count(DISTINCT said) FROM d) < 2 THEN 0 ELSE CAST(round((ln(p_allow) - ln(p_block)) * {url_filter.UNIT}) AS BIGINT) END AS ratio FROM c{order}),
s AS (SELECT url, any_value(said) AS said, CASE WHEN count(*) > 1 THEN CAST(sum(ratio) AS DOUBLE) / count(*) / {url_filter.UNIT} ELSE 0 END AS score FROM o JOIN x USING (gram) WHERE said IS NULL OR held GROUP BY url),
b AS (SELECT CAST(floor(greatest(least(score, 20), -20) * 100) AS BIGINT) AS step, said FROM s WHERE said IS NOT NULL),
z AS (SELECT l, (SELECT count(*) FROM b WHERE said = 'allow' AND step >= l) * (SELECT count(*) FROM b WHERE said = 'block') + (SELECT count(*) FROM b WHERE said = 'block' AND step < l) * (SELECT count(*) FROM b WHERE said = 'allow') AS good
      FROM (SELECT 0 AS l UNION SELECT step FROM b UNION SELECT step + 1 FROM b)),
y AS (SELECT CASE WHEN (SELECT count(DISTINCT said) FROM b) < 2 THEN 0 ELSE (SELECT l FROM z ORDER BY good DESC, abs(l), l LIMIT 1) END / 100.0::DOUBLE AS limit_)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, host, path, rule, coalesce(r.said, CASE WHEN coalesce(score, 0) >= (SELECT limit_ FROM y) THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN s USING (url)"""


@query("op12_url_filter", _url_sql(url_filter.ORDER))
def op12_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


TERMS_OF = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SEARCH_SQL = f"""
WITH
i2 AS (SELECT item_id, text, unnest({TERMS_OF}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT item_id, text, term, count(*) AS c FROM i2 GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS_OF} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, s GROUP BY term, big_n),
x AS (SELECT item_id, text, row, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op13_ranked_search", SEARCH_SQL)
def op13_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
