"""Prefix trie, URL filter and ranked search against brute force and SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from notewell.llm import prefix_trie, ranked_search, url_filter
from notewell.llm.search_queries import RULES
from notewell.llm.tables import with_hot
from tests.llm.conftest import got, odd_rows, sentence
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_url_filter", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


# ---- prefix trie

TURN_SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, depth int"


def conversations(seed=1):
    """A hot first turn, a hot conversation, prefixes of others, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    out = []
    for c in range(1, 90):
        kind = rng.random()
        if kind < 0.3:
            said = ["hello", "yes"]
        elif kind < 0.6:
            said = ["hello", *rng.choices(["a", "b", "é", ""], k=rng.randint(0, 5))]
        else:
            said = rng.choices(["a", "b", None, "hello"], k=rng.randint(1, 12))
        out += [(c, k if rng.random() > 0.05 else None, rng.choice(["user", "user", None]), t) for k, t in enumerate(said)]
    out += [(200, 0, "user", "x" * 50000), (200, 1, "user", "y"), (201, 0, "user", "x" * 50000), (202, 3, "b", "tie"), (202, 3, "a", "tie"), (202, 3, "a", "tie"), (None, 0, "user", "hello"), (-7, 0, "user", "a")]
    out += [(300, k, "user", "deep") for k in range(700)] + [(305, k, "user", "deep") for k in range(699)]
    return [(*r, "k", 1, 2) for r in out]


def brute_trie(sequences):
    """Nodes of ``{conv: [(role, text), ..]}`` by plain dictionaries of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        own = (len(held) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(held), len(p), min(members[p[:-1]]) if p else -1, len(held), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, held in members.items()
    )


def ordered_turns(turns):
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())

    out = defaultdict(list)
    for r in turns:
        if r[0] is not None:
            out[r[0]].append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=key)] for c, v in out.items()}


@pytest.mark.parametrize(("batch", "range_bytes"), [(10000, 1 << 24), (7, 600), (1, 200)])
def test_trie_equals_brute_force(spark, monkeypatch, batch, range_bytes):
    turns = conversations()
    own = ordered_turns(turns)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: h[c]] + s[h[c] :] for c, s in own.items()}
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", range_bytes)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(turns, TURN_SCHEMA).repartition(3)
        for sequences, expected in ((prefix_trie.rebuilt(df), rebuilt), (prefix_trie.sequences(df), own)):
            assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got(prefix_trie.trie(sequences))) == brute_trie(expected)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_trie_of_nothing(spark):
    assert got(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], TURN_SCHEMA)))) == []


def test_search_tree_is_balanced_and_whole():
    tree = prefix_trie.SearchTree()
    for k in prefix_trie.medians(1000):
        tree.insert([k, 5], k)
    steps = []
    for wanted in range(1000):
        here, n = 0, 0
        while tree.turn[here] != wanted:
            here, n = (tree.low if wanted < tree.turn[here] else tree.high)[here], n + 1
        assert tree.row[tree.down[here]] == wanted
        steps.append(n)
    assert max(steps) <= 10
    assert sorted(prefix_trie.medians(17)) == list(range(17))


# ---- URL filter

URLS = [
    "http://A.COM/x", "https://example.com/en/1", "https://www.example.com/en/1", "https://example.com/de?x=/en/", "http://m.example.com/en", "http://example.com#/en/", "http://com", "http://a.com:80/en/",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/esp", "ftp://notcom/", "no scheme", "", None, "http://", "://com/a", "http://b.com//://x.net/es/", "http://ünï.org/ß?q#f", "http://x.org/" + "y" * 30000, "line\nbreak://q.com/\nz",
]
PAGE_SCHEMA = "page_id long, url string, html string, key string, gram string, times int"


def pages():
    rng = random.Random(4)
    out = list(URLS)
    for _ in range(150):
        out.append(f"https://{rng.choice(['shop', 'news', 'www.example'])}{rng.randint(1, 30)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 999)}{rng.choice(['', '.html', '?page=2'])}")
    out += ["https://hot.org/es/1"] * 60
    return [(k if k % 20 else None, u, "", "k", "g", 1) for k, u in enumerate(out)]


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    fits = []
    for says, rule in RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, says))
    return max(fits)[1:] if fits else (None, None)


def brute_models(urls, order):
    """Witten-Bell chances of the longest context seen often enough, by recursion over plain counters."""
    count = Counter()
    for u in urls:
        s = url_filter.START * order + u + url_filter.END
        for i in range(order, len(s)):
            for k in range(order + 1):
                count[s[i - k : i], s[i]] += 1
    total, kinds = Counter(), Counter()
    for (context, _), n in count.items():
        total[context] += n
        kinds[context] += 1

    def chance(context, c):
        lower = chance(context[1:], c) if context else 1 / url_filter.CHARACTERS
        if total[context] < url_filter.LEAST:
            return lower
        return (count[context, c] + kinds[context] * lower) / (total[context] + kinds[context])

    return chance


def test_url_filter_equals_brute_force(spark):
    order, table = 3, pages()
    different = {u: brute_rule(*brute_host_path(u))[1] for _, u, *_ in table if u is not None}
    held = {u for u, says in different.items() if says and hashlib.md5(u.encode()).hexdigest()[0] in "012"}
    models = [brute_models([u for u, s in different.items() if s == side and u not in held], order) for side in url_filter.SIDES]

    def score(u):
        s = url_filter.START * order + u + url_filter.END
        parts = [round((math.log(models[0](s[i - order : i], s[i])) - math.log(models[1](s[i - order : i], s[i]))) * url_filter.UNIT) for i in range(order, len(s))]
        return sum(parts) / len(parts) / url_filter.UNIT if u else 0.0

    steps = [(math.floor(max(-20, min(20, score(u))) * 100), different[u]) for u in held]
    n = Counter(s for _, s in steps)
    limits = {0, *(s for s, _ in steps), *(s + 1 for s, _ in steps)}
    limit = min(limits, key=lambda x: (-sum((s >= x) == (says == "allow") and n["block" if says == "allow" else "allow"] for s, says in steps), abs(x), x)) / 100
    expected = Counter()
    for page, u, *_ in table:
        host, path = brute_host_path(u)
        rule, says = brute_rule(host, path)
        expected[page, host, path, rule, says or ("allow" if score(u or "") >= limit else "block")] += 1
    found = url_filter.judge(spark.createDataFrame(table, PAGE_SCHEMA).repartition(3), RULES, order).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == expected
    for r in found:
        assert (r["score"] is None) == (r["rule"] is not None)
    by_path = {(r["host"], r["path"]): r["score"] for r in found if r["score"] is not None}
    assert abs(by_path["hot.org", "/es/1"] - score("https://hot.org/es/1")) < 1e-5


def test_url_filter_without_labels_or_rows(spark):
    assert got(url_filter.judge(spark.createDataFrame([], PAGE_SCHEMA), RULES)) == []
    unknown = spark.createDataFrame([(1, "http://a.org/", "", "", "", 1), (2, None, "", "", "", 1)], PAGE_SCHEMA)
    assert {r["verdict"] for r in url_filter.judge(unknown, RULES).collect()} == {"allow"}


def test_url_filter_tells_held_out_sides_apart(spark):
    """Junk hosts rejected by one list are recognised on hosts that no rule names."""
    rng = random.Random(9)
    rules = [("allow", "good.test/"), ("block", "bad.test/")]
    urls = [(k, f"http://{rng.choice(['library', 'museum', 'school'])}{k}.good.test/{rng.choice(['paper', 'lesson'])}/{k}") for k in range(200)]
    urls += [(1000 + k, f"http://{rng.choice(['casino', 'pills', 'bets'])}{k}.bad.test/{rng.choice(['win', 'cheap'])}/{k}") for k in range(200)]
    new = [(2000 + k, f"http://{rng.choice(['library', 'school'])}{k}.new.example/{rng.choice(['paper', 'lesson'])}/{k}") for k in range(50)]
    new += [(3000 + k, f"http://{rng.choice(['casino', 'pills'])}{k}.new.example/{rng.choice(['win', 'cheap'])}/{k}") for k in range(50)]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls + new, "page_id long, url string"), rules).collect()}
    assert sum(found[k] == ("allow" if k < 3000 else "block") for k, _ in new) >= 95


def test_hot_keys_join_whole(spark):
    many = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id")
    times = many.groupBy("k").count().withColumnRenamed("count", "times")
    values = spark.range(3000).selectExpr("id AS k", "id * 2 AS v")
    assert sorted(got(with_hot(many, values, times, "k").select("id", "v"))) == sorted((i, 0 if i % 3 == 0 else 2 * i) for i in range(3000))


# ---- ranked search


def brute_search(docs, items, best):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        wanted = Counter(terms(text))
        for i, w in held:
            m = 75 + (25 * len(w) * n_docs) // n_terms
            tf = Counter(w)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in wanted.items())
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("best", "block_bytes", "batch"), [(20, 1 << 20, 4096), (3, 300, 5), (1, 1 << 20, 1)])
def test_search_equals_brute_force(spark, odd, best, block_bytes, batch):
    rng = random.Random(8)
    docs = [(r[0], r[1]) for r in odd_rows()]
    texts = [t for _, t in docs if t]
    items = [(k, " ".join(rng.choices(rng.choice(texts).split() or ["x"], k=rng.randint(1, 30)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, "unknown wordz"), (54, "one two"), (54, "one two"), (54, "three"), (None, "ünï ÇÖDÉ 漢字"), (55, "x X x"), (56, texts[0])]
    benchmark = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, rank int, score long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = got(ranked_search.search(odd, benchmark, best, block_bytes))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expected = brute_search(docs, [r for r in items if r[1] is not None], best)
    assert sorted(found, key=str) == expected


def test_search_of_nothing(spark, none, odd):
    benchmark = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert got(ranked_search.search(none, benchmark)) == []
    assert got(ranked_search.search(odd, benchmark.where("item_id < 0"))) == []


def test_pair_bounds_skip_documents(spark, monkeypatch):
    """With two words that never meet, the pair's bound is that of one word, and most documents are not scored."""
    rng = random.Random(2)
    docs = [(k, f"{'left' if k % 2 else 'right'} {sentence(rng, 20)}") for k in range(400)] + [(900 + k, f"rare{k % 3} rare{k % 3} rare{k % 3}") for k in range(3)]
    names = [f"rare{k}" for k in range(3)]
    items = [(1, "left right " + " ".join(names))]
    found = got(ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), 3))
    assert found == [tuple(r) for r in brute_search(docs, items, 3)]
    batch = ranked_search.pa.RecordBatch.from_pydict({
        "doc_ids": [[1, 2, 3, 4]], "terms": [[10, 20]], "at": [[0, 2, 4]], "place": [[0, 1, 2, 3]], "impact": [[5, 6, 7, 8]], "pair": [[]], "joint": [[]], "pair_at": [[0]], "pair_place": [[]],
    }, schema=ranked_search.pa.schema([(c, ranked_search.pa.list_(ranked_search.pa.int64())) for c in ("doc_ids", "terms", "at", "place", "impact", "pair", "joint", "pair_at", "pair_place")]))
    wanted = ranked_search.Items([], 10)
    np = ranked_search.np
    wanted.vocabulary, wanted.weights, wanted.pairs = np.array([10, 20]), np.array([1, 1]), np.array([[0, 1]])
    shard = ranked_search.Shard(wanted, batch, 0)
    unit = tuple(np.array([v]) for v in (0, 1, 1, 1, 0))
    assert [v.tolist() for v in shard.search(unit, 9)] == [[], []]  # 6 + 8 would not have been skipped, 8 is
    assert [v.tolist() for v in shard.search(unit, 7)] == [[2, 3], [7, 8]]
