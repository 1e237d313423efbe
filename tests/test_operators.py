import difflib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.functions import scalars
from notewell.operators import dedup, filters, joins, mutate, paging, quality, vectors, windows
from notewell.plans import drift, metrics


def skewed(n, seed=3):
    """One key holds most of the rows."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i, start + timedelta(minutes=rng.randint(0, 9000)), round(rng.uniform(-50, 900), 2)) for i in range(n)]


def test_nearest_rank_matches_brute_force(spark):
    rows = skewed(900)
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in windows.nearest_rank(df, ["k"], "v", (50, 95)).collect()}
    for key in {r[0] for r in rows}:
        values = sorted(r[3] for r in rows if r[0] == key)
        assert got[key] == tuple(values[int(round(p / 100 * (len(values) - 1)))] for p in (50, 95))


def test_running_totals_match_brute_force(spark):
    rows = skewed(700)
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, v double")
    got = {r["id"]: (round(r["running_sum"], 6), r["running_count"]) for r in windows.running_totals(df, "k", "ts", "id", F.col("v")).collect()}
    sums, counts = {}, {}
    for key, i, _, v in sorted(rows, key=lambda r: (r[2], r[1])):
        sums[key] = sums.get(key, 0) + v
        counts[key] = counts.get(key, 0) + 1
        assert got[i] == (round(sums[key], 6), counts[key])


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(100), "k string, id int, ts timestamp, v double")
    plan = windows.top_n_per_group(df, ["k"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_keep_first_over_many_copies(spark):
    rows = [(i, "copy" if i % 3 else f"text {i}", "fr" if i % 2 else "en") for i in range(60)] + [(100, None, "fr"), (101, "", "fr"), (102, None, "fr")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    got = {r["id"] for r in dedup.dedup_notes(df).collect()}
    seen, expected = set(), set()
    for i, t, lang in rows:
        if (t, lang) not in seen:
            seen.add((t, lang))
            expected.add(i)
    assert got == expected


def unit(v):
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_matches_brute_force_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(1)
    items = rng.normal(size=(60, 8)).astype(np.float32)
    items[5] = items[9]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in vectors.knn(df, df, 4, skip_same=True, block_rows=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["item_id"]
    u = np.array([unit(v.astype(np.float64)) for v in items])
    sim = u @ u.T
    for q in range(60):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(sim[q, i], 12), i))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == order


def test_knn_within_a_hot_key(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i < 40 else "cold", [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, k string, embedding array<float>")
    got = vectors.knn(df, df, 2, key="k", skip_same=True, block_rows=9, threshold=-1.0).collect()
    keys = {i: k for i, k, _ in rows}
    assert len(got) == 100 and all(keys[r["query_id"]] == keys[r["item_id"]] for r in got)


def test_knn_keeps_text_ids(spark):
    df = spark.createDataFrame([("CA_001", [1.0, 0.0]), ("CA_002", [0.9, 0.1]), ("CA_003", [0.0, 1.0])], "vec_id string, embedding array<float>")
    got = {r["query_id"]: r["item_id"] for r in vectors.knn(df, df, 1, skip_same=True, block_rows=1).collect()}
    assert got == {"CA_001": "CA_002", "CA_002": "CA_001", "CA_003": "CA_002"}


def test_zero_vectors_do_not_break_search(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = {(r["query_id"], r["item_id"]): r["score"] for r in vectors.knn(df, df, 2).collect()}
    assert got[(1, 2)] == 0.0 and got[(2, 2)] == 1.0


def test_similar_text_reuse(spark):
    seen = spark.createDataFrame([(1, "a", "bonjour", [1.0, 0.0]), (2, "a", "salut", [0.0, 1.0])], "id bigint, k string, text string, embedding array<float>")
    new = spark.createDataFrame([(10, "a", "bonjour", [0.0, 1.0]), (11, "a", "autre", [0.05, 1.0]), (12, "a", "loin", [-1.0, -1.0])], "id bigint, k string, text string, embedding array<float>")
    got = {r["id"]: (r["match_id"], r["kind"]) for r in vectors.semantic_reuse(new, seen, key="k").collect()}
    assert got == {10: (1, "exact"), 11: (2, "similar")}


def test_contains_join_matches_brute_force(spark):
    rng = random.Random(5)
    hay = [(i, "".join(rng.choices("abAB c", k=rng.randint(1, 12)))) for i in range(80)]
    needles = list({"".join(rng.choices("abc ", k=rng.randint(1, 5))) for _ in range(60)})
    got = {r["q"]: r["id"] for r in joins.contains_join(spark.createDataFrame([(n,) for n in needles], "q string"), spark.createDataFrame(hay, "id int, name string"), "q", "name", "id").collect()}
    expected = {}
    for n in needles:
        hits = [i for i, h in hay if n.lower() in h.lower()]
        if hits:
            expected[n.lower()] = min(hits)
    assert got == expected


def test_normalized_tags_match_difflib(spark):
    core = ["leather_goods", "watches", "jewelry", "birthday_gift", "travel_luggage", "entrepreneur_tech"]
    tags = ["leather_good", "Watches", "watches", "birthday", "gift_for_spouse", "travel_lugage", "zzz", "tech_entrepreneur", "jewelery"]
    got = {r["tag"]: r["normalized"] for r in joins.normalize_tags(spark.createDataFrame([(t,) for t in tags], "tag string"), core).collect()}
    for tag in tags:
        if tag in core or tag.startswith("gift_for_"):
            expected = tag
        elif tag in ("birthday", "tech_entrepreneur"):
            expected = {"birthday": "birthday_gift", "tech_entrepreneur": "entrepreneur_tech"}[tag]
        else:
            close = difflib.get_close_matches(tag, core, n=1, cutoff=0.8)
            expected = close[0] if close else None
        assert got[tag] == expected, tag


def test_lexicon_table_equals_inline_pack(spark):
    from notewell.functions.packs import RulePack

    words = {"bag": ["sac", "sac à main"], "wallet": ["card holder"], "tea": ["thé"], "travel": ["sac de voyage cuir", "thé"], "code": ["c++", ".net", "++"]}
    notes = spark.createDataFrame([(1, "Un sac à main."), (2, "card-holder"), (3, "le thé, card holder!"), (4, "sacs théière"), (5, "Sac de Voyage Cuir"), (6, "du c++ et .NET"), (7, "asp.net"), (8, "a ++ b"), (9, None)], "id int, text string")
    table = spark.createDataFrame([(t, w, k) for k, (t, ws) in enumerate(words.items()) for w in ws], "tag string, keyword string, position int")
    joined = {(r["id"], r["tag"]) for r in joins.tag_by_lexicon_table(notes, table, "id", "text").collect()}
    inline = {(r["id"], t) for r in joins.tag_by_lexicon(notes, "text", RulePack.from_keywords("w", words)).collect() for t in r["tags"]}
    assert joined == inline == {(1, "bag"), (3, "travel"), (3, "wallet"), (5, "bag"), (5, "travel"), (6, "code"), (8, "code")}


def test_reuse_respects_the_time_to_live(spark):

    now = datetime(2024, 1, 2)
    notes = spark.createDataFrame([(1, "Bonjour,  LE sac!"), (2, "autre"), (3, "vieux")], "id int, text string")
    stored = spark.createDataFrame([("bonjour le sac", now - timedelta(hours=1), "new"), ("bonjour le sac", now - timedelta(hours=5), "old"), ("vieux", now - timedelta(hours=30), "x")], "t string, cached_at timestamp, result string")
    results = stored.select(scalars.text_key(F.col("t"), "note").alias("cache_key"), "cached_at", "result")
    got = {r["id"]: (r["result"], r["from_cache"]) for r in joins.reuse_results(notes, results, now, "note").collect()}
    assert got == {1: ("new", True), 2: (None, False), 3: (None, False)}


def test_window_and_id_errors():
    with pytest.raises(ValueError):
        filters.resolve_window(datetime(2024, 1, 1), start=datetime(2024, 2, 1))
    with pytest.raises(ValueError):
        filters.resolve_window(datetime(2024, 1, 1), window="year")
    with pytest.raises(ValueError):
        filters.parse_ids("1,x")
    assert filters.parse_ids(" , ") is None and filters.parse_ids("1, 2") == [1, 2]


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("axb",)], "name string")
    assert [r[0] for r in filters.search(df, ["name"], "0%").collect()] == ["50% off"]
    assert [r[0] for r in filters.search(df, ["name"], "A_B").collect()] == ["a_b"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 7 AS tier", "cast(id AS string) AS name").write.parquet(path)
    plan = filters.apply_filters(spark.read.parquet(path), [("tier", "$gte", 3)]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tier), GreaterThanOrEqual(tier,3)]" in plan and "name" not in plan.split("ReadSchema")[1]


def test_page_arithmetic(spark):
    info = paging.page_info(spark.range(101), 2, 50).first()
    assert (info.total, info.total_pages) == (101, 3)
    assert paging.shortlist_size(1) == 12 and paging.shortlist_size(5, 20) == 20 and paging.candidate_limit(10) == 500 and paging.candidate_limit(9999) == 5000
    with pytest.raises(ValueError):
        paging.sort_columns("name")


def test_stock_never_goes_negative(spark):
    products = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "sku string, stock int")
    deltas = spark.createDataFrame([("a", -2), ("a", -1), ("b", -4)], "sku string, delta int")
    got = {r["sku"]: (r["stock"], r["rejected"]) for r in mutate.adjust_stock(products, deltas).collect()}
    assert got == {"a": (0, False), "b": (3, True), "c": (1, False)}


def test_product_import_cases(spark):
    target = spark.createDataFrame([("s1", "old", "", "", 1.0, "", "", "", False, 1)], "sku string, name string, url string, image_url string, price_eur double, category1 string, category2 string, category3 string, is_discount boolean, stock int")
    raw = spark.createDataFrame([("s1", "new", "12.5", "3"), ("", "x", "1", "1"), ("s2", " ", "1", "1"), ("s3", "third", "abc", "??"), ("s3", "third", "abc", "??")], "product_code string, title string, price string, stock string")
    changed, rejected = mutate.upsert_products(target, raw)
    got = {r["sku"]: (r["name"], r["price_eur"], r["stock"], r["change"]) for r in changed.collect()}
    assert got == {"s1": ("new", 12.5, 3, "updated"), "s3": ("third", 0.0, 10, "inserted")}
    assert sorted(r["error"] for r in rejected.collect()) == ["missing_name", "missing_sku"]


def test_partial_vector_documents_keep_fields(spark):
    coll = spark.createDataFrame([("a", [1.0], "red"), ("b", [2.0], "blue")], "id string, embedding array<double>, color string")
    docs = spark.createDataFrame([("a", [9.0], None), ("c", [3.0], "green")], "id string, embedding array<double>, color string")
    got = {r["id"]: (r["embedding"], r["color"]) for r in mutate.upsert_vectors(coll, docs).collect()}
    assert got == {"a": ([9.0], "red"), "b": ([2.0], "blue"), "c": ([3.0], "green")}


def test_new_clients_appear_once(spark):
    clients = spark.createDataFrame(
        [(1, "Claire Martin", "E1", "Regular", "Standard", 0.5, 1, datetime(2024, 1, 1), None)],
        "id bigint, name string, external_client_id string, category string, vic_status string, sentiment_score double, total_interactions bigint, last_contact_date timestamp, days_since_contact int",
    )
    t0 = datetime(2024, 1, 11)
    notes = spark.createDataFrame(
        [("E1", None, 1.0, None, t0), (None, "martin", 0.0, "vic", t0), ("E9", "Zoé", 0.2, None, t0), ("E9", "Zoé", 0.4, None, t0), (None, "inconnue", 0.0, "ultimate", t0)],
        "client_ref string, client_name string, sentiment double, behavior string, ts timestamp",
    )
    rows = mutate.upsert_clients(clients, notes).collect()
    old = next(r for r in rows if r["id"] == 1)
    assert (old.total_interactions, round(old.sentiment_score, 4), old.category, old.days_since_contact) == (3, 0.5, "VIC", 10)
    new = {r["name"]: r for r in rows if r["id"] != 1}
    assert len({r["id"] for r in rows}) == 3 and all(r["id"] > 0 for r in rows)
    assert set(new) == {"Zoé", "inconnue"} and new["Zoé"].external_client_id == "E9" and new["Zoé"].total_interactions == 2 and new["inconnue"].category == "Ultimate"


def test_quarantine_names_every_broken_rule(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    good, bad = quality.split_valid(df, {"positive": F.col("v") > 0, "present": F.col("v").isNotNull()})
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["error"] for r in bad.collect()} == {2: "positive", 3: "positive; present"}


def test_drift_of_the_sample_arithmetic(spark):
    reference = spark.createDataFrame([(0.95, 10.0)] * 3, "confidence double, tier double")
    current = spark.createDataFrame([(0.50, 10.0)] * 3, "confidence double, tier double")
    row = {r["feature"]: r for r in drift.drift_report(reference, current).collect()}
    assert round(row["confidence"].mean_change * 100, 1) == 47.4 and row["confidence"].drifted and not row["tier"].drifted
    empty = drift.drift(reference.limit(0), current).first()
    assert not empty.drift_detected and empty.drift_score == 0.0


def test_set_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "e array<string>, a array<string>")
    row = metrics.set_prf(df, "e", "a").first()
    assert (row.tp, row.fp, row.fn, row.precision, row.f1) == (1, 1, 1, 0.5, 0.5)


def test_cluster_size_shrinks(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id int, embedding array<double>")
    assert vectors.cluster(df, 6).select("cluster").distinct().count() == 2
    assert vectors.cluster(df.limit(1), 6).first()["cluster"] == 0


def test_percentiles_in_one_narrow_bucket_of_a_hot_key(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate((rng.uniform(500, 504, 3000).round(4), -rng.uniform(0, 0.01, 500), [0.0, -7.5, 1e9]))
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("one", 3.0), ("none", None)], "k string, v double").repartition(5)
    got = {r["k"]: (r["p5"], r["p50"], r["p99"]) for r in windows.nearest_rank(df, ["k"], "v", [5, 50, 99]).collect()}
    ranked = sorted(values)
    assert got == {"hot": tuple(ranked[round(p / 100 * (len(ranked) - 1))] for p in (5, 50, 99)), "one": (3.0, 3.0, 3.0)}


def test_running_totals_of_one_key_in_one_day(spark):
    start = datetime(2024, 3, 1)
    rows = [("hot", i, start.replace(hour=i % 24, minute=(7 * i) % 60, second=i % 3), i % 5) for i in range(300)] + [("other", 1000, start, 2)]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp, v int").repartition(4)
    got = {r["id"]: (r["running_sum"], r["running_count"]) for r in windows.running_totals(df, "k", "ts", "id", df["v"]).collect()}
    expected, total = {}, 0
    for n, (_, i, _, v) in enumerate(sorted(rows[:-1], key=lambda r: (r[2], r[1])), 1):
        total += v
        expected[i] = (total, n)
    assert got == expected | {1000: (2, 1)}


def test_first_rows_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", i) for i in range(3)], "k string, id int").repartition(4)
    rows = windows.top_n_of_hot_groups(df, ["k"], [df["id"].desc()], 100, "id").collect()
    assert sorted(r["id"] for r in rows if r["k"] == "hot") == list(range(400, 500)) and len(rows) == 103


def test_trie_of_keywords_equals_the_table_form(spark):
    rng = random.Random(5)
    words = ["sac", "à", "main", "rouge", "l'eau", "x2", "é", "net", "the"]
    seps = [" ", "  ", "-", "", ". ", ".", "!!", " & "]
    texts = [rng.choice(["", ".", " ", "&"]) + "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "...", "&", "net", ".NET", "a.net", "the " * 400]
    keywords = [(f"t{k}", rng.choice(["", "", ".", "#"]) + rng.choice(seps).join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", "", "!", "."])) for k in range(120)]
    keywords += [("amp", "&"), ("dots", ".."), ("bang", "!!"), ("net", ".net"), ("net2", "net"), ("same", "sac"), ("zzz", "sac"), ("blank", "  ")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    lexicon = spark.createDataFrame(keywords, "tag string, keyword string")
    expected = sorted(map(tuple, joins.tag_by_lexicon_table(df, lexicon, "id", "text").collect()))
    assert sorted(map(tuple, joins.tag_by_lexicon_trie(df, lexicon, "id", "text").collect())) == expected and len(expected) > 300
    assert joins.tag_by_lexicon_trie(df, lexicon.limit(0), "id", "text").count() == 0


def test_trie_of_many_keywords(spark):
    """100,000 keywords; of the texts a third of all words is one word, which begins many keywords."""
    lexicon = spark.range(100_000).selectExpr("concat('tag', id) AS tag", "concat('the w', id % 5000, ' x', id) AS keyword")
    texts = spark.range(3000).selectExpr("id", "concat_ws(' ', transform(sequence(0, 9), k -> concat('the w', (id + k) % 5000, ' x', (id + k) % 5000 + IF(k = 3, 5000, 1)))) AS text")
    found = sorted((r["id"], r["tag"]) for r in joins.tag_by_lexicon_trie(texts, lexicon, "id", "text").collect())
    assert found == sorted((i, f"tag{i + 3 + 5000}") for i in range(3000))


def test_pages_far_back_and_numbers_without_gaps(spark):
    df = spark.range(1000).selectExpr("id", "id * 7 % 13 AS v").repartition(5)
    order = [F.col("v").desc(), F.col("id")]
    rows = [r["id"] for r in df.orderBy(*order).collect()]
    for number in (1, 3, 10, 11):
        near, far = (sorted(r["id"] for r in paging.page(df, order, number, 100, n).collect()) for n in (10_000, 0))
        assert near == far == sorted(rows[(number - 1) * 100 : number * 100])
    ranked, ranges = paging.numbered(df, order)
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == rows and ranges.agg(F.sum("__n")).first()[0] == 1000
    assert paging.numbered(df.limit(0), order)[0].count() == 0


def test_new_client_ids_follow_the_largest(spark):
    clients = spark.createDataFrame(
        [(5, "Anna", None, "Regular", "Standard", 0.5, 1, datetime(2024, 1, 1), None)],
        "id bigint, name string, external_client_id string, category string, vic_status string, sentiment_score double, total_interactions bigint, last_contact_date timestamp, days_since_contact int",
    )
    for batch in range(3):
        notes = spark.createDataFrame([(f"r{batch}-{k}", None, 0.5, None, datetime(2024, 1, 2)) for k in range(40)], "client_ref string, client_name string, sentiment double, behavior string, ts timestamp")
        clients = spark.createDataFrame(mutate.upsert_clients(clients, notes).select(*clients.columns).collect(), clients.schema)
    assert sorted(r["id"] for r in clients.collect()) == list(range(5, 126))


def test_reuse_as_of_each_notes_time(spark):
    def at(h):
        return datetime(2024, 1, 1) + timedelta(hours=h)

    results = spark.createDataFrame([("a", at(1), 1), ("a", at(30), 2), ("a", at(30), 3), ("b", at(5), 4), ("c", None, 5)], "t string, cached_at timestamp, result int")
    results = results.select(scalars.text_key(F.col("t"), "note").alias("cache_key"), "cached_at", "result")
    asked = [(1, "a", at(0.5)), (2, "A!", at(1)), (3, "a", at(29.9)), (4, "a", at(30)), (5, "a", at(54.01)), (6, "a", at(53)), (7, "b", at(4.99)), (8, "c", at(9)), (9, "b", None), (10, None, at(3))]
    notes = spark.createDataFrame(asked, "id int, text string, ts timestamp")
    for chunk in ("hour", "year", "minute"):
        got = {r["id"]: (r["result"], r["from_cache"]) for r in joins.reuse_as_of(notes, results, "note", ttl_seconds=86400, chunk=chunk).collect()}
        assert got == {1: (None, False), 2: (1, True), 3: (None, False), 4: (3, True), 5: (None, False), 6: (3, True), 7: (None, False), 8: (None, False), 9: (None, False), 10: (None, False)}


def test_rules_read_equal_texts_once(spark):
    from notewell.operators import dedup

    df = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(60)], "id int, text string").repartition(7)
    seen = []
    rows = dedup.per_text(df, lambda texts: seen.append(texts) or texts.withColumn("n", F.monotonically_increasing_id()).withColumn("size", F.length("text"))).collect()
    assert seen[0].count() == 3 and sorted(r.id for r in rows) == list(range(60))
    assert len({(r.text, r.n) for r in rows}) == 3 and {(r.text, r["size"]) for r in rows} == {("a", 1), ("b", 1), (None, None)}


def test_substring_join_meets_long_names_by_long_grams(spark):
    names = spark.range(3000).selectExpr("id", "concat('Customer#', lpad(CAST(id AS STRING), 9, '0')) AS name")
    needles = spark.createDataFrame([("customer#000001234",), ("0002999",), ("99",), ("Customer#999999999",), ("",), (None,)], "who string")
    found = joins.contains_join(needles, names, "who", "name", "id")
    assert {(r["who"], r["id"]) for r in found.collect()} == {("customer#000001234", 1234), ("0002999", 2999), ("99", 99)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
