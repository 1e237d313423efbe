"""Findings of round 3: equal rows are read once, steps cost what their rows cost."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import privacy, similarity, text
from notewell.operators import vector_index, vectors
from notewell.plans import catalog, route


def test_equal_examples_share_rows_of_the_router(spark, monkeypatch):
    """2,000 equal examples are 64 rows that weigh 2,000; counted examples give the same rows."""
    from notewell import session

    kept = []
    original = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, name: kept.append(original(df, name)) or kept[-1])
    notes = [("Cherche un sac", 1)] * 2000 + [("Client VIP urgent flexible budget 20 k", 2)] * 40 + [("elle a un cancer", 3)]
    plain = spark.createDataFrame(notes, "text string, label int")
    router = route.train_router(plain, trees=5, folds=2)
    counted = plain.groupBy("text", "label").agg(F.count("*").alias("rows"))
    assert router is not None and route.train_router(counted, trees=5, folds=2) is not None
    for rows in kept:
        got = {r["label"]: (r["n"], round(r["w"], 6)) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("rows").alias("w")).collect()}
        assert got == {1.0: (route.EQUAL_ROWS, 2000.0), 2.0: (40, 40.0), 3.0: (1, 1.0)}
    out = route.route_ml(plain.distinct(), router).select("text", "tier").collect()
    assert {r["text"]: r["tier"] for r in out}["elle a un cancer"] == 3


def test_sensitive_categories_lower_a_text_once(spark):
    df = spark.createDataFrame([("Un AVOCAT au temple",), (None,), ("rien",)], "text string").select(privacy.sensitive_categories(F.col("text")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r["c"] for r in df.collect()] == [["family_conflict", "religion"], [], []]


def test_products_of_a_block_equal_brute_force(monkeypatch):
    """Blocks are cut into small products; later ones look at what reaches the k-th score, restrictions included."""
    monkeypatch.setattr(vectors, "PRODUCT", 24)
    rng = np.random.default_rng(3)
    q, i = rng.integers(-2, 3, (23, 4)).astype(np.float32), rng.integers(-2, 3, (61, 4)).astype(np.float32)  # many equal scores
    asked = pd.DataFrame({"query_id": [f"V{n:03d}" for n in range(23)], "__raw": [v.tobytes() for v in q], "price_low": 2.0, "price_high": [np.nan if n % 5 == 0 else 6.0 for n in range(23)]})
    goods = pd.DataFrame({"item_id": [f"V{n:03d}" for n in range(61)], "__raw": [v.tobytes() for v in i], "price": [np.nan if n % 7 == 0 else n % 9 for n in range(61)]})
    unit = lambda m: m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    score = unit(q) @ unit(i).T
    for threshold in (None, 0.4):
        got = vectors.block_topk(asked, goods.sample(frac=1, random_state=1), 5, threshold, True, 6, (np.float32, np.float32))
        for r in range(23):
            fits = [c for c in range(61) if c != r and (c % 7 == 0 or (c % 9 >= 2 and (r % 5 == 0 or c % 9 <= 6))) and (threshold is None or score[r, c] >= threshold)]
            best = sorted(fits, key=lambda c: (-round(score[r, c], 9), c))[:5]
            mine = got[got.query_id == f"V{r:03d}"]
            assert [round(v, 6) for v in mine.score] == [round(score[r, c], 6) for c in best]
            assert set(mine.item_id) <= {f"V{c:03d}" for c in fits}


def test_copies_of_a_search_do_not_follow_the_block_size(spark):
    """1,000 rows in blocks of 4 would be 62,500 pairs of blocks; each side is copied SPLIT times at most."""
    df = spark.createDataFrame([(n, [float(n % 7), 1.0, float(n % 3)]) for n in range(1000)], "vec_id long, embedding array<double>")
    found = vectors.knn(df, df, 2, block_rows=4)
    assert found.count() == 2000
    groups = vectors.block_counts(df.withColumn("__key", F.lit("")), df.withColumn("__key", F.lit("")), 4).first()
    assert (groups["__nq"], groups["__ni"]) == (vectors.SPLIT, vectors.SPLIT)


ODD = ["", "a", " x\u00a0y  z\t", "Mme Durand, 06 12 34 56 78", "ID X1234567A", "١٢٣-٤٥-٦٧٨٩ code 1234", "euh bon euh", "Euh, tu sais, c'est bon  .", "a@b.fr et Dr House",
       "budget 5000€ le 12/03/2024 Capucine 25", "un peu flexible et plutôt bien, un peu", "livraison à 12 rue X", "\u3000 aaa !!! bbb\u2003", "hummm euhh Bahh", "Prof. Étienne-Marie Dupont"]


def test_cleaning_steps_that_skip_equal_the_whole_patterns(spark):
    """Steps that look first, or read a text once, give what the patterns give one after the other."""
    df = spark.createDataFrame([(t, c) for t in ODD for c in ("FR", "EN", "XX")], "t string, lang string")
    t, lang = F.col("t"), F.col("lang")
    plain = contacts = t
    for _, mask, regex in privacy.mask_rules():
        plain = F.regexp_replace(plain, regex, mask)
    for regex, mask in ((fv.EMAIL, "[EMAIL]"), (fv.PHONE_CONTACT, "[PHONE]"), (fv.CIVILITY_NAME, "$1 [NAME]")):
        contacts = F.regexp_replace(contacts, "(?U)" + regex, mask)
    cut = text.fillers_cut(t, lang)
    got = df.select(
        privacy.mask_pii(t).eqNullSafe(plain).alias("masks"), privacy.masked_and_counted(t)["t"].eqNullSafe(plain).alias("counted"),
        privacy.mask_contacts(t).eqNullSafe(contacts).alias("contacts"), cut["t"].eqNullSafe(text.strip_fillers(t, lang)).alias("fillers"),
        cut["n"].eqNullSafe(text.count_fillers(t, lang)).alias("number"),
        F.regexp_replace(t, text._SPACES, " ").eqNullSafe(F.regexp_replace(t, r"(?U)\s+", " ")).alias("spaces"),
    ).collect()
    assert all(all(r) for r in got) and len(got) == 3 * len(ODD)
    for odd in [*ODD, "M. Un est la. Mr. Deux est la!! M. Un est la. \x1c Il dort bien."]:
        assert similarity.drop_repeated_sentences(odd) == similarity.drop_repeated_sentences(odd, split=fv.SENTENCE_SPLIT)


def shared_catalogue(spark, queries=600, items=900):
    rng = np.random.default_rng(8)
    vectors_of = rng.normal(size=(6, 8)).tolist()
    goods = [(k, f"S{k}", "ring", "Bag", None if k % 97 == 0 else float(100 + k % 7), f"{'red' if k % 3 else 'blue'} ring", 1, vectors_of[k % 6]) for k in range(items)]
    asked = [(5000 + k, "ring", "bags", ["red"] if k % 5 == 0 else [], float(90 + k % 11), float("nan") if k % 50 == 0 else None if k % 13 == 0 else float(97 + k % 11), [], ["bags"], vectors_of[k % 4]) for k in range(queries)]
    asked += [(5000 + queries, "ring", "bags", [], 1e6, 2e6, [], ["bags"], vectors_of[0]), (5001 + queries, "ring", "bags", [], 1.0, 2.0, [], ["bags"], vectors_of[0]), (5002 + queries, "ring", "bags", [], None, None, [], ["bags"], None)]
    return (
        spark.createDataFrame(asked, "id long, primary_query string, category_filter string, color_filter array<string>, price_low double, price_high double, boost_keywords array<string>, intents array<string>, embedding array<double>"),
        spark.createDataFrame(goods, "item_id long, sku string, name string, category string, price double, text string, stock int, embedding array<double>"),
    )


def test_f5_equal_queries_are_asked_once_and_each_gets_its_rows(spark, monkeypatch):
    queries, goods = shared_catalogue(spark)
    asked = []
    knn = vector_index.knn
    monkeypatch.setattr(vector_index, "knn", lambda q, *a, **b: asked.append(q.count()) or knn(q, *a, **b))
    found = sorted(tuple(r) for r in catalog.match_products(queries, goods, 3, -1.0).collect())
    assert asked[0] < 300  # 602 queries have a vector
    one_by_one = catalog.match_products(queries, goods, 3, -1.0, pruned=False, skip_same=True)  # no id is on both sides
    assert found == sorted(tuple(r) for r in one_by_one.collect())
    assert {r[0] for r in found} >= set(range(5000, 5600))


@pytest.mark.parametrize("skip_same", [False, True])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_f5_items_that_share_vectors_rank_by_id(spark, skip_same, threshold):
    rng = np.random.default_rng(9)
    of = rng.normal(size=(5, 16)).tolist()
    items = spark.createDataFrame([(k, of[k % 5], float(k % 4), int(k % 3)) for k in range(700)], "vec_id long, embedding array<double>, price double, color_bits long")
    asked = spark.createDataFrame([(k, of[k % 5], float(k % 3), float(k % 3 + k % 2), int(k % 4)) for k in range(200)], "vec_id long, embedding array<double>, price_low double, price_high double, color_bits long")
    found = vector_index.knn(asked, items, 4, skip_same=skip_same, threshold=threshold, cell_rows=100, block_rows=40, chunk_rows=30)
    number = {tuple(v): n for n, v in enumerate(of)}
    rows, goods = asked.collect(), items.collect()
    unit = np.array(of) / np.linalg.norm(of, axis=1, keepdims=True)
    want = {}
    for q in rows:
        fits = [(-float((unit[number[tuple(q["embedding"])]] * unit[i["vec_id"] % 5]).sum()), i["vec_id"]) for i in goods
                if q["price_low"] <= i["price"] <= q["price_high"] and (q["color_bits"] == 0 or q["color_bits"] & i["color_bits"]) and not (skip_same and q["vec_id"] == i["vec_id"])]
        want[q["vec_id"]] = [i for s, i in sorted(fits) if threshold is None or -s >= threshold][:4]
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {k: v for k, v in want.items() if v}
    assert vector_index.build(items, cell_rows=100, first=4).items.count() <= 5 * 4 * 3 * 4 < 700
