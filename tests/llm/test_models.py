"""Fitted operators: accuracy on rows not learned from, and defined results for odd rows."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from notewell.llm import language_id, quality_model, toxicity
from tests.llm.conftest import got, odd_rows

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.mark.parametrize("operator", [quality_model, toxicity])
def test_odd_rows_and_no_labels(spark, odd, none, operator):
    some = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None), (4, 7)], "doc_id long, label int")
    for labels in (some, some.limit(0)):
        rows = got(operator.score(odd, operator.fit(odd, labels)))
        assert len(rows) == len(odd_rows()) and all(0 <= s <= 1 for _, s in rows)
        by_text = {}
        for i, s in rows:
            by_text.setdefault(i, set()).add(s)
        assert len(by_text[0]) == 1  # equal texts, equal scores
    assert got(operator.score(none, operator.fit(none, some))) == []


def test_language_of_odd_rows(spark, odd, none):
    labels = odd.selectExpr("doc_id", "lang AS label")
    model = language_id.fit(odd, labels)
    rows = {}
    for i, lang, score in got(language_id.predict(odd, model)):
        rows.setdefault(i, []).append((lang, score))
    assert sum(map(len, rows.values())) == len(odd_rows())
    assert rows[13] == rows[14] == rows[17] == [("und", 0.0)]
    assert all(lang in ("en", "de", "und") and 0 <= s <= 1 for v in rows.values() for lang, s in v)
    assert language_id.keep(odd, model, 0.0).columns == odd.columns
    assert set(r[1] for r in got(language_id.predict(odd, language_id.fit(odd, labels.limit(0))))) == {"und"}
    assert got(language_id.predict(none, model)) == []


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    emit, change = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    weight = np.zeros((6, 3))
    for path in np.ndindex(*[3] * 6):
        p = np.exp(sum(emit[k, y] for k, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path[:-1], path[1:])))
        weight[np.arange(6), path] += p
    assert np.allclose(language_id.marginals(emit, change, np.array([0, 6])), weight / weight.sum(axis=1, keepdims=True))


def test_forward_backward_of_blocks_equals_one_pass():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 31, 32, 33, 200, 0, 7]
    first = np.concatenate(([0], np.cumsum(sizes)))
    emit, change = rng.normal(size=(first[-1], 4)), rng.normal(size=(4, 4))
    got_all = language_id.marginals(emit, change, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a < b:
            e, t = np.exp(emit[a:b]), np.exp(change)
            ahead, back = [e[0]], [np.ones(4)]
            for k in range(1, b - a):
                v = (ahead[-1] @ t) * e[k]
                ahead.append(v / v.sum())
            for k in range(b - a - 1, 0, -1):
                v = t @ (e[k] * back[0])
                back.insert(0, v / v.sum())
            own = np.array(ahead) * np.array(back)
            assert np.allclose(got_all[a:b], own / own.sum(axis=1, keepdims=True))


def test_clause_machine():
    step, kind = toxicity.STEP, toxicity.KIND

    def read(*classes):
        s = 0
        for c in classes:
            s = step[s, c]
        return int(kind[s])

    o, i, t, g, n, r = range(6)
    assert read(o, g, n, r) == 0
    assert read(o, i) == 1 and read(g, o, i) == 5 and read(t) == 9 and read(r, g, i) == 6
    assert read(n, i) == 3 and read(n, o, o, i) == 3 and read(n, o, o, o, i) == 1


@needs_tables
@pytest.mark.parametrize("name,column,least", [("op8_toxicity", "toxic", 0.93), ("op9_quality_model", "quality", 0.93)])
def test_held_out_accuracy(spark, name, column, least):
    rows = entry.queries()[name](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    right = rows.join(labels, "doc_id").selectExpr(f"avg(CAST(predicted = {column} AS INT))").first()[0]
    assert right >= least


@needs_tables
def test_held_out_languages(spark):
    rows = entry.queries()["op5_language_id"](spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert rows.join(docs, "doc_id").selectExpr("avg(CAST(lang_pred = lang AS INT))").first()[0] >= 0.97


def test_spans_of_mixed_text(spark):
    if not os.path.isdir(SF):
        pytest.skip("tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, docs.selectExpr("doc_id", "lang AS label"))
    en, de = (docs.where(f"lang = '{lang}' AND n_chars > 800").orderBy("doc_id").first()["text"][200:600] for lang in ("en", "de"))
    mixed = spark.createDataFrame([(1, f"{en}. {de}")], "doc_id long, text string")
    rows = language_id.spans(mixed, model).orderBy("start").collect()
    share = {}
    for r in rows:
        share[r["lang"]] = share.get(r["lang"], 0) + r["end"] - r["start"]
    assert share["en"] > 300 and share["de"] > 300


@needs_tables
def test_language_gate_closes_on_junk_and_foreign_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, docs.selectExpr("doc_id", "lang AS label"))
    junk = ["qzx wvk jjq zzq xqj", "Это русское предложение о погоде", "これは日本語です", "asdf asdf asdf", "xk9 0x33ff deadbeef aGVsbG8gd29ybGQ=", "1234", None]
    short = [r["text"][:n].rsplit(" ", 1)[0] for n in (20, 40, 120) for r in docs.where("n_chars > 200 AND text RLIKE '^[A-Za-z ]{120}'").orderBy("doc_id").limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(junk + short)), "doc_id long, text string")
    kept = {r["doc_id"] for r in language_id.keep(rows, model, corpus_pipeline.LEAST_KNOWN).collect()}
    assert kept == set(range(len(junk), len(junk) + len(short)))
    assert language_id.keep(docs, model, corpus_pipeline.LEAST_KNOWN).count() == docs.count()


def test_evidence_equals_brute_force(odd, spark):
    model = language_id.fit(odd, odd.selectExpr("doc_id", "lang AS label").where("doc_id < 20"))
    grams = language_id.known_grams(model)
    flags = np.unpackbits(grams)
    letter = re.compile(rb"[A-Za-z\x80-\xff]+")

    def triples(text):
        return [[b" " + w + b" " for w in [m.lower()]][0] for m in letter.findall((text or "").encode())]

    texts = [r[1] for r in odd_rows()]
    found = language_id.evidence(grams, pa.array(texts, pa.string()))
    for text, share in zip(texts, found, strict=True):
        of_words = [np.mean([flags[int.from_bytes(w[k : k + 3], "big")] for k in range(len(w) - 2)]) for w in triples(text)]
        assert abs(share - (np.mean(of_words) if of_words else 0.0)) < 1e-9
