"""Scores of the fitted operators, recomputed from the models by plain loops."""

import math
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from notewell.llm import labelled, language_id, quality_model, toxicity, words
from tests.llm.conftest import got, odd_rows, sentence

LETTERS = rb"A-Za-z\x80-\xff"


def hashed(raw, seed=0):
    data = np.frombuffer(raw, np.uint8)
    return int(words.mix(words.range_hash(words.prefix_hash(data), np.array([0]), np.array([len(data)])), seed)[0])


def lowered(text):
    return bytes(int(words.LOWER[b]) for b in (text or "").encode())


def labelled_docs(spark):
    rng = random.Random(6)
    bad = ["you idiot", "they will kill you", "stupid moron", "not an idiot", "she said you idiot"]
    docs = [(k, f"{sentence(rng, rng.randint(3, 25))}. {rng.choice(bad) if k % 3 == 0 else 'fine day'}! {sentence(rng, 5)}", int(k % 3 == 0)) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "label"), docs


# ---- quality: follow-the-regularised-leader


def grams(text):
    tokens = re.findall(rb"[0-9" + LETTERS + rb"]+|[^\x20\x09-\x0d0-9" + LETTERS + rb"]+", (text or "").encode())
    h = [hashed(t) for t in tokens]
    pairs = [int(quality_model._SAME) if a == b else int(words.mix(np.array([(a * 3 + b) & (2**64 - 1)], np.uint64), 1)[0]) for a, b in zip(h[:-1], h[1:], strict=True)]
    return [x >> (64 - quality_model.BITS) for x in h + pairs]


def plain_ftrl(rows):
    """Per-coordinate updates, one weight at a time."""
    m = quality_model
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= m.L1:
            return 0.0
        return (math.copysign(m.L1, z[i]) - z[i]) / ((m.BETA + math.sqrt(n[i])) / m.ALPHA + m.L2)

    for _ in range(m.EPOCHS):
        for counts, y in rows:
            total = max(1, sum(counts.values()))
            x = {i: float(np.float32(c * (m.SCALE / total))) for i, c in counts.items()} | {1 << m.BITS: 1.0}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weight(i) * v for i, v in x.items())))))
            step = {i: ((p - y) * v, weight(i)) for i, v in x.items()}
            for i, (g, w) in step.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / m.ALPHA * w
                n[i] += g * g
    return weight


def test_quality_equals_plain_updates(spark):
    docs, labels, _ = labelled_docs(spark)
    order = [(r["text"], r["label"]) for r in labelled.sample(docs, labels, 1000).collect()]
    weight = plain_ftrl([(Counter(grams(t)), y) for t, y in order])
    asked = docs.unionByName(spark.createDataFrame([(k + 1000, r[1]) for k, r in enumerate(odd_rows()[:40])], docs.schema))
    texts = {r["doc_id"]: r["text"] for r in asked.collect()}
    for doc_id, score in got(quality_model.score(asked, quality_model.fit(docs, labels))):
        i = grams(texts[doc_id])
        dot = sum(weight(k) for k in i) * quality_model.SCALE / max(1, len(i)) + weight(1 << quality_model.BITS)
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, dot))))) < 1e-4


# ---- toxicity: clauses read word by word


def plain_kind(classes):
    """The kind of a clause from the classes of its words, by the rules in words."""
    o, insult, threat, target, negation, report = range(6)
    hits = [k for k, c in enumerate(classes) if c in (insult, threat)]
    if not hits:
        return 0
    negated = any(negation in classes[max(0, k - toxicity.NEGATION_REACH) : k] for k in hits)
    return 1 + 8 * (threat in classes) + 4 * (target in classes) + 2 * negated + (report in classes)


def plain_toxicity(model, text):
    raw, known, stems = (text or "").encode(), model["known"], model["stems"]
    scores = [0.0] * toxicity.KINDS
    for clause in re.split(rb"[\n!.:;?]", raw):
        classes, weights = [], []
        for word in re.findall(rb"[" + LETTERS + rb"]+", clause):
            low = bytes(int(words.LOWER[b]) for b in word)
            kind, weight = toxicity.OTHER, 0.0
            for n in toxicity.STEMS:
                if len(low) > n and (h := hashed(low[:n], 1)) in stems:
                    kind, weight = toxicity.INSULT, stems[h]
            if hashed(low) in known:
                kind, weight = known[hashed(low)]
            classes.append(kind)
            weights.append(weight if kind in (toxicity.INSULT, toxicity.THREAT) else 0.0)
        scores[plain_kind(classes)] += sum(weights)
    scores[0] = 0.0
    dot = sum(math.log1p(s) * w for s, w in zip(scores, model["weights"], strict=True)) + model["intercept"]
    return 1 / (1 + math.exp(-max(-30, min(30, dot))))


def test_toxicity_equals_plain_loops(spark):
    docs, labels, _ = labelled_docs(spark)
    packed = toxicity.fit(docs, labels)
    model = pickle.loads(packed)
    assert model["known"] and np.abs(model["weights"]).max() > 0
    more = ["You idiot. Not you! never an idiot", "he said: kill them; nobody", "KILL", "no a b idiot", "no a b c idiot", "said kill you not idiot moron", "idiot\nyou"]
    asked = docs.unionByName(spark.createDataFrame([(k + 1000, t) for k, t in enumerate(more + [r[1] for r in odd_rows()[:40]])], docs.schema))
    texts = {r["doc_id"]: r["text"] for r in asked.collect()}
    for doc_id, score in got(toxicity.score(asked, packed)):
        assert abs(score - plain_toxicity(model, texts[doc_id])) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_machine_equals_the_rules_in_words(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        classes = rng.choices(range(6), k=rng.randint(0, 12))
        s = 0
        for c in classes:
            s = toxicity.STEP[s, c]
        assert toxicity.KIND[s] == plain_kind(classes), classes


# ---- language: features and predictions


def plain_language(labels, weights, change, text):
    found = [w.lower() for w in re.findall(rb"[" + LETTERS + rb"]+", lowered(text))]
    if not found or not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0

    def row(raw, seed=0):
        return hashed(raw, seed) >> (64 - language_id.BITS)

    emit = []
    for w in found:
        wide = b" " + w + b" "
        three = [((int.from_bytes(wide[k : k + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS) for k in range(len(w))]
        own = [row(w), row(w[:3], 1), row(w[-3:], 2)]
        emit.append(sum(weights[i].astype(float) for i in own) + sum(weights[i].astype(float) for i in three) * language_id.GRAMS / len(three))
    e, t = np.exp(np.array(emit)), np.exp(change)
    ahead, back = [e[0] / e[0].sum()], [np.ones(len(labels))]
    for k in range(1, len(e)):
        v = (ahead[-1] @ t) * e[k]
        ahead.append(v / v.sum())
    for k in range(len(e) - 1, 0, -1):
        v = t @ (e[k] * back[0])
        back.insert(0, v / v.sum())
    own = np.array(ahead) * np.array(back)
    share = (own / own.sum(axis=1, keepdims=True)).mean(axis=0)
    return labels[int(share.argmax())], float(share.max())


def test_languages_equal_plain_forward_backward(spark):
    rng = random.Random(7)
    kinds = {"aa": "abcde", "bb": "efghij", "cc": "jklmné"}
    docs = spark.createDataFrame([(k, sentence(rng, rng.randint(2, 40), kinds[lang]), lang) for k, lang in enumerate(sorted(kinds) * 40)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, docs.selectExpr("doc_id", "lang AS label"))
    labels, weights, change = language_id.unpack(model)
    mixed = [sentence(rng, 20, "abcde") + " " + sentence(rng, 15, "jklmné"), "a", "A1b2", "漢字 abc", "...", None, "", "Éé É", sentence(rng, 200, "efghij")]
    asked = spark.createDataFrame(list(enumerate(mixed + [r["text"] for r in docs.limit(30).collect()])), "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in asked.collect()}
    for doc_id, lang, score in got(language_id.predict(asked, model)):
        expected = plain_language(labels, weights, change, texts[doc_id])
        assert lang == expected[0] and abs(score - expected[1]) < 1e-6
