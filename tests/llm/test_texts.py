"""Operators on strings and words against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from notewell.llm import decontamination, near_dedup, packing, sharding, suffix_dedup, words
from notewell.llm.suffix_array import suffix_arrays
from notewell.llm.tables import BATCH_BYTES, bounded_batches, in_bytes, spread_join
from tests.llm.conftest import got, odd_rows, sentence

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=0, max_size=60), min_size=1, max_size=6))
def test_suffix_arrays_are_sorted(strings):
    strings = [[*s, 0] for s in strings]
    out = suffix_arrays(np.concatenate([np.array(s) for s in strings]), np.array([len(s) for s in strings]))
    at, expected = 0, []
    for s in strings:
        expected += [at + k for k in sorted(range(len(s)), key=lambda k: s[k:])]
        at += len(s)
    assert out.tolist() == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB é9.\n", max_size=40), max_size=8))
def test_words_do_not_cross_texts(texts):
    column = pa.array(texts, pa.string())
    for kind, pattern in ((words.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (words.NOT_PUNCT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for lo, hi, data, at in words.chunks(column, 16):
            _, _, first = words.words(data, at, kind)
            found += np.diff(first).tolist()
        assert found == [len(re.findall(pattern, t.translate(LOWER))) for t in texts]


def repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in raws for k in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(odd, none):
    rows = odd_rows()
    expected = sorted(zip([str(r[0]) for r in rows], repeats([r[1] for r in rows], 400), strict=True))
    assert sorted((str(r[0]), tuple(r[1:])) for r in got(suffix_dedup.digests(odd))) == expected
    assert got(suffix_dedup.digests(none)) == []


@pytest.mark.parametrize("group", [2, 64])  # with 2, most anchors are counted by single strings
def test_suffix_dedup_of_one_passage_in_many_texts(spark, group):
    rng = random.Random(5)
    passage = sentence(rng, 30)
    texts = [sentence(rng, 8) + passage[rng.randint(0, 9) :] + sentence(rng, 8) for _ in range(40)] + ["ab" * 200, "c" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = suffix_dedup.repeated_spans(docs, 60, group).collect()
    expected = repeats(texts, 60)
    gone = {k: np.zeros(len(t.encode()), bool) for k, t in enumerate(texts)}
    for r in spans:
        gone[r["doc_id"]][r["first"] : r["last"]] = True
    assert [int(g.sum()) for g in gone.values()] == [e[1] for e in expected]


def test_suffix_dedup_deals_a_frequent_anchor_to_many_tasks(spark):
    rng = random.Random(11)
    passage = sentence(rng, 60)
    texts = [sentence(rng, 12) + passage + sentence(rng, 12) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        met = suffix_dedup.repeated_anchors(docs, 60).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    anchors = Counter(r["anchor"] for r in met)
    once = Counter(r["anchor"] for r in suffix_dedup.segments(docs, 60).collect())
    assert anchors == {a: n for a, n in once.items() if n > 1}
    assert len({(r["doc_id"], r["anchor"], r["begin"]) for r in met}) == len(met)
    for anchor, n in anchors.most_common(3):
        assert n >= 500 and max(Counter(r["task"] for r in met if r["anchor"] == anchor).values()) < n / 4


def test_spread_join_equals_a_join(spark):
    rows = spark.range(9000).selectExpr("IF(id % 3 = 0, id * id % 7, 0) AS a", "1 AS b", "id").union(spark.range(5).selectExpr("id AS a", "2 AS b", "-id AS id"))
    values = rows.where("a <> 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    got_rows = sorted(map(tuple, spread_join(rows, values, ["a", "b"], "times").select("a", "b", "id", "times").collect()))
    assert got_rows == sorted(map(tuple, rows.join(values, ["a", "b"]).select("a", "b", "id", "times").collect()))
    nothing = spread_join(rows, values.where("times < 0"), ["a", "b"], "times")
    assert nothing.columns == ["a", "b", "id", "times"] and nothing.collect() == []


def test_suffix_dedup_keeps_other_columns(odd):
    out = suffix_dedup.clean(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, got(out.select("doc_id", "lang", "rank", "rest")))) == sorted(map(str, got(odd.select("doc_id", "lang", "rank", "rest"))))


def shingle_sets(rows, width):
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        s = frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
        out.setdefault(r[0], []).append(s)
    return out


def groups(sets, percent):
    nodes = [(i, s) for i, group in sets.items() if i is not None for s in group]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(nodes):
        for j, t in nodes[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def test_near_dedup_equals_brute_force(odd, none):
    sets = shingle_sets(odd_rows(), 4)
    expected = groups(sets, 80)
    rows = got(near_dedup.near_duplicates(odd, 4, 80))
    assert len(rows) == len(odd_rows())
    for i, n, component in rows:
        assert component == expected.get(i) and n in [len(s) for s in sets[i]]
    assert got(near_dedup.near_duplicates(none, 4, 80)) == []


def test_near_dedup_compares_across_a_mixed_bucket(spark):
    """Copies at both ends of a chain are linked only through the ones between them."""
    rng = random.Random(11)
    base = sentence(rng, 120).split()
    texts, words_now = [], list(base)
    for k in range(12):
        texts.append(" ".join(words_now))
        words_now[10 * k % 120] = f"w{k}"
        words_now[(10 * k + 5) % 120] = f"v{k}"
    rows = [(100 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = groups(shingle_sets(rows, 3), 80)
    assert {r[0]: r[2] for r in got(near_dedup.near_duplicates(docs, 3, 80))} == expected


def test_block_links_agree_for_small_and_large_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    labels = np.arange(40)
    expected = {(i, j) for j in range(40) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    side = np.zeros(40, int)
    assert set(near_dedup.block_links(labels, sets, side, 50)) == expected
    side[20:] = 1
    assert set(near_dedup.block_links(labels, sets, side, 50)) == {(i, j) for i, j in expected if i < 20 <= j}


def test_keep_one(odd):
    out = near_dedup.keep_one(odd, 4, 80)
    assert out.columns == odd.columns
    ids = [r[0] for r in got(out)]
    expected = groups(shingle_sets(odd_rows(), 4), 80)
    assert sorted(i for i in ids if i is not None) == sorted({c for c in expected.values()}) and ids.count(None) == 2


ITEMS = [(1, "ab cd ef gh ij kl mn op qr st uv wx"), (2, "short item"), (3, None), (None, "ab cd"), (4, "..."), (10, "short item"), (2, "short item"), (5, "Solo")]


def brute_hits(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pattern, (text or "").translate(LOWER))
    hit, names = set(), set()
    for name, t in items:
        own = re.findall(pattern, (t or "").translate(LOWER))
        if name is None or not own:
            continue
        for p in range(max(1, len(own) - window + 1)):
            part = own[p : p + window]
            for q in range(len(w) - len(part) + 1):
                if w[q : q + len(part)] == part:
                    hit |= set(range(q, q + len(part)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 12])  # the second searches the items in several passes
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(7)
    parts = ["ab cd ef gh ij kl mn op qr st uv wx".split()[a : a + n] for a in range(3) for n in (3, 9, 10, 12)]
    texts = [None, "", "SHORT, item!", "short item short item", "solo. Short-Item"]
    texts += [sentence(rng, 5) + " " + ". ".join(" ".join(rng.choice(parts)) for _ in range(3)) + " " + rng.choice(["", "solo", "short item"]) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, items int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in decontamination.hits(docs, items, block_bytes=block_bytes).collect():
        n_hit = sum(b - a for a, b in zip(r["hit_from"], r["hit_to"], strict=True))
        assert (r["n_words"], n_hit, list(r["items"])) == brute_hits(texts[r["doc_id"]], ITEMS)
    out = decontamination.clean(docs, items)
    assert out.columns == docs.columns
    for doc_id, text, _ in got(out):
        assert brute_hits(texts[doc_id], ITEMS)[1] == 0 and text == texts[doc_id] or len(text) < len(texts[doc_id])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_finds_every_occurrence(text, patterns):
    width = max(map(len, patterns))
    table = np.zeros((len(patterns), width), np.int64)
    for k, p in enumerate(patterns):
        table[k, width - len(p) :] = p
    index = decontamination.FmIndex(np.array(text), 5)
    which, lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    found = {k: set() for k in range(len(patterns))}
    for k, a, b in zip(which, lo, hi, strict=True):
        found[int(k)] = set(index.locate(np.arange(a, b)).tolist())
    assert found == {k: {q for q in range(len(text)) if text[q : q + len(p)] == p} for k, p in enumerate(patterns)}


def test_decontamination_without_items_or_documents(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] for r in decontamination.hits(odd, empty).collect())
    assert got(decontamination.hits(none, spark.createDataFrame(ITEMS, "item_id long, text string"))) == []


def test_packing_is_a_round_trip(odd, none):
    from tokenizers import Tokenizer

    paths = packing.default_paths()
    tokenizer = Tokenizer.from_file(paths[0])
    rows = packing.pack(odd, 64, with_ids=True).collect()
    expected = Counter()
    for r in odd_rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 64 or min(64, len(ids))
        edges = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = ids[a:b]
            expected[(r[0], k, a, b - a, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 64) * 1.02 + 2
    assert got(packing.pack(none)) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 50), max_size=20))
def test_best_fit_places_every_rank_once(counts):
    places = packing.best_fit(counts, 32)
    for length, n in counts.items():
        covered = sorted((a, b) for size, a, b, _, _ in places if size == length)
        assert [a for a, _ in covered] == [0, *[b for _, b in covered]][: len(covered)] and (covered[-1][1] if covered else 0) == n
    fill = Counter()
    for length, a, b, first, offset in sorted(places, key=lambda p: p[4]):
        for k in range(b - a):
            assert fill[first + k] == offset
            fill[first + k] += length
    assert all(v <= 32 for v in fill.values())
    assert len(fill) <= 2 * -(-sum(k * v for k, v in counts.items()) // 32) + 1


def test_sharding(odd, none):
    rows = sharding.shard(odd, 4, 64).collect()
    raws = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in raws)
    for shard in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["next_shard"] in (r["shard"], 4) and r["next_version"] == r["map_version"] + 1 for r in rows)
    assert got(sharding.shard(none)) == []


def test_slot_maps_balance_bytes():
    rng = random.Random(1)
    sizes = [{"virtual_slot": s, "n_bytes": rng.randint(1, 1000), "n_rows": 1} for s in range(512)]
    first = sharding.first_map(sizes, 8, 512)
    load = Counter()
    for _, _, shard, n_bytes, _ in first:
        load[shard] += n_bytes
    assert max(load.values()) - min(load.values()) <= 1000
    grown = sharding.grow_map(first, 8)
    after = Counter()
    for (_, slot, a, n_bytes, _), (_, same, b, _, _) in zip(first, grown, strict=True):
        assert slot == same and b in (a, 8)
        after[b] += n_bytes
    assert max(after.values()) - min(after.values()) <= 2000


def test_copies_of_a_row_spread_over_shards(spark):
    """One row 3,000 times among 9,000: shards stay near equal."""
    rng = random.Random(2)
    docs = [(5, "x" * 300)] * 3000 + [(100 + k, "y" * rng.randint(1, 400)) for k in range(6000)]
    load = Counter()
    for r in sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 8).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8


@pytest.mark.parametrize(("size", "bytes_"), [("67108864b", 64 << 20), ("64m", 64 << 20), ("64MB", 64 << 20), ("1g", 1 << 30), ("500", 500), ("2kb", 2048)])
def test_sizes_of_settings(size, bytes_):
    assert in_bytes(size) == bytes_


def test_batches_are_bounded_whatever_the_unit(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(limit)
    try:
        for given_size in ("64m", "1g", "67108864b"):
            spark.conf.set(limit, given_size)
            bounded_batches(spark)
            assert in_bytes(spark.conf.get(limit)) == BATCH_BYTES
    finally:
        spark.conf.set(limit, old)


def test_long_document_is_searched_whole(spark):
    rng = random.Random(12)
    item = sentence(rng, 30)
    text = " ".join(sentence(rng, 4000) + " " + item for _ in range(20))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontamination.hits(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row["n_words"], sum(b - a for a, b in zip(row["hit_from"], row["hit_to"], strict=True)), row["items"]) == brute_hits(text, [(7, item)])


def test_pipeline_cuts_passages_of_51_to_60_words(spark):
    """Passages of over 50 words of everyday length in two documents each are gone from both; the other words stay."""
    rng = random.Random(20)
    made, docs = [], []
    for k in range(120):
        passage = sentence(rng, 51 + k % 10, "aeinorstlu")
        made.append(passage)
        docs += [(2 * k + side, f"{sentence(rng, rng.randint(5, 80))} {passage} {sentence(rng, rng.randint(5, 80))}", "en", "s", 0) for side in (0, 1)]
    docs += [(1000 + k, sentence(rng, rng.randint(1, 200)), "en", "s", 0) for k in range(100)]
    before = {d[0]: d[1] for d in docs}
    after = dict(got(corpus_pipeline.without_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int"), "").select("doc_id", "text")))
    caught = [all(p not in after[2 * k + side] and len(before[2 * k + side]) - len(after[2 * k + side]) >= len(p) for side in (0, 1)) for k, p in enumerate(made)]
    assert all(caught)
    assert all(after[d] == before[d] for d in before if d >= 1000)
    assert all(len(before[d]) - len(after[d]) <= len(made[d // 2]) + 8 for d in before if d < 1000)
