"""Chat formatting, embeddings, components and the registered queries against SQL."""

import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from notewell.llm import chat_format, embedding_dedup
from notewell.llm.components import components
from tests.llm.conftest import got
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@needs_tables
@pytest.mark.parametrize("name", ["op2_chat_format", "op6_decontamination", "op10_embedding_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "cy", ""), (3, 5, None, "x"), (3, 4000, "cy", "é")]


def test_every_participant_has_a_rendering(spark):
    turns = spark.createDataFrame([(*t, "z", 0) for t in TURNS], "conv_id long, turn long, role string, text string, segment string, start int")
    out = {}
    for r in chat_format.rotate(turns, chunk=2).collect():
        out.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(out) == {(1, "ann"), (1, "bob"), (3, "cy")}
    for (_, who), parts in out.items():
        parts.sort(key=lambda r: r["start"])
        whole = "".join(r["segment"] for r in parts)
        at = 0
        for r in parts:
            assert (r["start"], r["end"]) == (at, at + len(r["segment"])) and whole[at : r["end"]] == r["segment"]
            at = r["end"]
            if r["chat_role"] == "assistant":
                assert whole[r["mask_start"] : r["mask_end"]].endswith("<|end|>") and r["name"] is None
            else:
                assert r["mask_start"] is None and (r["chat_role"] == "system" or r["name"] != who)
    ann = "".join(r["segment"] for r in out[(1, "ann")])
    assert ann == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user:bob|>\n<|end|>\n" + 2 * "<|assistant|>\nBye<|end|>\n"


def test_chat_format_of_nothing(spark):
    assert got(chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(100, 99), (99, 98)]])
def test_components(spark, edges):
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = dict(got(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}


def brute(vectors, cosine):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j, w in good.items() if j != i and len(w) == len(v) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= cosine} for i, v in good.items()}
    out = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen) if i is not None else None)
    return out


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_embedding_links_equal_brute_force(spark, tile_rows):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 16))
    vectors = [(k, (centre[k % 6] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist()) for k in range(150)]
    vectors += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (None, [1.0, 2.0]), (207, [float("inf")] * 16), (208, [-0.0, 1.0]), (209, [0.0, 1.0])]
    random.Random(1).shuffle(vectors)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, links int, component string")
    found = {r[0]: (r[1], r[2]) for r in got(embedding_dedup.near_duplicates(df, 0.95, tile_rows=tile_rows))}
    assert found == brute(vectors, 0.95)


def test_embedding_pairs_at_a_block_border_count_once(spark):
    """Pairs whose distance in block 0 is the border of that block, so that single precision falls on either side of it."""
    rng, n, near = np.random.default_rng(8), 64, (2 - 2 * 0.95) / 4 + embedding_dedup.SLACK
    turn, vectors = embedding_dedup.rotation(n), []
    for k in range(1500):
        u = rng.normal(size=n)
        u /= np.sqrt(u @ u)
        step = rng.normal(size=16)
        v = u.copy()
        v[:16] += step * np.sqrt((near + rng.normal() * 1e-8) / (step @ step))
        v[16:] *= np.sqrt((1 - v[:16] @ v[:16]) / (v[16:] @ v[16:]))
        vectors += [(2 * k, (turn @ u).tolist()), (2 * k + 1, (turn @ v).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = got(embedding_dedup.near_duplicates(df, 0.95, tile_rows=700))
    assert sorted(found) == [(i, 1, i - i % 2) for i in range(3000)]


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert got(embedding_dedup.near_duplicates(empty)) == []


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and len({r["doc_id"] for r in out}) <= docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert docs.columns == before.columns
        assert (docs.count() > 0) == (start is odd)
