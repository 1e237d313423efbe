"""Ranked lexical search with MaxScore whose bounds are tightened by term pairs.

1. Documents are cut into shards (one Arrow batch each). A shard is one row of a stored table:
   its ids, the terms in it, and per term a posting list (places and occurrences).
2. Document counts and lengths are summed over all shards, and so are the documents per term.
3. For each block of items the index is completed: occurrences become integer impacts, and
   for every pair of neighbouring terms of an item (by document count) the shard gets
   the intersection of the two posting lists and the largest joint impact in it.
4. A search takes an item's terms as units, pairs where there is one. A unit can add no more than
   the joint maximum of the pair, or the larger maximum of the two outside the intersection, which is
   less than the sum of both maxima. The units with the smallest bounds that together stay below
   the item's 20th best score are not essential: only documents in the lists of the others are
   candidates, and a candidate is dropped as soon as its score and the bounds left (smaller
   outside a pair's intersection) cannot reach that score. The best lists live as long as the task, so later
   shards start with a high threshold. Scores are exact; nothing is dropped that could rank.

Items are taken in blocks of bounded bytes, one block after the other over the stored shards.

Defined results: null and empty texts have no terms; repeated documents and documents with a
null id rank as any other, null ids behind equal scores; an item given twice counts once, items
with one id and different texts are ranked each; an item without terms gets no rows; an empty
input gives none; other columns are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from notewell.llm import words
from notewell.llm.tables import bounded_batches, keyed_texts, settle, settle_wide

BEST = 20
BLOCK_BYTES = 1 << 20  # text of the items that are searched in one pass
PARTS = 32  # first level of the ranking of one item's finds


def _one(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def postings(docs: DataFrame) -> DataFrame:
    """One row per shard: ``doc_ids`` and their lengths ``n``, ``terms`` (sorted), the borders ``at`` of their lists, ``place`` and ``tf``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            hashes, row = [], []
            for lo, hi, data, at in words.chunks(batch.column(1)):
                _, found, first = words.words(data, at, words.NOT_PUNCT)
                hashes.append(found)
                row.append(np.repeat(np.arange(lo, hi), np.diff(first)))
            if not hashes:
                continue
            hashes, row = np.concatenate(hashes).view(np.int64), np.concatenate(row)
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(row)))
            terms, place = hashes[first], row[first]
            edge = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            n = np.bincount(row, minlength=len(batch))
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([
                ids, _one(n, pa.int64()), _one(terms[edge], pa.int64()), _one(np.append(edge, len(terms)), pa.int32()), _one(place, pa.int32()), _one(tf, pa.int32()),
                pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
            ], ["doc_ids", "n", "terms", "at", "place", "tf", "n_docs", "n_terms"])

    schema = f"doc_ids array<{kind}>, n array<long>, terms array<long>, at array<int>, place array<int>, tf array<int>, n_docs long, n_terms long"
    return keyed_texts(docs).mapInArrow(run, schema)


def document_counts(shards: DataFrame) -> DataFrame:
    """``term`` and ``df``, the number of documents that hold it, over all shards."""
    found = F.explode(F.expr("transform(terms, (t, i) -> struct(t AS term, at[i + 1] - at[i] AS df))")).alias("e")
    return shards.select(found).groupBy("e.term").agg(F.sum(F.col("e.df").cast("long")).alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The terms of a block of items: for each item weights with repeats, and its terms in units of one or two."""

    def __init__(self, items: list[tuple], n_docs: int):
        self.names, self.found = [], []
        self.n_docs = n_docs
        for lo, hi, data, at in words.chunks(pa.array([t for _, t in items], pa.large_string())):
            _, hashes, first = words.words(data, at, words.NOT_PUNCT)
            for k in range(hi - lo):
                terms, times = np.unique(hashes[first[k] : first[k + 1]].view(np.int64), return_counts=True)
                if len(terms):
                    self.names.append(items[lo + k][0])
                    self.found.append((terms, times))
        self.vocabulary = np.unique(np.concatenate([t for t, _ in self.found])) if self.found else np.zeros(0, np.int64)

    def weigh(self, df: dict[int, int]) -> None:
        self.weights = np.array([weight(self.n_docs, df.get(t, 0)) for t in self.vocabulary.tolist()], np.int64)
        counts = np.array([df.get(t, 0) for t in self.vocabulary.tolist()], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        self.units = []
        for terms, times in self.found:
            term = np.searchsorted(self.vocabulary, terms)
            live = (counts[term] > 0) & (self.weights[term] > 0)
            term, times = term[live], times[live]
            order = np.lexsort((term, counts[term]))
            term, times = term[order], times[order]
            a, b = term[0::2], term[1::2]
            number = np.full(len(a), -1)
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=False)):
                number[k] = pairs.setdefault((min(x, y), max(x, y)), len(pairs))
            whole_b, times_b = np.full(len(a), -1), np.zeros(len(a), np.int64)
            whole_b[: len(b)], times_b[: len(b)] = b, times[1::2]
            self.units.append((a, whole_b, times[0::2], times_b, number))
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)


def _column(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.asarray(batch.column(name)[k].values)


def _complete(items: Items, mean: tuple[int, int]):
    """Impacts in place of occurrences, and per pair of the block its largest joint impact and the intersection of the lists."""
    n_docs, n_terms = mean

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                n, terms, at, place, tf = (_column(batch, c, k).astype(np.int64) for c in ("n", "terms", "at", "place", "tf"))
                m = 75 + 25 * n * n_docs // max(n_terms, 1)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
                where = _places(terms, items.vocabulary)
                pair, joint, sizes, both = [], [], [], []
                a, b = (where[items.pairs[:, c]] for c in (0, 1))
                for p in np.flatnonzero((a >= 0) & (b >= 0)).tolist():
                    left, right = slice(at[a[p]], at[a[p] + 1]), slice(at[b[p]], at[b[p] + 1])
                    shared, i, j = np.intersect1d(place[left], place[right], assume_unique=True, return_indices=True)
                    if len(shared):
                        w = items.weights[items.pairs[p]]
                        pair.append(p)
                        joint.append(int((w[0] * impact[left][i] + w[1] * impact[right][j]).max()))
                        sizes.append(len(shared))
                        both.append(shared)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids").slice(k, 1), _one(terms, pa.int64()), _one(at, pa.int32()), _one(place, pa.int32()), _one(impact, pa.int32()), _one(pair, pa.int32()),
                    _one(joint, pa.int64()), _one(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), _one(np.concatenate(both) if both else [], pa.int32()),
                ], ["doc_ids", "terms", "at", "place", "impact", "pair", "joint", "pair_at", "pair_place"])

    return run


def _places(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted term stands among the sorted terms; -1 where it does not."""
    if not len(terms):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


class Shard:
    """One shard's lists, ready for the items of a block."""

    def __init__(self, items: Items, batch: pa.RecordBatch, k: int):
        self.ids = batch.column("doc_ids")[k].values
        terms, self.at, self.place, self.impact = (_column(batch, c, k).astype(np.int64) for c in ("terms", "at", "place", "impact"))
        pair, joint, self.pair_at, self.pair_place = (_column(batch, c, k).astype(np.int64) for c in ("pair", "joint", "pair_at", "pair_place"))
        self.where = _places(terms, items.vocabulary)
        highest = np.maximum.reduceat(self.impact, self.at[:-1]) if len(terms) else np.zeros(1, np.int64)
        self.highest = np.where(self.where >= 0, highest[self.where], 0) * items.weights
        self.joint, self.pair_row = np.zeros(len(items.pairs) + 1, np.int64), np.full(len(items.pairs) + 1, -1)
        self.joint[pair], self.pair_row[pair] = joint, np.arange(len(pair))
        self.score = np.zeros(len(self.ids), np.int64)
        self.weights = items.weights

    def list(self, term: int, times: int) -> tuple[np.ndarray, np.ndarray]:
        t = self.where[term]
        lo, hi = (self.at[t], self.at[t + 1]) if t >= 0 else (0, 0)
        return self.place[lo:hi], self.impact[lo:hi] * (self.weights[term] * times)

    def search(self, units: tuple, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents whose score is ``least`` or more."""
        a, b, times_a, times_b, number = units
        high_a, high_b = self.highest[a] * times_a, np.where(b >= 0, self.highest[b], 0) * times_b
        apart = np.maximum(high_a, high_b)
        bound = np.minimum(high_a + high_b, np.maximum(apart, self.joint[number] * np.maximum(times_a, times_b)))
        order = np.argsort(bound, kind="stable")
        below = np.concatenate(([0], np.cumsum(bound[order])))  # what the first so many units can add
        optional = int(np.searchsorted(below[1:], least))
        if optional == len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = self.score
        score[:] = 0
        for u in order[optional:].tolist():
            for term, times in ((a[u], times_a[u]), (b[u], times_b[u])):
                if term >= 0:
                    place, value = self.list(term, times)
                    score[place] += value
        some = np.flatnonzero(score)
        some = some[score[some] + below[optional] >= least]
        for k in range(optional - 1, -1, -1):
            if not len(some) or not bound[order[k]]:
                break
            u = order[k]
            row = self.pair_row[number[u]] if b[u] >= 0 else -1
            if b[u] >= 0:  # outside the intersection the pair adds the larger maximum at most
                inside = _within(self.pair_place[self.pair_at[row] : self.pair_at[row + 1]], some)[0] if row >= 0 else np.zeros(len(some), bool)
                some = some[score[some] + np.where(inside, bound[u], min(apart[u], bound[u])) + below[k] >= least]
            for term, times in ((a[u], times_a[u]), (b[u], times_b[u])):
                if term >= 0:
                    place, value = self.list(term, times)
                    hit, at = _within(place, some)
                    score[some[hit]] += value[at[hit]]
            some = some[score[some] + below[k] >= least]
        return some, score[some]


def _within(place: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``some`` are in the sorted list, and where."""
    if not len(place):
        return np.zeros(len(some), bool), np.zeros(len(some), np.int64)
    at = np.minimum(np.searchsorted(place, some), len(place) - 1)
    return place[at] == some, at


def _search(items: Items, best: int, kind: str, name: str):
    def run(batches):
        lists: list[list] = [[] for _ in items.names]  # of each item: (-score, id is null, id), sorted, `best` at most
        for batch in batches:
            for k in range(len(batch)):
                shard = Shard(items, batch, k)
                for q, units in enumerate(items.units):
                    least = -lists[q][-1][0] if len(lists[q]) == best else 1
                    at, score = shard.search(units, least)
                    if len(at) > best:
                        keep = score >= np.partition(score, len(score) - best)[len(score) - best]
                        at, score = at[keep], score[keep]
                    if len(at):
                        ids = shard.ids.take(pa.array(at)).to_pylist()
                        lists[q] = sorted([*lists[q], *((-s, i is None, i if i is not None else 0) for s, i in zip(score.tolist(), ids, strict=True))])[:best]
        rows = [(*n, None if null else i, -s) for n, found in zip(items.names, lists, strict=True) for s, null, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    schema = f"item_id {name}, key long, doc_id {kind}, score long"
    types = to_arrow_schema(T.StructType.fromDDL(schema))
    return run, schema


def search(docs: DataFrame, benchmark: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``best`` documents of each item of ``benchmark`` (``item_id``, ``text``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, name = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    shards = settle_wide(postings(docs), "postings")
    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    mean = totals[0] or 0, totals[1] or 0
    counts = settle(document_counts(shards), "terms")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod("key", F.lit(blocks)) == block) if blocks > 1 else items
        wanted = Items([((r["item_id"], r["key"]), r["text"]) for r in part.collect()], mean[0])  # about block_bytes
        terms = spark.createDataFrame(pa.table({"term": wanted.vocabulary}))
        wanted.weigh({r["term"]: r["df"] for r in counts.join(F.broadcast(terms), "term").collect()})  # a block's terms
        columns = f"doc_ids array<{kind}>, terms array<long>, at array<int>, place array<int>, impact array<int>, pair array<int>, joint array<long>, pair_at array<int>, pair_place array<int>"
        index = settle_wide(shards.mapInArrow(_complete(wanted, mean), columns), "index")
        run, schema = _search(wanted, best, kind, name)
        here = index.mapInArrow(run, schema)
        here = settle(here, "found") if blocks > 1 else here
        found = here if found is None else found.unionByName(here)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    last = Window.partitionBy("item_id", "key").orderBy(*order)
    top = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    return top.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
