"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Each permutation of the shingle hashes gives two
signature values, its minimum and its maximum, so a signature of 2k values costs k hash
evaluations. Bands of the signature bring candidates together; a link is confirmed on the
full sets, with whole numbers: 100 * common >= percent * all.

Documents with equal sets are one node, named by their smallest id. The members of a band's
bucket are first compared with the bucket's smallest member; this settles most groups. In
every bucket whose members are then still in different components, all pairs across
components are compared, inside tasks, in tiles of bounded size; only one link per pair of
components leaves a task. So no pair of candidates is skipped and none is written out.

Defined results: null and empty texts have no shingles and no links; a text with fewer words
than a shingle is one shingle; rows with a null id are compared with nothing; rows of the
same id are one document (their sets are linked); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewell.llm import words
from notewell.llm.components import components
from notewell.llm.tables import bounded_batches, keyed_texts, lean, settle

BANDS = 24
BAND_PERMUTATIONS = 2  # each gives a minimum and a maximum: four values a band, found at 0.8 with 1 - 3e-6
TILE = 1024  # members of a bucket that are compared with as many others in one group
HASH_BYTES = 6  # of a shingle's hash in a stored set
_SLICE = 4096  # shingles in one product of incidence matrices


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted in each text), and the border of each text in them."""
    _, h, first = words.words(data, at, words.NOT_SPACE)
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, size - width + 1), 0)
    begin = np.repeat(first[:-1], count) + words.runs(count)
    end = np.repeat(first[1:], count)
    value = np.zeros(len(begin), np.uint64)
    for k in range(width):
        inside = begin + k < end
        value = np.where(inside, value * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(begin + k, len(h) - 1)], value) if len(h) else value
    value = words.mix(value, 5) >> np.uint64(64 - 8 * HASH_BYTES)
    parts, border = [], np.zeros(len(count) + 1, np.int64)
    edge = np.concatenate(([0], np.cumsum(count)))
    for k in range(len(count)):
        part = np.unique(value[edge[k] : edge[k + 1]])
        parts.append(part)
        border[k + 1] = border[k] + len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), border


def _seeds() -> np.ndarray:
    return words.mix(np.arange(BANDS * BAND_PERMUTATIONS, dtype=np.uint64), 11) | np.uint64(1)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles``, two digests of the set, and a key for each band."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seeds = _seeds()
        for batch in batches:
            n = len(batch)
            size, digest, keys = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64)
            for lo, hi, data, at in words.chunks(batch.column(1)):
                value, border = shingles(data, at, width)
                size[lo:hi] = np.diff(border)
                full = np.flatnonzero(size[lo:hi])
                if not len(full):
                    continue
                cut, full = border[:-1][full], full + lo
                base = words.mix(value, 7)
                digest[0, full] = np.add.reduceat(base, cut)
                digest[1, full] = np.add.reduceat(words.mix(value, 8), cut)
                for band in range(BANDS):
                    key = np.full(len(full), band + 1, np.uint64)
                    for k in range(BAND_PERMUTATIONS):
                        turned = base * seeds[band * BAND_PERMUTATIONS + k]
                        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, cut))
                        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(turned, cut))
                    keys[full, band] = key
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), bands], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return keyed_texts(docs).mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, d1 long, d2 long, bands array<long>")


def stored_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles``, the sorted hashes packed into bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            packed = []
            for lo, hi, data, at in words.chunks(batch.column(1)):
                value, border = shingles(data, at, width)
                raw = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                packed += [raw[border[k] : border[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(lean(run), f"id {kind}, shingles binary")


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(np.uint64).ravel()


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep, last, other = [], None, None
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                raw = y.as_py()
                if raw != last:
                    last, other = raw, unpack(raw)
                own = unpack(x.as_py())
                if percent * max(len(own), len(other)) <= 100 * min(len(own), len(other)) and linked(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def block_links(labels: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of one linked pair for each two labels that a pair links; pairs are taken across sides only, or all if there is one side."""
    size = np.array([len(s) for s in sets])
    one = bool((side == side[0]).all())
    if len(sets) <= 8:
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if labels[i] != labels[j] and (one or side[i] != side[j]) and percent * max(size[i], size[j]) <= 100 * min(size[i], size[j])]
        out = [(i, j) for i, j in pairs if linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j], percent)]
    else:
        distinct, column, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = freq[column] > 1  # a shingle of one member adds nothing to any pair
        dense = np.cumsum(freq > 1) - 1
        row, column = row[shared], dense[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for begin in range(0, int((freq > 1).sum()), _SLICE):
            lo, hi = np.searchsorted(column, (begin, begin + _SLICE))
            matrix = np.zeros((len(sets), _SLICE), np.float32)
            matrix[row[lo:hi], column[lo:hi] - begin] = 1
            common += matrix @ matrix.T
        good = linked(common.astype(np.int64), size[:, None], size[None, :], percent) & (labels[:, None] != labels[None, :])
        if not one:
            good &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(good, 1))
        out = list(zip(i.tolist(), j.tolist(), strict=True))
    seen = {}
    for i, j in out:
        seen.setdefault((min(labels[i], labels[j]), max(labels[i], labels[j])), (i, j))
    return list(seen.values())


def _across(percent: int):
    """Links across labels in each (bucket, tile, tile) group of rows that arrive sorted by it."""

    def solve(rows):
        labels = np.array([r[1] for r in rows])
        if len(set(labels.tolist())) < 2:
            return []
        got = block_links(labels, [unpack(r[3]) for r in rows], np.array([r[2] for r in rows]), percent)
        return [(labels[i], labels[j]) for i, j in got]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for bucket, low, high, node, label, tile, packed in zip(*columns, strict=True):
                if (bucket, low, high) != key:
                    found += solve(rows) if rows else []
                    key, rows = (bucket, low, high), []
                rows.append((node, label, tile, packed))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = solve(rows) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; ``doc_id`` must be a whole number."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sig = settle(signatures(docs, width), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = settle(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = settle(members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    inside = settle(members.join(buckets, "bucket"), "members")  # members of buckets of two or more
    pairs = settle(inside.where("node <> pivot").select("node", "pivot").distinct(), "pairs")

    wanted = inside.select("node").distinct()
    texts = keyed_texts(docs).join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
    once = texts.groupBy("doc_id", F.xxhash64("text")).agg(F.any_value("text").alias("text"))  # repeated rows; an id may still have several texts
    sets = settle(stored_sets(once.select("doc_id", "text"), width), "sets")
    own = pairs.join(sets.withColumnRenamed("shingles", "x"), pairs["node"] == sets["id"]).select("node", "pivot", "x")
    other = sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("y"))
    confirmed = own.join(other, "pivot").select("node", "pivot", "x", "y").mapInArrow(lean(_confirm(percent)), "a long, b long")
    same_id = full.select("doc_id", "d1", "d2", "n_shingles").join(nodes.select("d1", "d2", "n_shingles", "node"), ["d1", "d2", "n_shingles"])
    edges = settle(confirmed, "links")
    shared = settle(same_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b"), "same-id")
    first = components(edges.unionByName(shared))

    label = F.coalesce("component", "node").alias("label")
    named = inside.join(first, "node", "left").select("bucket", "node", "n", label)
    mixed = named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("bucket")
    tiles = F.ceil(F.col("n") / TILE)
    tile = F.pmod(F.xxhash64("node"), tiles)
    spread = named.join(mixed, "bucket").select("bucket", "node", "label", tile.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("with"))
    spread = spread.select("bucket", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "node", "label", "tile")
    loaded = spread.join(sets, spread["node"] == sets["id"]).select("bucket", "low", "high", "node", "label", "tile", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = loaded.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "tile").mapInArrow(lean(_across(percent)), "a long, b long")
    second = components(across)

    merged = nodes.select("d1", "d2", "n_shingles", "node").join(first, "node", "left").select("d1", "d2", "n_shingles", label)
    merged = merged.join(second.select(F.col("node").alias("label"), F.col("component").alias("further")), "label", "left")
    merged = merged.select("d1", "d2", "n_shingles", F.coalesce("further", "label").alias("component_id"))
    keys = (F.col("s.d1") == F.col("m.d1")) & (F.col("s.d2") == F.col("m.d2")) & (F.col("s.n_shingles") == F.col("m.n_shingles")) & F.col("s.doc_id").isNotNull()
    out = sig.select("doc_id", "n_shingles", "d1", "d2").alias("s").join(merged.alias("m"), keys, "left")
    return out.select("s.doc_id", "s.n_shingles", F.coalesce("m.component_id", "s.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each group the one with the smallest id; rows with a null id stay."""
    found = near_duplicates(docs, width, percent)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.join(stay, docs["doc_id"] == stay["id"], "left_semi")
    nth = "nth"
    while nth in docs.columns:
        nth += "_"
    once = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
