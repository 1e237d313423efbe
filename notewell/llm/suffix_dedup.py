"""Removal of byte strings that occur more than once, found with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes, in
the same document or another. Strings are judged on the input.

1. Each string is assigned the leftmost smallest hashed gram (half its length) inside it, its
   anchor; equal strings have equal anchors. The starts that follow each other with the same
   anchor form a segment: the text from the first start to the end of the last string.
2. Only anchors whose hash occurs twice can belong to a repeated string. Equal segments are
   counted; where there are two or more, all their strings are repeated.
3. The texts of the other segments are cut out and put together by anchor. For each anchor
   the suffix array of its segments is built (linear grouping construction, see
   ``suffix_array``); neighbours in it that agree on ``length`` bytes are repeated.
   The segments of an anchor with more different ones than ``GROUP`` are not brought into one
   task. They are cut into blocks of ``BLOCK`` starts; equal strings of a block have its core,
   the bytes common to all of them, so blocks meet by the hash of the core instead, and the
   same is done again. Where even a core has too many different surroundings, each single
   string is counted by a 128-bit hash, which is exact up to collisions.
4. The starts found are mapped back to their documents and merged into spans.

Defined results: a null text counts as empty; texts shorter than ``length`` keep everything;
rows with the same id and text are two documents with equal strings, so all of those go; an
empty input gives no rows; other columns are ignored. A cut through a character of several
bytes leaves bytes that are dropped when the rest is returned as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.llm import words
from notewell.llm.suffix_array import suffix_arrays
from notewell.llm.tables import bounded_batches, bundled, keyed_texts, lean, settle, spread_join, unbundled

LENGTH = 400
GROUP = 64  # different segments of one anchor whose suffixes are sorted together
BLOCK = 16  # starts of a block
BATCH_BYTES = 1 << 20  # text whose suffix arrays are built in step


def _windows(data: np.ndarray, at: np.ndarray, length: int):
    """Anchor hash, content hash, first start (in its text), number of starts and text of each segment."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none
    gram = length // 2
    width = length - gram + 1
    prefix = words.prefix_hash(data)
    grams = words.mix(words.range_hash(prefix, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1)))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= at[text + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor))
    good = fits[first]
    first, last = first[good], last[good]
    if not len(first):
        return none
    content = words.mix(words.range_hash(prefix, first, last + length - 1), 3)
    return grams[anchor[first]], content, first - at[text[first]], last - first, text[first]


def segments(docs: DataFrame, length: int, hashes_only: bool = False) -> DataFrame:
    """``anchor`` of every segment and, unless ``hashes_only``, where and what it is."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [[], [], [], [], []]
            for lo, _, data, at in words.chunks(batch.column(1)):
                found = _windows(data, at, length)
                for part, value in zip(parts, (*found[:4], found[4] + lo), strict=True):
                    part.append(value)
            if not parts[0]:
                continue
            anchor, content, begin, starts, row = map(np.concatenate, parts)
            anchor = pa.array(anchor.view(np.int64))
            if hashes_only:
                yield pa.RecordBatch.from_arrays([anchor], ["anchor"])
                continue
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                anchor, pa.array(content.view(np.int64)), batch.column(0).take(row), batch.column(2).take(row), pa.array(begin.astype(np.int32)), pa.array(starts.astype(np.int32)),
            ], ["anchor", "content", "doc_id", "key", "begin", "starts"])

    schema = "anchor long" if hashes_only else f"anchor long, content long, doc_id {kind}, key long, begin int, starts int"
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(lean(run), schema)


def _compressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key`` and, instead of the text, its bytes in a compressed ``frame``, for the shuffles that carry texts."""
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("frame", T.BinaryType())])

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            frames = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(frames, pa.binary())], [*names, "frame"])

    return rows.mapInArrow(run, schema)


def _cut(length: int):
    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, columns = [], [[] for _ in range(6)]
            rows = []
            for k, (frame, parts) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = expand.decompress(frame.as_py())
                for part in parts:
                    rows.append(k)
                    for column, name in zip(columns, ("anchor", "content", "n", "m", "begin", "starts"), strict=True):
                        column.append(part[name])
                    texts.append(raw[part["begin"] : part["begin"] + part["starts"] + length - 1])
            row = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), batch.column(0).take(row), batch.column(1).take(row), pa.array(texts, pa.binary())],
                ["anchor", "content", "n", "m", "begin", "starts", "doc_id", "key", "segment"],
            )

    return run


def repeated_starts(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each group of segments, flags of each segment's starts whose string stands at another start of the group too."""
    strings, raws, lengths, valid, cuts = [], [], [], [], []
    at = 0
    for group in groups:
        m, total = len(group), 0
        for k, raw in enumerate(group):
            data = np.frombuffer(raw, np.uint8)
            strings += [data.astype(np.int32) + m, np.array([m - 1 - k], np.int32)]  # separators differ, the last is the smallest
            raws += [data, np.zeros(1, np.uint8)]
            n = len(data) - length + 1
            flags = np.zeros(len(data) + 1, bool)
            flags[:n] = True
            valid.append(flags)
            cuts.append((at, n))
            at += len(data) + 1
            total += len(data) + 1
        lengths.append(total)
    text, valid = np.concatenate(strings), np.concatenate(valid)
    order = suffix_arrays(text, np.array(lengths))
    string = np.repeat(np.arange(len(groups)), lengths)
    order = order[valid[order]]
    raw = np.concatenate([*raws, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    left, right = order[:-1], order[1:]
    same = np.flatnonzero(string[left] == string[right])
    for step in (*range(0, length - 7, 8), length - 8):
        same = same[eight[left[same] + step] == eight[right[same] + step]]
    found = np.zeros(len(text), bool)
    found[left[same]] = found[right[same]] = True
    out, k = [], 0
    for group in groups:
        out.append([found[a : a + n] for a, n in cuts[k : k + len(group)]])
        k += len(group)
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def _sort_groups(length: int):
    """Rows arrive sorted by anchor; gives the spans (in their documents) of the segments that occur once."""

    def run(batches):
        import itertools

        def solve(groups, schema):
            flags = repeated_starts([[r[-1] for r in g] for g in groups], length)
            rows, begin, end = [], [], []
            for group, found in zip(groups, flags, strict=True):
                for (n, at, doc, key, _), f in zip(group, found, strict=True):
                    if n == 1 and f.any():
                        a, b = _ranges(f)
                        rows += [(doc, key)] * len(a)
                        begin += (a + at).tolist()
                        end += (b + at + length - 1).tolist()
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], schema), pa.array([k for _, k in rows], pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "key", "first", "last"])

        def stream():
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in (0, 2, 4, 6, 7, 8)]
                for row in zip(*columns, strict=True):
                    yield batch.schema.field("doc_id").type, row

        groups, size, kind = [], 0, None
        for _, rows in itertools.groupby(stream(), key=lambda x: x[1][0]):
            rows = list(rows)
            kind = rows[0][0]
            groups.append([r[1:] for _, r in rows])
            size += sum(len(r[-1]) for _, r in rows)
            if size >= BATCH_BYTES:
                yield solve(groups, kind)
                groups, size = [], 0
        if groups:
            yield solve(groups, kind)

    return run


def _blocks(length: int):
    """The blocks of segments, with a key for the core in place of the anchor and a hash of the block as content."""

    def run(batches):
        for batch in batches:
            rows, key, content, begin, starts, texts = [], [], [], [], [], []
            anchors, first, count = (batch.column(k).to_numpy() for k in (0, 4, 5))
            for k, raw in enumerate(batch.column(8)):
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                prefix = words.prefix_hash(data)
                gram = length // 2
                at = np.arange(len(data) - gram + 1)
                anchor = anchors[k : k + 1].view(np.uint64)
                a = int(np.flatnonzero(words.mix(words.range_hash(prefix, at, at + gram)) == anchor[0])[0])
                number = np.arange((a - count[k] + 1) // BLOCK, a // BLOCK + 1)
                low, high = a - (number + 1) * BLOCK + 1, a - number * BLOCK  # first and last start of each block
                core = words.mix(words.range_hash(prefix, high, low + length), 4)
                key.append(words.mix(core + words.mix(number.astype(np.uint64) + anchor, 5), 6))
                low, high = np.maximum(low, 0), np.minimum(high, count[k] - 1)
                content.append(words.mix(words.range_hash(prefix, low, high + length), 7))
                rows += [k] * len(number)
                begin += (low + first[k]).tolist()
                starts += (high - low + 1).tolist()
                texts += [data[x : y + length].tobytes() for x, y in zip(low, high, strict=True)]
            if not rows:
                continue
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(content).view(np.int64)), batch.column(2).take(row), pa.array(begin, pa.int32()),
                pa.array(starts, pa.int32()), batch.column(6).take(row), batch.column(7).take(row), pa.array(texts, pa.binary()),
            ], ["anchor", "content", "copies", "begin", "starts", "doc_id", "key", "segment"])

    return run


def _single_starts(length: int):
    """The strings of segments by hash."""

    def run(whole_batches):
        for batch in (b.slice(at, 256) for b in whole_batches for at in range(0, len(b), 256)):
            data, at = words.buffers(batch.column(8).cast(pa.large_binary()).view(pa.large_string()))
            prefix = words.prefix_hash(data)
            starts = batch.column(5).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), starts)
            nth = words.runs(starts)
            p = at[row] + nth
            half = p + length // 3
            h1 = words.mix(words.range_hash(prefix, p, p + length))
            h2 = words.mix(words.range_hash(prefix, p, half) * np.uint64(0x9E3779B97F4A7C15) ^ words.range_hash(prefix, half, p + length), 9)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(2).take(take), batch.column(6).take(take), batch.column(7).take(take),
                pa.array(batch.column(4).to_numpy()[row].astype(np.int64) + nth),
            ], ["h1", "h2", "n", "doc_id", "key", "first"])

    return run


def _span(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("doc_id", "key", F.col("begin").cast("long").alias("first"), (F.col("begin") + F.col("starts") + length - 1).cast("long").alias("last"))


def _undecided(distinct: DataFrame) -> DataFrame:
    """Different segments whose anchor has another one, if not all of them are known to be repeated; ``m`` is their number."""
    sizes = settle(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("fewest")).where("m > 1"), "sizes")
    return spread_join(distinct, sizes, ["anchor"], "m").where("fewest = 1").drop("fewest")


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """The ``segments`` whose anchor occurs more than once."""
    again = settle(segments(docs, length, hashes_only=True).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
    return spread_join(segments(docs, length), again, ["anchor"], "times").drop("times")


def _repeated(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` whose anchor and content ``counted`` has ``n > 1`` times."""
    return spread_join(rows, counted.where("n > 1").select("anchor", "content", F.col("n").alias("times")), ["anchor", "content"], "times").drop("times")


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``key`` (hash of id and text), ``first`` and ``last`` (bytes, end excluded) of repeated stretches; they may overlap."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = keyed_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(repeated_anchors(docs, length), "segments")
    place = F.min(F.struct("doc_id", "key", "begin", "starts")).alias("place")
    distinct = settle(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), place), "distinct")
    whole = _span(_repeated(found, distinct), length)

    wanted = _undecided(distinct).select("anchor", "content", "n", "m", "place.*")
    by_doc = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "content", "n", "m", "begin", "starts")).alias("parts"))  # of one document
    texts = _compressed(docs)
    joined = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["doc_id"]) & (texts["key"] == by_doc["key"])).select(texts["doc_id"], texts["key"], "frame", "parts")
    columns = f"anchor long, content long, n long, m long, begin int, starts int, doc_id {kind}, key long, segment binary"
    cut = settle(joined.mapInArrow(lean(_cut(length)), columns), "cut")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = f"doc_id {kind}, key long, first long, last long"

    def by_suffixes(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(lean(_sort_groups(length)), spans)

    few = by_suffixes(cut.where(F.col("m") <= group))

    blocks = f"anchor long, content long, copies long, begin int, starts int, doc_id {kind}, key long, segment binary"
    blocks = settle(cut.where(F.col("m") > group).mapInArrow(lean(_blocks(length)), blocks), "blocks")
    different = settle(blocks.groupBy("anchor", "content").agg(F.sum("copies").alias("n")), "different")
    whole_blocks = _span(_repeated(blocks.where("copies = 1"), different), length)
    open_blocks = blocks.dropDuplicates(["anchor", "content"]).join(_undecided(different), ["anchor", "content"])
    open_blocks = settle(open_blocks.select("anchor", "content", "n", "m", "begin", "starts", "doc_id", "key", "segment"), "open-blocks")
    few_blocks = by_suffixes(open_blocks.where(F.col("m") <= group))

    single = open_blocks.where(F.col("m") > group).mapInArrow(lean(_single_starts(length)), f"h1 long, h2 long, n long, doc_id {kind}, key long, first long")
    single = settle(single, "starts")
    twice = settle(single.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1"), "twice")
    strings = spread_join(single.where("n = 1"), twice, ["h1", "h2"], "times").select("doc_id", "key", "first", (F.col("first") + length).alias("last"))
    return whole.unionByName(few).unionByName(whole_blocks).unionByName(few_blocks).unionByName(strings)


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``rest`` (the other columns), the compressed ``frame`` of the text and ``spans`` (array of first and last) of every row."""
    spans = repeated_spans(docs, length).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one document
    texts = _compressed(bundled(docs))
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["key"] == spans["key"]), "left")
    return joined.select(texts["doc_id"], "frame", F.coalesce("spans", F.array().cast("array<struct<first: bigint, last: bigint>>")).alias("spans"), "rest")


def _kept(batch: pa.RecordBatch):
    """Per row: the text's bytes, and the flags of the bytes that stay."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    spans = batch.column(2)
    border = np.asarray(spans.offsets)
    border = border - border[0]
    flat = spans.flatten()
    first, last = np.asarray(flat.field("first")), np.asarray(flat.field("last"))
    for k, frame in enumerate(batch.column(1)):
        raw = np.frombuffer(expand.decompress(frame.as_py()), np.uint8)
        change = np.zeros(len(raw) + 1, np.int64)
        a, b = border[k], border[k + 1]
        np.add.at(change, first[a:b], 1)
        np.add.at(change, last[a:b], -1)
        yield raw, np.cumsum(change[:-1]) == 0


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""

    def run(batches):
        for batch in batches:
            size, removed, spans, sha = [], [], [], []
            for raw, keep in _kept(batch):
                size.append(len(raw))
                removed.append(int(len(raw) - keep.sum()))
                spans.append(len(_ranges(~keep)[0]))
                sha.append(hashlib.sha256(raw[keep].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked(keyed_texts(docs), length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, with all its columns, and the repeated stretches cut out of ``text``."""

    def run(batches):
        for batch in batches:
            texts = pa.array([raw[keep].tobytes().decode(errors="ignore") for raw, keep in _kept(batch)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(3)], ["doc_id", "text", "rest"])

    rows = marked(docs, length)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), rows.schema["rest"]])
    return unbundled(rows.mapInArrow(lean(run), schema), docs)
