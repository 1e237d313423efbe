"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents. Its words become symbols; words that no test phrase holds
can be part of no match, so only runs of known words at least as long as the shortest phrase
are indexed, with a separator between runs. The index is the Burrows-Wheeler transform of
that sequence in a wavelet matrix with ranks, the symbol counts, and every fourth suffix
position. All test phrases are searched backwards together; occurrences are located by
walking to a sampled position, and their word ranges are merged into removal spans.

Test items are taken in blocks of bounded size, one after the other over the same documents,
so neither the driver nor a task ever holds more than one block of phrases per pass.

Defined results: null and empty texts have no words and no hits; items without words have no
phrase; items with a null id are left out; an item given twice counts once; repeated
documents are searched each; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.llm import words
from notewell.llm.tables import bounded_batches, bundled, lean, settle, unbundled

WINDOW = 10  # words of a phrase; a shorter item is one phrase
BLOCK_BYTES = 4 << 20  # text of the items that are searched in one pass
SAMPLE = 4  # every fourth suffix position is kept


class FmIndex:
    """Index of a symbol sequence (int array, symbols from 0)."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.text = np.append(np.asarray(text) + 1, 0)  # the end is a symbol of its own, below all others
        sigma += 1
        n = len(self.text)
        rank, reach = self.text.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            if reach < n:
                ahead[:-reach] = rank[reach:] + 1
            key = rank * (n + sigma + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            if rank[order[-1]] == n - 1:
                break
            reach *= 2
        last = self.text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=sigma))))
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (last >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones)))))
            self.zeros.append(n - int(ones.sum()))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        kept = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the given place."""
        lo, hi = np.zeros(len(at), np.int64), at
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            up = (symbol >> bit) & 1 == 1
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            hi = np.where(up, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def symbol_at(self, at: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(at), np.int64), at
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            up = ones[i + 1] > ones[i]
            out |= up.astype(np.int64) << bit
            i = np.where(up, zeros + ones[i], i - ones[i])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and suffix intervals of the patterns (rows, aligned to the right) that occur."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.text), np.int64)
        for k in range(patterns.shape[1]):
            more = lengths[which] > k
            c = patterns[which, -1 - k] + 1
            lo = np.where(more, self.before[c] + self.ranks(c, lo), lo)
            hi = np.where(more, self.before[c] + self.ranks(c, hi), hi)
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their order."""
        out, todo, i = np.zeros(len(at), np.int64), np.arange(len(at)), at
        steps = 0
        while len(todo):
            hit = self.kept[i + 1] > self.kept[i]
            out[todo[hit]] = self.positions[self.kept[i[hit]]] + steps
            todo, i = todo[~hit], i[~hit]
            c = self.symbol_at(i)
            i = self.before[c] + self.ranks(c, i)
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, as symbols, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[tuple, set] = {}
        for lo, hi, data, at in words.chunks(pa.array([t for _, t in items], pa.large_string())):
            _, hashes, first = words.words(data, at, words.NOT_PUNCT)
            for k in range(hi - lo):
                own = hashes[first[k] : first[k + 1]].tolist()
                for w in range(max(1, len(own) - window + 1) if own else 0):
                    found.setdefault(tuple(own[w : w + window]), set()).add(number[items[lo + k][0]])
        vocabulary = np.unique(np.array([w for phrase in found for w in phrase], np.uint64))
        self.symbols = words.Lookup(vocabulary, np.arange(1, len(vocabulary) + 1))
        self.sigma = len(vocabulary) + 1
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 1
        self.table = np.zeros((len(found), self.width), np.int64)
        for k, phrase in enumerate(found):
            self.table[k, self.width - len(phrase) :] = np.searchsorted(vocabulary, np.array(phrase, np.uint64)) + 1
        self.item_at = np.concatenate(([0], np.cumsum([len(v) for v in found.values()]))).astype(np.int64)
        self.item = np.array([i for v in found.values() for i in sorted(v)], np.int64)


def find(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text (total at the end), a flag for each word, and (text, item) pairs as rows."""
    firsts, kept_symbol, kept_word, n_words = [np.zeros(1, np.int64)], [], [], 0
    for _, _, data, at in words.chunks(column):
        starts, hashes, first = words.words(data, at, words.NOT_PUNCT)
        i, s = phrases.symbols.find(hashes)
        if len(i):
            text = np.searchsorted(first, i, side="right")
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (text[1:] != text[:-1])
            run = np.flatnonzero(new)
            size = np.diff(np.append(run, len(i)))
            long = np.repeat(size >= phrases.shortest, size)
            i, s, new = i[long], s[long], new[long]
            places = np.arange(len(i)) + np.cumsum(new)  # one place for the separator before each run
            symbol, word = np.zeros(len(i) + int(new.sum()), np.int64), np.full(len(i) + int(new.sum()), -1)
            symbol[places], word[places] = s, i + n_words
            kept_symbol.append(symbol)
            kept_word.append(word)
        firsts.append(first[1:] + n_words)
        n_words += len(starts)
    first = np.concatenate(firsts)
    flags, pairs = np.zeros(n_words, bool), np.zeros((0, 2), np.int64)
    if kept_symbol and len(phrases.table) and sum(map(len, kept_symbol)):
        symbol, word = np.concatenate(kept_symbol), np.concatenate(kept_word)
        index = FmIndex(symbol, phrases.sigma)
        which, lo, hi = index.search(phrases.table, phrases.lengths)
        count = hi - lo
        at = index.locate(np.repeat(lo, count) + words.runs(count))
        phrase = np.repeat(which, count)
        if len(at):
            begin = word[at]
            change = np.zeros(n_words + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + phrases.lengths[phrase], -1)
            flags = np.cumsum(change[:-1]) > 0
            text = np.searchsorted(first, begin, side="right") - 1
            seen = np.unique(text * len(phrases.table) + phrase)
            text, phrase = seen // len(phrases.table), seen % len(phrases.table)
            n = phrases.item_at[phrase + 1] - phrases.item_at[phrase]
            item = phrases.item[np.repeat(phrases.item_at[phrase], n) + words.runs(n)]
            pairs = np.unique(np.column_stack((np.repeat(text, n), item)), axis=0)
    return first, flags, pairs


def _lists(values, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


_COUNTS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``text``, the number of words, the merged ranges of hit words, the ids of the items found and ``rest`` (the other columns).

    ``benchmark`` has ``item_id`` and ``text``.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / block_bytes))
    out = bundled(docs)
    schema = T.StructType([out.schema["doc_id"], out.schema["text"], *_COUNTS, out.schema["rest"]])
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        phrases = Phrases([(r["item_id"], r["text"]) for r in part.collect()], window)  # about block_bytes
        out = out.mapInArrow(lean(_search(phrases, block > 0)), schema)
        if block + 1 < blocks:
            out = settle(out, "hits")  # so that the next block finds the phrases of this one gone from the plan
    return out


def _search(phrases: Phrases, again: bool):
    """One pass; with ``again``, ranges and items of earlier passes are kept too."""

    def run(batches):
        for batch in batches:
            first, flags, pairs = find(phrases, batch.column(1))
            names = np.array(phrases.names, object)[pairs[:, 1]]
            text = pairs[:, 0]
            if again:
                n = np.diff(np.asarray(batch.column(3).offsets))
                if n.sum():
                    shift = np.repeat(first[:-1], n)
                    change = np.zeros(len(flags) + 1, np.int64)
                    np.add.at(change, np.asarray(batch.column(3).flatten()) + shift, 1)
                    np.add.at(change, np.asarray(batch.column(4).flatten()) + shift, -1)
                    flags |= np.cumsum(change[:-1]) > 0
                old = np.diff(np.asarray(batch.column(5).offsets))
                text = np.concatenate((text, np.repeat(np.arange(len(old)), old)))
                names = np.concatenate((names, np.array(batch.column(5).flatten().to_pylist(), object)))
                order = sorted(range(len(text)), key=lambda k: (text[k], names[k]))
                text, names = text[order], names[order]
            edge = np.ones(len(flags) + 1, bool)  # a range never goes on into the next text
            edge[1:-1] = flags[1:] != flags[:-1]
            edge[first] = True
            at = np.flatnonzero(edge)
            begin, end = at[:-1], at[1:]
            hit = flags[begin] if len(flags) else np.zeros(0, bool)
            begin, end = begin[hit], end[hit]
            of = np.searchsorted(first, begin, side="right") - 1
            n = np.bincount(of, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(first), pa.int64()), _lists(begin - first[of], n, pa.int64()), _lists(end - first[of], n, pa.int64()),
                _lists(list(names), np.bincount(text, minlength=len(batch)), pa.string()),
                batch.column(batch.num_columns - 1),
            ], ["doc_id", "text", "n_words", "hit_from", "hit_to", "items", "rest"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, with all its columns, and the hit words and all between them cut out of ``text``."""

    def run(batches):
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), np.diff(np.asarray(batch.column(3).offsets))
            begins, ends = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k in np.flatnonzero(n):
                raw = np.frombuffer(texts[k].encode(), np.uint8)
                starts, stops = words.find_words(words.LOWER[raw], np.array([0, len(raw)]), words.NOT_PUNCT)
                keep = np.ones(len(raw), bool)
                for a, b in zip(begins[k], ends[k], strict=True):
                    keep[starts[a] : stops[b - 1]] = False
                texts[k] = raw[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(6)], ["doc_id", "text", "rest"])

    rows = hits(docs, benchmark, window)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text"], rows.schema["rest"]])
    return unbundled(rows.mapInArrow(lean(run), schema), docs)
