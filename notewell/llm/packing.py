"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed length.

Documents become pieces: only a document longer than a sequence is cut, its first piece
taking the odd rest. Pieces and the gaps of open sequences are kept sorted by length. In
each round every class of equally long unplaced pieces sweeps to the smallest gap that
holds it; where several classes want the same gaps, the longer ones rank first and the
others try again; gaps are updated, and the next round begins. New sequences are opened
when the longest unplaced class fits no gap.

The unit of a round is the class of pieces of one length, with ranks inside it, so a round
moves intervals of ranks: its state is bounded by the sequence length, whatever the number
of documents, and it is held on the driver. What grows with the input (tokenising, counting
lengths, ranking pieces inside their class, looking up the place of a rank) is done by Spark.

Defined results: a null text counts as empty and is one piece, the end token alone; repeated
rows and ids are packed row by row; equal lengths are ranked by a hash of the piece; other
columns are ignored; an empty input gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewell.llm.tables import bounded_batches, keyed_texts, lean, settle

END_TOKEN = 2
SEQUENCE_TOKENS = 1024
SALTS = 64  # parts of a class of equal lengths that are ranked apart
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one special token
_SPACE_RUN = re.compile(r"\s\s+\S")
_BEFORE_LAST_SPACE = r"\s+(?!\S)|"  # fixed value: the alternative of the pattern that only runs of white space need
_loaded: dict = {}


def encoders(json_path: str, ranks_path: str, pattern: str):
    """The tokenizer, and two encoders of the same vocabulary that give the same ids faster.

    Texts without a run of white space before a word never need the pattern's look-ahead, and
    without it the text is split by a plain automaton.
    """
    key = (json_path, ranks_path, pattern)
    if key not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        plain = tiktoken.Encoding("plain", pat_str=pattern.replace(_BEFORE_LAST_SPACE, ""), mergeable_ranks=ranks, special_tokens={})
        full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = [None, plain, full]
    return _loaded[key]


def token_ids(text: str, paths: tuple[str, str, str]) -> np.ndarray:
    """The ids that the tokenizer file gives, without added special tokens."""
    loaded = encoders(*paths)
    if SPECIAL in text:  # the tokenizer takes its special token out of a text; the faster encoders don't
        if loaded[0] is None:
            from tokenizers import Tokenizer

            loaded[0] = Tokenizer.from_file(paths[0])
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, "<u4")
    return loaded[2 if _SPACE_RUN.search(text) else 1].encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, paths: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every piece."""
    paths = paths or default_paths()
    bounded_batches(docs.sparkSession)
    rows = keyed_texts(docs)

    def run(batches):
        for batch in batches:
            source, columns, ids_out = [], [[], [], [], []], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(text, paths) if text else np.zeros(0, "<u4"), np.array([END_TOKEN], "<u4"))
                head = len(ids) % tokens or min(len(ids), tokens)
                edges = [0, *range(head, len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    source.append(row)
                    part = ids[a:b]
                    for column, value in zip(columns, (k, a, b - a, zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(counts: dict[int, int], tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts`` pieces of each length, as (length, first rank, rank past the last, first sequence, offset).

    The pieces of such a row go to consecutive sequences, one each, all at the same offset.
    """
    left = {n: c for n, c in counts.items() if c}
    done = dict.fromkeys(left, 0)  # ranks placed so far
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: intervals of sequences
    sizes: list[int] = []  # gaps in order
    places, sequences = [], 0

    def place(length: int, gap: int, first: int, n: int) -> None:
        places.append((length, done[length], done[length] + n, first, tokens - gap))
        done[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        if gap > length:
            if gap - length not in gaps:
                gaps[gap - length] = []
                insort(sizes, gap - length)
            gaps[gap - length].append((first, first + n))

    while left:
        longest = max(left)
        if not sizes or sizes[-1] < longest:  # nothing holds the longest class: open as few sequences as it needs
            n = -(-left[longest] // (tokens // longest))
            place(longest, tokens, sequences, n)
            sequences += n
            continue
        wanted: dict[int, list[int]] = {}  # gap: lengths that want it, longest first
        for length in sorted(left, reverse=True):
            k = bisect_left(sizes, length)
            if k < len(sizes):
                wanted.setdefault(sizes[k], []).append(length)
        for gap, lengths in wanted.items():
            free = gaps.pop(gap)
            sizes.remove(gap)
            for length in lengths:
                while free and length in left:
                    a, b = free.pop()
                    n = min(b - a, left[length])
                    place(length, gap, a, n)
                    if a + n < b:
                        free.append((a + n, b))
            if free:
                if gap not in gaps:
                    gaps[gap] = []
                    insort(sizes, gap)
                gaps[gap] += free
    return places


def pack(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, paths: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; the pieces of a sequence fill it from 0 without gaps."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokens, paths, with_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS))), "pieces")
    parts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most tokens * SALTS rows
    counts: dict[int, int] = {}
    begins = []
    for r in sorted(parts):
        begins.append((r["length"], r["salt"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    places = spark.createDataFrame(best_fit(counts, tokens), "length long, first long, last long, first_sequence long, offset long")
    begins = spark.createDataFrame(begins, "length long, salt long, begins long")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("nth", nth).join(F.broadcast(begins), ["length", "salt"]).withColumn("rank", F.col("begins") + F.col("nth") - 1)
    at = (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return ranked.join(F.broadcast(places), at).select(  # both tables are bounded by the sequence length
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []),
    )
