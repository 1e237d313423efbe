"""Sequence similarity: the one place where Python workers are needed.

Python's ``difflib`` ratio is order dependent and has no SQL form, so these run as
Arrow-batched pandas UDFs. Each looks at one row's own data only. The module is
pickled by value, so executors need no copy of this package.
"""

from __future__ import annotations

import re
import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.fixed_values import SENTENCE_MIN_WORDS, SENTENCE_RATIO, SENTENCE_SPLIT

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reaches(a: str, b: str, cutoff: float, strict: bool = False) -> float | None:
    """The ratio when it reaches ``cutoff``; the two cheap upper bounds go first."""
    matcher = SequenceMatcher(None, a, b)
    value = 0.0
    for ratio in (matcher.real_quick_ratio, matcher.quick_ratio, matcher.ratio):
        value = ratio()
        if value < cutoff or (strict and value <= cutoff):
            return None
    return value


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of ``a``."""
    where: dict[str, int] = {}
    for n, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << n)
    full = (1 << len(a)) - 1
    row = full
    for at in map(where.get, b):
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


class SeenSentences:
    """Earlier sentences of one text, with cheap upper bounds of the similarity ratio.

    The ratio is 2*M/(la+lb) where M is at most the number of shared characters, and at
    most the longest common subsequence; only pairs that both bounds leave open are compared.
    """

    def __init__(self, text: str, cutoff: float) -> None:
        self.alphabet = np.unique(self.codes(text))
        self.cutoff = cutoff
        self.exact: set[str] = set()
        self.items: list[str] = []
        self.counts = np.zeros((16, len(self.alphabet)), dtype=np.int32)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def vector(self, sentence: str) -> np.ndarray:
        return np.bincount(np.searchsorted(self.alphabet, self.codes(sentence)), minlength=len(self.alphabet)).astype(np.int32)

    def repeats(self, sentence: str) -> bool:
        if sentence in self.exact:
            return True
        n = len(self.items)
        row = self.vector(sentence)
        if n:
            known = self.counts[:n]
            total = known.sum(axis=1) + len(sentence)
            shared = np.minimum(known, row).sum(axis=1)
            for i in np.nonzero(2.0 * shared / total > self.cutoff)[0]:
                old = self.items[i]
                size = len(old) + len(sentence)
                if 2.0 * common_subsequence(old, sentence) / size <= self.cutoff:
                    continue
                if SequenceMatcher(None, old, sentence).ratio() > self.cutoff:
                    return True
        if n == len(self.counts):
            self.counts = np.vstack([self.counts, np.zeros_like(self.counts)])
        self.counts[n] = row
        self.items.append(sentence)
        self.exact.add(sentence)
        return False


_SPLIT = "(?=[.!?])" + SENTENCE_SPLIT  # what precedes is looked at only where a sentence may end


def drop_repeated_sentences(
    text: str | None,
    min_words: int = SENTENCE_MIN_WORDS,
    cutoff: float = SENTENCE_RATIO,
    split: str = _SPLIT,
) -> tuple[str | None, int]:
    if not text:
        return text, 0
    kept: list[str] = []
    pairs = [(part.strip(), " ".join(part.lower().split())) for part in re.split(split, text)]
    seen = SeenSentences("".join(folded for _, folded in pairs), cutoff)
    removed = 0
    for sentence, folded in pairs:
        if not sentence:
            continue
        if len(folded.split()) < min_words or not seen.repeats(folded):
            kept.append(sentence)
        else:
            removed += 1
    out = ". ".join(kept)
    return (out + "." if out and not out.endswith(".") else out), removed


def dedup_sentences(text: Column) -> Column:
    """struct(text, removed): sentences equal or nearly equal to an earlier one dropped."""
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drop_repeated_sentences(t) for t in texts], columns=["text", "removed"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, result)(text)


def seq_ratio(a: Column, b: Column) -> Column:
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(left, right)], dtype="float64")

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())(a, b)


def closest_of(tag: Column, vocabulary: list[str], cutoff: float) -> Column:
    """The closest vocabulary entry at or above ``cutoff``, else null.

    ``vocabulary`` is a configuration list (its length is checked by the caller).
    Ties go to the larger string, as difflib's close matches order (ratio, word).
    """

    def best(value: str | None) -> str | None:
        if value is None:
            return None
        scored = [(r, w) for w in vocabulary if (r := reaches(w, value, cutoff)) is not None]
        return max(scored)[1] if scored else None

    def run(tags: pd.Series) -> pd.Series:
        return tags.map(best).astype(object)

    run.__annotations__ = {"tags": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(tag)


def closest_of_each(tags: Column, vocabulary: list[str], cutoff: float) -> Column:
    """``closest_of`` for every entry of an array column; positions are kept."""

    def run(batch: pd.Series) -> pd.Series:
        memo: dict[str, str | None] = {}

        def best(value: str) -> str | None:
            if value not in memo:
                scored = [(r, w) for w in vocabulary if (r := reaches(w, value, cutoff)) is not None]
                memo[value] = max(scored)[1] if scored else None
            return memo[value]

        return pd.Series([None if row is None else [best(v) for v in row] for row in batch], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.StringType()))(tags)
