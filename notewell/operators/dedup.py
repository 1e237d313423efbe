"""Set operations and de-duplication.

A key may hold a large share of all rows (copies of one text), so "keep the first"
is an aggregate with map-side combine over a digest, never a per-key sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.functions import similarity


def union_notes(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_digest(columns: Sequence[str]):
    """Fixed-size key of several columns (null is distinct from the empty string)."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sized = [F.concat_ws(":", F.length(p).cast("string"), p) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def first_ids(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The smallest id of every key; only digests and ids are shuffled."""
    return (
        df.select(key_digest(keys).alias("__key"), F.col(id_col))
        .groupBy("__key")
        .agg(F.min(id_col).alias(id_col))
        .select(id_col)
    )


def dedup_notes(df: DataFrame, text: str = "text", lang: str | None = "lang", id_col: str = "id") -> DataFrame:
    """Keep the row with the smallest id of every (text, language)."""
    keys = [text] + ([lang] if lang and lang in df.columns else [])
    return df.join(first_ids(df, keys, id_col), id_col, "left_semi")


def per_text(df: DataFrame, rules: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``df`` with the columns that ``rules`` adds, worked out once for every different text.

    ``rules`` gets a table of the texts alone and keeps one row for each; what it adds must follow from the
    text. Rows meet their text's result by the text itself, a null text by null. Different texts are dealt
    over all cores, however few bytes they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = rules(df.select(text).distinct().repartition(4 * cores)).withColumnRenamed(text, "__text")
    return df.join(found, F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")


def dedup_sentences(df: DataFrame, text: str) -> DataFrame:
    """Near-equal sentences within each note dropped; adds ``duplicates_removed``."""
    return (
        df.withColumn("__d", similarity.dedup_sentences(F.col(text)))
        .withColumn(text, F.col("__d")["text"])
        .withColumn("duplicates_removed", F.col("__d")["removed"])
        .drop("__d")
    )
