"""Candidate terms for the taxonomy: n-gram occurrences and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_terms(df: DataFrame, text: str, max_words: int = 3, min_count: int = 2) -> DataFrame:
    """(candidate, occurrences, documents, tfidf_score) for runs of 1..max_words words.

    Every occurrence gives one row and every (document, term) one more that counts the
    document, so one aggregation with map-side combine yields both counts; the score is
    the mean tf * idf over the term's documents.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - n + 1, F.lit(1)))
        return F.transform(
            starts, lambda i: F.when(i + n - 1 <= F.size("__w"), F.array_join(F.slice("__w", i, F.lit(n)), " "))
        )

    grams = F.concat(*[runs(n) for n in range(1, max_words + 1)])
    listed = (
        df.select(words.alias("__w"))
        .select(F.size("__w").alias("__len"), F.array_compact(grams).alias("__g"))
        .select(
            F.inline(
                F.concat(
                    F.transform("__g", lambda g: F.struct(g.alias("candidate"), F.lit(1).alias("occ"), F.lit(0).alias("doc"), (1.0 / F.col("__len")).alias("share"))),
                    F.transform(F.array_distinct("__g"), lambda g: F.struct(g.alias("candidate"), F.lit(0).alias("occ"), F.lit(1).alias("doc"), F.lit(0.0).alias("share"))),
                )
            )
        )
    )
    n_docs = df.count()
    out = listed.groupBy("candidate").agg(
        F.sum("occ").alias("occurrences"),
        F.sum("doc").alias("documents"),
        (F.sum("share") / F.sum("doc")).alias("__mean_tf"),
    )
    idf = F.log((F.lit(n_docs) + 1.0) / (F.col("documents") + 1.0)) + 1.0
    return out.where(F.col("occurrences") >= min_count).select(
        "candidate", "occurrences", "documents", (F.col("__mean_tf") * idf).alias("tfidf_score")
    )
