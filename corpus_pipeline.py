"""From raw documents to packed training sequences, one operator a stage.

Each stage takes the whole output of the one before, as a table in the shared folder; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import decontamination, language_id, near_dedup, packing, suffix_dedup
from notewell.llm.tables import settle, table

LEAST_KNOWN = 0.8  # of a text's trigrams, word by word, that learned texts of the word's language hold
REPEATED_BYTES = 200  # passages of over 50 words are longer, whatever their words


def _measured(rows: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    return rows.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else rows


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go.

    A null or empty text has no letter and goes; repeated rows and ids are judged row by row; all
    columns come back under their names. Without a non-null ``lang`` no language is learned and every document goes.
    """
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    return language_id.keep(docs, language_id.fit(docs, labels), LEAST_KNOWN)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, 0.8) the document with the smallest id stays.

    Texts without words are like no other and stay; of rows with one id one stays; rows with a null id stay.
    """
    return near_dedup.keep_one(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEATED_BYTES`` bytes that occur more than once are cut out of all places.

    Null texts become empty; every row stays, with what is left of its text; repeated rows lose all their strings of that length.
    """
    return _measured(suffix_dedup.clean(docs, REPEATED_BYTES))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark (ten words, or a whole shorter item) are cut out; every row stays, null and empty texts as they are."""
    return _measured(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 1024 tokens; a null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_test_items),
    ("packing", sequences),
]

#: The stages are fitted, hashed and tokenised; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
