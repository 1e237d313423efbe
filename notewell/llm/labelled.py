"""Bounded samples of labelled texts, and fitting on them in one task.

The sample is the ``limit`` labelled rows with the smallest hash of the id, so it is the same
on every run. Its size does not grow with the corpus; scoring covers every text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.llm.tables import bounded_batches


def sample(docs: DataFrame, labels: DataFrame, limit: int, kinds: int = 2) -> DataFrame:
    """``text`` and ``label`` of at most ``limit`` rows of ``labels`` (``doc_id``, ``label`` from 0 below ``kinds``), in hash order."""
    order = F.xxhash64(F.col("doc_id"))
    chosen = labels.select("doc_id", "label").where(F.col("doc_id").isNotNull() & (F.col("label") >= 0) & (F.col("label") < kinds)).orderBy(order, "doc_id", "label").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `limit` ids
    return texts.orderBy(order, "doc_id", "text").limit(limit).select("text", F.col("label").cast("int").alias("label"))


def fit(rows: DataFrame, train: Callable[[list[pa.RecordBatch]], bytes]) -> bytes:
    """``train`` over the whole (bounded) sample in one task; gives the model as bytes."""

    bounded_batches(rows.sparkSession)

    def run(batches):
        yield pa.RecordBatch.from_pydict({"model": pa.array([train(list(batches))], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return found["model"] if found else train([])  # no task runs on no rows


def held(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))
