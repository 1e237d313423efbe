"""Reading inputs and writing intermediate tables to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.session import BATCH_BYTES, bounded_batches, in_bytes

HOT = 4096


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; in local mode below the warehouse where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later stages reuse it, and a lost executor loses nothing."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Writers otherwise look at their size after 100 rows, and readers take up to 4096 rows of a row group at once.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def settle_wide(df: DataFrame, name: str) -> DataFrame:
    """As ``settle``, for rows of several MB each: row groups of few rows, which bound what a task writes or reads at a time."""
    path = work_folder(df.sparkSession, name)
    df.write.options(**WIDE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving freed memory back when its task ends.

    Python workers live on from stage to stage, and what their allocators keep of each stage would add up.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def with_hot(rows: DataFrame, values: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``values`` (a row per ``key``), whatever share of ``rows`` a key has.

    ``times`` says how many ``rows`` each key has. Keys with over 1/HOT of them, so fewer than HOT, meet a broadcast table; the others are shuffled.
    """
    limit = (times.agg(F.sum("times")).first()[0] or 0) / HOT
    hot = settle(times.where(F.col("times") > limit).select(key, F.lit(True).alias("hot")), "hot")
    flagged = rows.join(F.broadcast(hot), key, "left")
    often = values.join(F.broadcast(hot), key).drop("hot")
    return flagged.where("hot").drop("hot").join(F.broadcast(often), key).unionByName(flagged.where("hot IS NULL").drop("hot").join(values, key))


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``rows`` joined with ``values`` (settled, a row per ``keys``) in one pass over ``rows``, whatever share of ``rows`` a key has.

    The column ``times`` of ``values`` says how many ``rows`` each key has, or more. Keys with over 1/HOT of them, so fewer than HOT, are
    dealt to parts of that size by a hash of the row, and their values are repeated for each part. Equal rows stay in one part.
    """
    limit = (values.agg(F.sum(times)).first()[0] or 0) // HOT + 1
    parts = F.ceil(F.col(times) / limit)
    often = values.where(F.col(times) > limit).select(*keys, parts.alias("__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("__parts")), F.lit(0)).cast("long")
    dealt = rows.join(F.broadcast(often), keys, "left").withColumn("__part", part).drop("__parts")
    repeated = values.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "__part"]).drop("__part")


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and ``more``, whatever else the input carries under any name."""
    return docs.select("doc_id", "text", *more)


def others(docs: DataFrame) -> list[str]:
    """The columns that an operator only passes on."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def bundled(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``rest``, a struct of all other columns, so that none of their names can clash."""
    rest = [F.col(f"`{c}`") for c in others(docs)] or [F.lit(0).alias("none")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest"))


def unbundled(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, from ``doc_id``, ``text`` and ``rest``."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])
