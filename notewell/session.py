"""Session settings that the operators are written for."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.parquet.filterPushdown": "true",
}

BATCH_BYTES = 4 << 20


def build_session(app: str = "notewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; in local mode below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive result feeds several later stages; a written table
    survives the loss of executors, unlike cached blocks.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Rows of a few large files over all cores, before CPU-bound work.

    Does nothing when the scan already has a partition per core, as it has at scale. Meant
    for plain scans: counting the partitions of a scan reads nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_bytes(size: str) -> int:
    """Bytes of a size as Spark's settings state it, such as ``64m``."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1]]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: rows with long texts or sets would otherwise make a Python worker's batch very large."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if in_bytes(spark.conf.get(limit, "64m")) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
