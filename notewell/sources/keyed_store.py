"""Stored tables with unique keys: merges rewrite only the buckets they touch, and readers see whole versions.

Rows live in a fixed number of buckets by a hash of the key. A merge reads the buckets that its changes
fall into, writes their new rows to a folder of the new version, and then writes a manifest, one
small file that names the folder of every bucket. Readers take the newest manifest, so a merge that is
under way, or that failed, is not seen; files of other buckets are neither read nor written. A manifest also holds the number of the last
batch, so a repeated batch changes nothing. One writer at a time; of two, the second fails on the manifest's folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.session import cut_lineage

BUCKETS = 64
_MANIFEST = "bucket int, stored int, batch long"

Combine = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> KeyedTable:
        """Store ``rows`` (one per key) as version 0."""
        table = cls(rows.sparkSession, root, rows.schema, tuple(keys), buckets)
        table._write(0, rows, [(b, -1) for b in range(buckets)], range(buckets), -1)
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> KeyedTable:
        return cls(spark, root, schema, tuple(keys), buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        try:
            found = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").select("version").distinct()
            return sorted(r["version"] for r in found.collect())  # one number per version
        except AnalysisException:
            return []

    def manifest(self, version: int | None = None) -> tuple[int, list[tuple[int, int]], int]:
        """(version, (bucket, version of its rows or -1) of every bucket, last batch)."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()  # one row per bucket
        return version, sorted((r["bucket"], r["stored"]) for r in rows), max(r["batch"] for r in rows)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)[1])

    def _rows(self, places: Sequence[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.root}/rows/__stored={stored}/__bucket={b}" for b, stored in places if stored >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names)

    def merge(self, changes: DataFrame, combine: Combine, batch: int | None = None) -> int:
        """Bring ``changes`` in with ``combine(old rows, changes)``, which gets the touched buckets only; the version that holds them."""
        version, places, done = self.manifest()
        if batch is not None and batch <= done:
            return version
        changes = cut_lineage(changes.withColumn("__bucket", self.bucket()), "changes")
        touched = sorted(r["__bucket"] for r in changes.select("__bucket").distinct().collect())  # bucket numbers
        old = self._rows([p for p in places if p[0] in set(touched)])
        self._write(version + 1, combine(old, changes.drop("__bucket")), places, touched, done if batch is None else batch)
        return version + 1

    def _write(self, version: int, rows: DataFrame, places: Sequence[tuple[int, int]], touched, batch: int) -> None:
        path = f"{self.root}/rows/__stored={version}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        placed = typed.withColumn("__bucket", self.bucket())
        placed.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)
        whole = T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])
        filled = {r["__bucket"] for r in self.spark.read.schema(whole).parquet(path).select("__bucket").distinct().collect()}  # bucket numbers
        new = [(b, (version if b in filled else -1) if b in set(touched) else stored, batch) for b, stored in places]
        self.spark.createDataFrame(new, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/version={version}")

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that only versions older than the last ``keep`` name; how many there were."""
        versions = self.versions()
        used = {stored for v in versions[-keep:] for _, stored in self.manifest(v)[1]}
        gone = [v for v in range(versions[-1] + 1) if v not in used and v <= versions[-1]]
        old = [f"rows/__stored={v}" for v in gone] + [f"manifest/version={v}" for v in versions[:-keep]]
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        removed = 0
        for name in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            removed += bool(path.getFileSystem(hadoop).delete(path, True))
        return removed


def replacing(keys: Sequence[str], gone: Column | None = None) -> Combine:
    """New rows take the place of old ones; rows for which ``gone`` holds leave the table."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        left = new if gone is None else new.where(~gone)
        return old.join(new.select(*keys), list(keys), "left_anti").unionByName(left.select(*old.columns))

    return combine
